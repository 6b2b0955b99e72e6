"""Pieces of DuckDB SQL that the queries' twins share."""

DAILY = """bars as (
  select user_id as code, cast(ts as date) as date, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low,
         arg_max(value, (ts, event_id)) as close, cast(count(*) as double) as volume
  from events where value is not null and isfinite(value) group by 1, 2)"""

SLOTS = """slots as (
  select user_id as code, cast(ts as date) as date, time_bucket(interval '5 minutes', ts) as slot, arg_min(value, (ts, event_id)) as open,
         max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, cast(count(*) as double) as volume
  from events where value is not null and isfinite(value) group by 1, 2, 3)"""

SHIPS = """ships as (
  select l_suppkey as code, cast(l_shipdate as date) as date, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as open,
         max(l_extendedprice) as high, min(l_extendedprice) as low, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as close,
         sum(l_quantity) as volume
  from lineitem where l_extendedprice is not null and isfinite(l_extendedprice) group by 1, 2)"""
