"""Merges, quality, as-of joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, merge, xsec
from tidemark.plans.panel_queries import c, daily, rounded, ships
from tidemark.plans.registry import register
from tidemark.plans.sql import DAILY, SHIPS, SLOTS
from tidemark.sources import bars as B

#: An old and a new delivery of the same bars: the new one lacks some days, moves some closes, and has incomplete rows.
OLD = "old as (select * replace (case when code % 7 = 3 and day(date) = 5 then null else close end as close) from bars where day(date) <> 9)"
NEW = "new as (select * replace (case when day(date) = 12 then null else close + 1 end as close) from bars where day(date) >= 8)"


def deliveries(spark, d):
    b = daily(spark, d)
    day = F.dayofmonth("date")
    old = b.where(day != 9).withColumn("close", F.when((c("code") % 7 == 3) & (day == 5), None).otherwise(c("close")))
    new = b.where(day >= 8).withColumn("close", F.when(day == 12, None).otherwise(c("close") + 1))
    return old, new


@register(
    "merge_prefer_incoming",
    f"with {DAILY}, {OLD}, {NEW}, u as (select *, 0 as s from old union all by name select *, 1 as s from new where close is not null) select * exclude (s) from u qualify row_number() over (partition by code, date order by s desc) = 1",
)
def merge_prefer_incoming(spark, d):
    return merge.upsert(*deliveries(spark, d))


@register(
    "merge_prefer_existing",
    f"""with {DAILY}, {OLD}, {NEW}, u as (select *, 0 as s from old union all by name select *, 1 as s from new where close is not null)
    select * exclude (s) from u qualify row_number() over (partition by code, date order by case when s = 1 then 1 when close is not null then 2 else 0 end desc) = 1""",
)
def merge_prefer_existing(spark, d):
    return merge.upsert(*deliveries(spark, d), prefer="existing")


def slot_deliveries(spark, d):
    b = B.slot_bars(B.read(spark, d, "events"))
    return b, b.where((c("code") % 3 == 0) & (F.dayofmonth("date") >= 10) & ((c("code") % 6 == 0) | (F.hour("slot") >= 6)))


S_NEW = "fresh as (select * from slots where code % 3 = 0 and day(date) >= 10 and (code % 6 = 0 or hour(slot) >= 6))"


@register("merge_replace_days", f"with {SLOTS}, {S_NEW} select * from slots where (code, date) not in (select (code, date) from fresh) union all select * from fresh", dates=("date", "slot"))
def merge_replace_days(spark, d):
    return merge.replace_days(*slot_deliveries(spark, d)).select("code", "date", "slot", "open", "high", "low", "close", "volume")


@register(
    "merge_without_thinner_days",
    f"""with {SLOTS}, {S_NEW}, lost as (select distinct s.code, s.date from slots s where (s.code, s.date) in (select (code, date) from fresh) and (s.code, s.date, s.slot) not in (select (code, date, slot) from fresh))
    select * from fresh where (code, date) not in (select (code, date) from lost)""",
    dates=("date", "slot"),
)
def merge_without_thinner_days(spark, d):
    return merge.without_thinner_days(*slot_deliveries(spark, d)).select("code", "date", "slot", "open", "high", "low", "close", "volume")


@register(
    "merge_volume_units",
    f"""with {DAILY}, peer as (select code, date, volume * case when code % 2 = 0 then 100 else 3 end as other from bars),
    r as (select code, list_sort(list(other / volume)) as r from bars join peer using (code, date) group by 1 having count(*) >= 5)
    select code, date, volume * case when r[len(r) // 2 + 1] between 80 and 120 then 100.0 else 1.0 end as volume from bars left join r using (code)""",
)
def merge_volume_units(spark, d):
    b = daily(spark, d)
    peer = b.select("code", "date", (c("volume") * F.when(c("code") % 2 == 0, 100).otherwise(3)).alias("volume"))
    return merge.align_volume(b, peer).select("code", "date", "volume")


@register(
    "quality_levels",
    f"""with {DAILY}, l as (select *, lag(close) over (partition by code order by date) as p from bars),
    q as (select code, count(*) as n_bars, count_if(open > 0 and p > 0 and abs(open / p - 1) < 1e-4) as n_flat, count_if(open > 0 and p > 0) as k, max(date) as last from l group by 1)
    select code, n_bars, cast(n_flat as bigint) as n_flat, case when n_bars < 25 or date_diff('day', last, date '2024-01-31') > 3 or (k >= 20 and n_flat > 0.4 * k) then 'thin' else 'good' end as level from q""",
    dates=(),
)
def quality_levels(spark, d):
    return merge.quality(daily(spark, d), "2024-01-31", stale_days=3, thin=25)


@register(
    "diff_series",
    f"""with {DAILY}, {OLD}, {NEW}, b as (select coalesce(o.code, n.code) as code, o.close as old, n.close as new from old o full join new n on o.code = n.code and o.date = n.date)
    select code, cast(count_if(old is not null and new is not null) as bigint) as overlap, cast(count_if(old is null) as bigint) as added, cast(count_if(new is null) as bigint) as removed,
    round(max(abs(new - old)), 6) as max_move, round(max(case when abs(old) > 1e-12 then abs(new - old) / abs(old) end), 6) as max_share from b group by 1""",
    dates=(),
)
def diff_series(spark, d):
    return merge.difference(*deliveries(spark, d)).select("code", "overlap", "added", "removed", F.round("max_move", 6).alias("max_move"), F.round("max_share", 6).alias("max_share"))


@register("agg_coverage_dates", f"with {DAILY}, t as (select case when count(distinct code) <= 3 then count(distinct code) else greatest(2, floor(count(distinct code) * 0.8 + 0.999999)) end as least from bars), g as (select date, count(distinct code) as n from bars group by 1) select date, n from g, t where n >= least or (select max(n) from g) < least")
def agg_coverage_dates(spark, d):
    return merge.coverage(daily(spark, d))


@register("set_common_dates", f"with {DAILY} select date from bars where code % 2 = 0 intersect select date from bars where code % 2 = 1")
def set_common_dates(spark, d):
    b = daily(spark, d)
    return b.where("code % 2 = 0").select("date").intersect(b.where("code % 2 = 1").select("date"))


@register("set_cluster_universe", "select c_custkey as code from customer where c_acctbal > 9000 union select o_custkey from orders where o_totalprice > 450000", dates=())
def set_cluster_universe(spark, d):
    a = B.read(spark, d, "customer").where("c_acctbal > 9000").select(c("c_custkey").alias("code"))
    return a.union(B.read(spark, d, "orders").where("o_totalprice > 450000").select(c("o_custkey").alias("code"))).distinct()


@register("set_universe_hash", f"with {DAILY} select date, cast(sum(code * code % 1000003) as bigint) % 1000000007 as mark, cast(sum(code * 48271 % 2147483647) as bigint) as universe_hash, count(*) as n from (select distinct date, code from bars) group by 1")
def set_universe_hash(spark, d):
    return merge.universe_hash(daily(spark, d))


# As-of joins: orders against the price of the customer's last earlier order, events against bars.

@register("asof_filter", f"with {DAILY} select code, date, close from bars where date <= date '2024-01-15'")
def asof_filter(spark, d):
    return daily(spark, d).where("date <= date '2024-01-15'").select("code", "date", "close")


_TRADES = "t as (select event_id, user_id as code, cast(ts as date) as date from events)"


#: The orders of a customer stand for quotes: an order line meets the last one before its shipping, or the next one after.
_QUOTES = "o as (select o_custkey as code, cast(o_orderdate as date) as quote_date, max(o_totalprice) as price from orders group by 1, 2)"
_SHIPPED = "t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey as code, cast(l_shipdate as date) as date from lineitem join orders on l_orderkey = o_orderkey)"


def quotes(spark, d):
    return B.read(spark, d, "orders").groupBy(c("o_custkey").alias("code"), F.to_date("o_orderdate").alias("quote_date")).agg(F.max("o_totalprice").alias("price"))


def shipped(spark, d):
    orders = B.read(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("code"))
    return B.read(spark, d, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "code", F.to_date("l_shipdate").alias("date"))


@register("asof_backward", f"with {_QUOTES}, {_SHIPPED} select t.*, o.quote_date, o.price from t asof left join o on t.code = o.code and t.date >= o.quote_date", dates=("date", "quote_date"))
def asof_backward(spark, d):
    """Order lines with the customer's last order at or before shipping."""
    return asof.backward(shipped(spark, d), quotes(spark, d), "code", "date", "quote_date")


@register("asof_strict", f"with {DAILY}, {_TRADES} select t.event_id, t.code, t.date, b.date as bar_date, b.close from t asof left join (select code, date, close from bars) b on t.code = b.code and t.date > b.date", dates=("date", "bar_date"))
def asof_strict(spark, d):
    t = B.read(spark, d, "events").select("event_id", c("user_id").alias("code"), F.to_date("ts").alias("date"))
    return asof.backward(t, daily(spark, d).select("code", c("date").alias("bar_date"), "close"), "code", "date", "bar_date", strict=True)


@register("asof_forward", f"with {_QUOTES}, {_SHIPPED} select t.*, o.quote_date, o.price from t asof left join o on t.code = o.code and t.date <= o.quote_date", dates=("date", "quote_date"))
def asof_forward(spark, d):
    """Order lines with the customer's next order at or after shipping."""
    return asof.forward(shipped(spark, d), quotes(spark, d), "code", "date", "quote_date")


@register(
    "asof_point_in_time",
    """with f as (select o_custkey as code, cast(o_orderdate as date) as report_date, cast(o_orderdate as date) + 30 as available, o_totalprice as value, o_orderkey from orders where o_orderstatus = 'F'),
    q as (select l_orderkey as id, l_linenumber as line, l_partkey as part, o_custkey as code, cast(l_shipdate as date) as as_of from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R')
    select q.id, q.line, q.part, q.code, q.as_of, max(f.report_date) as report_date, count(f.value) as n_known from q left join f on f.code = q.code and f.available <= q.as_of group by 1, 2, 3, 4, 5""",
    dates=("as_of", "report_date"),
)
def asof_point_in_time(spark, d):
    """What was known at a date: rows count from the day they became available, and the newest report among them is taken."""
    from pyspark.sql import Window

    o, lines = B.read(spark, d, "orders"), B.read(spark, d, "lineitem")
    n = B.pieces(lines)
    f = o.where("o_orderstatus = 'F'").select(c("o_custkey").alias("code"), F.to_date("o_orderdate").alias("report_date"), F.date_add(F.to_date("o_orderdate"), 30).alias("available")).repartition(n, "code")
    known = Window.partitionBy("code").orderBy("available").rangeBetween(Window.unboundedPreceding, 0)
    f = f.withColumns({"newest": F.max("report_date").over(known), "n_known": F.count("report_date").over(known)}).select("code", "available", c("newest").alias("report_date"), "n_known").distinct()
    # Lines are dealt by order once: that deals what is distinct too.
    returned = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("as_of")).repartition(n, "l_orderkey")
    q = returned.join(o.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), c("l_orderkey") == c("o_orderkey")).select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), c("o_custkey").alias("code"), "as_of")
    q = q.distinct()
    return asof.backward(q, f, "code", "as_of", "available", pieces=n).select("id", "line", "part", "code", "as_of", "report_date", F.coalesce("n_known", F.lit(0)).alias("n_known"))


# Cross-sections of the daily bars; the market segment of a customer stands for the sector.

FEATS = ["ret1", "range_pct", "volume"]
_FEATS = f"""{DAILY}, feats as (select b.code, date, s.c_mktsegment as sector, close, volume, round(case when abs(lag(close) over w) > 1e-12 then close / lag(close) over w end - 1, 9) as ret1,
  round((high - low) / nullif(open, 0), 9) as range_pct from bars b left join customer s on s.c_custkey = b.code window w as (partition by b.code order by date))"""
_LONG = "long as (select date, code, unnest(['ret1', 'range_pct', 'volume']) as name, unnest([ret1, range_pct, volume]) as x from feats)"


def feats(spark, d):
    from tidemark.plans.panel_queries import P

    b = daily(spark, d)
    sector = B.read(spark, d, "customer").select(c("c_custkey").alias("code"), c("c_mktsegment").alias("sector"))
    return b.join(sector, "code", "left").select("code", "date", "sector", "close", "volume", F.round(P.roc(c("close"), 1), 9).alias("ret1"), F.round((c("high") - c("low")) / F.nullif(c("open"), F.lit(0.0)), 9).alias("range_pct"))


_CUBE = "cube as (select date, name, count(x) as n, avg(x) as mu, case when var_pop(x) > 1e-12 then sqrt(var_pop(x)) end as sigma from long where x is not null group by 1, 2 having count(x) >= 2)"


@register("xs_day_cube", f"with {_FEATS}, {_LONG}, {_CUBE} select date, name, n, round(mu, 6) as mu, round(sigma, 6) as sigma from cube")
def xs_day_cube(spark, d):
    return rounded(xsec.day_cube(feats(spark, d), FEATS), "date", "name", "n")


@register("xs_cube_scores", f"with {_FEATS}, {_LONG}, {_CUBE} select date, code, name, round(coalesce((x - mu) / sigma, 0), 5) as z from long join cube using (date, name) where x is not null")
def xs_cube_scores(spark, d):
    f = feats(spark, d)
    return xsec.cube_scores(f, xsec.day_cube(f, FEATS), FEATS).select("date", "code", "name", F.round("z", 5).alias("z"))


@register(
    "xs_panel_zscore",
    f"with {_FEATS} select code, date, round(case when ret1 is not null then case when count(ret1) over d >= 2 and var_pop(ret1) over d > 1e-12 then (ret1 - avg(ret1) over d) / sqrt(var_pop(ret1) over d) else 0 end end, 5) as z from feats window d as (partition by date)",
)
def xs_panel_zscore(spark, d):
    from tidemark.plans.panel_queries import P

    return feats(spark, d).select("code", "date", F.round(P.panel_zscore(c("ret1")), 5).alias("z"))


@register(
    "xs_neutral_scores",
    f"""with {_FEATS}, b as (select *, cast(floor((row_number() over (partition by date order by close nulls first, code) - 1) * 5 / count(*) over (partition by date)) as integer) as bucket from feats),
    n as (select *, volume - avg(volume) over (partition by date, sector) + 50 as by_sector from b)
    select code, date, bucket, round(by_sector, 10) as by_sector, round(by_sector - avg(by_sector) over (partition by date, bucket) + 50, 10) as by_size from n""",
)
def xs_neutral_scores(spark, d):
    f = feats(spark, d).withColumn("bucket", xsec.size_bucket(c("close"), 5)).withColumn("by_sector", xsec.neutralised(c("volume"), "date", "sector"))
    return f.select("code", "date", "bucket", F.round("by_sector", 10).alias("by_sector"), F.round(xsec.neutralised(c("by_sector"), "date", "bucket"), 10).alias("by_size"))


@register("xs_breadth", f"with {_FEATS} select distinct date, sector, round(avg(case when ret1 >= 0.02 then 1.0 when ret1 is not null then 0.0 end) over (partition by date, sector), 6) as breadth from feats")
def xs_breadth(spark, d):
    return feats(spark, d).select("date", "sector", F.round(xsec.breadth(c("ret1"), 0.02, "date", "sector"), 6).alias("breadth")).distinct()


@register(
    "xs_less_peers",
    f"""with {_FEATS}, f as (select * from feats where ret1 is not null and sector is not null), s as (select date, sector, median(ret1) as m, count(ret1) as n from f group by 1, 2), a as (select date, median(ret1) as m from f group by 1)
    select f.code, f.date, f.ret1, round(case when s.n >= 3 then s.m else a.m end, 6) as peer, round(ret1 - case when s.n >= 3 then s.m else a.m end, 6) as less_peer from f join s using (date, sector) join a using (date)""",
)
def xs_less_peers(spark, d):
    f = xsec.less_peers(feats(spark, d).where("ret1 is not null and sector is not null"), "ret1", "sector")
    return f.select("code", "date", "ret1", F.round("peer", 6).alias("peer"), F.round("less_peer", 6).alias("less_peer"))


@register(
    "xs_pair_correlations",
    f"""with {_FEATS}, p as (select 'ret1' as a, 'range_pct' as b, ret1 as u, range_pct as v from feats union all select 'ret1', 'volume', ret1, volume from feats union all select 'range_pct', 'volume', range_pct, volume from feats),
    g as (select a, b, count(*) as n, corr(u, v) as r, least(stddev_pop(u), stddev_pop(v)) as s from p where u is not null and v is not null group by 1, 2)
    select a, b, n, round(case when n >= 30 and s > 1e-12 then r end, 5) as r, case when n < 30 then 'sparse' when s <= 1e-12 then 'constant' else 'ok' end as reason from g""",
    dates=(),
)
def xs_pair_correlations(spark, d):
    return xsec.pair_correlations(feats(spark, d), FEATS, least=30).withColumn("r", F.round("r", 5))


@register("xs_day_rank", f"with {_FEATS} select code, date, row_number() over (partition by date order by ret1 desc nulls last, code) as place from feats")
def xs_day_rank(spark, d):
    return feats(spark, d).select("code", "date", xsec.day_rank("ret1").cast("long").alias("place"))


@register("filter_amount_floor", f"with {SHIPS}, a as (select code, avg(close * volume) as amount, count(*) as n from (select * from ships qualify row_number() over (partition by code order by date desc) <= 20) group by 1), r as (select *, row_number() over (order by amount, code) - 1 as i, count(*) over () as k from a) select code, round(amount, 4) as amount, amount >= (select amount from r where i = floor(k * 20 / 100)) as kept from r", dates=())
def filter_amount_floor(spark, d):
    """Entities whose 20-bar mean amount reaches the 20th percentile (the value at index int(n * 0.2))."""
    a = B.last_rows(ships(spark, d), 20).groupBy("code").agg(F.avg(c("close") * c("volume")).alias("amount"))
    return merge.above_floor(a, "amount", 0.2).select("code", F.round("amount", 4).alias("amount"), "kept")


@register(
    "filter_screen",
    """select p_partkey, p_name, p_retailprice, p_size from part where p_type like '%ROM%' and p_retailprice <= 980 and p_size between 5 and 40 order by p_retailprice desc nulls last, p_partkey limit 20""",
    dates=(),
)
def filter_screen(spark, d):
    p = B.read(spark, d, "part").where(c("p_type").contains("ROM") & (c("p_retailprice") <= 980) & c("p_size").between(5, 40))
    return p.orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_name", "p_retailprice", "p_size")
