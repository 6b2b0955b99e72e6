"""Scans, rolling and cross-sectional expressions, and the rank IC built of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel, rounded_to, safe_div
from tidemark.operators import metrics
from tidemark.plans.registry import register
from tidemark.plans.sql import DAILY, SHIPS, SLOTS
from tidemark.sources import bars as B

P = Panel()
c = F.col


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Every other column as a double of so many places, without negative zeros."""
    return df.select(*keys, *((rounded_to(c(x), digits) + F.lit(0.0)).alias(x) for x in df.columns if x not in keys))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return B.daily_bars(B.read(spark, d, "events"))


def ships(spark: SparkSession, d: str) -> DataFrame:
    return B.ship_bars(B.read(spark, d, "lineitem"))


@register("scan_daily_bars", f"with {DAILY} select * from bars")
def scan_daily_bars(spark, d):
    return daily(spark, d)


@register("scan_slot_bars", f"with {SLOTS} select code, date, slot, open, high, low, close, volume from slots", dates=("date", "slot"))
def scan_slot_bars(spark, d):
    return B.slot_bars(B.read(spark, d, "events"))


@register("scan_ship_bars", f"with {SHIPS} select * from ships")
def scan_ship_bars(spark, d):
    return ships(spark, d)


@register("scan_last_bars", f"with {DAILY} select * from bars qualify row_number() over (partition by code order by date desc) <= 5")
def scan_last_bars(spark, d):
    return B.last_rows(daily(spark, d), 5)


@register("scan_since", f"with {DAILY} select * from bars where date >= date '2024-01-20'")
def scan_since(spark, d):
    return B.daily_bars(B.read(spark, d, "events").where("ts >= '2024-01-20'"))


@register("scan_of_codes", f"with {DAILY} select * from bars where code in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def scan_of_codes(spark, d):
    codes = B.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("code"))
    return B.of_codes(daily(spark, d), codes)


@register("scan_span", f"with {DAILY} select code, min(date) as first_date, max(date) as last_date, count(*) as n_bars from bars group by 1", dates=("first_date", "last_date"))
def scan_span(spark, d):
    return B.span(daily(spark, d))


@register("scan_span_snapshot", f"with {DAILY}, s as (select code, max(date) as date, count(distinct date) as n_days from bars group by 1) select bars.*, n_days from bars join s using (code, date)")
def scan_span_snapshot(spark, d):
    b = daily(spark, d)
    last = b.groupBy("code").agg(F.max("date").alias("date"), F.count_distinct("date").alias("n_days"))
    return b.join(last, ["code", "date"])


@register("scan_symbols", "select distinct user_id as code, event_type as kind from events", dates=())
def scan_symbols(spark, d):
    return B.read(spark, d, "events").select(c("user_id").alias("code"), c("event_type").alias("kind")).distinct()


_ROLL = "over (partition by code order by date rows between 4 preceding and current row)"


def _full(value: str, n: int = 5, x: str = "close") -> str:
    w = f"over (partition by code order by date rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {w} = {n} then {value} {w} end"


@register(
    "dsl_rolling",
    f"""with {DAILY} select code, date, round({_full('avg(close)')}, 6) as mean5, round({_full('stddev_pop(close)')}, 6) as std5, round({_full('var_pop(close)')}, 5) as var5,
    round({_full('max(close)')}, 6) as max5, round({_full('min(close)')}, 6) as min5, round({_full('sum(close)')}, 6) as sum5 from bars""",
)
def dsl_rolling(spark, d):
    x = c("close")
    df = daily(spark, d).select("code", "date", P.mean(x, 5).alias("mean5"), P.std(x, 5).alias("std5"), P.var(x, 5).alias("var5"), P.ts_max(x, 5).alias("max5"), P.ts_min(x, 5).alias("min5"), P.total(x, 5).alias("sum5"))
    return rounded(df, "code", "date").withColumn("var5", F.round("var5", 5))


@register(
    "dsl_shifts",
    f"""with {DAILY} select code, date, lag(close, 3) over w as ref3, lead(close, 2) over w as lead2, round(close - lag(close, 1) over w, 6) as delta1,
    round(case when abs(lag(close, 2) over w) > 1e-12 then close / lag(close, 2) over w end - 1, 6) as roc2 from bars window w as (partition by code order by date)""",
)
def dsl_shifts(spark, d):
    x = c("close")
    return daily(spark, d).select("code", "date", P.ref(x, 3).alias("ref3"), P.ref(x, -2).alias("lead2"), F.round(P.delta(x, 1), 6).alias("delta1"), F.round(P.roc(x, 2), 6).alias("roc2"))


@register(
    "dsl_ts_rank",
    f"""with {DAILY}, l as (select code, date, close, list(close) {_ROLL} as v, count(close) {_ROLL} as n from bars)
    select code, date, case when n = 5 then (len(list_filter(v, lambda x: x < close)) + len(list_filter(v, lambda x: x = close)) / 2.0) / 5.0 end as ts_rank5 from l""",
)
def dsl_ts_rank(spark, d):
    return daily(spark, d).select("code", "date", P.ts_rank(c("close"), 5).alias("ts_rank5"))


@register(
    "dsl_rsv",
    f"""with {DAILY}, l as (select code, date, close, {_full('min(close)')} as lo, {_full('max(close)')} as hi from bars)
    select code, date, round(case when hi - lo < 1e-12 then 0.5 else (close - lo) / (hi - lo) end, 6) as rsv5 from l""",
)
def dsl_rsv(spark, d):
    return daily(spark, d).select("code", "date", F.round(P.rsv(c("close"), 5), 6).alias("rsv5"))


@register(
    "dsl_corr_cov",
    f"""with {SHIPS}, l as (select code, date, {_full('stddev_pop(close)', 10)} as sx, {_full('stddev_pop(volume)', 10, 'volume')} as sy,
    {_full('corr(close, volume)', 10)} as r, {_full('covar_samp(close / 1000, volume)', 10)} as v from ships)
    select code, date, round(case when not (sx < 1e-12 or sy < 1e-12) then r end, 5) as corr10, round(v, 2) as cov10 from l""",
)
def dsl_corr_cov(spark, d):
    x, y = c("close"), c("volume")
    return ships(spark, d).select("code", "date", F.round(P.corr(x, y, 10), 5).alias("corr10"), F.round(P.cov(x / 1000, y, 10), 2).alias("cov10"))


@register(
    "dsl_cs_rank",
    f"""with {DAILY} select code, date, (rank() over (partition by date order by volume) + (count(*) over (partition by date, volume) - 1) / 2.0) / count(*) over (partition by date) as cs_rank from bars""",
)
def dsl_cs_rank(spark, d):
    return daily(spark, d).select("code", "date", P.cs_rank(c("volume")).alias("cs_rank"))


@register(
    "dsl_cs_zscore",
    f"""with {DAILY} select code, date, round(case when count(close) over d >= 2 then case when stddev_pop(close) over d <= 1e-12 then 0.0 else (close - avg(close) over d) / stddev_pop(close) over d end end, 6) as cs_z
    from bars window d as (partition by date)""",
)
def dsl_cs_zscore(spark, d):
    return daily(spark, d).select("code", "date", F.round(P.cs_zscore(c("close")), 6).alias("cs_z"))


@register(
    "dsl_vwap_division",
    f"with {DAILY} select code, date, round((high + low + close) / 3, 6) as vwap, round(case when abs(high - low) > 1e-12 then (close - low) / (high - low) end, 6) as place from bars",
)
def dsl_vwap_division(spark, d):
    return daily(spark, d).select("code", "date", F.round((c("high") + c("low") + c("close")) / 3, 6).alias("vwap"), F.round(safe_div(c("close") - c("low"), c("high") - c("low")), 6).alias("place"))


IC = f"""with {DAILY}, f as (
  select code, date, case when abs(lag(close, 5) over w) > 1e-12 then close / lag(close, 5) over w end - 1 as x,
         case when abs(close) > 1e-12 then lead(close, 3) over w / close - 1 end as y from bars window w as (partition by code order by date)),
g as (select * from f where x is not null and y is not null),
r as (select date, rank() over (partition by date order by x) + (count(*) over (partition by date, x) - 1) / 2.0 as rx,
             rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2.0 as ry from g),
ic as (select date, count(*) as n, corr(rx, ry) as rank_ic from r group by date having count(*) >= 5 and stddev_pop(rx) > 1e-12 and stddev_pop(ry) > 1e-12)"""


@register("dsl_rank_ic_by_date", IC + " select date, n, round(rank_ic, 6) as rank_ic from ic")
def dsl_rank_ic_by_date(spark, d):
    b = daily(spark, d)
    rows = b.select("code", "date", P.roc(c("close"), 5).alias("x"), safe_div(P.ref(c("close"), -3), c("close")).alias("y")).withColumn("y", c("y") - 1)
    return metrics.rank_ic(rows, "x", "y", least=5).select("date", "n", F.round("rank_ic", 6).alias("rank_ic"))


@register("dsl_rank_ic_summary", IC + " select count(*) as days, case when count(*) >= 3 then round(avg(rank_ic), 4) end as mean_ic, case when count(*) >= 3 then round(stddev_pop(rank_ic), 4) end as ic_std, case when count(*) >= 3 and stddev_pop(rank_ic) > 1e-12 then round(avg(rank_ic) / stddev_pop(rank_ic), 4) end as ic_ir, case when count(*) >= 3 then round(avg(case when rank_ic > 0 then 1.0 else 0.0 end), 4) end as positive, max(n) as max_names from ic", dates=())
def dsl_rank_ic_summary(spark, d):
    b = daily(spark, d)
    rows = b.select("code", "date", P.roc(c("close"), 5).alias("x"), (safe_div(P.ref(c("close"), -3), c("close")) - 1).alias("y"))
    return metrics.ic_summary(metrics.rank_ic(rows, "x", "y", least=5))
