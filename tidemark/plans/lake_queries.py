"""Feature tables written, replaced by partition, read back and brought up to date; calendars."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tidemark.operators import calendars, rescoring, xsec
from tidemark.plans.merge_queries import _CUBE, _FEATS, _LONG, FEATS, feats
from tidemark.plans.panel_queries import c, daily, rounded, ships
from tidemark.plans.registry import register
from tidemark.plans.sql import DAILY, SHIPS
from tidemark.sources import bars as B
from tidemark.sources import lake
from tidemark.sources.versions import Versions


def folder(spark) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp()
    return f"{base.rstrip('/')}/lake-{uuid.uuid4().hex}"


@register("lake_features", f"with {_FEATS} select code, date, ret1, range_pct * case when day(date) >= 20 then 2 else 1 end as range_pct from feats")
def lake_features(spark, d):
    """Two columns of a family read back after the days from the 20th on were written anew; a second family in the table is pruned away."""
    path, f = folder(spark), feats(spark, d).select("code", "date", *FEATS)
    lake.write_features(f.select("code", "date", "volume"), path, "volumes", "1")
    mark = lake.write_features(f, path, "prices", "1")
    lake.write_features(f.where(F.dayofmonth("date") >= 20).withColumn("range_pct", c("range_pct") * 2), path, "prices", "1")
    return lake.read_features(spark, path, "prices", mark, columns=["ret1", "range_pct"])


@register("lake_one_date", f"with {_FEATS} select code, date, range_pct from feats where date = (select min(date) + 5 from feats)")
def lake_one_date(spark, d):
    """One partition of a stored family, the sixth day: the scan reads no other."""
    path, f = folder(spark), feats(spark, d).select("code", "date", *FEATS)
    mark = lake.write_features(f, path, "prices", "1")
    day = f.agg(F.date_add(F.min("date"), 5)).first()[0]
    return lake.read_features(spark, path, "prices", mark, [str(day)], ["range_pct"])


@register("lake_cube", f"with {_FEATS}, {_LONG}, {_CUBE} select date, name, n, round(mu, 6) as mu, round(sigma, 6) as sigma from cube")
def lake_cube(spark, d):
    path = folder(spark)
    lake.write_cube(feats(spark, d), FEATS, path, "all")
    return rounded(lake.read_cube(spark, path, "all").select("date", "name", "n", "mu", "sigma"), "date", "name", "n")


@register("lake_without_cube", f"with {_FEATS}, {_LONG}, {_CUBE} select code, date from feats where date not in (select date from cube where day(date) % 2 = 0)")
def lake_without_cube(spark, d):
    """Rows of the days whose statistics are missing: here those of the odd days were never stored."""
    f = feats(spark, d)
    return lake.without_cube(f, xsec.day_cube(f, FEATS).where(F.dayofmonth("date") % 2 == 0)).select("code", "date")


#: What was stored: each code's bars up to a day of its own.
_STORED = "stored as (select * from bars where day(date) <= 10 + code % 12)"


def stored(b):
    return b.where(F.dayofmonth("date") <= 10 + c("code") % 12)


@register("lake_tail", f"with {DAILY}, {_STORED}, l as (select code, max(date) as last from stored group by 1) select b.code, b.date from bars b left join l using (code) where last is null or b.date > last - 3")
def lake_tail(spark, d):
    b = daily(spark, d)
    return lake.tail(b, stored(b), pad=3).select("code", "date")


@register(
    "lake_keep_longer",
    f"""with {DAILY}, {_STORED}, fresh as (select code, date, open, high, low, close + 1 as close, volume from bars where day(date) >= 8 and (code % 2 = 0 or day(date) <= 9)), x as (select code, min(date) as a, max(date) as z from stored group by 1), y as (select code, min(date) as a, max(date) as z from fresh group by 1),
    s as (select x.code from x join y using (code) where y.a > x.a and y.z <= x.z) select code, date, close from fresh where code not in (select code from s) union all select code, date, close from stored where code in (select code from s)""",
)
def lake_keep_longer(spark, d):
    b = daily(spark, d)
    fresh = b.where((F.dayofmonth("date") >= 8) & ((c("code") % 2 == 0) | (F.dayofmonth("date") <= 9))).withColumn("close", c("close") + 1)
    return lake.keep_longer(stored(b), fresh).select("code", "date", "close")


@register("lake_merge_rows", f"with {DAILY}, {_STORED}, fresh as (select code, date, close + 1 as close from bars where day(date) >= 8) select code, date, close from stored where (code, date) not in (select (code, date) from fresh) union all select * from fresh")
def lake_merge_rows(spark, d):
    b = daily(spark, d)
    fresh = b.where(F.dayofmonth("date") >= 8).select("code", "date", (c("close") + 1).alias("close"))
    return lake.merged_rows(stored(b).select("code", "date", "close"), fresh, "code", "date")


@register("lake_recent", f"with {DAILY} select code, date from bars where date >= (select max(b.date) from bars b where b.code = bars.code) - 7")
def lake_recent(spark, d):
    return lake.recent(daily(spark, d), 7, "code").select("code", "date")


@register("lake_without_dates", f"with {DAILY}, g as (select code, date from bars where high = low) select code, date from bars where (code, date) not in (select (code, date) from g)")
def lake_without_dates(spark, d):
    """Bars without the days on which a code has no range."""
    b = daily(spark, d)
    return lake.without_dates(b, b.where("high = low"), "code").select("code", "date")


@register("lake_series_hash", f"with {DAILY}, r as (select code, strftime(date, '%Y-%m-%d') || '|' || cast(cast(volume as bigint) as varchar) as x from bars) select code, sha1(array_to_string(list_sort(list(x)), chr(10))) as mark from r group by 1", dates=())
def lake_series_hash(spark, d):
    b = daily(spark, d).withColumn("v", c("volume").cast("long"))
    return b.groupBy("code").agg(lake.series_hash("date", "v").alias("mark"))


# Versions of a table: bars by shipping day are merged with bars by the day of the order, partitioned by month.

_ORDERED = """ordered as (select l_suppkey as code, cast(o_orderdate as date) as date, max(l_extendedprice) as high, min(l_extendedprice) as low, sum(l_quantity) as volume from lineitem join orders on l_orderkey = o_orderkey where l_extendedprice is not null and isfinite(l_extendedprice) group by 1, 2),
shipped as (select code, date, high, low, volume from ships)"""
_BARS = "code long, date date, high double, low double, volume double, month string"


def _monthly(bars):
    return bars.select(c("code").cast("long").alias("code"), "date", "high", "low", c("volume").cast("double").alias("volume"), F.date_format("date", "yyyy-MM").alias("month"))


def ordered(spark, d):
    lines = B.read(spark, d, "lineitem").join(B.read(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("date")), "l_orderkey")
    price = B.finite(c("l_extendedprice"))
    # As for bars: lines are narrower than states, and few share a supplier and a day.
    return lines.where(price.isNotNull()).repartition("l_suppkey").groupBy(c("l_suppkey").alias("code"), "date").agg(F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").alias("volume"))


@register(
    "lake_versions_merge",
    f"""with {SHIPS}, {_ORDERED}, merged as (select * from ordered union all select * from shipped where (code, date) not in (select (code, date) from ordered))
    select code, date, high, low, volume from merged where strftime(date, '%Y') <> '1995'""",
)
def lake_versions_merge(spark, d):
    """Two whole tables merged by code and day, the later one first; then a year is dropped."""
    t = Versions(spark, folder(spark), _BARS, ("month",))
    t.replace(_monthly(ships(spark, d)))
    merged = t.merge(_monthly(ordered(spark, d)), "code", "date")
    t.drop(t.live(merged).where("month like '1995-%'").select("month"))
    return t.read().select("code", "date", "high", "low", "volume")


@register("lake_versions_prune", f"with {SHIPS}, {_ORDERED}, k as (select max(strftime(date, '%Y-%m')) as m from ordered) select code, date, high, low, volume from shipped, k where strftime(date, '%Y-%m') > m")
def lake_versions_prune(spark, d):
    """Months later than the last order are kept, after an empty keep set that prunes nothing."""
    t = Versions(spark, folder(spark), _BARS, ("month",))
    t.replace(_monthly(ships(spark, d)))
    last = _monthly(ordered(spark, d)).agg(F.max("month")).first()[0]
    keep = [r[0] for r in t.live().where(c("month") > last).select("month").collect()]
    t.prune("month", [])
    t.prune("month", keep)
    return t.read().select("code", "date", "high", "low", "volume")


# Scores by a stored model: two blocks of features, statistics, coefficients.

_BETAS = [("(intercept)", 0.25), ("ret1", 1.5), ("range_pct", -0.5), ("size", 0.125)]
_SCORED = f"""{_FEATS}, wide as (select code, date, ret1, range_pct, ln(volume) as size from feats), cells as (select date, code, unnest(['ret1', 'range_pct', 'size']) as name, unnest([ret1, range_pct, size]) as x from wide),
stats as (select date, name, avg(x) as mu, case when var_pop(x) > 1e-12 then sqrt(var_pop(x)) end as sigma from cells where x is not null group by 1, 2 having count(x) >= 2), betas as (select unnest(['ret1', 'range_pct', 'size']) as name, unnest([1.5, -0.5, 0.125]) as beta),
old as (select date, code, count(*) as n, 0.25 + sum(coalesce((x - mu) / sigma, 0) * beta) as score from cells join stats using (date, name) join betas using (name) where x is not null group by 1, 2)"""


def blocks(spark, d):
    f = feats(spark, d)
    return rescoring.overlaid(f.select("code", "date", "ret1"), f.select("code", "date", "range_pct", F.log("volume").alias("size")))


@register("xs_model_scores", f"with {_SCORED} select date, code, n, round(score, 6) as score from old")
def xs_model_scores(spark, d):
    rows = blocks(spark, d)
    cube = xsec.day_cube(rows, ["ret1", "range_pct", "size"])
    return rounded(rescoring.scored(rows, cube, spark.createDataFrame(_BETAS, "name string, beta double")), "date", "code", "n")


@register(
    "lake_rescored",
    f"with {_SCORED}, moved as (select date from stats where name = 'size' and mu > (select avg(mu) from stats where name = 'size')) select date, code, n, round(case when date in (select date from moved) then score - 0.125 * coalesce(0.5 / sigma, 0) else score end, 6) as score, date in (select date from moved) as fresh from old left join (select date, sigma from stats where name = 'size') using (date)",
)
def lake_rescored(spark, d):
    """Scores are stored; then the mean size moves up on days of large sizes, and those days are scored again."""
    rows = blocks(spark, d)
    coefficients = spark.createDataFrame(_BETAS, "name string, beta double")
    path, statistics = folder(spark), folder(spark)
    # Statistics are made once: made again, sums in another order would differ in their last digits, and every date would count as changed.
    lake.write_cube(rows, ["ret1", "range_pct", "size"], statistics, "all")
    cube = lake.read_cube(spark, statistics, "all")
    stored = rescoring.scored(rows, cube, coefficients).join(rescoring.marks(cube, coefficients), "date")
    lake.write_partitions(stored, path, "date")
    usual = cube.where("name = 'size'").agg(F.avg("mu")).first()[0]
    moved = cube.withColumn("mu", F.when((c("name") == "size") & (c("mu") > F.lit(usual)), c("mu") + 0.5).otherwise(c("mu")))
    return rounded(rescoring.rescored(rows, moved, coefficients, spark.read.parquet(path)).drop("mark"), "date", "code", "n", "fresh")


# Trading days: weekdays but for given holidays.

_HOLIDAYS = ["1995-05-01", "1996-05-01", "1997-10-01", "2024-01-01"]
_DAYS = f"h as (select unnest([{', '.join(f'date {chr(39)}{x}{chr(39)}' for x in _HOLIDAYS)}]) as date), t as (select cast(unnest(generate_series(date '1992-01-01', date '2025-12-31', interval 1 day)) as date) as date), k as (select date from t where isodow(date) < 6 and date not in (select date from h))"


@register(
    "calendar_neighbours",
    f"""with {_DAYS}, o as (select distinct cast(o_orderdate as date) as date from orders) select o.date, o.date in (select date from k) as trading, (select min(k.date) from k where k.date > o.date) as next, (select max(k.date) from k where k.date < o.date) as previous from o""",
    dates=("date", "next", "previous"),
)
def calendar_neighbours(spark, d):
    days = B.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return calendars.neighbours(days, _HOLIDAYS)


@register("calendar_trading_rows", f"with {_DAYS} select o_orderkey, cast(o_orderdate as date) as date from orders where cast(o_orderdate as date) in (select date from k)")
def calendar_trading_rows(spark, d):
    o = B.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return calendars.trading_rows(o, _HOLIDAYS)
