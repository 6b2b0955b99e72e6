"""Curves against each other, series against their stored form, tables against what they should hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import agreement, matching
from tidemark.plans.lake_queries import _ORDERED, ordered
from tidemark.plans.panel_queries import c, daily, rounded, ships
from tidemark.plans.registry import register
from tidemark.plans.sql import DAILY, SHIPS
from tidemark.sources import bars as B

#: Each supplier's close and the mean close of all suppliers by day.
_CURVES = f"""{SHIPS}, cv as (select code, date, close as a, avg(close) over (partition by date) as b from ships where close > 0), rr as (select code, date, a / lag(a) over s - 1 as x, b / lag(b) over s - 1 as y, count(*) over (partition by code) as c from cv window s as (partition by code order by date)),
r as (select *, row_number() over (partition by code order by date) as i, count(*) over (partition by code) as n from rr where x is not null and c >= 10),
w as (select code, date, i, n, lag(date, 29) over s as start, corr(x, y) over f as corr, stddev_samp(x - y) over f as dev from r window s as (partition by code order by date), f as (partition by code order by date rows between 29 preceding and current row)),
ag as (select code, start as window_start, date as window_end, 30 as n_days, round(corr, 4) + 0.0 as corr, round(dev * sqrt(252.0) * 100, 4) as te from w where i >= 30 and (i - 30) % 5 = 0)"""


def windows(spark, d):
    from pyspark.sql import Window

    curves = ships(spark, d).where("close > 0").select("code", "date", c("close").alias("a"), F.avg("close").over(Window.partitionBy("date")).alias("b"))
    return agreement.rolling_agreement(curves)


@register("curve_agreement", f"with {_CURVES} select code, window_start, window_end, n_days, corr, te as tracking_error_pct from ag", dates=("window_start", "window_end"))
def curve_agreement(spark, d):
    return windows(spark, d).where("n_days = 30").withColumn("corr", c("corr") + 0.0)


@register(
    "curve_agreement_trend",
    f"""with {_CURVES}, k as (select *, count(corr) over (partition by code order by window_end) as i, count(corr) over (partition by code) as m from ag), g as (select code, count(*) as n_windows, arg_max(corr, window_end) filter (where corr is not null) as corr_latest, avg(corr) as cm, arg_max(te, window_end) as te_latest, avg(te) as tm,
      max(m) as m, avg(corr) filter (where i > m // 2) - avg(corr) filter (where i <= m // 2) as up from k group by 1)
    select code, n_windows, round(corr_latest, 4) as corr_latest, round(cm, 4) + 0.0 as corr_mean, round(te_latest, 4) as te_latest, round(tm, 2) as te_mean, case when m < 3 then 'insufficient' when abs(up) < 1e-6 then 'stable' when up > 0 then 'improving' else 'declining' end as trend from g""",
    dates=(),
)
def curve_agreement_trend(spark, d):
    s = agreement.agreement_summary(windows(spark, d).where("n_days = 30"))
    return s.select("code", "n_windows", "corr_latest", (F.round("corr_mean", 4) + 0.0).alias("corr_mean"), "te_latest", F.round("te_mean", 2).alias("te_mean"), "trend")


@register(
    "curve_alerts",
    f"""with {_CURVES}, v as (select code, window_end as date, te as v, row_number() over (partition by code order by window_end desc) - 1 as k, coalesce(-te < lag(-te) over (partition by code order by window_end) - 1e-12, false) as fell from ag where te is not null),
    g as (select code, count(*) as n, avg(-v) filter (where k < 5) as r, avg(-v) filter (where k >= 5 and k < 10) as p, min(k) filter (where not fell) as falls from v group by 1), e as (select *, n >= 9 and p is not null as en, case when abs(p) < 1e-12 then 0 else (p - r) / abs(p) end as rate from g)
    select code, case when not en then 'insufficient' when falls >= 3 and rate > 0.1 then 'degrading' when rate < -0.1 then 'improving' when abs(rate) <= 0.1 then 'stable' else 'marginal' end as alert, round(case when en then r end, 4) as recent_mean, round(case when en then p end, 4) as prior_mean, round(case when en then rate end, 4) + 0.0 as decline_rate, cast(case when en then falls else 0 end as integer) as falls from e""",
    dates=(),
)
def curve_alerts(spark, d):
    """Of the tracking error: lower is better."""
    te = windows(spark, d).where("n_days = 30").select("code", c("window_end").alias("date"), c("tracking_error_pct").alias("value"))
    return rounded(agreement.alerts(te, higher_is_better=False), "code", "alert", "falls", digits=4).withColumn("falls", c("falls").cast("int"))


@register(
    "lake_suffix_start",
    f"""with {SHIPS}, b as (select *, row_number() over (partition by code order by date desc) as k, count(*) over (partition by code) as n from ships)
    select code, max(n) as n, count(*) filter (where k <= 30 + code % 50) as n_stored, case when code % 3 > 0 or max(n) <= 40 + code % 50 then greatest(max(n) - 30 - code % 50, 0) end as start from b group by 1""",
    dates=(),
)
def lake_suffix_start(spark, d):
    """Stored are the last 30 to 79 bars of each code; those of every third one differ in a volume far back, where they reach."""
    from pyspark.sql import Window

    b = ships(spark, d)
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    whole = F.count("*").over(Window.partitionBy("code"))
    stored = b.withColumns({"k": place, "n": whole}).where(c("k") <= 30 + c("code") % 50)
    changed = (c("code") % 3 == 0) & (c("k") == 30) & (c("n") > 40 + c("code") % 50)
    return agreement.suffix_starts(b, stored.withColumn("volume", F.when(changed, c("volume") + 1).otherwise(c("volume"))))


@register("filter_other_series", f"with {SHIPS}, {_ORDERED}, l as (select code, max(date) as date, arg_max(close, date) as close from ships where close > 0 group by 1), x as (select l.code from l join ordered o on o.code = l.code and o.date = l.date and o.high > 0 and abs(l.close - o.high) / greatest(abs(l.close), abs(o.high), 1e-9) > 0.02) select code, date, close from ships where code not in (select code from x)")
def filter_other_series(spark, d):
    """Shipping bars without the suppliers whose last close is far from that day's highest ordered price."""
    stored = ordered(spark, d).select("code", "date", c("high").alias("close"))
    return agreement.without_mismatched(ships(spark, d), stored).select("code", "date", "close")


_PRESENT = f"""{DAILY}, pr as (select distinct user_id as code, cast(ts as date) as date, case when hour(ts) < 12 then 'morning' else 'afternoon' end as kind from events union select code, date, 'daily' from bars), u as (select distinct c_custkey as code from customer where c_custkey in (select code from bars)),
gr as (select date, unnest(['daily', 'morning', 'afternoon', 'evening']) as kind from (select distinct date from bars)), cnt as (select date, kind, count(*) as n from pr where code in (select code from u) group by 1, 2), need as (select count(*) as s, greatest(2, cast(ceil(count(*) * 0.5) as integer)) as need from u),
cov as (select gr.date, gr.kind, coalesce(n, 0) as n, need, coalesce(n, 0) / s as fraction, coalesce(n, 0) >= need as ok from gr left join cnt using (date, kind), need)"""


def covered(spark, d):
    e = B.read(spark, d, "events")
    b = daily(spark, d)
    halves = e.select(c("user_id").alias("code"), F.to_date("ts").alias("date"), F.when(F.hour("ts") < 12, "morning").otherwise("afternoon").alias("kind"))
    present = halves.unionByName(b.select("code", "date", F.lit("daily").alias("kind")))
    universe = B.read(spark, d, "customer").select(c("c_custkey").alias("code")).join(b.select("code").distinct(), "code", "left_semi")
    return agreement.coverage(present, universe, b.select("date"), ["daily", "morning", "afternoon", "evening"])


@register("agg_coverage_kinds", f"with {_PRESENT} select date, kind, n, need, round(fraction, 6) as fraction, ok from cov")
def agg_coverage_kinds(spark, d):
    return covered(spark, d).withColumn("fraction", F.round("fraction", 6))


@register("agg_coverage_gaps", f"with {_PRESENT} select kind, count(*) as n_days, cast(min(date) as varchar) as date_from, cast(max(date) as varchar) as date_to, array_to_string(list_sort(list(cast(date as varchar)))[:8], ',') as sample from cov where not ok group by 1", dates=())
def agg_coverage_gaps(spark, d):
    g = agreement.gaps(covered(spark, d))
    return g.select("kind", "n_days", c("date_from").cast("string").alias("date_from"), c("date_to").cast("string").alias("date_to"), F.array_join(c("sample").cast("array<string>"), ",").alias("sample"))


@register("log_effectiveness", dates=())
def log_effectiveness(spark, d):
    """Errors of users as entries, their purchases and signups within an hour as labels, each used once."""
    e = B.read(spark, d, "events").select(c("user_id").alias("code"), "ts", c("event_id").alias("id"), "event_type")
    outcome = F.when(c("event_type") == "purchase", "true_positive").when(c("event_type") == "signup", "false_positive")
    labels = e.withColumn("outcome", outcome).where("outcome is not null").drop("event_type")
    out = matching.labelled(e.where("event_type = 'error'"), labels, ["code"], tolerance=3600)
    return matching.effectiveness(out.withColumn("hour", F.hour("ts")), "hour")
