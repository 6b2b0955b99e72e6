"""Signals, stops, precision of calls, tiers, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import signals
from tidemark.plans.measure_queries import _TRADES, trades
from tidemark.plans import series_queries  # noqa: F401, its twins are used
from tidemark.plans.panel_queries import c, rounded, ships
from tidemark.plans.registry import ORACLES, register
from tidemark.plans.research_queries import _XY, xy
from tidemark.plans.sql import DAILY, SHIPS


def _inner(name: str) -> str:
    """The twin of a query over the daily bars, over the longer series of shipments instead."""
    return ORACLES[name].replace(DAILY, SHIPS.replace("ships as (", "bars as (", 1))


@register(
    "win_combined_signal",
    f"""with mc as ({_inner('win_macd')}), kd as ({_inner('win_kdj')}), rs as ({_inner('win_rsi')}), {SHIPS}, va as (select code, cast(date as varchar) as date, volume, avg(volume) over w as u, row_number() over (partition by code order by date) as n from ships window w as (partition by code order by date rows between 19 preceding and current row)),
    m as (select code, date, case when dif > dea and bar > lag(bar) over w then 2 when dif > dea then 1 when dif < dea and bar < lag(bar) over w then -2 when dif < dea then -1 else 0 end as m from mc window w as (partition by code order by date)),
    k0 as (select *, lag(k) over w as pk, lag(d) over w as pd from kd window w as (partition by code order by date)), k1 as (select *, case when k > d and pk <= pd then case when k < 30 then 2 else 1 end when k < d and pk >= pd then case when k > 70 then -2 else -1 end else 0 end as x from k0),
    k as (select code, date, case when j < 0 then greatest(x, 1) when j > 100 then least(x, -1) else x end as k from k1), r as (select code, date, case when rsi < 30 then 2 when rsi < 40 then 1 when rsi > 70 then -2 when rsi > 60 then -1 else 0 end as r from rs),
    a as (select va.code, va.date, va.n, case when va.n >= 35 then coalesce(m, 0) else 0 end as macd, coalesce(k, 0) as kdj, coalesce(r, 0) as rsi, case when va.n < 20 or u = 0 then 0 when volume / u >= 4 then 3 when volume / u >= 2 then 2 when volume / u >= 1.5 then 1 when volume / u < 0.3 then -2 when volume / u < 0.5 then -1 else 0 end as volume
      from va left join m using (code, date) left join k using (code, date) left join r using (code, date)), b as (select *, round(macd * 0.35 + kdj * 0.25 + rsi * 0.25 + volume * 0.15, 4) + 0.0 as composite from a where n >= 30)
    select code, date, macd, kdj, rsi, volume, composite, case when composite >= 1 then 'strong_buy' when composite >= 0.3 then 'buy' when composite <= -1 then 'strong_sell' when composite <= -0.3 then 'sell' else 'neutral' end as signal, round_even(greatest(0, least(100, 50 + composite * 25)), 1) as score from b""",
)
def win_combined_signal(spark, d):
    return signals.combined(ships(spark, d))


@register(
    "win_stops",
    f"""with {SHIPS}, t as (select code, date, close, case when lag(close) over s is not null then greatest(high - low, abs(high - lag(close) over s), abs(low - lag(close) over s)) end as tr from ships window s as (partition by code order by date))
    select code, date, round(round(close - 2 * avg(tr) over (s rows between 13 preceding and current row), 4) + 1e-6, 2) as range_stop, round(round(0.9 * max(close) over s, 4) + 1e-6, 2) as trailing_stop from t window s as (partition by code order by date)""",
)
def win_stops(spark, d):
    s = signals.stops(ships(spark, d))
    return s.select("code", "date", *(F.round(c(x) + 1e-6, 2).alias(x) for x in ("range_stop", "trailing_stop")))


@register("win_rate", f"with {_TRADES} select code, date, round(case when row_number() over s >= 5 then avg(case when r > 0 then 1.0 else 0 end) over (s rows between 19 preceding and current row) else 0.5 end, 6) as win_rate from tr window s as (partition by code order by date)")
def win_rate(spark, d):
    return rounded(signals.rolling_win_rate(trades(spark, d)), "code", "date")


@register(
    "win_yearly_volatility",
    f"""with {SHIPS}, r as (select code, date, close / lag(close) over s - 1 as r from ships where close > 0 window s as (partition by code order by date)) select code, date, round(case when count(r) over w >= 10 then stddev_samp(r) over w * sqrt(252.0) end, 5) as vol from r window w as (partition by code order by date rows between 19 preceding and current row)""",
)
def win_yearly_volatility(spark, d):
    return rounded(signals.yearly_volatility(ships(spark, d)), "code", "date", digits=5)


_LIFT = "select code, count(*) as n_labeled, cast(count_if(call) as bigint) as n_up, round(avg(u), 6) as base_rate, round(sum(case when call then u end) / count_if(call), 6) as precision, round(sum(case when call then u end) / count_if(call) - avg(u), 6) as lift from l group by 1 having count_if(call) >= 3"


@register("metric_lift", f"with {_XY}, l as (select code, case when y > 1e-12 then 1.0 else 0 end as u, coalesce(score > 0.5, false) as call from xy where y is not null) {_LIFT}", dates=())
def metric_lift(spark, d):
    return rounded(signals.precision_lift(xy(spark, d), "score", "y", least=3, eps=0.5), "code", "n_labeled", "n_up")


@register("metric_lift_in_section", f"with {_XY}, l as (select code, case when y > 1e-12 then 1.0 else 0 end as u, coalesce(score > median(score) over (partition by date) and count(score) over (partition by date) >= 2, false) as call from xy where y is not null) {_LIFT}", dates=())
def metric_lift_in_section(spark, d):
    return rounded(signals.precision_lift(xy(spark, d), "score", "y", mode="cs", least=3), "code", "n_labeled", "n_up")


@register("rank_tiers", f"with {SHIPS}, v as (select code, sum(volume) as x from ships where volume > 0 group by 1), p as (select *, row_number() over (order by x desc, code) as k from v) select code, x as score, case when k <= 3 then 'A' when k <= 8 then 'B' else 'C' end as tier from p", dates=())
def rank_tiers(spark, d):
    v = ships(spark, d).where("volume > 0").groupBy("code").agg(F.sum("volume").alias("score"))
    return signals.tiers(v, "score", 3, 5)


@register(
    "metric_prediction",
    f"""with {_XY}, l as (select date, score - 0.5 as p, y as a from xy where score is not null and y is not null), g as (select date, count(*) as n, corr(p, a) as ic, sqrt(avg((p - a) * (p - a))) as rmse, sum((p - a) * (p - a)) as e, var_pop(a) * count(*) as t, avg(case when abs(p) >= 0.05 then case when sign(p) = sign(a) then 1.0 else 0 end end) as h, count_if(abs(p) >= 0.05) as s from l group by 1)
    select date, n, round(case when n >= 4 then ic end, 6) as ic, round(case when n >= 4 then rmse end, 6) as rmse, round(case when n >= 4 and t > 1e-12 then greatest(0, least(1, 1 - e / t)) end, 6) as r2, round(case when n >= 4 then h end, 6) as sign_hit, cast(case when n >= 4 then s end as double) as n_signed from g""",
)
def metric_prediction(spark, d):
    return rounded(signals.prediction_metrics(xy(spark, d).withColumn("p", c("score") - 0.5), "p", "y", "date"), "date", "n")


@register(
    "label_split",
    f"""with {SHIPS}, n as (select code, date, row_number() over (partition by code order by date) as k, count(*) over (partition by code) as n from ships), e as (select *, greatest(15, floor(n * 0.6)) as a from n where n >= 30), z as (select *, least(greatest(a + 5, floor(n * 0.8)), n - 5) as b from e)
    select code, date, case when k <= a then 'train' when k <= b then 'valid' else 'test' end as part from z""",
)
def label_split(spark, d):
    return signals.split_rows(ships(spark, d)).select("code", "date", "part")
