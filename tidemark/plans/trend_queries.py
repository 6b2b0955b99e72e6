"""Scores of trends, volumes and reversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scalars, trends
from tidemark.plans.panel_queries import rounded, ships
from tidemark.plans.registry import register
from tidemark.plans.sql import SHIPS, SLOTS
from tidemark.sources import bars as B


def _case(x: str, steps: list[trends.Step], otherwise: float = 50) -> str:
    return "case " + " ".join(f"when {x} {sign} {limit} then {value}" for sign, limit, value in steps) + f" else {otherwise} end"


_S = "window s as (partition by code order by date)"
_NUMBERED = f"{SHIPS}, a as (select *, row_number() over s as n, lag(close) over s as p from ships {_S})"


def _frame(n: int) -> str:
    return f"(s rows between {n - 1} preceding and current row)"


def _ma(k: int) -> str:
    return f"case when n >= {k} then avg(close) over {_frame(k)} end as m{k}"


@register(
    "factor_ma_slope",
    f"""with {_NUMBERED}, b as (select code, date, n, {', '.join(map(_ma, (5, 10, 20, 60)))} from a {_S}),
    d as (select code, date, n, {', '.join(f'(m{k} / lag(m{k}, 5) over s - 1) * 100 as s{k}' for k in (5, 10, 20, 60))} from b {_S}), e as (select *, s5 - s20 as dv, s20 - lag(s20, 5) over s as ac from d {_S}),
    f as (select *, {_case('(s5 + s10) / 2', trends.SHORT_SLOPE)} as h, {_case('coalesce((s20 + s60) / 2, s20)', trends.MIDDLE_SLOPE)} as m from e)
    select code, date, round(s5, 6) as slope_5, round(s10, 6) as slope_10, round(s20, 6) as slope_20, round(s60, 6) as slope_60, round(dv, 6) as divergence, round(ac, 6) as acceleration,
    case when n >= 10 then round(cast(greatest(0, least(100, 0.3 * h + 0.3 * m + 0.2 * {_case('dv', trends.DIVERGENCE)} + 0.2 * {_case('ac', trends.ACCELERATION)} + case when h > 60 and m > 60 then 3 when h < 40 and m < 40 then -2 else 0 end)) + 1e-9 as double), 1) end as score from f""",
)
def factor_ma_slope(spark, d):
    return rounded(trends.slope_scores(ships(spark, d)), "code", "date")


@register(
    "factor_volume_price",
    f"""with {_NUMBERED}, b as (select *, case when p > 0 then (close / p - 1) * 100 end as m, sum(case when close > p then volume when close < p then -volume else 0 end) over s as obv, avg(case when volume > 0 then volume end) over {_frame(3)} / avg(case when volume > 0 then volume end) over {_frame(10)} as r,
      list_filter(list(volume) over {_frame(60)}, lambda v: v > 0) as vs, close - lag(close, 4) over s as up, sum(volume) over {_frame(3)} / 3 - sum(volume) over (s rows between 4 preceding and 2 preceding) / 3 as more from a {_S}),
    g as (select *, case when n >= 2 then r end as vr, case when n >= 10 and len(vs) >= 5 then len(list_filter(vs, lambda v: v < vs[-1])) / cast(len(vs) as double) * 100 end as vp, avg(obv) over {_frame(3)} as o3, avg(obv) over {_frame(10)} as o10 from b {_S})
    select code, date, round(vr, 6) as volume_ratio, round(vp, 6) as volume_place, case when n >= 5 then round(cast(0.2 * {_case('vr', trends.VOLUME_RATIO)} + 0.25 * case when m > 2 and vr > 1.5 then 85 when m > 0 and vr > 1.2 then 70 when m > 0 and vr < 0.8 then 42 when m < -2 and vr > 1.5 then 20 when m < 0 and vr < 0.7 then 55 when m < 0 and vr > 1 then 35 else 50 end
      + 0.2 * case when n >= 10 and o3 > o10 * 1.02 then 65 when n >= 10 and o3 < o10 * 0.98 then 35 else 50 end + 0.15 * {_case('vp', trends.VOLUME_PLACE)} + 0.2 * case when m is null then 50 when up < 0 and more > 0 then 30 when up > 0 and more < 0 then 35 when up < 0 and more < 0 then 62 when up > 0 and more > 0 then 68 else 50 end + 1e-9 as double), 1) end as score from g""",
)
def factor_volume_price(spark, d):
    return rounded(trends.volume_price_scores(ships(spark, d)), "code", "date")


@register(
    "factor_money_flow",
    f"""with {_NUMBERED}, t as (select *, (high + low + close) / 3 as tp from a), u as (select *, lag(tp) over s as q from t {_S}),
    f as (select *, coalesce(sum(case when tp > q then tp * volume end) over {_frame(14)}, 0) as u, coalesce(sum(case when tp < q then tp * volume end) over {_frame(14)}, 0) as w from u {_S}), g as (select *, case when n > 14 and u + w > 0 then case when w <= 0 then 100 else 100 * u / (u + w) end end as x from f)
    select code, date, round(x, 6) as mfi, round(case when x between 45 and 65 then 62 + (x - 45) * 0.4 when x >= 30 and x < 45 then 48 + (x - 30) * 0.5 when x > 65 and x <= 80 then 58 - (x - 65) * 0.4 when x < 30 then 38 when x is not null then 40 end, 1) as score from g""",
)
def factor_money_flow(spark, d):
    return rounded(trends.money_flow_scores(ships(spark, d)), "code", "date")


#: The mean close of a date's bars stands for the index.
_LEVEL = "i as (select date, avg(close) as level from ships group by 1)"


@register(
    "factor_against_index",
    f"""with {_NUMBERED}, {_LEVEL}, j as (select a.code, a.date, n, close, level, close / lag(close) over s - 1 as y, level / lag(level) over s - 1 as x from a join i using (date) {_S}),
    k as (select *, list(y) over {_frame(20)} as ys, list(x) over {_frame(20)} as xs, first(close) over (s rows between 20 preceding and current row) as s0, first(level) over (s rows between 20 preceding and current row) as i0 from j {_S}),
    l as (select *, list_filter(ys, lambda v: v is not null) as yy, list_filter(xs, lambda v: v is not null) as xx from k), o as (select *, list_avg(yy) as my, list_avg(xx) as mx, list_sum(list_transform(xx, lambda v: (v - list_avg(xx)) * (v - list_avg(xx)))) as vx, list_sum(list_transform(list_zip(xx, yy), lambda z: (z[1] - list_avg(xx)) * (z[2] - list_avg(yy)))) as vxy from l),
    q as (select *, case when n >= 6 then round((close / s0 - level / i0) * 100, 2) + 0.0 end as e, case when len(yy) >= 5 then case when vx < 1e-16 then my else list_avg(yy[-5:]) - (my + vxy / vx * (list_avg(xx[-5:]) - mx)) end * 100 end as r from o)
    select code, date, e as excess_pct, cast(case when e >= 3 then 85 when e >= 1 then 72 when e >= -1 then 58 when e >= -3 then 42 when e is not null then 28 end as double) as strength, round(r, 6) as residual_pct,
    cast(case when r between 0.3 and 2.5 then 68 when r between 0 and 5 then 58 when r >= -1 and r < 0 then 48 when r > 5 then 42 when r is not null then 38 end as double) as idiosyncratic from q""",
)
def factor_against_index(spark, d):
    b = ships(spark, d)
    return rounded(trends.against_index(b, b.groupBy("date").agg(F.avg("close").alias("close"))), "code", "date")


@register(
    "factor_weekly",
    f"""with {_NUMBERED}, w as (select *, (n - 1) // 5 as k from a), g as (select code, k, arg_max(close, n) as wc, sum(volume) as wv from w group by 1, 2),
    h as (select code, k, list(wc) over (s rows between 9 preceding and 1 preceding) as cs, list(wv) over (s rows between 7 preceding and 1 preceding) as vs from g window s as (partition by code order by k)),
    r as (select w.code, w.date, w.n, w.k, w.close, coalesce(h.cs, []) as cs, coalesce(h.vs, []) as vs, sum(w.volume) over (partition by w.code, w.k order by w.n) as tv from w join h on w.code = h.code and w.k = h.k),
    x as (select *, case when k >= 4 then (list_sum(cs[-4:]) + close) / 5 end as m5, case when k >= 9 then (list_sum(cs[-9:]) + close) / 10 end as m10, case when k >= 4 then (close / cs[-4] - 1) * 100 end as g4, case when k >= 8 then (close / cs[-8] - 1) * 100 end as g8,
      case when k >= 7 and list_sum(vs[:4]) <> 0 then ((tv + list_sum(vs[5:])) / list_sum(vs[:4]) - 1) * 100 end as vt from r),
    y as (select *, case when m10 is null then 50 when m5 > m10 and close > m5 then 80 when m5 < m10 and close < m5 then 25 when close > m5 then 65 when close < m5 then 38 else 50 end as t, {_case('g4', trends.WEEK_MOMENTUM)} as mo from x)
    select code, date, round(g4, 6) as momentum_4w, round(g8, 6) as momentum_8w, round(vt, 6) as volume_trend, case when k >= 2 then round(cast(greatest(0, least(100, 0.35 * t + 0.25 * {_case('close / m5', trends.WEEK_PLACE)} + 0.25 * mo + 0.15 * {_case('vt', trends.WEEK_VOLUME)} + case when t > 65 and mo > 60 then 5 when t < 35 and mo < 40 then -3 else 0 end)) + 1e-9 as double), 1) end as score from y""",
)
def factor_weekly(spark, d):
    return rounded(trends.weekly_scores(ships(spark, d)), "code", "date")


_WILDER = "list_transform(range(2, len({x}) - 12), lambda i: list_reduce(list_prepend(list_sum({x}[1:14]) / 14, {x}[15:13 + i]), lambda e, v: (e * 13 + v) / 14))"
_ADX = f"""{_NUMBERED}, mv as (select *, high - lag(high) over s as ri, lag(low) over s - low as fa from a {_S}), dm as (select code, date, greatest(high - low, abs(high - p), abs(low - p)) as tr, case when ri > fa and ri > 0 then ri else 0 end as du, case when fa > ri and fa > 0 then fa else 0 end as dd from mv where p is not null),
sr as (select code, list(date order by date) as ds, list(tr order by date) as t, list(du order by date) as u, list(dd order by date) as w from dm group by 1 having count(*) > 14),
wl as (select code, unnest(ds[15:]) as date, unnest({_WILDER.format(x='t')}) as t, unnest({_WILDER.format(x='u')}) as u, unnest({_WILDER.format(x='w')}) as w from sr),
dx as (select code, date, case when t = 0 then null when u + w > 0 then 100 * abs(u - w) / (u + w) else 0 end as dx from wl), ax as (select code, date, avg(dx) over (partition by code order by date) as adx from dx)"""


@register("win_adx", f"with {_ADX} select code, date, round(adx, 6) as adx from ax")
def win_adx(spark, d):
    return rounded(trends.directional_index(ships(spark, d)), "code", "date")


_SHAPE = [
    ("sp = 0", "doji", 48), ("sz / sp < 0.1", "doji", 50), ("bo > sz * 2 and tp < sz * 0.5 and bd > 0", "hammer", 65), ("tp > sz * 2 and bo < sz * 0.5 and bd > 0", "inverted_hammer", 55), ("bd > 0 and sz / sp > 0.7 and (high - close) / sp < 0.1", "strong_bullish", 75),
    ("bd > 0 and sz / sp > 0.7", "bullish", 65), ("bd < 0 and sz / sp > 0.7 and (close - low) / sp < 0.1", "strong_bearish", 25), ("bd < 0 and sz / sp > 0.7", "bearish", 35), ("bd > 0 and sz / sp < 0.3", "small_bullish", 58), ("bd < 0 and sz / sp < 0.3", "small_bearish", 42),
    ("tp > sz * 1.5 and bd > 0", "long_upper_shadow", 38), ("bo > sz * 1.5 and bd < 0", "long_lower_shadow", 55),
]
_ORDER = [
    ("m20 is null", "insufficient_data", 50), ("m5 > m10 and m10 > m20 and m20 > m60", "bullish_alignment", 82), ("m5 > m10 and m10 > m20", "bullish_alignment_short", 72), ("m5 < m10 and m10 < m20 and m20 < m60", "bearish_alignment", 18), ("m5 < m10 and m10 < m20", "bearish_alignment_short", 28),
    ("m60 is not null and close > m5 and m5 > m10 and m10 > m20", "price_above_all_ma", 75), ("close > m5 and close > m10 and close > m20", "price_above_ma", 65), ("m60 is not null and close < m5 and m5 < m10 and m10 < m20", "price_below_all_ma", 22), ("close < m5 and close < m10 and close < m20", "price_below_ma", 35),
    ("abs(m5 - m20) / m20 * 100 < 2", "ma_entangled", 52), ("abs(m5 - m20) / m20 * 100 < 5", "ma_loosely_entangled", 48),
]
_BREAK = [
    ("n < 20", "insufficient_data", 50), ("bh = bl", "no_box", 50), ("close > bh and volume > us * 1.5", "volume_breakout_up", 88), ("close > bh and volume > us * 1.2", "moderate_breakout_up", 78), ("close > bh", "weak_breakout_up", 65), ("close < bl and volume > us * 1.5", "volume_breakdown", 15), ("close < bl", "weak_breakdown", 30),
    ("close > m20 and p <= m20", "ma_breakout", 68), ("close < m20 and p >= m20", "ma_breakdown", 32),
]


def _chosen(cases, otherwise, value=50):
    pick = lambda at, last: "case " + " ".join(f"when {x[0]} then {repr(x[at])}" for x in cases) + f" else {last!r} end"
    return pick(1, otherwise), pick(2, value)


@register(
    "factor_pattern",
    f"""with {_ADX}, z as (select a.*, adx, {', '.join(map(_ma, (5, 10, 20, 60)))}, max(high) over {_frame(20)} as bh, min(low) over {_frame(20)} as bl, avg(volume) over {_frame(20)} as us from a left join ax using (code, date) {_S}),
    y as (select *, high - low as sp, abs(close - open) as sz, close - open as bd, high - greatest(open, close) as tp, least(open, close) - low as bo, (m20 / lag(m20, 5) over s - 1) * 100 as sl from z {_S}),
    x as (select *, {_chosen(_ORDER, 'ma_mixed', 45)[0]} as alignment, {_chosen(_ORDER, 'ma_mixed', 45)[1]} as av, {_chosen(_BREAK, 'no_breakout')[0]} as breakout, {_chosen(_BREAK, 'no_breakout')[1]} as bv, {_chosen(_SHAPE, 'neutral')[0]} as candle, {_chosen(_SHAPE, 'neutral')[1]} as cv,
      case when n >= 20 then round(cast(0.5 * {_case('adx', trends.TREND_STRENGTH)} + 0.5 * {_case('sl', trends.TREND_SLOPE)} + 1e-9 as double), 1) else 50 end as tv from y)
    select code, date, alignment, breakout, candle, round(adx, 6) as adx, case when n >= 5 then round(cast(0.35 * bv + 0.3 * cv + 0.2 * av + 0.15 * tv + 1e-9 as double), 1) end as score from x""",
)
def factor_pattern(spark, d):
    return trends.pattern_scores(ships(spark, d)).withColumn("adx", F.round("adx", 6))


@register(
    "factor_reversal",
    f"""with {_NUMBERED}, z as (select a.*, case when s_nationkey % 5 = 0 then 4.5 when code % 3 = 0 then 19.5 else 9.5 end as lim from a join supplier on code = s_suppkey),
    b as (select *, case when p > 0 and (close / p - 1) * 100 >= lim then 1 else 0 end as u, case when p > 0 and (close / p - 1) * 100 <= -lim then 1 else 0 end as w, (high - low) / close * 100 as am, case when open > p * 1.01 then 1 else 0 end as gu, case when open < p * 0.99 then 1 else 0 end as gd from z),
    k as (select *, sum(u) over {_frame(20)} as lu, sum(w) over {_frame(20)} as ld, array_to_string(list(u) over {_frame(20)}, '') as us, max(high) over {_frame(20)} as h, min(low) over {_frame(20)} as l, avg(am) over {_frame(10)} as aa, am - first(am) over {_frame(10)} as amt, sum(gu) over {_frame(10)} as g1, sum(gd) over {_frame(10)} as g2 from b {_S}),
    m as (select *, list_max(list_transform(string_split(us, '0'), lambda x: len(x))) as run, case when n >= 5 then case when h = l then 50 else (close - l) / (h - l) * 100 end end as pl, case when n >= 5 then round(aa, 2) end as a2, case when n >= 5 then round(amt, 2) end as t2, case when g1 + g2 > 0 then round(g1 / (g1 + g2), 2) else 0.5 end as gs from k)
    select code, date, cast(lu as double) as limit_ups, cast(ld as double) as limit_downs, cast(run as double) as limit_run, round(pl, 6) as place, a2 as amplitude, t2 + 0.0 as amplitude_trend, gs as gap_share, case when n >= 5 then round(cast(0.25 * greatest(case when lu >= 3 then 25 when lu = 2 then 38 when lu = 1 then 52 else 50 end, case when ld >= 2 then 72 when ld = 1 then 58 else 0 end)
      + 0.2 * case when run >= 3 then 20 when run = 2 then 38 when run = 1 then 52 else 60 end + 0.25 * {_case('pl', trends.PLACE_IN_RANGE)} + 0.15 * case when t2 > 2 and a2 > 5 then 35 when t2 < -2 and a2 < 3 then 58 when t2 > 0 and a2 < 4 then 52 else 48 end + 0.15 * {_case('gs', trends.GAP_SHARE)} + 1e-9 as double), 1) end as score from m""",
)
def factor_reversal(spark, d):
    """Limits by board and name: every third supplier stands for a growth board, those of every fifth nation for names under special treatment."""
    named = ships(spark, d).join(B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), "s_name", "s_nationkey"), "code")
    board = F.concat(F.when(F.col("code") % 3 == 0, "300").otherwise("600"), F.col("code").cast("string"))
    limit = scalars.limit_pct(board, F.concat(F.when(F.col("s_nationkey") % 5 == 0, "*st ").otherwise(""), "s_name"))
    return rounded(trends.reversal_scores(named, limit), "code", "date")


@register(
    "factor_tail",
    f"""with {SLOTS}, b as (select *, row_number() over (partition by code, date order by slot desc) as k from slots), g as (select code, date, count(*) as n, sum(case when k <= 6 then volume end) / sum(volume) as v, max(case when k = least(c, 3) then close end) as p0, max(case when k = 1 then close end) as p1 from (select *, count(*) over (partition by code, date) as c from b) group by 1, 2),
    h as (select code, date, round(v, 4) as tail_volume, round(case when p0 > 0 then (p1 / p0 - 1) * 100 end, 4) + 0.0 as tail_slope from g where n >= 4) select *, cast(50 + {_case('tail_volume', trends.TAIL_VOLUME, 0)} + {_case('tail_slope', trends.TAIL_SLOPE, 0)} as double) as score from h""",
)
def factor_tail(spark, d):
    return rounded(trends.tail_scores(B.slot_bars(B.read(spark, d, "events"))), "code", "date")
