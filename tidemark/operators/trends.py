"""Scores of 0 to 100 of trends, volumes and reversals for every entity and date, from its bars up to that date.

A score is NULL where its series is too short to count at all; a part of a score that lacks its inputs is neutral, 50. Steps are fixed
values: the first that holds gives the score. Bars have one row for each code and date; NULL prices make NULL what needs
them, further columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel, finite
from tidemark.operators import technical
from tidemark.operators.packs import places

P = Panel()
Step = tuple[str, float, float]

# Fixed values.
EXCESS: list[Step] = [(">=", 3, 85), (">=", 1, 72), (">=", -1, 58), (">=", -3, 42), ("<", -3, 28)]
SHORT_SLOPE: list[Step] = [(">", 5, 82), (">", 3, 72), (">", 1, 62), (">", 0, 55), ("<", -5, 18), ("<", -3, 28), ("<", -1, 40), ("<", 0, 46)]
MIDDLE_SLOPE: list[Step] = [(">", 4, 80), (">", 2, 70), (">", 0.5, 60), (">", 0, 55), ("<", -4, 22), ("<", -2, 32), ("<", -0.5, 42), ("<", 0, 47)]
DIVERGENCE: list[Step] = [(">", 3, 72), (">", 1, 62), (">", 0, 55), ("<", -3, 25), ("<", -1, 38), ("<", 0, 46)]
ACCELERATION: list[Step] = [(">", 1, 68), (">", 0, 56), ("<", -1, 30), ("<", 0, 44)]
VOLUME_RATIO: list[Step] = [(">=", 2.5, 82), (">=", 1.5, 68), (">=", 1.1, 55), ("<", 0.5, 30), ("<", 0.8, 42)]
VOLUME_PLACE: list[Step] = [(">", 90, 72), (">", 70, 62), ("<", 10, 32), ("<", 30, 42)]
WEEK_PLACE: list[Step] = [(">", 1.05, 72), (">", 1, 60), ("<", 0.95, 28), ("<", 1, 40)]
WEEK_MOMENTUM: list[Step] = [(">", 8, 78), (">", 4, 68), (">", 0, 56), ("<", -8, 22), ("<", -4, 34), ("<", 0, 44)]
WEEK_VOLUME: list[Step] = [(">", 30, 70), (">", 10, 58), ("<", -20, 35), ("<", -5, 44)]
TREND_STRENGTH: list[Step] = [(">", 40, 78), (">", 30, 65), (">", 20, 55), ("<=", 20, 45)]
TREND_SLOPE: list[Step] = [(">", 5, 78), (">", 2, 68), (">", 0, 58), ("<", -5, 25), ("<", -2, 35), ("<", 0, 45)]
PLACE_IN_RANGE: list[Step] = [(">", 90, 25), (">", 75, 38), ("<", 10, 75), ("<", 25, 62)]
GAP_SHARE: list[Step] = [(">", 0.7, 42), ("<", 0.3, 58)]
TAIL_VOLUME: list[Step] = [(">=", 0.35, -12), (">=", 0.25, -6), ("<=", 0.12, 4)]
TAIL_SLOPE: list[Step] = [("<=", -1, -15), ("<=", -0.4, -8), (">=", 0.6, 6)]


def stepped(x: Column, steps: list[Step], otherwise: float = 50.0) -> Column:
    """The score of the first step that holds; ``otherwise`` if none does, or without ``x``."""
    score = F.lit(float(otherwise))
    for sign, limit, value in reversed(steps):
        holds = {">": x > limit, ">=": x >= limit, "<": x < limit, "<=": x <= limit}[sign]
        score = F.when(holds, F.lit(float(value))).otherwise(score)
    return score


def _first(*cases: tuple[Column, float], otherwise: float = 50.0) -> Column:
    """The value of the first case that holds; one that is NULL does not."""
    score = F.lit(float(otherwise))
    for holds, value in reversed(cases):
        score = F.when(holds, F.lit(float(value))).otherwise(score)
    return score


def _tenth(x: Column) -> Column:
    """To one place; sums of steps that lie half-way go up, whatever their last bits."""
    return F.round(x + 1e-9, 1)


def _rows() -> Column:
    return F.row_number().over(P.series)


def _last(n: int):
    return P.series.rowsBetween(-(n - 1), 0)


def _change() -> Column:
    before = F.lag("close").over(P.series)
    return F.when(before > 0, (F.col("close") / before - 1) * 100)


def average(n: int) -> Column:
    """Mean close of n rows, NULL on fewer."""
    return F.when(_rows() >= n, F.avg("close").over(_last(n)))


def slope_scores(bars: DataFrame) -> DataFrame:
    """``code, date, slope_5, slope_10, slope_20, slope_60, divergence, acceleration, score``: how steeply averages of close rose over five rows, in per cent."""
    b = bars.select("code", "date", "close").withColumns({"n": _rows(), **{f"ma_{k}": average(k) for k in (5, 10, 20, 60)}})
    past = lambda k: F.lag(f"ma_{k}", 5).over(P.series)
    b = b.withColumns({f"slope_{k}": F.when(past(k) != 0, (F.col(f"ma_{k}") / past(k) - 1) * 100) for k in (5, 10, 20, 60)})
    b = b.withColumns({"divergence": F.col("slope_5") - F.col("slope_20"), "acceleration": F.col("slope_20") - F.lag("slope_20", 5).over(P.series)})
    short = stepped((F.col("slope_5") + F.col("slope_10")) / 2, SHORT_SLOPE)
    middle = stepped(F.coalesce((F.col("slope_20") + F.col("slope_60")) / 2, F.col("slope_20")), MIDDLE_SLOPE)
    b = b.withColumns({"short": short, "middle": middle})
    agree = _first(((F.col("short") > 60) & (F.col("middle") > 60), 3), ((F.col("short") < 40) & (F.col("middle") < 40), -2), otherwise=0)
    total = 0.3 * F.col("short") + 0.3 * F.col("middle") + 0.2 * stepped(F.col("divergence"), DIVERGENCE) + 0.2 * stepped(F.col("acceleration"), ACCELERATION) + agree
    score = F.when(F.col("n") >= 10, _tenth(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))))
    return b.select("code", "date", "slope_5", "slope_10", "slope_20", "slope_60", "divergence", "acceleration", score.alias("score"))


def volume_price_scores(bars: DataFrame) -> DataFrame:
    """``code, date, volume_ratio, volume_place, score``: mean positive volume of three rows to that of ten, and the share of the last sixty below today's, in per cent."""
    s = P.series
    some = F.when(F.col("volume") > 0, F.col("volume"))
    b = bars.select("code", "date", "close", "volume").withColumns({"n": _rows(), "some": some, "change": _change()})
    move = F.col("close") - F.lag("close").over(s)
    signed = F.when(move > 0, F.col("volume")).when(move < 0, -F.col("volume")).otherwise(F.lit(0.0))
    b = b.withColumn("signed", signed).withColumn("obv", F.sum("signed").over(s.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.collect_list("some").over(_last(60))
    newest = F.element_at(known, -1)
    place = F.when((F.col("n") >= 10) & (F.size(known) >= 5), F.size(F.filter(known, lambda v: v < newest)) / F.size(known) * 100)
    b = b.withColumns({
        "volume_ratio": F.when(F.col("n") >= 2, F.avg("some").over(_last(3)) / F.avg("some").over(_last(10))), "volume_place": place, "obv_3": F.avg("obv").over(_last(3)), "obv_10": F.avg("obv").over(_last(10)),
        "rise": F.col("close") - F.lag("close", 4).over(s), "more": F.sum("volume").over(_last(3)) / 3 - F.sum("volume").over(s.rowsBetween(-4, -2)) / 3,
    })
    r, m, up, more = F.col("volume_ratio"), F.col("change"), F.col("rise"), F.col("more")
    together = _first(((m > 2) & (r > 1.5), 85), ((m > 0) & (r > 1.2), 70), ((m > 0) & (r < 0.8), 42), ((m < -2) & (r > 1.5), 20), ((m < 0) & (r < 0.7), 55), ((m < 0) & (r > 1.0), 35))
    flow = F.when(F.col("n") >= 10, _first((F.col("obv_3") > F.col("obv_10") * 1.02, 65), (F.col("obv_3") < F.col("obv_10") * 0.98, 35))).otherwise(F.lit(50.0))
    apart = F.when(m.isNotNull(), _first(((up < 0) & (more > 0), 30), ((up > 0) & (more < 0), 35), ((up < 0) & (more < 0), 62), ((up > 0) & (more > 0), 68))).otherwise(F.lit(50.0))
    total = 0.2 * stepped(r, VOLUME_RATIO) + 0.25 * together + 0.2 * flow + 0.15 * stepped(F.col("volume_place"), VOLUME_PLACE) + 0.2 * apart
    return b.select("code", "date", "volume_ratio", "volume_place", F.when(F.col("n") >= 5, _tenth(total)).alias("score"))


def inflow_scores(bars: DataFrame, inflow: str = "net_inflow") -> DataFrame:
    """``code, date, ratio, score``: a day's net inflow against the mean amount above 0 (close times volume) of ten rows; by its sign alone where there is no such amount, NULL without an inflow."""
    amount = F.col("close") * F.col("volume")
    b = bars.select("code", "date", finite(F.col(inflow).cast("double")).alias("net"), F.avg(F.when(amount > 0, amount)).over(_last(10)).alias("usual"))
    ratio = F.col("net") / F.col("usual")
    by_sign = F.when(F.col("net") > 0, 62.0).when(F.col("net") < 0, 38.0).when(F.col("net") == 0, 50.0)
    score = F.when(ratio.isNotNull(), F.greatest(F.lit(20.0), F.least(F.lit(85.0), F.round(50 + 35 * F.tanh(ratio * 8), 1)))).otherwise(by_sign)
    return b.select("code", "date", ratio.alias("ratio"), score.alias("score"))


def money_flow_scores(bars: DataFrame, window: int = 14) -> DataFrame:
    """``code, date, mfi, score``: the share of typical price times volume that came on rises, of ``window`` moves. Where net inflows are known, ``inflow_scores`` come first."""
    s = P.series
    typical = (F.coalesce("high", "close") + F.coalesce("low", "close") + F.col("close")) / 3
    b = bars.select("code", "date", typical.alias("tp"), "volume").withColumns({"n": _rows(), "before": F.lag("tp").over(s)})
    flow = F.when(F.col("volume") > 0, F.col("tp") * F.col("volume"))
    up, down = (F.coalesce(F.sum(F.when(hit, flow)).over(_last(window)), F.lit(0.0)) for hit in (F.col("tp") > F.col("before"), F.col("tp") < F.col("before")))
    b = b.withColumns({"up": up, "down": down})
    mfi = F.when((F.col("n") > window) & (F.col("up") + F.col("down") > 0), F.when(F.col("down") <= 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("up") / F.nullif("down", F.lit(0.0)))))
    b = b.withColumn("mfi", mfi)
    x = F.col("mfi")
    score = F.when(x.between(45, 65), 62 + (x - 45) * 0.4).when((x >= 30) & (x < 45), 48 + (x - 30) * 0.5).when((x > 65) & (x <= 80), 58 - (x - 65) * 0.4).when(x < 30, 38.0).when(x.isNotNull(), 40.0)
    return b.select("code", "date", "mfi", F.round(score, 1).alias("score"))


def against_index(bars: DataFrame, index: DataFrame, window: int = 20, residual_window: int = 20) -> DataFrame:
    """``code, date, excess_pct, strength, residual_pct, idiosyncratic`` of bars on the dates that the index (date, close) has too.

    The excess is the return over ``window`` rows (over fewer, at least five, where there are no more) less the index's. The residual is the mean of the last
    five of a regression on the index's returns over ``residual_window`` rows (at least five).
    """
    both = bars.where("close is not null").select("code", "date", "close").join(index.where("close is not null").select("date", F.col("close").alias("level")), "date")
    s = P.series
    positive = (F.col("close") > 0) & (F.col("level") > 0) & (F.lag("close").over(s) > 0) & (F.lag("level").over(s) > 0)
    own, market = (F.when(positive, F.col(c) / F.lag(c).over(s) - 1) for c in ("close", "level"))
    b = both.withColumns({"n": _rows(), "y": own, "x": market, "s0": F.first("close").over(s.rowsBetween(-window, 0)), "i0": F.first("level").over(s.rowsBetween(-window, 0))})
    excess = F.when((F.col("n") >= 6) & (F.col("s0") > 0) & (F.col("i0") > 0), F.round((F.col("close") / F.nullif("s0", F.lit(0.0)) - F.col("level") / F.nullif("i0", F.lit(0.0))) * 100, 2))
    w = _last(residual_window)
    n, spread = F.count("y").over(w), F.var_pop("x").over(w) * F.count("y").over(w)
    mean_y, mean_x = F.avg("y").over(w), F.avg("x").over(w)
    b = b.withColumns({"excess_pct": excess, "pairs": n, "spread": spread, "mean_y": mean_y, "mean_x": mean_x, "beta": F.covar_pop("y", "x").over(w) * n / F.nullif(spread, F.lit(0.0)), "near_y": F.avg("y").over(_last(5)), "near_x": F.avg("x").over(_last(5))})
    residual = F.when(F.col("spread") < 1e-16, F.col("mean_y")).otherwise(F.col("near_y") - F.col("mean_y") - F.col("beta") * (F.col("near_x") - F.col("mean_x"))) * 100
    b = b.withColumn("residual_pct", F.when((F.col("n") >= 6) & (F.col("pairs") >= 5), residual))
    r = F.col("residual_pct")
    idio = F.when(r.between(0.3, 2.5), 68.0).when(r.between(0.0, 5.0), 58.0).when((r >= -1) & (r < 0), 48.0).when(r > 5, 42.0).when(r.isNotNull(), 38.0)
    return b.select("code", "date", "excess_pct", F.when(F.col("excess_pct").isNotNull(), stepped(F.col("excess_pct"), EXCESS)).alias("strength"), "residual_pct", idio.alias("idiosyncratic"))


def _cases(*cases: tuple[np.ndarray, float], otherwise: float = 50.0) -> np.ndarray:
    """``_first`` for values in a task."""
    return np.select([holds for holds, _ in cases], [float(v) for _, v in cases], float(otherwise))


def _weekly(x: technical.Fields, i: np.ndarray, days: int) -> technical.Fields:
    """What ``weekly_scores`` gives, along whole series."""
    c, v = x["close"], x["volume"]
    at, week, day = np.arange(len(c)), (i - 1) // days, (i - 1) % days
    absent = lambda a: np.where(a == 0, np.nan, a)
    # A week's last row is day + 1 + days * (k - 1) rows before today's for the k-th week before.
    whole = technical.total(v, i, days)[0]

    def ended(a: np.ndarray, k: int) -> np.ndarray:
        return np.where(week >= k, a[np.maximum(at - day - 1 - days * (k - 1), 0)], np.nan)

    def added(a: np.ndarray, far: int, near: int) -> np.ndarray:
        """The sum over the weeks from ``far`` to ``near`` before; NaN if none is there."""
        values = [ended(a, k) for k in range(far, near - 1, -1)]
        known = [~np.isnan(y) for y in values]
        return np.where(np.any(known, axis=0), sum(np.where(there, y, 0.0) for there, y in zip(known, values)), np.nan)

    mean = lambda k: np.where(week >= k - 1, (c + added(c, k - 1, 1)) / k, np.nan)
    grown = lambda k: (c / absent(ended(c, k)) - 1) * 100
    so_far = [np.where(k <= day, technical.ago(v, i, k), np.nan) for k in range(days - 1, -1, -1)]
    this_week = np.where(np.any([~np.isnan(y) for y in so_far], axis=0), sum(np.nan_to_num(y, nan=0.0) for y in so_far), np.nan)
    volume_trend = np.where(week >= 7, ((this_week + added(whole, 3, 1)) / absent(added(whole, 7, 4)) - 1) * 100, np.nan)
    m4, m8 = grown(4), grown(8)
    a, z = absent(mean(5)), absent(mean(10))
    trend = _cases(((a > z) & (c > a), 80), ((a < z) & (c < a), 25), (~np.isnan(z) & (c > a), 65), (~np.isnan(z) & (c < a), 38))
    place = _cases((c > a * 1.05, 72), (c > a, 60), (c < a * 0.95, 28), (c < a, 40))
    moved = _scored(m4, WEEK_MOMENTUM)
    agree = _cases(((trend > 65) & (moved > 60), 5), ((trend < 35) & (moved < 40), -3), otherwise=0)
    total = 0.35 * trend + 0.25 * place + 0.25 * moved + 0.15 * _scored(volume_trend, WEEK_VOLUME) + agree
    return {"momentum_4w": m4, "momentum_8w": m8, "volume_trend": volume_trend, "score": np.where(week >= 2, places(np.clip(total, 0.0, 100.0) + 1e-9, 1), np.nan)}


def weekly_scores(bars: DataFrame, days: int = 5) -> DataFrame:
    """``code, date, momentum_4w, momentum_8w, volume_trend, score`` of weeks of ``days`` rows from an entity's first, the last of which may be shorter. One pass along each series."""
    return technical.along_series(bars, ("close", "volume"), lambda x, i: _weekly(x, i, days), ("momentum_4w", "momentum_8w", "volume_trend", "score"))


def _adx(x: technical.Fields, i: np.ndarray, period: int = 14) -> tuple[np.ndarray, np.ndarray]:
    """The mean so far of the directional movement index along whole series, NaN where there is none, and the rows that Wilder's averages reach."""
    before = {c: technical.ago(x[c], i) for c in ("high", "low", "close")}
    moved = ~np.isnan(before["close"])
    tr = np.fmax(np.fmax(x["high"] - x["low"], np.abs(x["high"] - before["close"])), np.abs(x["low"] - before["close"]))
    moved &= ~np.isnan(tr)
    at = technical.of_rows(moved, i)
    rise, fall = x["high"] - before["high"], before["low"] - x["low"]
    up, down = np.where((rise > fall) & (rise > 0), rise, 0.0), np.where((fall > rise) & (fall > 0), fall, 0.0)
    tr, up, down = (technical.wilder(v[moved], at, period) for v in (tr, up, down))
    given = ~np.isnan(tr)
    up, down = (100 * v / np.where(tr == 0, np.nan, tr) for v in (up, down))
    dx = np.where(up + down > 0, 100 * np.abs(up - down) / (up + down), np.where(given & (tr != 0), 0.0, np.nan))
    there = ~np.isnan(dx)
    summed, count = (technical.folded(v, at, add) for v in (np.where(there, dx, 0.0), there.astype(float)))
    return technical.back(moved, np.where(given & (count > 0), summed / count, np.nan)), technical.back(moved, given.astype(float)) == 1


def directional_index(bars: DataFrame, period: int = 14) -> DataFrame:
    """``code, date, adx``: the mean so far of the directional movement index by Wilder's averages, from row ``period + 2`` on."""

    def fields(x: technical.Fields, i: np.ndarray) -> technical.Fields:
        adx, given = _adx(x, i, period)
        return {"adx": adx, "given": np.where(given, 1.0, np.nan)}

    return technical.along_series(bars, ("high", "low", "close"), fields, ("adx", "given")).where("given is not null").select("code", "date", "adx")


def _scored(x: np.ndarray, steps: list[Step], otherwise: float = 50.0) -> np.ndarray:
    """``stepped`` for values in a task."""
    signs = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}
    return np.select([signs[sign](x, limit) for sign, limit, _ in steps], [float(v) for *_, v in steps], otherwise)


Case = tuple[np.ndarray, str, float]


def _chosen(cases: list[Case], otherwise: str, value: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first case that holds among the cases' names (``otherwise`` last), and its value."""
    holds = [c[0] for c in cases]
    return np.select(holds, [float(n) for n in range(len(cases))], float(len(cases))), np.select(holds, [float(c[2]) for c in cases], float(value))


def _shapes(o: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray) -> list[Case]:
    """The cases of a bar's shape."""
    body, size, span = c - o, np.abs(c - o), h - l
    per = np.where(span == 0, np.nan, span)
    share, top, bottom = size / per, h - np.fmax(o, c), np.fmin(o, c) - l
    near_high, near_low = (h - c) / per < 0.1, (c - l) / per < 0.1
    return [
        (span == 0, "doji", 48), (share < 0.1, "doji", 50), ((bottom > size * 2) & (top < size * 0.5) & (body > 0), "hammer", 65), ((top > size * 2) & (bottom < size * 0.5) & (body > 0), "inverted_hammer", 55),
        ((body > 0) & (share > 0.7) & near_high, "strong_bullish", 75), ((body > 0) & (share > 0.7), "bullish", 65), ((body < 0) & (share > 0.7) & near_low, "strong_bearish", 25), ((body < 0) & (share > 0.7), "bearish", 35),
        ((body > 0) & (share < 0.3), "small_bullish", 58), ((body < 0) & (share < 0.3), "small_bearish", 42), ((top > size * 1.5) & (body > 0), "long_upper_shadow", 38), ((bottom > size * 1.5) & (body < 0), "long_lower_shadow", 55),
    ]


ALIGNMENTS = ("insufficient_data", "bullish_alignment", "bullish_alignment_short", "bearish_alignment", "bearish_alignment_short", "price_above_all_ma", "price_above_ma", "price_below_all_ma", "price_below_ma", "ma_entangled", "ma_loosely_entangled", "ma_mixed")
BREAKOUTS = ("insufficient_data", "no_box", "volume_breakout_up", "moderate_breakout_up", "weak_breakout_up", "volume_breakdown", "weak_breakdown", "ma_breakout", "ma_breakdown", "no_breakout")
CANDLES = ("doji", "doji", "hammer", "inverted_hammer", "strong_bullish", "bullish", "strong_bearish", "bearish", "small_bullish", "small_bearish", "long_upper_shadow", "long_lower_shadow", "neutral")


def _patterns(x: technical.Fields, i: np.ndarray) -> technical.Fields:
    """What ``pattern_scores`` gives, along whole series; names by their places."""

    def mean(k: int) -> np.ndarray:
        summed, count = technical.total(x["close"], i, k)
        return np.where(i >= k, summed / count, np.nan)

    tenth = lambda v: places(v + 1e-9, 1)
    m5, m10, m20, m60 = map(mean, (5, 10, 20, 60))
    c, v = x["close"], x["volume"]
    long = ~np.isnan(m60) & (m60 != 0)
    away = np.abs(m5 - m20) / np.where(m20 == 0, np.nan, m20) * 100
    alignment = _chosen(list(zip([
        np.isnan(m20), long & (m5 > m10) & (m10 > m20) & (m20 > m60), (m5 > m10) & (m10 > m20), long & (m5 < m10) & (m10 < m20) & (m20 < m60), (m5 < m10) & (m10 < m20), long & (c > m5) & (m5 > m10) & (m10 > m20),
        (c > m5) & (c > m10) & (c > m20), long & (c < m5) & (m5 < m10) & (m10 < m20), (c < m5) & (c < m10) & (c < m20), away < 2, away < 5,
    ], ALIGNMENTS, (50, 82, 72, 18, 28, 75, 65, 22, 35, 52, 48))), ALIGNMENTS[-1], 45)
    high, low = technical.extreme(x["high"], i, 20, np.fmax), technical.extreme(x["low"], i, 20, np.fmin)
    usual, before = technical.total(v, i, 20)[0] / 20, technical.ago(c, i)
    breakout = _chosen(list(zip([
        i < 20, high == low, (c > high) & (v > usual * 1.5), (c > high) & (v > usual * 1.2), c > high, (c < low) & (v > usual * 1.5), c < low, (c > m20) & (before <= m20), (c < m20) & (before >= m20),
    ], BREAKOUTS, (50, 50, 88, 78, 65, 15, 30, 68, 32))), BREAKOUTS[-1])
    shape = _chosen(_shapes(x["open"], x["high"], x["low"], c), CANDLES[-1])
    adx, past = _adx(x, i)[0], technical.ago(m20, i, 5)
    slope = (m20 / np.where(past == 0, np.nan, past) - 1) * 100
    strength = np.where(i >= 20, tenth(0.5 * _scored(adx, TREND_STRENGTH) + 0.5 * _scored(slope, TREND_SLOPE)), 50.0)
    total = 0.35 * breakout[1] + 0.3 * shape[1] + 0.2 * alignment[1] + 0.15 * strength
    return {"alignment": alignment[0], "breakout": breakout[0], "candle": shape[0], "adx": adx, "score": np.where(i >= 5, tenth(total), np.nan)}


def pattern_scores(bars: DataFrame) -> DataFrame:
    """``code, date, alignment, breakout, candle, adx, score``: order of the averages, exits from the 20-row box, the bar's shape and the strength of the trend. One pass along each series."""
    found = technical.along_series(bars, ("open", "high", "low", "close", "volume"), _patterns, ("alignment", "breakout", "candle", "adx", "score"))
    named = lambda c, names: F.get(F.array(*map(F.lit, names)), F.col(c).cast("int")).alias(c)
    return found.select("code", "date", named("alignment", ALIGNMENTS), named("breakout", BREAKOUTS), named("candle", CANDLES), "adx", "score")


def _reversals(x: technical.Fields, i: np.ndarray) -> technical.Fields:
    """What ``reversal_scores`` gives, along whole series."""
    o, h, l, c, limit = (x[k] for k in ("open", "high", "low", "close", "__limit"))  # noqa: E741
    before = technical.ago(c, i)
    change = np.nan_to_num(np.where(before > 0, (c / before - 1) * 100, np.nan), nan=0.0, posinf=np.inf, neginf=-np.inf)
    known = lambda hit, *needs: np.where(np.isnan(sum(needs)), np.nan, hit)
    up, down = known(change >= limit, limit), known(change <= -limit, limit)
    ups, downs = technical.total(up, i, 20)[0], technical.total(down, i, 20)[0]
    now, run = np.zeros(len(c)), np.zeros(len(c))
    for k in range(19, -1, -1):
        v = technical.ago(up, i, k)
        now = np.where(np.isnan(v), now, (now + 1) * v)
        run = np.maximum(run, now)
    low = technical.extreme(l, i, 20, np.fmin)
    span = technical.extreme(h, i, 20, np.fmax) - low
    place = np.where(i >= 5, np.where(span == 0, 50.0, (c - low) / span * 100), np.nan)
    amp = np.where(c > 0, (h - l) / c * 100, np.nan)
    summed, count = technical.total(amp, i, 10)
    last, first = amp, technical.ago(amp, i, 9)
    for k in range(1, 10):
        last = np.where(np.isnan(last), technical.ago(amp, i, k), last)
        first = np.where(np.isnan(first), technical.ago(amp, i, 9 - k), first)
    amplitude, trend = (np.where(i >= 5, places(v, 2), np.nan) for v in (summed / count, last - first))
    gaps_up, gaps_down = (technical.total(known(hit, o, before), i, 10)[0] for hit in (o > before * 1.01, o < before * 0.99))
    both = gaps_up + gaps_down
    share = places(gaps_up / np.where(both == 0, np.nan, both), 2)
    share = np.where(np.isnan(share), 0.5, share)
    limits = _scored(ups, [(">=", 3, 25), (">=", 2, 38), (">=", 1, 52)])
    limits = np.where(downs >= 2, np.maximum(limits, 72.0), np.where(downs == 1, np.maximum(limits, 58.0), limits))
    spans = np.where(np.isnan(amplitude), 50.0, _cases(((trend > 2) & (amplitude > 5), 35), ((trend < -2) & (amplitude < 3), 58), ((trend > 0) & (amplitude < 4), 52), otherwise=48))
    total = 0.25 * limits + 0.2 * _scored(run, [(">=", 3, 20), (">=", 2, 38), (">=", 1, 52)], 60) + 0.25 * _scored(place, PLACE_IN_RANGE) + 0.15 * spans + 0.15 * _scored(share, GAP_SHARE)
    score = np.where(i >= 5, places(total + 1e-9, 1), np.nan)
    return {"limit_ups": ups, "limit_downs": downs, "limit_run": run, "place": place, "amplitude": amplitude, "amplitude_trend": trend, "gap_share": share, "score": score}


def reversal_scores(bars: DataFrame, limit_pct: float | Column = 9.5) -> DataFrame:
    """``limit_pct`` is one limit for all, or an expression over ``bars`` (by board and name: ``scalars.limit_pct``). ``code, date, limit_ups, limit_downs, limit_run, place, amplitude, amplitude_trend, gap_share, score``: days at the limits among 20, the place in their range, and spans and gaps of ten rows. One pass along each series."""
    limit = limit_pct if isinstance(limit_pct, Column) else F.lit(limit_pct)
    names = ("limit_ups", "limit_downs", "limit_run", "place", "amplitude", "amplitude_trend", "gap_share", "score")
    found = technical.along_series(bars.withColumn("__limit", limit), ("open", "high", "low", "close", "__limit"), _reversals, names)
    return found.withColumns({n: F.col(n).cast("long") for n in names[:2]} | {"limit_run": F.col("limit_run").cast("int")})


def tail_scores(slots: DataFrame, minutes: int = 30, slope_minutes: int = 15, slot_minutes: int = 5) -> DataFrame:
    """``code, date, tail_volume, tail_slope, score`` of days with four slots or more: the share of volume in the last half hour's slots, and how close moved over the last quarter's, in per cent."""
    back = F.row_number().over(Window.partitionBy("code", "date").orderBy(F.desc("slot")))
    b = slots.select("code", "date", "slot", "open", "close", "volume", back.alias("back"))
    k, j = max(1, minutes // slot_minutes), max(1, min(slope_minutes, minutes) // slot_minutes)
    first = F.coalesce(F.nullif("close", F.lit(0.0)), F.col("open"))
    days = b.groupBy("code", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("total"), F.sum(F.when(F.col("back") <= k, F.col("volume"))).alias("late"), F.max_by(F.when(F.col("back") <= j, first), F.when(F.col("back") <= j, F.col("back"))).alias("p0"), F.min_by("close", "back").alias("p1")
    )
    share = F.when(F.col("total") > 0, F.round(F.col("late") / F.nullif("total", F.lit(0.0)), 4))
    slope = F.when(F.col("p0") > 0, F.round((F.col("p1") / F.nullif("p0", F.lit(0.0)) - 1) * 100, 4))
    days = days.where("n >= 4").withColumns({"tail_volume": share, "tail_slope": slope})
    return days.select("code", "date", "tail_volume", "tail_slope", (50 + stepped(F.col("tail_volume"), TAIL_VOLUME, 0) + stepped(F.col("tail_slope"), TAIL_SLOPE, 0)).alias("score"))
