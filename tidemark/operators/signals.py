"""Signals of technical series, stops, and how well calls of a rise came true.

Rows with a NULL input have no signal of it; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel, finite, refuse
from tidemark.operators import measures, technical

P = Panel()
#: Rows before which a signal counts 0, and the weights of the four.
LEAST = {"macd": 35, "kdj": 9, "rsi": 16, "volume": 20}
WEIGHTS = {"macd": 0.35, "kdj": 0.25, "rsi": 0.25, "volume": 0.15}


def _strengths(x: technical.Fields, i: np.ndarray) -> technical.Fields:
    """The strengths of whole series, and the rows' numbers; prices count where there is a close."""
    known = ~np.isnan(x["close"])
    at = technical.of_rows(known, i)
    before = lambda v: technical.ago(v, at)
    priced = {c: x[c][known] for c in ("high", "low", "close")}
    m = technical.macd_fields(priced["close"], at)
    dif, dea, bar = m["dif"], m["dea"], m["bar"]
    k, d, j = (technical.kdj_fields(priced, at)[c] for c in ("k", "d", "j"))
    rsi = technical.rsi_field(priced["close"], at)
    up, down = (k > d) & (before(k) <= before(d)), (k < d) & (before(k) >= before(d))
    crossed = np.select([up & (k < 30), up, down & (k > 70), down], [2, 1, -2, -1], 0)
    parts = {
        "macd": np.select([(dif > dea) & (bar > before(bar)), dif > dea, (dif < dea) & (bar < before(bar)), dif < dea], [2, 1, -2, -1], 0),
        "kdj": np.where(j < 0, np.maximum(crossed, 1), np.where(j > 100, np.minimum(crossed, -1), crossed)),
        "rsi": np.select([rsi < 30, rsi < 40, rsi > 70, rsi > 60], [2, 1, -2, -1], 0),
    }
    summed, count = technical.total(x["volume"], i, 20)
    return {"n": i.astype(float), "volume": measures.strength(x["volume"] / np.where(summed == 0, np.nan, summed / count)), **{c: technical.back(known, v.astype(float)) for c, v in parts.items()}}


def combined(bars: DataFrame, weights: dict[str, float] = WEIGHTS, least: int = 30) -> DataFrame:
    """``code, date, macd, kdj, rsi, volume, composite, signal, score``: the strengths, -2 to 3, of each series on each date, and their weighted mean.

    From the ``least``-th row of a code on; a series that is too short counts 0. One pass along each series.
    """
    rows = technical.along_series(bars, ("high", "low", "close", "volume"), _strengths, ("n", *LEAST))
    rows = rows.select("code", "date", "n", *(F.when(F.col("n") >= LEAST[c], F.coalesce(F.col(c).cast("int"), F.lit(0))).otherwise(0).alias(c) for c in LEAST))
    total = sum(w for w in weights.values() if w > 0)
    rows = rows.withColumn("composite", F.round(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / total, 4))
    x = F.col("composite")
    signal = F.when(x >= 1, "strong_buy").when(x >= 0.3, "buy").when(x <= -1, "strong_sell").when(x <= -0.3, "sell").otherwise("neutral")
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + x * 25)), 1)
    return rows.where(F.col("n") >= least).select("code", "date", *LEAST, "composite", signal.alias("signal"), score.alias("score"))


def stops(bars: DataFrame, multiple: float = 2.0, window: int = 14, trail: float = 0.1, entry: Column | None = None, since: Column | None = None) -> DataFrame:
    """``code, date, range_stop, trailing_stop``: the entry price less ``multiple`` mean true ranges of up to ``window`` rows, and the highest close of the position less ``trail`` of it.

    ``entry`` (default: each close) and ``since`` (the date of the entry; default: the entity's first) are expressions over ``bars``. Before its entry, or where
    the entry is NULL, a row has no stops; the first is NULL on an entity's first row too.
    """
    s = P.series
    before = F.lag("close").over(s)
    tr = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    b = bars.select("code", "date", "close", tr.alias("tr"), (F.col("close") if entry is None else entry).alias("entry"), (F.lit(None).cast("date") if since is None else since).alias("since"))
    held = F.lit(True) if since is None else F.coalesce(F.col("date") >= F.col("since"), F.lit(False))
    b = b.withColumn("range", F.avg("tr").over(s.rowsBetween(1 - window, 0)))
    of_position = Window.partitionBy("code", "since").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(F.when(held, F.col("close"))).over(of_position)
    stop = lambda x: F.when(held & F.col("entry").isNotNull(), F.round(x, 4))
    return b.select("code", "date", stop(F.col("entry") - F.col("range") * multiple).alias("range_stop"), stop(peak * (1 - trail)).alias("trailing_stop"))


def rolling_win_rate(trades: DataFrame, window: int = 20, least: int = 5) -> DataFrame:
    """``code, date, win_rate`` of the last ``window`` trades (ret_pct) of a code; 0.5 before its ``least``-th."""
    s = P.series
    won = F.avg((F.col("ret_pct") > 0).cast("double")).over(s.rowsBetween(1 - window, 0))
    return trades.select("code", "date", F.when(F.row_number().over(s) >= least, won).otherwise(F.lit(0.5)).alias("win_rate"))


def yearly_volatility(bars: DataFrame, window: int = 20, least: int = 10) -> DataFrame:
    """``code, date, vol``: sample deviation of up to ``window`` daily returns of positive closes by the root of 252; NULL with fewer than ``least``."""
    s = P.series
    b = bars.where("close > 0").select("code", "date", (F.col("close") / F.lag("close").over(s) - 1).alias("__r"))
    w = s.rowsBetween(1 - window, 0)
    return b.select("code", "date", F.when(F.count("__r").over(w) >= least, F.stddev_samp("__r").over(w) * math.sqrt(252)).alias("vol"))


def precision_lift(rows: DataFrame, score: str, y: str, mode: str = "abs", least: int = 8, eps: float = 0.05, section: str = "date") -> DataFrame:
    """``code, n_labeled, n_up, base_rate, precision, lift``: how much likelier a code rose when it was called than on all its labelled days.

    A rise is called by a score above ``eps`` (``abs``), or above the median of the day's scores (``cs``, days of two scores or more).
    Codes with fewer than ``least`` calls are left out.
    """
    if mode not in ("abs", "cs"):
        raise ValueError(f"mode={mode}")
    known = rows.select("code", section, finite(F.col(score).cast("double")).alias("s"), finite(F.col(y).cast("double")).alias("y")).where("y is not null and code is not null")
    rose = F.col("y") > 1e-12
    call = F.col("s") > eps
    if mode == "cs":
        day = Window.partitionBy(section)
        call = (F.count("s").over(day) >= 2) & (F.col("s") > F.percentile("s", 0.5).over(day))
    g = known.withColumn("call", F.coalesce(call, F.lit(False))).groupBy("code").agg(F.count(F.lit(1)).alias("n_labeled"), F.count_if("call").alias("n_up"), F.avg(rose.cast("double")).alias("base_rate"), (F.count_if(F.col("call") & rose) / F.nullif(F.count_if("call"), F.lit(0))).alias("precision"))
    return g.where(F.col("n_up") >= least).withColumn("lift", F.col("precision") - F.col("base_rate"))


def tiers(rows: DataFrame, score: str, a_count: int = 100, b_count: int = 300) -> DataFrame:
    """``rows`` (one a code) with ``tier``: A for the ``a_count`` best scores, B for the next ``b_count``, C for the rest and for rows without a score; ties by code.

    The limits are found among as many rows as A and B have: no task orders all codes.
    """
    refuse(rows, "tier")
    x = finite(F.col(score).cast("double"))
    best = rows.select("code", x.alias("__x")).where("__x is not null").orderBy(F.desc("__x"), "code").limit(a_count + b_count)
    placed = best.select("code", F.row_number().over(Window.orderBy(F.desc("__x"), "code")).alias("__place"))
    return rows.join(F.broadcast(placed), "code", "left").withColumn("tier", F.when(F.col("__place") <= a_count, "A").when(F.col("__place").isNotNull(), "B").otherwise("C")).drop("__place")  # as many rows as A and B


def prediction_metrics(rows: DataFrame, pred: str, y: str, *by: str, least: int = 4, min_abs: float = 0.05) -> DataFrame:
    """``by, n, ic, rmse, r2, sign_hit, n_signed``: correlation, error, share of variance explained (0 to 1), and how often the sign of a prediction of at least ``min_abs`` was right; NULL below ``least`` rows."""
    p, a = finite(F.col(pred).cast("double")), finite(F.col(y).cast("double"))
    known = rows.select(*by, p.alias("p"), a.alias("a")).where("p is not null and a is not null")
    err, signed = F.col("p") - F.col("a"), F.abs("p") >= min_abs
    total = F.var_pop("a") * F.count("a")
    g = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.covar_pop("p", "a") / F.nullif(F.stddev_pop("p") * F.stddev_pop("a"), F.lit(0.0))).alias("ic"), F.sqrt(F.avg(err * err)).alias("rmse"), F.when(total > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sum(err * err) / F.nullif(total, F.lit(0.0))))).alias("r2"),
        F.avg(F.when(signed, (F.signum("p") == F.signum("a")).cast("double"))).alias("sign_hit"), F.count_if(signed).alias("n_signed"),
    )
    enough = F.col("n") >= least
    return g.select(*by, "n", *(F.when(enough, F.col(c)).alias(c) for c in ("ic", "rmse", "r2", "sign_hit", "n_signed")))


def split_rows(rows: DataFrame, train: float = 0.6, valid: float = 0.2, least: int = 30) -> DataFrame:
    """``rows`` of codes with ``least`` rows or more with ``part``: train, valid or test by place in time, each of some rows."""
    refuse(rows, "part")
    train, valid = max(0.1, min(train, 0.8)), max(0.05, min(valid, 0.3))
    if train + valid >= 0.95:
        train, valid = 0.6, 0.2
    n = F.count(F.lit(1)).over(Window.partitionBy("code"))
    place = F.row_number().over(P.series)
    first = F.greatest(F.lit(least // 2), F.floor(n * train))
    second = F.least(F.greatest(first + 5, F.floor(n * (train + valid))), n - 5)
    second = F.when(second > first, second).otherwise(F.least(n, first + F.greatest(F.lit(5), F.floor(n / 10))))
    return rows.withColumns({"__n": n, "part": F.when(place <= first, "train").when(place <= second, "valid").otherwise("test")}).where(F.col("__n") >= least).drop("__n")
