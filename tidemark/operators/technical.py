"""Technical series: recursive averages, bars of bars, signed volume, streaks, drawdowns.

Recursions (exponential and Wilder averages, KDJ) go along one entity's series after the other: the value at a row depends on all rows
before it, so no window frame expresses it. Spark deals and sorts the rows; a task has the rows of some whole series at
once, which is their length in days, not the size of the table. NaN is missing there, as everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.panel import Panel, finite, safe_div
from tidemark.operators.packs import doubles, shifted

P = Panel()
Fields = dict[str, np.ndarray]


def whole_series(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows (their first ``keys`` columns are the code) as tables of whole series, and the rows' numbers in their series from 1."""
    kept: list[pa.RecordBatch] = []

    def numbered(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(parts)
        at = np.arange(len(rows))
        return rows, at - np.maximum.accumulate(np.where(_begins(rows, keys), at, 0)) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        before = [kept[-1].slice(kept[-1].num_rows - 1)] if kept else []
        starts = np.flatnonzero(_begins(pa.Table.from_batches([*before, batch]), keys)[len(before) :])
        if kept and not len(starts):
            kept.append(batch)
            continue
        last = int(starts[-1])
        if kept or last:
            yield numbered([*kept, batch.slice(0, last)])
        kept = [batch.slice(last)]
    if kept:
        yield numbered(kept)


def _begins(rows: pa.Table, keys: int) -> np.ndarray:
    """Where a series begins; the first row begins one."""
    begins = np.zeros(len(rows), bool)
    begins[:1] = True
    for codes in rows.columns[:keys]:
        code = codes.combine_chunks().dictionary_encode(null_encoding="encode")
        code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        begins[1:] |= code[1:] != code[:-1]
    return begins


def along_series(
    bars: DataFrame, columns: tuple[str, ...], fields: Callable[[Fields, np.ndarray], Fields], names: tuple[str, ...], keep: tuple[str, ...] = (), by: tuple[str, ...] = ("code",), order: str = "date"
) -> DataFrame:
    """``by, order`` (``code, date``), the columns ``keep`` and ``names``: what ``fields`` makes of whole series of ``columns`` and their rows' numbers. Without ``by`` all rows are one series."""
    keys = [*by, order]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, i in whole_series(batches, len(by)):
            with np.errstate(all="ignore"):
                found = fields({c: doubles(rows.column(c)) for c in columns}, i)
            yield from pa.table([*(rows.column(k) for k in (*keys, *keep)), *(pa.array(found[n], pa.float64(), from_pandas=True) for n in names)], [*keys, *keep, *names]).combine_chunks().to_batches()

    series = bars.select(*keys, *(F.col(c).cast("double") for c in columns)).repartition(*(by or (1,))).sortWithinPartitions(*keys)
    return series.mapInArrow(passed, StructType([*(series.schema[k] for k in keys), *(StructField(n, DoubleType()) for n in (*keep, *names))]))


def of_rows(known: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The numbers in their series of the rows that are ``known``, the others left out."""
    series = np.cumsum(i == 1)[known]
    at = np.arange(len(series))
    return at - np.maximum.accumulate(np.where(np.concatenate([[True], series[1:] != series[:-1]])[: len(at)], at, 0)) + 1


def back(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of the known rows at their places among all."""
    out = np.full(len(known), np.nan)
    out[known] = values
    return out


def ago(x: np.ndarray, i: np.ndarray, n: int = 1) -> np.ndarray:
    """The value of n rows before in the same series."""
    return np.where(i > n, shifted(x, n), np.nan)


def folded(x: np.ndarray, i: np.ndarray, step: Callable[[float, float], float], first: float | None = None) -> np.ndarray:
    """All states of a fold along each series from its second row on, begun with ``first`` (default: its first value)."""
    begins = np.flatnonzero(i == 1).tolist()
    out: list[float] = []
    for a, b in zip(begins, [*begins[1:], len(x)]):
        values = x[a:b].tolist()
        out += accumulate(values if first is None else [first, *values[1:]], step)
    return np.array(out, float)


def ema(x: np.ndarray, i: np.ndarray, span: int) -> np.ndarray:
    """Exponential average with alpha 2 / (span + 1), begun with a series' first value."""
    a = 2.0 / (span + 1)
    return folded(x, i, lambda e, v: e + (v - e) * a)


def wilder(x: np.ndarray, i: np.ndarray, period: int) -> np.ndarray:
    """Wilder's average, begun with the mean of the first ``period`` values, given from the value after them on."""
    begins = np.flatnonzero(i == 1).tolist()
    out = np.full(len(x), np.nan)
    for a, b in zip(begins, [*begins[1:], len(x)]):
        values = x[a:b].tolist()
        if len(values) > period:
            first = reduce(add, values[:period], 0.0) / period
            out[a + period : b] = list(accumulate([first, *values[period:]], lambda e, v: (e * (period - 1) + v) / period))[1:]
    return out


def total(x: np.ndarray, i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the values among the last n rows; the sum of none is NaN."""
    summed, count = np.zeros(len(x)), np.zeros(len(x))
    for k in range(n - 1, -1, -1):
        v = ago(x, i, k)
        there = ~np.isnan(v)
        summed += np.where(there, v, 0.0)
        count += there
    return np.where(count > 0, summed, np.nan), count


def extreme(x: np.ndarray, i: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """The largest (``np.fmax``) or smallest (``np.fmin``) of the last n rows."""
    out = x
    for k in range(1, n):
        out = of(out, ago(x, i, k))
    return out


def macd_fields(close: np.ndarray, i: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> Fields:
    dif = ema(close, i, fast) - ema(close, i, slow)
    dea = ema(dif, i, signal)
    return {"dif": dif, "dea": dea, "bar": 2 * (dif - dea)}


def rsi_field(close: np.ndarray, i: np.ndarray, period: int = 14) -> np.ndarray:
    """NaN where there is none."""
    moved = i > 1
    move, at = (close - shifted(close, 1))[moved], i[moved] - 1
    gain, loss = (wilder(np.maximum(x, 0.0), at, period) for x in (move, -move))
    return back(moved, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)))


def kdj_fields(x: Fields, i: np.ndarray, n: int = 9, m: int = 3) -> Fields:
    low, high = extreme(x["low"], i, n, np.fmin), extreme(x["high"], i, n, np.fmax)
    rsv = np.where(high > low, (x["close"] - low) / (high - low) * 100, 50.0)
    smooth = lambda v: folded(v, i, lambda e, y: (e * (m - 1) + y) / m, 50.0)
    series = np.cumsum(i == 1) - 1
    enough = np.bincount(series)[series] >= n if len(i) else np.zeros(0, bool)
    k = smooth(rsv)
    d = smooth(k)
    return {c: np.where(enough, v, np.nan) for c, v in (("k", k), ("d", d), ("j", 3 * k - 2 * d))}


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """``code, date, dif, dea, bar``: difference of two exponential averages of close, its average, and twice what lies between."""
    return along_series(bars.where("close is not null"), ("close",), lambda x, i: macd_fields(x["close"], i, fast, slow, signal), ("dif", "dea", "bar"))


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """``code, date, rsi`` by Wilder's average: begun with the mean of the first ``period`` moves, given from the move after them on; 100 without a loss."""
    return along_series(bars.where("close is not null"), ("close",), lambda x, i: {"rsi": rsi_field(x["close"], i, period)}, ("rsi",)).where("rsi is not null")


def kdj(bars: DataFrame, n: int = 9, m: int = 3) -> DataFrame:
    """``code, date, k, d, j``: the place in the range of up to n rows, smoothed twice by 1 / m; the first row is 50, and entities with fewer than n rows have none."""
    return along_series(bars.where("close is not null"), ("high", "low", "close"), lambda x, i: kdj_fields(x, i, n, m), ("k", "d", "j")).where("k is not null")


def chunk_bars(bars: DataFrame, n: int = 5) -> DataFrame:
    """Bars of every n rows from an entity's first (the last may be shorter): ``code, chunk, date`` (of its last row) and prices."""
    chunk = F.floor((F.row_number().over(P.series) - 1) / n).alias("chunk")
    return bars.select("*", chunk).groupBy("code", "chunk").agg(
        F.max("date").alias("date"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    )


def on_balance_volume(bars: DataFrame) -> DataFrame:
    """``code, date, obv``: volume added on rises of close and taken off on falls."""
    move = F.col("close") - F.lag("close").over(P.series)
    signed = F.when(move > 0, F.col("volume")).when(move < 0, -F.col("volume")).otherwise(F.lit(0.0))
    return bars.withColumn("signed", signed).select("code", "date", F.sum("signed").over(P.series.rowsBetween(Window.unboundedPreceding, 0)).alias("obv"))


def longest_run(rows: DataFrame, hit: Column) -> DataFrame:
    """``code, longest, trailing``: the longest run of rows with ``hit``, and the one that reaches the last row."""
    breaks = F.sum((~hit).cast("int")).over(P.series.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.select("code", "date", hit.alias("hit"), breaks.alias("run"))
    sizes = runs.groupBy("code", "run").agg(F.count_if("hit").alias("n"))
    return sizes.groupBy("code").agg(F.max("n").alias("longest"), F.max_by("n", "run").alias("trailing"))


def drawdown(rows: DataFrame, value: str) -> DataFrame:
    """``code, date, drawdown``: per cent below the highest value so far."""
    peak = F.max(value).over(P.series.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("code", "date", ((safe_div(F.col(value), peak) - 1) * 100).alias("drawdown"))


def true_range() -> Column:
    before = F.lag("close").over(P.series)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr_pct(n: int) -> Column:
    """Mean true range of n rows as per cent of close."""
    return safe_div(P.mean(F.col("true_range"), n), F.col("close")) * 100


def rolling_sharpe(ret: Column, n: int, yearly: int = 252) -> Column:
    """Mean over sample deviation of n rows, times the root of the rows in a year."""
    x = finite(ret)
    sd = P.full(n, F.stddev_samp(x).over(P.frame(n)), x)
    return safe_div(P.mean(x, n), sd) * F.sqrt(F.lit(float(yearly)))
