"""Wide feature packs: fields anchored at a day's open, with what was known at that open.

A day's row stands for a bar whose prices are all today's open and whose volume is yesterday's; the rows before keep their own
values. Such rows are not added: each window covers the rows before, and today's value stands in its last place.

Bars have code, date, open, high, low, close, volume, one row for each code and date; further columns are ignored. A NULL price or
volume makes NULL what needs it; an entity with too short a series gets NULLs, an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.panel import EPS, Panel

P = Panel()
#: The windows in days, and the rows (today's among them) without which a day has no pack.
WINDOWS = (5, 10, 20, 30, 60)
LEAST = 61


def _over(a: Column, b: Column) -> Column:
    return a / (b + EPS)


def _corr(var_x: Column, var_y: Column, cov: Column) -> Column:
    """NULL where either does not vary (a deviation below 1e-12, or one lost in rounding)."""
    return F.when((var_x > 1e-18) & (var_y > 1e-18), cov / F.sqrt(var_x * var_y))


def doubles(column: pa.ChunkedArray) -> np.ndarray:
    """The column's values, NaN where it has none."""
    return column.to_numpy().astype(float)


def shifted(a: np.ndarray, n: int) -> np.ndarray:
    """The values of n rows before, NaN on the first n."""
    return np.concatenate([np.full(min(n, len(a)), np.nan), a[: max(len(a) - n, 0)]])


def places(a: np.ndarray, digits: int) -> np.ndarray:
    """``a`` rounded as ``panel.rounded_to`` does, without negative zeros."""
    scaled = a * 10.0**digits
    near = np.rint(scaled)
    rest = scaled - near
    half = np.abs(rest) == 0.5
    if half.any():
        near += half & (rest > 0) & (scaled > 0)
        near -= half & (rest < 0) & (scaled < 0)
    near /= 10.0**digits
    near += 0.0
    return near


NAMES = (
    "ROC", "MA", "STD", "BETA", "RSQR", "RESI", "MAX", "LOW", "QTLU", "QTLD", "RANK", "RSV", "IMAX", "IMIN", "IMXD", "CORR", "CORD", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD", "VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD", "VROC", "VRAMA",
)


def _open_fields(x: dict[str, np.ndarray], rows: np.ndarray, d: int) -> dict[str, np.ndarray]:
    """The fields of window d at ``rows`` of consecutive series ``x``; each row has d rows of its own series before it. NaN is missing."""
    per = lambda a, b: a / (b + EPS)

    def ending(name: str, last: str | None = None) -> np.ndarray:
        values = sliding_window_view(x[name], d)[rows - d + 1]
        if last:
            values[:, -1] = x[last][rows]
        return values

    def moments(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean = a.mean(1)
        apart = a - mean[:, None]
        return mean, apart, np.einsum("ij,ij->i", apart, apart) / d

    def corr(a: np.ndarray, var_a: np.ndarray, b: np.ndarray, var_b: np.ndarray) -> np.ndarray:
        return np.where((var_a > 1e-18) & (var_b > 1e-18), np.einsum("ij,ij->i", a, b) / d / np.sqrt(var_a * var_b), np.nan)

    def parts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up, moves = np.maximum(a, 0.0).sum(1), np.abs(a).sum(1)
        down = np.maximum(-a, 0.0).sum(1)
        return per(up, moves), per(down, moves), per(up - down, moves)

    o, v0, last_v = x["o"][rows], x["v0"][rows], x["last_v"][rows]
    os, rs, vs = ending("o"), ending("r"), ending("v", "v0")
    highs, lows = ending("high", "o"), ending("low", "o")
    high, low = highs.max(1), lows.min(1)
    at_high, at_low = (np.where(np.isnan(e), np.nan, at / d) for e, at in ((high, highs.argmax(1)), (low, lows.argmin(1))))
    mean_o, from_o, var_o = moments(os)
    mean_v, _, var_v = moments(vs)
    mean_rv, _, var_rv = moments(np.abs(rs) * vs)
    _, from_r, var_r = moments(rs)
    _, from_lv, var_lv = moments(ending("lv", "lv0"))
    _, from_vr, var_vr = moments(ending("vr", "vr0"))
    places = d * (d * d - 1) / 12
    slope = from_o @ (np.arange(d) - (d - 1) / 2) / places
    missing_o, missing_r = mean_o * 0, rs.sum(1) * 0
    rises, falls = ((hit.sum(1) / d + missing_r) for hit in (rs > 0, rs < 0))

    def quantile(q: float) -> np.ndarray:
        at = q * (d - 1)
        low, high = ordered[:, int(at)], ordered[:, min(int(at) + 1, d - 1)]
        return low + (high - low) * (at - int(at))

    ordered = np.partition(os, sorted({min(int(q * (d - 1)) + k, d - 1) for q in (0.2, 0.8) for k in (0, 1)}), axis=1)
    fields = [
        per(x["o"][rows - d], o), per(mean_o, o), per(np.sqrt(var_o), o), per(slope, o), np.where(var_o * d > EPS, slope * slope * places / (var_o * d), missing_o), per(o - (mean_o + slope * ((d - 1) / 2)), o), per(high, o), per(low, o),
        per(quantile(0.8) + missing_o, o), per(quantile(0.2) + missing_o, o), (os < o[:, None]).sum(1) / d + missing_o, per(o - low, high - low), at_high, at_low, at_high - at_low, corr(from_o, var_o, from_lv, var_lv), corr(from_r, var_r, from_vr, var_vr),
        rises, falls, rises - falls, *parts(rs), per(mean_v, v0), per(np.sqrt(var_v), v0), np.where(mean_rv > EPS, per(np.sqrt(var_rv), mean_rv), np.nan), *parts(ending("dv", "dv0")), per(x["v"][rows - d], last_v), per(per(mean_v, last_v), per(mean_o, o)),
    ]
    return dict(zip(NAMES, fields))


def along(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[tuple[pa.RecordBatch, pa.Table, np.ndarray, int]]:
    """Each batch of sorted series (its first column is the code) with the ``reach`` rows before it: the batch, all rows, their numbers within their series from 1, and how many of them are from before."""
    kept, before = None, 0  # rows of the batch before, and how many rows of the first one's series lie before it
    for batch in batches:
        if not batch.num_rows:
            continue
        n_kept = kept.num_rows if kept is not None else 0
        rows = pa.Table.from_batches([kept, batch] if n_kept else [batch]).combine_chunks()
        code = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        at = np.arange(len(code))
        first = np.maximum.accumulate(np.where(np.concatenate([[False], code[1:] != code[:-1]]), at, 0))
        i = at - first + 1 + np.where(first == 0, before, 0)
        yield batch, rows, i, n_kept
        start = max(len(at) - reach, 0)
        before = int(i[start]) - 1
        kept = rows.slice(start).combine_chunks().to_batches()[0]


def open_pack(bars: DataFrame, windows: tuple[int, ...] = WINDOWS, least: int = LEAST, digits: int | None = None) -> DataFrame:
    """``code, date`` and for each window d the fields NAME_d, rounded to ``digits`` places if given; NULL unless ``least`` and d + 1 rows exist.

    Fields: ROC, MA, STD, BETA, RSQR, RESI, MAX, LOW, QTLU, QTLD, RANK, RSV, IMAX, IMIN, IMXD, CORR, CORD, CNTP, CNTN, CNTD, SUMP, SUMN,
    SUMD of prices and VMA, VSTD, WVMA, VSUMP, VSUMN, VSUMD, VROC, VRAMA of volumes.

    Spark deals the series over the partitions and sorts them; a task goes through its rows batch by batch, with the rows that the longest window reaches back to kept from the batch before.
    """
    names = [f"{name}_{d}" for d in windows for name in NAMES]
    reach = max(windows)

    def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, i, n_kept in along(batches, reach):
            at = np.arange(len(i))
            o, high, low, v = (rows.column(c).to_numpy().astype(float) for c in ("open", "high", "low", "volume"))
            with np.errstate(all="ignore"):
                ago = lambda a: np.where(i > 1, np.concatenate([[np.nan], a[:-1]]), np.nan)  # noqa: B023, E731
                last_v = ago(v)
                # Yesterday's volume stands for today's; without one a unit does.
                v0 = np.where(np.isnan(last_v) | (last_v == 0), 1.0, last_v)
                x = {
                    "o": o, "high": high, "low": low, "v": v, "r": o / (ago(o) + EPS) - 1, "dv": v - last_v, "lv": np.log(v + 1), "vr": np.log(v / (last_v + EPS) + 1), "last_v": last_v, "v0": v0, "dv0": v0 - last_v, "lv0": np.log(v0 + 1), "vr0": np.log(v0 / (last_v + EPS) + 1),
                }
                columns = []
                for d in windows:
                    known = np.flatnonzero((i >= max(d + 1, least)) & (at >= n_kept))
                    values = _open_fields(x, known, d) if len(known) else {}
                    for name in NAMES:
                        whole = np.full(len(at), np.nan)
                        if len(known):
                            whole[known] = values[name] if digits is None else places(values[name], digits)
                        columns.append(pa.array(whole[n_kept:], pa.float64(), mask=np.isnan(whole[n_kept:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["code", "date", *names])

    series = bars.select("code", "date", *(F.col(c).cast("double") for c in ("open", "high", "low", "volume"))).repartition("code").sortWithinPartitions("code", "date")
    kinds = StructType([series.schema["code"], series.schema["date"], *(StructField(name, DoubleType()) for name in names)])
    return series.mapInArrow(fields, kinds)


def _inside(value: Column, span: Column, flat: float) -> Column:
    """``value`` in spans; ``flat`` where the span is none."""
    return F.when(span > EPS, value / span).when(span.isNotNull(), F.lit(flat))


def candle_pack(bars: DataFrame) -> DataFrame:
    """``code, date`` and the shape of yesterday's bar: body, length, shadows and shift against its open, and against its range (0 where it has none)."""
    s = P.series
    c, o, h, l = (F.lag(x).over(s) for x in ("close", "open", "high", "low"))
    rng, top, bottom = h - l, F.greatest(o, c), F.least(o, c)
    parts = {"YKMID": c - o, "YKUP": h - top, "YKLOW": bottom - l, "YKSFT": 2.0 * c - h - l}
    fields = {name: _over(v, o) for name, v in parts.items()} | {f"{name}2": _inside(v, rng, 0.0) for name, v in parts.items()}
    fields |= {"YKLEN": _over(rng, o), "YBODY": _over(F.abs(c - o), o), "YUPPER_SHARE": _inside(h - top, rng, 0.0), "YLOWER_SHARE": _inside(bottom - l, rng, 0.0)}
    return bars.select("code", "date", *(v.alias(k) for k, v in fields.items()))


GAPS = (
    "GAP", "GAP_ABS", "CLOSE0", "YHIGH0", "YLOW0", "YVWAP0", "YOPEN0", "OPEN_IN_YRANGE", "GAP_VS_YRANGE", "GAP_ATR", "ABOVE_YHIGH", "BELOW_YLOW", "GAP_UP", "GAP_DN", "NEAR_UPLIMIT", "NEAR_DNLIMIT", "YCLOSE_LOC", "GAP_X_YVOL", "GAP_X_YRANGE", "YOPEN_RET", "YRANGE_PCT", "YVOL_Z20", "GAP_VS_OOMA5", "GAP_VS_OOMA20",
)


def _gap_fields(x: dict[str, np.ndarray], i: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """The fields at ``rows`` of consecutive series ``x``, their rows numbered ``i``. NaN is missing, and does not count in a mean."""
    per = lambda a, b: a / (b + EPS)
    inside = lambda value, span, flat: np.where(span > EPS, value / span, np.where(np.isnan(span), np.nan, flat))
    flag = lambda hit, *needs: np.where(np.isnan(sum(needs)), np.nan, hit)
    before = np.where(i > 1, shifted(x["close"], 1), np.nan)
    true = np.fmax(np.fmax(x["high"] - x["low"], np.abs(x["high"] - before)), np.abs(x["low"] - before))
    x = x | {"tr": per(true, before), "oo": np.where(i == 1, 0.0, per(x["open"], shifted(x["open"], 1)) - 1)}
    n = i[rows]
    ago = lambda c, k=1: np.where(n > k, x[c][np.maximum(rows - k, 0)], np.nan)

    def last(c: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the k rows before."""
        back = np.arange(k, 0, -1)
        values = x[c][np.maximum(rows[:, None] - back, 0)]
        there = (n[:, None] > back) & ~np.isnan(values)
        count = there.sum(1)
        mean = np.where(there, values, 0.0).sum(1) / count
        apart = np.where(there, values - mean[:, None], 0.0)
        return mean, np.sqrt((apart * apart).sum(1) / count)

    today = x["open"][rows]
    o, h, l, c, v = (ago(y) for y in ("open", "high", "low", "close", "volume"))  # noqa: E741
    atr = last("tr", 14)[0]
    atr = np.where(np.isnan(atr), EPS, atr)
    gap, rng = per(today, c) - 1, h - l
    rng_pct = per(rng, c)
    ma5 = np.where(n > 5, last("oo", 5)[0], 0.0)
    ma20 = np.where(n > 20, last("oo", 20)[0], ma5)
    usual, deviation = last("volume", 20)
    vol_z = per(v - np.where(n > 20, usual, v), np.where(n > 20, deviation, EPS))
    return {
        "GAP": gap, "GAP_ABS": np.abs(gap), "CLOSE0": per(c, today), "YHIGH0": per(h, today), "YLOW0": per(l, today), "YVWAP0": per((h + l + c) / 3, today), "YOPEN0": per(o, today),
        "OPEN_IN_YRANGE": inside(today - l, rng, 0.5), "GAP_VS_YRANGE": inside(gap, rng_pct, 0.0), "GAP_ATR": per(gap, atr), "ABOVE_YHIGH": flag(today > h, today, h), "BELOW_YLOW": flag(today < l, today, l),
        "GAP_UP": np.fmax(gap, 0.0), "GAP_DN": np.fmax(-gap, 0.0), "NEAR_UPLIMIT": per(c * 1.1 - today, c), "NEAR_DNLIMIT": per(today - c * 0.9, c), "YCLOSE_LOC": inside(c - l, rng, 0.5),
        "GAP_X_YVOL": gap * vol_z, "GAP_X_YRANGE": gap * rng_pct, "YOPEN_RET": np.where(n >= 3, per(o, ago("close", 2)) - 1, 0.0), "YRANGE_PCT": rng_pct, "YVOL_Z20": vol_z, "GAP_VS_OOMA5": gap - ma5, "GAP_VS_OOMA20": gap - ma20,
    }


def gap_pack(bars: DataFrame, digits: int | None = None) -> DataFrame:
    """``code, date`` and today's open against yesterday's bar: the gap, its size in ranges, in true ranges and in usual moves, the distance to the limits of 10 per cent, and yesterday's levels and volume.

    Fields are rounded to ``digits`` places if given, and NULL on a series' first row. One pass along sorted series, as in ``open_pack``.
    """
    prices = ("open", "high", "low", "close", "volume")

    def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, i, n_kept in along(batches, 21):
            with np.errstate(all="ignore"):
                found = _gap_fields({c: doubles(rows.column(c)) for c in prices}, i, np.arange(n_kept, len(i)))
                values = [np.where(i[n_kept:] > 1, found[name] if digits is None else places(found[name], digits), np.nan) for name in GAPS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.float64(), from_pandas=True) for v in values)], ["code", "date", *GAPS])

    series = bars.select("code", "date", *(F.col(c).cast("double") for c in prices)).repartition("code").sortWithinPartitions("code", "date")
    return series.mapInArrow(fields, StructType([series.schema["code"], series.schema["date"], *(StructField(name, DoubleType()) for name in GAPS)]))


def lag_pack(bars: DataFrame) -> DataFrame:
    """``code, date`` and what the days before did: open-to-open returns up to today's, close and range moves, shocks; NULL with fewer than five days before."""
    s, x = P.series, F.col
    ago = lambda c, n=1: F.lag(c, n).over(s)
    b = bars.select("code", "date", "open", "high", "low", "close", "volume").withColumns({"n": F.row_number().over(s), "oo": _over(x("open"), ago("open")) - 1, "rng": _over(x("high") - x("low"), x("close"))})
    to_today, last20 = P.frame, s.rowsBetween(-20, -1)
    usual = lambda c: F.when(x("n") > 20, F.avg(c).over(last20)).otherwise(ago(c))
    ten = x("n") > 10
    fields = {
        "OO_LAG1": x("oo"), "OO_LAG2": ago("oo"), "OO_LAG3": ago("oo", 2), "OO_MA5": F.avg("oo").over(to_today(5)), "OO_STD5": F.stddev_pop("oo").over(to_today(5)), "CC_LAG1": _over(ago("close"), ago("close", 2)) - 1,
        "OC_LAG1": _over(ago("close"), ago("open")) - 1, "OO_SIGN_MA5": F.avg(F.signum("oo")).over(to_today(5)), "MOM3_O": F.sum("oo").over(to_today(3)), "MOM3_C": _over(ago("close"), ago("close", 4)) - 1, "REV1_O": -x("oo"),
        "VOL_SHOCK": _over(ago("volume"), usual("volume")), "RANGE_SHOCK": _over(ago("rng"), usual("rng")), "OO_MA10": F.when(ten, F.avg("oo").over(to_today(10))), "OO_STD10": F.when(ten, F.stddev_pop("oo").over(to_today(10))),
    }
    return b.select("code", "date", *(F.when(x("n") > 5, y).alias(k) for k, y in fields.items()))
