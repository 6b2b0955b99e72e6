"""What a decision may use and what it may choose: availability by date, rows from the future, anomalies of inputs, candidates, slots.

Gates add columns and drop nothing unless they say so. A NULL input is a missing one; an empty table gives an empty result; further columns
stay as they are, and a name that would be overwritten is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import finite, refuse
from tidemark.operators import asof

#: The ends of fiscal periods; how far a quoted change may be from the gap (in points); words that stand for a clock and not a date.
PERIOD_ENDS = ("03-31", "06-30", "09-30", "12-31")
GAP_STEP = 0.2
CLOCKS = ("open", "eod", "intraday", "eod_next")
#: Fixed value: a share of the budget (in per cent) too small to be held.
CRUMB = 0.05


def calendar_day(text: Column) -> Column:
    """The date of ``2024-01-31``, ``2024/01/31`` (more may follow) or ``20240131``; NULL for anything else and for years before 1900."""
    t = F.trim(text)
    digits = F.when(t.rlike(r"^\d{4}([-/])\d{2}\1\d{2}"), F.concat(t.substr(1, 4), t.substr(6, 2), t.substr(9, 2))).when(t.rlike(r"^\d{8}"), t.substr(1, 8))
    day = F.try_to_date(digits, "yyyyMMdd")
    return F.when(F.year(day) >= 1900, day)


def with_availability(points: DataFrame) -> DataFrame:
    """``points`` (as_of, announced, valued, available: dates) with ``available_as_of`` and ``unannounced``.

    An announced point is there from ``available``, else from the announcement. Without an announcement, a fiscal period's end is known
    from a valuation on or after it only, never from the period's end itself; any other day is an observation, there from ``available``,
    the valuation or itself. What remains is ``unannounced`` and has no date.
    """
    refuse(points, "available_as_of", "unannounced")
    as_of, valued, available = F.col("as_of"), F.col("valued"), F.col("available")
    fiscal = F.coalesce(F.date_format(as_of, "MM-dd").isin(*PERIOD_ENDS), F.lit(False))
    seen = F.when(fiscal, F.when(valued >= as_of, valued)).otherwise(F.coalesce(available, valued, as_of))
    since = F.when(F.col("announced").isNotNull(), F.coalesce(available, F.col("announced"))).otherwise(seen)
    return points.withColumn("available_as_of", since).withColumn("unannounced", F.col("available_as_of").isNull())


def known_points(decisions: DataFrame, points: DataFrame, key: str = "code", at: str = "date") -> DataFrame:
    """``decisions`` with the columns of the latest point that was available (of one day: of the latest as_of), ``known``, and where there is none ``earliest_later``, the day from which one is.

    One pass along each entity's days: nothing is paired.
    """
    refuse(decisions, "known", "earliest_later")
    found = asof.backward(decisions, points, key, at, "available_as_of", tie="as_of").withColumn("known", F.col("available_as_of").isNotNull())
    first = points.groupBy(key).agg(F.min("available_as_of").alias("__first"))
    later = F.when(~F.col("known") & (F.col("__first") > F.col(at)), F.col("__first"))
    return found.join(first, key, "left").withColumn("earliest_later", later).drop("__first")


def windows_as_of(bars: DataFrame, decisions: DataFrame, rows: int = 30, key: str = "code", order: str = "date") -> DataFrame:
    """The last ``rows`` bars up to each decision (key, order), that of its day among them: the bars with ``as_of``. A decision without a bar of its day has none.

    Each bar meets the at most ``rows`` decisions that can hold it by place in the series, an equi-join.
    """
    refuse(bars, "as_of")
    placed = bars.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    ends = placed.join(decisions.select(key, order).distinct(), [key, order], "left_semi").select(key, F.col(order).alias("as_of"), F.col("__i").alias("__end"))
    spread = ends.withColumn("__i", F.explode(F.sequence(F.greatest(F.lit(1), F.col("__end") - (rows - 1)), F.col("__end"))))
    return placed.join(spread.drop("__end"), [key, "__i"]).drop("__i")


def future_rows(rows: DataFrame, *by: str, day: str = "date", as_of: str = "as_of") -> DataFrame:
    """``by, n, later, clean``: how many rows of a window lie after its decision's day. Text is read by ``calendar_day``; what is no day is not counted as later."""
    read = lambda c: calendar_day(F.col(c)) if dict(rows.dtypes)[c] == "string" else F.to_date(c)
    later = F.coalesce(read(day) > read(as_of), F.lit(False))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(later).alias("later")).withColumn("clean", F.col("later") == 0)


def anomalies(rows: DataFrame, needed: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``issues`` (``missing:...``, ``pit:...``, in order), ``fatal_eod``, ``fatal_tau`` and ``gate_reason`` (the first fatal one).

    Read are eod_as_of, expected_as_of, trade_day (dates), session (``intraday``, ``eod_next`` or other), live (boolean), open,
    prev_close, gap_pct, last_change (numbers) and tau_as_of (text). Of ``needed`` columns, all missing is fatal, half a remark.
    """
    refuse(rows, "issues", "fatal_eod", "fatal_tau", "gate_reason")
    yes = lambda x: F.coalesce(x, F.lit(False))
    col = F.col
    number = lambda c: finite(col(c).cast("double"))
    intraday, live = yes(col("session") == "intraday"), yes(col("live"))
    opened, before, gap, change = (number(c) for c in ("open", "prev_close", "gap_pct", "last_change"))
    need_open = intraday | live | (yes(col("session") == "eod_next") & col("eod_as_of").isNotNull())
    tau = F.trim(col("tau_as_of"))
    tau_day = tau.substr(1, 10)
    clock = F.lower(tau).isin(*CLOCKS)
    lacking = sum((F.when(col(c).isNull(), 1).otherwise(0) for c in needed), F.lit(0))
    #: name, holds, spoils the close's heads, spoils the heads of the clock
    checks: list[tuple[str, Column, bool, bool]] = [
        ("missing:eod_as_of", col("eod_as_of").isNull(), True, False),
        ("pit:eod_as_of", yes(col("eod_as_of") != col("expected_as_of")), True, False),
        ("pit:eod_intraday_leak", intraday & yes(col("eod_as_of") == col("trade_day")), True, False),
        ("missing:open_t", need_open & opened.isNull(), True, True),
        ("missing:prev_close", need_open & opened.isNotNull() & before.isNull(), True, True),
        ("missing:gap", need_open & opened.isNotNull() & before.isNotNull() & gap.isNull(), True, True),
        ("pit:as_of_tau", yes((F.length(tau_day) >= 10) & ~clock & (tau_day != F.date_format("trade_day", "yyyy-MM-dd"))), False, True),
        ("pit:last_change_vs_gap", yes(F.abs(change - gap) > GAP_STEP), True, False),
    ]
    if needed:
        checks.append(("missing:sub_scores", lacking == len(needed), True, False))
        checks.append(("missing:sub_scores_sparse", (lacking < len(needed)) & (lacking > 0) & (lacking * 2 >= len(needed)), False, False))
    none = F.lit(None).cast("string")
    issues = F.array_compact(F.array(*(F.when(holds, name).otherwise(none) for name, holds, _, _ in checks)))
    fatal = lambda *names: F.arrays_overlap("issues", F.array(*map(F.lit, names)))
    eod, tau_names = [n for n, _, e, _ in checks if e], [n for n, _, _, t in checks if t]
    out = rows.withColumn("issues", issues).withColumns({"fatal_eod": fatal(*eod), "fatal_tau": fatal(*tau_names)})
    worst = F.array_intersect("issues", F.array(*(F.lit(n) for n, _, e, t in checks if e or t)))
    return out.withColumn("gate_reason", F.when(F.size(worst) > 0, F.get(worst, F.lit(0))))


def without_spoilt(rows: DataFrame, eod_heads: tuple[str, ...], tau_heads: tuple[str, ...]) -> DataFrame:
    """``rows`` of ``anomalies`` with the heads that a fatal issue spoils set to NULL, and ``hard_reject`` where the close's are."""
    refuse(rows, "hard_reject")
    spoilt = {c: F.lit(False) for c in (*eod_heads, *tau_heads)}
    spoilt |= {c: spoilt[c] | F.col("fatal_eod") for c in eod_heads}
    spoilt |= {c: spoilt[c] | F.col("fatal_tau") for c in tau_heads}
    return rows.withColumns({c: F.when(~bad, F.col(c)) for c, bad in spoilt.items()}).withColumn("hard_reject", F.col("fatal_eod"))


def candidates(rows: DataFrame, score: Column, floor: float, limit: int, section: str = "date", code: str = "code") -> DataFrame:
    """The ``limit`` best rows of a section with ``place`` from 1: neither ``hard_reject`` nor below ``floor``; ties fall by code. Rows without a score are no candidates."""
    refuse(rows, "place")
    kept = rows.withColumn("__s", finite(score.cast("double"))).where(~F.coalesce(F.col("hard_reject"), F.lit(False)) & (F.col("__s") >= floor))
    place = F.row_number().over(Window.partitionBy(section).orderBy(F.desc("__s"), F.col(code).cast("string")))
    return kept.withColumn("place", place).where(F.col("place") <= limit).drop("__s")


def slots(rows: DataFrame, score: str, sector: str, positions: int, per_sector: int, section: str = "date", code: str = "code") -> DataFrame:
    """``rows`` with ``chosen`` and ``skipped`` (``sector_slot_full``, ``max_positions``, NULL): the best ``positions`` of a section, no more than ``per_sector`` of one sector; ties fall by code.

    Going down the ranking, what a full sector turns away takes no position; so a row is chosen if it is among the first of its sector,
    and among the first of all such rows. Once all positions are taken, every row after is ``max_positions``. No sector is one too; a row
    without a score stands last.
    """
    refuse(rows, "chosen", "skipped")
    order = (F.desc_nulls_last(score), F.col(code).cast("string"))
    r = rows.withColumn("__fits", F.row_number().over(Window.partitionBy(section, sector).orderBy(*order)) <= per_sector)
    taken = F.coalesce(F.sum(F.col("__fits").cast("int")).over(Window.partitionBy(section).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("__taken", taken)
    why = F.when(F.col("__taken") >= positions, "max_positions").when(~F.col("__fits"), "sector_slot_full")
    return r.withColumn("skipped", why).withColumn("chosen", F.col("skipped").isNull()).drop("__fits", "__taken")


def parity_weights(rows: DataFrame, vol: str, score: str, sector: str, cap: float, sector_cap: float, positions: int, section: str = "date", code: str = "code") -> DataFrame:
    """Chosen rows (``slots``) with ``weight_pct``: the budget in proportion to 1 / volatility (a missing one counts as 1), each at most ``cap``, a sector at most ``sector_cap``.

    The largest come first (of equal ones the better scored); what finds no room in its sector is cut, and what would be 0.05 or less is not held (0). What is cut stays cash.
    """
    refuse(rows, "weight_pct")
    v = finite(F.col(vol).cast("double"))
    day, held = Window.partitionBy(section), Window.partitionBy(section, sector)
    r = rows.where("chosen").withColumn("__i", F.when(v > 1e-8, 1 / F.nullif(v, F.lit(0.0))).otherwise(F.lit(1.0)))
    r = r.withColumn("__want", F.least(F.lit(cap), F.col("__i") * (min(100.0, positions * cap)) / F.sum("__i").over(day)))
    before = F.sum(F.round("__want", 4)).over(held.orderBy(F.desc("__i"), F.desc_nulls_last(score), F.col(code).cast("string")).rowsBetween(Window.unboundedPreceding, -1))
    take = F.least(F.col("__want"), F.lit(sector_cap) - F.coalesce(before, F.lit(0.0)))
    return r.withColumn("weight_pct", F.when(take > CRUMB, F.round(take, 4)).otherwise(F.lit(0.0))).drop("__i", "__want")
