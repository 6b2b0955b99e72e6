"""Merging series of bars: upserts, whole-day replacement, unit alignment, quality and differences.

All of them compare an ``existing`` with an ``incoming`` frame by key; nothing is iterated on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.bars import complete

FIELDS = ("open", "high", "low", "close", "volume")


def upsert(existing: DataFrame, incoming: DataFrame, prefer: str = "incoming") -> DataFrame:
    """One bar for each code and date. Incomplete rows are never inserted.

    ``incoming``: its complete rows win. ``existing``: complete rows stay, incomplete ones are replaced. Of several deliveries of a side for
    one key the one whose values hash highest is taken, so the result does not depend on the order of rows. Both sides have the same columns,
    of any names but ``__side`` and ``__place``.
    """
    if prefer not in ("incoming", "existing"):
        raise ValueError(f"prefer={prefer}")
    both = existing.withColumn("__side", F.lit(0)).unionByName(incoming.where(complete(incoming)).withColumn("__side", F.lit(1)))
    rank = F.desc("__side") if prefer == "incoming" else F.desc(F.when(F.col("__side") == 0, F.when(complete(both), 2).otherwise(0)).otherwise(1))
    place = Window.partitionBy("code", "date").orderBy(rank, F.desc(F.xxhash64(*existing.columns)))
    return both.withColumn("__place", F.row_number().over(place)).where("__place = 1").select(*existing.columns)


def replace_days(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Slot bars where any incoming day replaces the whole stored day."""
    return existing.join(incoming.select("code", "date").distinct(), ["code", "date"], "left_anti").unionByName(incoming)


def without_thinner_days(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming slot bars without the days that miss a slot the stored day has."""
    lost = existing.join(incoming.select("code", "date").distinct(), ["code", "date"], "left_semi").join(incoming, ["code", "date", "slot"], "left_anti")
    return incoming.join(lost.select("code", "date").distinct(), ["code", "date"], "left_anti")


def align_volume(bars: DataFrame, peer: DataFrame, low: float = 80, high: float = 120, least: int = 5) -> DataFrame:
    """Volumes times 100 for codes whose median ratio of the peer's volume to theirs is about 100 (upper middle value, ``least`` shared rows or more)."""
    shared = bars.select("code", "date", "volume").join(peer.select("code", "date", F.col("volume").alias("other")), ["code", "date"]).where("volume > 0 and other > 0")
    ordered = F.sort_array(F.collect_list(F.col("other") / F.col("volume")))
    ratio = shared.groupBy("code").agg(ordered.alias("r")).where(F.size("r") >= least).select("code", F.get("r", F.floor(F.size("r") / 2).cast("int")).alias("ratio"))
    scale = F.when(F.col("ratio").between(low, high), F.lit(100.0)).otherwise(F.lit(1.0))
    return bars.join(ratio, "code", "left").withColumn("volume", F.col("volume") * scale).drop("ratio")


def quality(bars: DataFrame, today: str, source: str = "", stale_days: int = 10, thin: int = 15, checks: int = 20) -> DataFrame:
    """``code, n_bars, n_flat, level`` of every code.

    empty: a row without a date, or bars made of quotes (``source``). thin: fewer than ``thin`` bars, a last bar older than ``stale_days``, a fallback source, or more
    than 40 per cent of at least ``checks`` opens within 0.01 per cent of the close before (both above 0). Else good.
    """
    before = F.lag("close").over(Window.partitionBy("code").orderBy("date"))
    seen = bars.select("code", "date", "open", before.alias("before"))
    both = (F.col("open") > 0) & (F.col("before") > 0)
    flat = F.count_if(both & (F.abs(F.col("open") / F.col("before") - 1) < 1e-4))
    rows = seen.groupBy("code").agg(F.count(F.lit(1)).alias("n_bars"), flat.alias("n_flat"), F.count_if(both).alias("n_checks"), F.max("date").alias("last"), F.count_if(F.col("date").isNull()).alias("undated"))
    stale = F.datediff(F.lit(today).cast("date"), F.col("last")) > stale_days
    copied = (F.col("n_checks") >= checks) & (F.col("n_flat") > 0.4 * F.col("n_checks"))
    unreal, weak = "quote_fallback" in source, source == "empty" or "fallback" in source
    level = F.when((F.col("undated") > 0) | F.lit(unreal), "empty").when((F.col("n_bars") < thin) | stale | copied | F.lit(weak), "thin").otherwise("good")
    return rows.select("code", "n_bars", "n_flat", level.alias("level"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """``code``: rows in both, added, removed, and the largest absolute and relative move of close among those in both."""
    a = before.select("code", "date", F.col("close").alias("old"))
    b = after.select("code", "date", F.col("close").alias("new"))
    both = a.join(b, ["code", "date"], "full")
    move = F.abs(F.col("new") - F.col("old"))
    return both.groupBy("code").agg(
        F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("overlap"),
        F.count_if(F.col("old").isNull()).alias("added"),
        F.count_if(F.col("new").isNull()).alias("removed"),
        F.max(move).alias("max_move"),
        F.max(F.when(F.abs("old") > 1e-12, move / F.abs("old"))).alias("max_share"),
    )


def coverage(bars: DataFrame, share: float = 0.8) -> DataFrame:
    """``date, n``: dates on which enough codes have a bar, with how many have one.

    Enough is all of up to three codes, else ``share`` (0.5 to 1) of them rounded up and at least two; all dates, if none has enough.
    """
    share = min(1.0, max(0.5, share))
    n = bars.agg(F.count_distinct("code").alias("n_codes"))
    least = F.when(F.col("n_codes") <= 3, F.col("n_codes")).otherwise(F.greatest(F.lit(2), F.floor(F.col("n_codes") * share + 0.999999)))
    by_date = bars.groupBy("date").agg(F.count_distinct("code").alias("n")).join(F.broadcast(n.select(least.alias("least"))))  # one row
    enough = F.broadcast(by_date.agg(F.max(F.col("n") >= F.col("least")).alias("some")))  # one row
    return by_date.join(enough).where("n >= least or not some").select("date", "n")


def universe_hash(bars: DataFrame) -> DataFrame:
    """``date, mark, universe_hash, n``: two sums that stand for the set of a date's (numeric) codes, whatever their order, and its size.

    Sums are made by partial aggregation: no task sees all codes of a date.
    """
    codes = bars.select("date", F.col("code").cast("long").alias("code")).distinct()
    mark = F.sum(F.col("code") * F.col("code") % 1000003) % 1000000007
    return codes.groupBy("date").agg(mark.alias("mark"), F.sum(F.col("code") * 48271 % 2147483647).alias("universe_hash"), F.count("*").alias("n"))


def above_floor(rows: DataFrame, value: str, share: float) -> DataFrame:
    """``rows`` with ``kept``: whether the value reaches the one at index int(n * share) in ascending order; NULLs neither count nor are kept.

    The place is found by counting in 1024 bins of the range, then within one bin's rows, again and again: no task orders all values.
    """
    known = rows.where(F.col(value).isNotNull())
    n, low, high = known.agg(F.count("*"), F.min(value), F.max(value)).first()
    left = int(n * share)
    while n and low < high:
        width = (high - low) / 1024
        if low + width == low:
            break
        at = F.least(F.floor((F.col(value) - low) / width), F.lit(1023))
        bins = known.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("bin").collect()
        for b in bins:
            if left < b["n"]:
                low, high = b["low"], b["high"]
                break
            left -= b["n"]
    return rows.withColumn("kept", F.coalesce(F.col(value) >= F.lit(low), F.lit(False)))
