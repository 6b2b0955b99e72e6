"""Scores of stored cross-sections by fitted coefficients, made again only where something changed.

A score is the intercept plus the sum of coefficients times standard scores by the stored statistics. It is a join of three long tables
(values, statistics, coefficients) and one aggregate, so that features that a model does not use are never read past the join. What a
date's scores depend on is summed up in one number a date; only dates whose number differs from the stored one are read again. The number goes by
the statistics' last digits: they are to be read from a table (``lake.write_cube``), as statistics made again from the same rows may differ there.

Values that are missing or not finite count as their date's mean; so do flat features. Rows without any value of the model have no score; dates without statistics have
none. Repeated rows of a code and date give repeated scores only in the sum of their values: one row for each is expected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.panel import finite
from tidemark.operators.xsec import long_form

INTERCEPT = "(intercept)"


def overlaid(base: DataFrame, top: DataFrame, aliases: dict[str, str] | None = None, keys: tuple[str, ...] = ("code", "date"), need: str = "any") -> DataFrame:
    """The columns of both blocks for every key of either (``need='any'``), of ``base`` or of ``top``: finite values of ``top`` go before those of ``base``.

    ``aliases`` names further columns by what they stand for: a column that has no value of its own takes that of the other, either way.
    """
    if need not in ("any", "base", "top"):
        raise ValueError(f"need={need}")
    side = lambda df, mark: df.select(*keys, *(finite(F.col(c).cast("double")).alias(f"{mark}{c}") for c in df.columns if c not in keys))
    joined = side(base, "b_").join(side(top, "t_"), list(keys), {"any": "full", "base": "left", "top": "right"}[need])
    names = dict.fromkeys(c for df in (base, top) for c in df.columns if c not in keys)
    value = {c: F.coalesce(*(F.col(m + c) for m, df in (("t_", top), ("b_", base)) if c in df.columns)) for c in names}
    for alias, source in (aliases or {}).items():
        both = [value[c] for c in (alias, source) if c in value]
        if both:
            value |= {alias: F.coalesce(*both), source: F.coalesce(*both[::-1])}
    return joined.select(*keys, *(v.alias(c) for c, v in value.items()))


def scored(rows: DataFrame, cube: DataFrame, coefficients: DataFrame, section: str = "date", code: str = "code") -> DataFrame:
    """``section, code, n, score``: ``n`` values of the model and its forecast. ``cube``: section, name, mu, sigma; ``coefficients``: name, beta, and a row ``(intercept)``.

    The coefficients are few (a row for each feature) and join first.
    """
    level = coefficients.where(F.col("name") == INTERCEPT).agg(F.coalesce(F.sum("beta"), F.lit(0.0)).alias("beta")).first()["beta"]
    names = [r["name"] for r in coefficients.where((F.col("name") != INTERCEPT) & F.col("beta").isNotNull()).select("name").distinct().collect() if r["name"] in rows.columns]  # a model's features
    if not names:
        return rows.select(section, code, F.lit(0).cast("long").alias("n"), F.lit(level).alias("score")).limit(0)
    weights = cube.select(section, "name", "mu", "sigma").join(coefficients.select("name", "beta"), "name")
    cells = long_form(rows, [section, code], names).join(weights, [section, "name"])
    z = F.coalesce((F.col("x") - F.col("mu")) / F.nullif("sigma", F.lit(0.0)), F.lit(0.0))
    return cells.groupBy(section, code).agg(F.count("x").alias("n"), (F.lit(level) + F.sum(z * F.col("beta"))).alias("score"))


def marks(cube: DataFrame, coefficients: DataFrame, section: str = "date") -> DataFrame:
    """``section, mark``: what a section's scores depend on besides its rows: the statistics of the model's features and their coefficients."""
    used = cube.join(coefficients.select("name", "beta"), "name")
    level = coefficients.where(F.col("name") == INTERCEPT).agg(F.sum("beta").alias("beta")).first()["beta"]
    one = F.xxhash64("name", "mu", "sigma", "beta", F.lit(level)).cast("decimal(38,0)")
    return used.groupBy(section).agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(one).cast("string")).alias("mark"))


def changed(now: DataFrame, stored: DataFrame, section: str = "date") -> DataFrame:
    """Sections of ``now`` (section, mark) that ``stored`` has not, or with another mark."""
    return now.join(stored.select(section, "mark").distinct(), [section, "mark"], "left_anti")


def rescored(rows: DataFrame, cube: DataFrame, coefficients: DataFrame, stored: DataFrame, section: str = "date", code: str = "code") -> DataFrame:
    """``section, code, n, score, mark, fresh``: stored scores (section, code, n, score, mark) where the mark is the same, new ones elsewhere.

    Rows of the sections that changed are the only ones read (a semi-join on the section, by which stored tables are partitioned).
    """
    now = marks(cube, coefficients, section)
    anew = changed(now, stored, section)
    again = scored(rows.join(anew.select(section), section, "left_semi"), cube.join(anew.select(section), section, "left_semi"), coefficients, section, code)
    kept = stored.join(now, [section, "mark"], "left_semi").select(section, code, "n", "score", "mark")
    return kept.withColumn("fresh", F.lit(False)).unionByName(again.join(now, section).select(section, code, "n", "score", "mark").withColumn("fresh", F.lit(True)))

