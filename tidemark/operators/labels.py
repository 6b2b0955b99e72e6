"""Forward returns, time splits and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.panel import Panel, finite, safe_div

P = Panel()


def forward_pct(price: Column, h: int) -> Column:
    """Per cent from this row's price to that of h rows later."""
    return (safe_div(F.lead(price, h).over(P.series), price) - 1) * 100


def lag_features(rows: DataFrame, label: str, window: int) -> DataFrame:
    """``code, date, lag1, mean, std, streak`` of up to ``window`` labels strictly before a row: a shorter history gives a value too.

    ``streak`` counts the equal signs at its end, negative for falls.
    """
    known = rows.select("code", "date", finite(F.col(label).cast("double")).alias("y"))
    # Rows are numbered by the labels so far, so that a frame of that number holds the last labels whatever gaps lie between.
    known = known.withColumn("k", F.count("y").over(P.series.rowsBetween(Window.unboundedPreceding, 0)))
    known = known.withColumn("now", F.collect_list("y").over(Window.partitionBy("code").orderBy("k").rangeBetween(1 - window, 0)))
    v = known.withColumn("v", F.coalesce(F.lag("now").over(P.series), F.array().cast("array<double>")))
    n = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n
    v = v.withColumn("mean", F.when(n > 0, mean))
    var = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n
    # Walked from the newest back: (sign, length, still going).
    end = F.sign(F.element_at("v", -1))
    run = F.aggregate(F.reverse("v"), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda s, x: F.struct((s["k"] + F.when(s["on"] & (F.sign(x) == end) & (end != 0), 1).otherwise(0)).alias("k"), (s["on"] & (F.sign(x) == end)).alias("on")))
    return v.select("code", "date", F.when(n > 0, F.element_at("v", -1)).alias("lag1"), "mean", F.when(n > 0, F.sqrt(var)).alias("std"), F.when(n > 0, run["k"] * end).alias("streak"))


def holdout(rows: DataFrame, days: int, embargo: int) -> DataFrame:
    """``rows`` with ``part``: test for the last ``days`` dates, embargo for the ``embargo`` dates before, train for the rest.

    Only the table of distinct dates is ranked.
    """
    dates = rows.select("date").distinct()
    back = F.row_number().over(Window.orderBy(F.desc("date")))
    parts = dates.select("date", F.when(back <= days, "test").when(back <= days + embargo, "embargo").otherwise("train").alias("part"))
    return rows.join(parts, "date")


def walk_forward(rows: DataFrame, folds: int, test: int, embargo: int) -> DataFrame:
    """``fold, part, date`` of expanding windows: fold f tests ``test`` dates and trains on all dates more than ``embargo`` before them."""
    dates = rows.select("date").distinct()
    back = dates.withColumn("back", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)
    each = back.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    first, end = F.col("fold") * test, (F.col("fold") + 1) * test
    part = F.when(F.col("back").between(first, end - 1), "test").when(F.col("back") >= end + embargo, "train")
    return each.select("fold", part.alias("part"), "date").where("part is not null")
