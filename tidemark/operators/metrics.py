"""Measures of predictions: information coefficients, classification, ranking, quantile spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import EPS, Panel, finite, pearson


def _both(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.withColumns({x: finite(F.col(x).cast("double")), y: finite(F.col(y).cast("double"))}).where(f"{x} is not null and {y} is not null")


def rank_ic(rows: DataFrame, x: str, y: str, section: str = "date", least: int = 2) -> DataFrame:
    """``section, n, ic, rank_ic``: correlations of x and y, and of their average ranks, for sections of ``least`` rows or more in which both vary."""
    rows = _both(rows, x, y)
    p = Panel(section=section)
    ranked = rows.select(section, x, y, p.average_rank(F.col(x)).alias("rx"), p.average_rank(F.col(y)).alias("ry"))
    found = ranked.groupBy(section).agg(F.count("*").alias("n"), pearson(F.col(x), F.col(y)).alias("ic"), pearson(F.col("rx"), F.col("ry")).alias("rank_ic"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return found.where((F.col("n") >= least) & (F.col("sx") > EPS) & (F.col("sy") > EPS)).drop("sx", "sy")


def ic_summary(ics: DataFrame, column: str = "rank_ic", least: int = 3) -> DataFrame:
    """``days, mean_ic, ic_std, ic_ir, positive, max_names`` of a daily IC to four places: mean, deviation (of the population), their ratio and the share above zero; NULL below ``least`` days."""
    x = F.col(column)
    enough, sd = F.count(x) >= least, F.stddev_pop(x)
    stats = {"mean_ic": F.avg(x), "ic_std": sd, "ic_ir": F.when(sd > EPS, F.avg(x) / F.nullif(sd, F.lit(0.0))), "positive": F.avg((x > 0).cast("double"))}
    return ics.agg(F.count(x).alias("days"), *(F.when(enough, F.round(v, 4)).alias(k) for k, v in stats.items()), F.max("n").alias("max_names"))


def auc(rows: DataFrame, score: str, label: str, *by: str, least: int = 5) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counting half; NULL with fewer than ``least`` rows or one class.

    Rows are first counted by score, so one task sorts distinct scores of a group, not its rows.
    """
    rows = _both(rows, score, label)
    counts = rows.groupBy(*by, score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*by).orderBy(score)) - F.col("neg")
    won = counts.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    total = won.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ok = (F.col("pos") + F.col("neg") >= least) & (F.col("pos") > 0) & (F.col("neg") > 0)
    return total.select(*by, F.when(ok, F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"))


def calibration(p: Column, y: Column) -> dict[str, Column]:
    """Aggregates of probabilities against 0/1 outcomes: Brier score, log loss, accuracy, precision and recall at one half."""
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    hit, call = (y == 1), (p >= 0.5)
    count = lambda x: F.sum(x.cast("double"))
    return {
        "brier": F.avg((p - y) * (p - y)),
        "log_loss": F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))),
        "accuracy": F.avg((call == hit).cast("double")),
        "precision": count(call & hit) / F.nullif(count(call), F.lit(0.0)),
        "recall": count(call & hit) / F.nullif(count(hit), F.lit(0.0)),
    }


def ndcg(rows: DataFrame, score: str, truth: str, k: int, section: str = "date", code: str = "code") -> DataFrame:
    """``section, ndcg``: gains are the ascending ranks of ``truth`` (from 0), discounts log2(place + 1), ties by code."""
    rows = _both(rows, score, truth)
    day = Window.partitionBy(section)
    gain = F.row_number().over(day.orderBy(truth, F.desc(code))) - 1
    placed = rows.select(section, gain.alias("gain"), F.row_number().over(day.orderBy(F.desc(score), code)).alias("place"), F.row_number().over(day.orderBy(F.desc(truth), code)).alias("ideal"))
    dcg = lambda p: F.sum(F.when(F.col(p) <= k, F.col("gain") / F.log2(F.col(p) + 1.0)))
    return placed.groupBy(section).agg((dcg("place") / F.nullif(dcg("ideal"), F.lit(0.0))).alias("ndcg"))


def quantile_spread(rows: DataFrame, score: str, truth: str, share: float, section: str = "date", code: str = "code") -> DataFrame:
    """``section, top, bottom, spread``: mean ``truth`` of the best and worst ceil(share * n) by score."""
    rows = _both(rows, score, truth)
    day = Window.partitionBy(section)
    k = F.ceil(F.count("*").over(day) * share)
    placed = rows.select(section, truth, k.alias("k"), F.row_number().over(day.orderBy(F.desc(score), code)).alias("best"), F.row_number().over(day.orderBy(F.asc(score), F.desc(code))).alias("worst"))
    mean = lambda p: F.avg(F.when(F.col(p) <= F.col("k"), F.col(truth)))
    return placed.groupBy(section).agg(mean("best").alias("top"), mean("worst").alias("bottom")).withColumn("spread", F.col("top") - F.col("bottom"))


def top_overlap(rows: DataFrame, a: str, b: str, k: int, section: str = "date", code: str = "code") -> DataFrame:
    """``section, overlap``: share of the k best by ``a`` that are also among the k best by ``b``."""
    day = Window.partitionBy(section)
    placed = _both(rows, a, b).select(section, *(F.row_number().over(day.orderBy(F.desc(x), code)).alias(f"p_{n}") for n, x in enumerate((a, b))))
    return placed.groupBy(section).agg((F.count_if((F.col("p_0") <= k) & (F.col("p_1") <= k)) / F.count_if(F.col("p_0") <= k)).alias("overlap"))
