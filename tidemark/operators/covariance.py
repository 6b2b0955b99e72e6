"""Covariances of a few entities' returns, and what a portfolio of them risks.

Pairs are made of the entities asked for, never of a whole table; sums over dates are distributed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs(returns: DataFrame, half_life: float | None = None, least: int = 1) -> DataFrame:
    """``a, b, n, cov`` for a <= b over the dates both have (code, date, ret); pairs with fewer than ``least`` dates are left out.

    With a half-life in periods a date weighs by how many dates of the table follow it. Only the distinct dates are ranked.
    """
    r = returns.where("ret is not null").select("date", "code", "ret")
    if half_life is None:
        r = r.withColumn("w", F.lit(1.0))
    else:
        age = F.row_number().over(Window.orderBy(F.desc("date"))) - 1
        r = r.join(r.select("date").distinct().select("date", F.pow(F.lit(0.5), age / half_life).alias("w")), "date")
    x = r.select("date", F.col("code").alias("a"), F.col("ret").alias("x"), "w").join(r.select("date", F.col("code").alias("b"), F.col("ret").alias("y")), "date").where("a <= b")
    s = x.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"))
    return s.where(F.col("n") >= least).select("a", "b", "n", (F.col("sxy") / F.col("sw") - F.col("sx") / F.col("sw") * F.col("sy") / F.col("sw")).alias("cov"))


def ewma(returns: DataFrame, half_life: float = 21.0, least: int = 10) -> DataFrame:
    """``a, b, n, cov`` weighted by age in periods, for pairs with ``least`` common dates or more."""
    return pairs(returns, half_life, least)


def matrix(cov: DataFrame, codes: list) -> np.ndarray:
    """The symmetric matrix of a few codes."""
    at = {c: i for i, c in enumerate(codes)}
    out = np.zeros((len(codes),) * 2)
    for r in cov.where(F.col("a").isin(codes) & F.col("b").isin(codes)).collect():
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = r["cov"]
    return out


def contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """``code, weight, marginal, share``: how each weight moves the portfolio's deviation, and its share of the variance."""
    both = cov.unionByName(cov.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "cov"))
    w = lambda x: weights.select(F.col("code").alias(x), F.col("weight").alias(f"w_{x}"))
    rows = both.join(w("a"), "a").join(w("b"), "b").groupBy("a", "w_a").agg(F.sum(F.col("cov") * F.col("w_b")).alias("cw"))
    var = F.broadcast(rows.agg(F.sum(F.col("cw") * F.col("w_a")).alias("var")))  # one row
    return rows.join(var).select(F.col("a").alias("code"), F.col("w_a").alias("weight"), (F.col("cw") / F.sqrt("var")).alias("marginal"), (F.col("cw") * F.col("w_a") / F.col("var")).alias("share"))


def ledoit_wolf(returns: DataFrame, target: str = "diagonal") -> DataFrame:
    """``a, b, n, cov, shrinkage`` for a <= b: the covariance drawn towards its diagonal (``diagonal``) or the mean variance (``identity``) by the intensity that the data suggest.

    Returns (code, date, ret; one for each) count on the dates on which all entities have one; NULLs are no returns. The intensity comes from sums by date of second and
    fourth powers, so that no matrix of dates by entities is made. A target that is met already, up to 1e-12, has intensity 1; fewer than two such dates give an empty result.
    """
    if target not in ("diagonal", "identity"):
        raise ValueError(f"target={target}")
    r = returns.where("ret is not null").select("code", "date", "ret")
    size = r.agg(F.count_distinct("code").alias("n")).first()["n"]
    whole = r.join(r.groupBy("date").count().where(F.col("count") == size).select("date"), "date")
    periods = whole.agg(F.count_distinct("date").alias("t")).first()["t"]
    if periods < 2:
        return returns.select(F.col("code").alias("a"), F.col("code").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("cov"), F.lit(1.0).alias("shrinkage")).limit(0)
    sample = pairs(whole)
    x = whole.join(whole.groupBy("code").agg(F.avg("ret").alias("mean")), "code").withColumn("x2", F.pow(F.col("ret") - F.col("mean"), 2))
    days = x.groupBy("date").agg(F.sum("x2").alias("norm"), F.sum(F.col("x2") * F.col("x2")).alias("fourth"))
    powers = days.agg(F.avg(F.col("norm") * F.col("norm")).alias("norm2"), F.avg("fourth").alias("fourth"))
    own = F.col("a") == F.col("b")
    square = F.col("cov") * F.col("cov")
    sums = sample.agg(F.sum(F.when(own, square).otherwise(2 * square)).alias("all"), F.sum(F.when(own, square)).alias("diagonal"), F.sum(F.when(own, F.col("cov"))).alias("trace"))
    p, q = powers.first(), sums.first()  # two rows of sums
    mean = q["trace"] / size
    pi = p["norm2"] - q["all"]
    rho, apart = (p["fourth"] - q["diagonal"], q["all"] - q["diagonal"]) if target == "diagonal" else ((p["norm2"] - q["trace"] ** 2) / size, q["all"] - size * mean * mean)
    d = 1.0 if apart <= 1e-12 else max(0.0, min(1.0, (pi - rho) / (periods * apart)))
    aim = F.when(own, F.col("cov") if target == "diagonal" else F.lit(mean)).otherwise(F.lit(0.0))
    return sample.select("a", "b", "n", (aim * d + F.col("cov") * (1 - d)).alias("cov"), F.lit(d).alias("shrinkage"))


def nearest_psd(m: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """The matrix with its negative eigenvalues raised to ``floor``."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def shrunk(m: np.ndarray, intensity: float) -> np.ndarray:
    """Drawn towards the mean variance on the diagonal."""
    return (1 - intensity) * m + intensity * np.trace(m) / len(m) * np.eye(len(m))


def orthogonal(m: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Symmetric (Löwdin) transform that makes features of the correlation ``m`` uncorrelated."""
    values, vectors = np.linalg.eigh(m)
    return (vectors / np.sqrt(np.maximum(values, eps))) @ vectors.T


def simulated_var(m: np.ndarray, weights: np.ndarray, alpha: float, n: int = 10_000, seed: int = 0) -> float:
    """The alpha quantile of normal portfolio returns drawn with this covariance."""
    draws = np.random.default_rng(seed).standard_normal((n, len(m))) @ np.linalg.cholesky(nearest_psd(m)).T
    return float(np.quantile(draws @ weights, alpha))
