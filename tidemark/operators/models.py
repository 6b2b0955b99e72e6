"""Linear models over panels: the sums are made in one distributed aggregate, the small system is solved on the driver.

What comes to the driver has one number for each pair of features.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.panel import EPS, finite


def gram(rows: DataFrame, features: list[str], label: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of rows with a label, feature means, centred Gram matrix and centred products with the label; a missing feature counts as its mean."""
    x = {f: finite(F.col(f).cast("double")) for f in features}
    rows = rows.select(*(x[f].alias(f) for f in features), finite(F.col(label).cast("double")).alias("__label")).where("__label is not null")
    first = rows.agg(F.count("*").alias("n"), F.avg("__label").alias("y"), *(F.avg(f).alias(f"m{i}") for i, f in enumerate(features))).first()
    mu = np.array([first[f"m{i}"] or 0.0 for i in range(len(features))])
    z = [F.coalesce(F.col(f) - float(m), F.lit(0.0)) for f, m in zip(features, mu)]
    pairs = list(combinations_with_replacement(range(len(features)), 2))
    sums = rows.agg(*(F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i, j in pairs), *(F.sum(v * (F.col("__label") - float(first["y"] or 0))).alias(f"b{i}") for i, v in enumerate(z))).first()
    g = np.zeros((len(features),) * 2)
    for i, j in pairs:
        g[i, j] = g[j, i] = sums[f"g{i}_{j}"] or 0.0
    return first["n"], np.append(mu, first["y"] or 0.0), g, np.array([sums[f"b{i}"] or 0.0 for i in range(len(features))])


def ridge(rows: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> DataFrame:
    """``feature, beta, mu, sigma`` of a ridge regression on standard scores, and a row ``(intercept)``; flat features have beta 0."""
    n, mu, g, b = gram(rows, features, label)
    sigma = np.sqrt(np.diag(g) / max(n, 1))
    use = sigma > EPS
    s = np.where(use, sigma, 1.0)
    z, c = g / np.outer(s, s), b / s
    beta = np.zeros(len(features))
    if use.any():
        beta[use] = np.linalg.solve(z[np.ix_(use, use)] + penalty * np.eye(int(use.sum())), c[use])
    table = [(f, float(v), float(m), float(d)) for f, v, m, d in zip(features, beta, mu, sigma)]
    return rows.sparkSession.createDataFrame([*table, ("(intercept)", float(mu[-1]), 0.0, 0.0)], "feature string, beta double, mu double, sigma double")


def predicted(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``rows`` with ``pred``: the intercept and the betas of all features a row has, on their standard scores; NULL if it has none."""
    table = {r["feature"]: r for r in coefficients.collect()}  # one row for each feature
    terms, there = F.lit(table.pop("(intercept)")["beta"]), F.lit(False)
    for f, r in table.items():
        if r["sigma"] > EPS:
            x = finite(F.col(f).cast("double"))
            terms = terms + F.coalesce((x - r["mu"]) / r["sigma"] * r["beta"], F.lit(0.0))
            there = there | x.isNotNull()
    return rows.withColumn("pred", F.when(there, F.round(terms, 6)))


def logistic(rows: DataFrame, features: list[str], label: str, penalty: float = 1e-3) -> DataFrame:
    """``feature, beta, mu, sigma`` of a penalised logistic regression on standard scores, by Spark's own optimiser."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    _, mu, g, _ = gram(rows, features, label)
    n = rows.where(F.col(label).isNotNull()).count()
    sigma = np.sqrt(np.diag(g) / max(n, 1))
    z: list[Column] = [F.coalesce((finite(F.col(f).cast("double")) - float(m)) / float(s if s > EPS else 1.0), F.lit(0.0)).alias(f) for f, m, s in zip(features, mu, sigma)]
    data = VectorAssembler(inputCols=features, outputCol="x").transform(rows.where(F.col(label).isNotNull()).select(*z, F.col(label).cast("double").alias("label")))
    fitted = LogisticRegression(featuresCol="x", regParam=penalty, standardization=False, maxIter=40).fit(data)
    table = [(f, float(v), float(m), float(s)) for f, v, m, s in zip(features, fitted.coefficients, mu, sigma)]
    return rows.sparkSession.createDataFrame([*table, ("(intercept)", float(fitted.intercept), 0.0, 0.0)], "feature string, beta double, mu double, sigma double")
