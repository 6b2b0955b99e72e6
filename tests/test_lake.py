"""Feature tables: overwriting by partition, pruning, fingerprints."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.sources import lake


def features(spark, days, codes=(1, 2), add=0.0):
    return spark.createDataFrame([(c, date(2024, 1, 1) + timedelta(d), float(c * d) + add, float(d)) for c in codes for d in days], "code long, date date, a double, b double")


def test_writes_replace_only_their_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/lake"
    mark = lake.write_features(features(spark, range(5)), path, "f", "1")
    lake.write_features(features(spark, [3, 4, 5], add=100.0), path, "f", "1")
    got = {(r["code"], r["date"].day): r["a"] for r in lake.read_features(spark, path, "f", mark).collect()}
    assert len(got) == 12 and got[1, 1] == 0.0 and got[1, 4] == 103.0
    assert lake.read_features(spark, path, "f", "other").count() == 0


def test_reads_are_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/lake"
    mark = lake.write_features(features(spark, range(5)), path, "f", "1")
    df = lake.read_features(spark, path, "f", mark, dates=["2024-01-02"], columns=["a"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(family" in plan and "b#" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert df.count() == 2


def test_cube_and_missing_dates(spark, tmp_path):
    path = f"file://{tmp_path}/cube"
    rows = features(spark, range(3))
    lake.write_cube(rows.where("date <= '2024-01-02'"), ["a", "b"], path, "u")
    cube = lake.read_cube(spark, path, "u")
    assert cube.count() == 4
    assert {r["date"].day for r in lake.without_cube(rows, cube).collect()} == {3}


def test_tails_and_suffixes(spark):
    old, new = features(spark, range(5), codes=(1,)), features(spark, range(2, 7))
    assert sorted((r["code"], r["date"].day) for r in lake.tail(new, old).where("code = 1").collect()) == [(1, 6), (1, 7)]
    kept = lake.keep_longer(old, features(spark, [3, 4], codes=(1, 3)))
    assert kept.where("code = 1").count() == 5 and kept.where("code = 3").count() == 2


def test_series_hash_ignores_order(spark):
    a, b = features(spark, range(4)), features(spark, list(reversed(range(4))))
    h = lambda df: {r["code"]: r["h"] for r in df.groupBy("code").agg(lake.series_hash("date", "a").alias("h")).collect()}
    assert h(a) == h(b) != h(a.withColumn("a", F.col("a") + 1))
    assert lake.fingerprint("f", 1) != lake.fingerprint("f", 2)
