"""Versions of partitioned tables, and scores made again where their statistics changed."""

from __future__ import annotations

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import SMALL, as_rows
from tidemark.operators import rescoring, xsec
from tidemark.sources import lake
from tidemark.sources.versions import Versions

SCHEMA = "code string, n long, day string, clock string"


@pytest.fixture
def table(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/t", SCHEMA, ("day", "clock"))


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(t, version=None):
    return sorted(tuple(r) for r in t.read(version).collect())


def test_replacing_keeps_other_partitions_and_old_versions(spark, table):
    assert table.current() == 0 and content(table) == [] and table.clear() == 0 and table.vacuum() == 0
    table.replace(frame(spark, ("a", 1, "d1", "open"), ("b", 2, "d1", "open"), ("a", 3, "d2", "open")))
    assert table.replace(frame(spark, ("c", 9, "d1", "open"), ("c", 9, "d1", "10:30"))) == 2
    assert content(table) == [("a", 3, "d2", "open"), ("c", 9, "d1", "10:30"), ("c", 9, "d1", "open")]
    assert content(table, 1) == [("a", 1, "d1", "open"), ("a", 3, "d2", "open"), ("b", 2, "d1", "open")]
    assert table.replace(frame(spark)) == 2


def test_a_write_that_fails_leaves_the_old_version(spark, table, monkeypatch):
    table.replace(frame(spark, *((c, 1, f"d{i}", "open") for c in "ab" for i in range(5))))
    before = content(table)
    bad = frame(spark, *(("z", i, f"d{i}", "open") for i in range(5))).withColumn("n", F.when(F.col("day") == "d4", F.raise_error(F.lit("in the middle")).cast("long")).otherwise(F.col("n")))
    for fails in (lambda: table.replace(bad), lambda: table.merge(bad, "code"), lambda: table.replace(frame(spark, ("a", 1, None, "open")))):
        with pytest.raises(Exception, match="in the middle|is NULL"):
            fails()
        assert table.current() == 1 and content(table) == before
    # Between the data and the version.
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(Versions, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        table.replace(frame(spark, ("z", 1, "d1", "open")))
    assert table.current() == 1 and content(table) == before
    # What the failed writes left behind goes, nothing else does.
    assert table.vacuum() >= 1
    assert content(table) == before


def test_a_second_writer_of_one_version_is_refused(spark, table):
    table.replace(frame(spark, ("a", 1, "d1", "open")))
    table._commit(table.live(1), 1)
    with pytest.raises(Exception, match="(?i)already exists"):
        table._commit(table.live(1), 1)
    assert content(table) == [("a", 1, "d1", "open")]


@pytest.mark.parametrize("stored_first", [False, True])
def test_merging_by_key(spark, table, stored_first):
    table.replace(frame(spark, ("a", 1, "d1", "open"), (None, 2, "d1", "open"), ("b", 3, "d1", "open"), ("a", 4, "d2", "open")))
    table.merge(frame(spark, ("a", 10, "d1", "open"), (None, 20, "d1", "open"), ("c", 30, "d1", "open"), ("c", 40, "d3", "open")), "code", stored_first=stored_first)
    own = {"a": 1, None: 2} if stored_first else {"a": 10, None: 20}
    assert {(r.code, r.n, r.day) for r in table.read().collect()} == {("a", own["a"], "d1"), (None, own[None], "d1"), ("b", 3, "d1"), ("c", 30, "d1"), ("a", 4, "d2"), ("c", 40, "d3")}


def test_dropping_and_pruning_follow_the_keep_set(spark, table):
    table.replace(frame(spark, *((c, 1, d, k) for c in "ab" for d in ("d1", "d2", "d3") for k in ("open", "10:30"))))
    # An empty keep set is not known: nothing goes, no version is made.
    assert table.prune("clock", []) == 1 and table.prune("clock", [""]) == 1 and table.read().count() == 12
    table.drop(spark.createDataFrame([("d1", "open"), ("d9", "open")], "day string, clock string"))
    assert {(r.day, r.clock) for r in table.live().collect()} == {("d1", "10:30"), ("d2", "open"), ("d2", "10:30"), ("d3", "open"), ("d3", "10:30")}
    table.drop(spark.createDataFrame([("d2",)], "day string"))
    table.prune("clock", ["open", "other"])
    assert {(r.day, r.clock) for r in table.live().collect()} == {("d3", "open")} and table.read().count() == 2
    assert table.drop(spark.createDataFrame([("d7",)], "day string")) == table.current() == 4
    table.clear()
    assert content(table) == [] and table.read(1).count() == 12
    table.replace(frame(spark, ("n", 1, "d1", "open")))
    assert content(table) == [("n", 1, "d1", "open")]
    assert table.vacuum() == 1 and content(table) == [("n", 1, "d1", "open")]
    with pytest.raises(ValueError):
        table.drop(spark.createDataFrame([("x",)], "other string"))


def test_reads_scan_only_live_partitions(spark, table):
    table.replace(frame(spark, ("a", 1, "d1", "open"), ("a", 2, "d2", "open")))
    table.replace(frame(spark, ("a", 3, "d1", "open"), ("a", 4, "d2", "open")))
    plan = table.read().where("day = 'd2'")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters and "write" in filters


# Scores.


def cells(spark, seed=1, days=6, codes=9):
    rng = random.Random(seed)
    rows = [(f"c{i}", dt.date(2024, 1, 1 + d), rng.gauss(3, 2), None if (i + d) % 4 == 0 else rng.gauss(0, 1), float("nan") if i == 2 else rng.random(), 7.0) for d in range(days) for i in range(codes)]
    return rows, spark.createDataFrame(rows, "code string, date date, a double, b double, c double, flat double")


BETA = [("(intercept)", 0.5), ("a", 2.0), ("b", -1.0), ("flat", 100.0), ("unknown", 3.0), ("c", None)]


def by_hand(rows, shift=None):
    import statistics as st

    out = {}
    for day in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == day]
        for r in own:
            z, n = 0.5, 0
            for k, beta in ((2, 2.0), (3, -1.0), (5, 100.0)):
                v = [x[k] for x in own if x[k] is not None]
                if r[k] is None:
                    continue
                n += 1
                mu = st.mean(v) + (shift or {}).get((day, k), 0.0)
                if st.pvariance(v) > 1e-12:
                    z += beta * (r[k] - mu) / st.pstdev(v)
            out[r[0], day] = (n, z)
    return out


def test_scores_by_stored_statistics(spark):
    rows, df = cells(spark)
    cube = xsec.day_cube(df, ["a", "b", "c", "flat"])
    got = {(r.code, r.date): (r.n, r.score) for r in rescoring.scored(df, cube, spark.createDataFrame(BETA, "name string, beta double")).collect()}
    want = by_hand(rows)
    assert set(got) == set(want) and all(got[k][0] == n and math.isclose(got[k][1], z, rel_tol=1e-9, abs_tol=1e-9) for k, (n, z) in want.items())
    assert rescoring.scored(df, cube, spark.createDataFrame(BETA[:1], "name string, beta double")).count() == 0


def test_only_changed_dates_are_scored_again(spark, tmp_path):
    rows, df = cells(spark)
    coefficients = spark.createDataFrame(BETA, "name string, beta double")
    cube = xsec.day_cube(df, ["a", "b", "c", "flat"])
    path = f"file://{tmp_path}/scores"
    rescoring.scored(df, cube, coefficients).join(rescoring.marks(cube, coefficients), "date").write.parquet(path)
    stored = spark.read.parquet(path)
    same = rescoring.rescored(df, cube, coefficients, stored)
    assert same.count() == 54 and same.where("fresh").count() == 0
    day = dt.date(2024, 1, 3)
    moved = cube.withColumn("mu", F.when((F.col("date") == F.lit(day)) & (F.col("name") == "a"), F.col("mu") + 1.0).otherwise(F.col("mu")))
    # A statistic that the model does not use changes nothing.
    moved = moved.withColumn("mu", F.when(F.col("name") == "unused", F.lit(0.0)).otherwise(F.col("mu")))
    got = rescoring.rescored(df, moved, coefficients, stored).collect()
    want = by_hand(rows, {(day, 2): 1.0})
    assert len(got) == 54 and {r.date for r in got if r.fresh} == {day}
    assert all(math.isclose(r.score, want[r.code, r.date][1], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    # The rows of other dates do not pass the semi-join before the model's.
    plan = rescoring.rescored(df, moved, coefficients, stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan
    # Other coefficients change all dates; new dates are scored, gone ones left out.
    other = spark.createDataFrame([*BETA[:1], ("a", 2.5)], "name string, beta double")
    assert rescoring.rescored(df, cube, other, stored).where("not fresh").count() == 0
    assert {r.date for r in rescoring.rescored(df, cube.where(F.col("date") != F.lit(day)), coefficients, stored).collect()} == {r[1] for r in rows} - {day}


def test_overlaid_blocks(spark):
    d = dt.date(2024, 1, 1)
    base = spark.createDataFrame([("x", d, 1.0, 2.0), ("y", d, None, float("nan")), ("z", d, 5.0, 6.0)], "code string, date date, a double, b double")
    top = spark.createDataFrame([("x", d, 10.0, 3.0), ("y", d, float("inf"), 4.0), ("w", d, 7.0, None)], "code string, date date, a double, c double")
    got = {r.code: (r.a, r.b, r.c, r.old) for r in rescoring.overlaid(base, top, {"old": "c"}).collect()}
    assert got == {"x": (10.0, 2.0, 3.0, 3.0), "y": (None, None, 4.0, 4.0), "z": (5.0, 6.0, None, None), "w": (7.0, None, None, None)}
    assert {r.code for r in rescoring.overlaid(base, top, need="top").collect()} == {"x", "y", "w"}
    with pytest.raises(ValueError):
        rescoring.overlaid(base, top, need="both")


def test_statistics_are_made_once(spark, duck, monkeypatch):
    """Statistics whose last digits differ whenever they are made do not make a date a changed one."""
    unsteady = F.udf(lambda mu: mu * (1 + int.from_bytes(os.urandom(1)) * 2.0**-52), "double").asNondeterministic()
    once = xsec.day_cube
    made = lambda *args: once(*args).withColumn("mu", unsteady("mu"))
    monkeypatch.setattr(xsec, "day_cube", made)
    monkeypatch.setattr(lake, "day_cube", made)
    got = __spark_entry__.queries()["lake_rescored"](spark, SMALL).toPandas()
    assert as_rows(got) == as_rows(duck.execute(__spark_entry__.oracle_sql()["lake_rescored"]).df())
