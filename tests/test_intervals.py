"""Interval joins against all pairs, on small grids so that keys are cut into many cells."""

import random
from datetime import datetime as dt
from datetime import timedelta

import pytest

from factloom.operators import intervals, temporal

ROW = "key string, fact_id string, valid_from {0}, valid_until {0}"


def made(seed, n, moment):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randint(0, 200) if rng.random() < 0.8 else 90
        end = None if rng.random() < 0.2 else start + rng.choice([0, 1, 5, 40, 300, -3])
        out.append((rng.choice(["hot", "hot", "hot", "cold", None]), f"f{i:03d}", None if rng.random() < 0.02 else moment(start), None if end is None else moment(end)))
    return out


KINDS = {"timestamp": lambda n: dt(2024, 1, 1) + timedelta(hours=n), "timestamp_ntz": lambda n: dt(2024, 3, 9) + timedelta(minutes=20 * n), "long": lambda n: n}


@pytest.mark.parametrize("kind", KINDS)
def test_overlap_join_gives_all_pairs_once(spark, kind):
    a, b = made(1, 120, KINDS[kind]), made(2, 90, KINDS[kind])
    want = sorted(
        (x[1], y[1]) for x in a for y in b
        if x[0] is not None and x[0] == y[0] and x[2] is not None and y[2] is not None and (y[3] is None or x[2] < y[3]) and (x[3] is None or y[2] < x[3])
    )
    left, right = (spark.createDataFrame(r, ROW.format(kind)) for r in (a, b))
    for size in (4, 1000):
        got = intervals.overlap_join(left, right, ["key"], size)
        assert got.columns == ["key", "fact_id", "valid_from", "valid_until", "fact_id_b", "valid_from_b", "valid_until_b"]
        assert sorted((r.fact_id, r.fact_id_b) for r in got.collect()) == want


def test_a_hot_key_compares_little_more_than_it_pairs(spark):
    from pyspark.sql import functions as F

    rows = spark.range(6000).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("fact_id"), F.col("id").alias("valid_from"), (F.col("id") + 20).alias("valid_until"))
    grid = intervals.grid_of(rows.select(F.struct("key").alias("__key"), F.col("valid_from").cast("double").alias("__start")), 64)
    placed = rows.withColumns({"__key": F.struct("key"), "__start": F.col("valid_from").cast("double"), "__end": F.col("valid_until").cast("double")}).join(grid, "__key")
    reach = placed.select(F.explode(F.sequence(intervals.cell("__start"), intervals.cell("__end"))).alias("c"))
    compared = reach.groupBy("c").count().join(placed.groupBy(intervals.cell("__start").alias("c")).agg(F.count("*").alias("n")), "c").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert compared < 6000 * 64 * 2 < 6000 * 6000 / 40
    assert intervals.overlap_join(rows, rows, ["key"]).where("fact_id <> fact_id_b").count() == 2 * sum(min(19, 5999 - i) for i in range(6000))


@pytest.mark.parametrize("kind", KINDS)
def test_covering_lookup_is_the_latest_start_that_covers(spark, kind):
    facts = made(3, 150, KINDS[kind])
    rng = random.Random(4)
    probes = [(rng.choice(["hot", "cold", "none", None]), KINDS[kind](rng.randint(-5, 600)), i) for i in range(120)] + [("hot", None, 900)]

    def best(key, at):
        held = [f for f in facts if f[0] == key and at is not None and f[2] is not None and f[2] <= at and (f[3] is None or at < f[3])]
        return max(held, key=lambda f: (f[2], f[1]), default=(None, None))[1]

    asked, known = spark.createDataFrame(probes, f"key string, at {kind}, n int"), spark.createDataFrame(facts, ROW.format(kind))
    for size in (3, 20, 1000):
        got = intervals.covering_lookup(asked, known, ["key"], ["fact_id"], size)
        assert got.columns == ["key", "at", "n", "fact_id", "valid_from", "valid_until"]
        assert {r.n: r.fact_id for r in got.collect()} == {n: best(k, at) for k, at, n in probes}


def test_value_at_a_moment_skips_what_had_ended_or_was_withdrawn(spark):
    day = lambda n: dt(2024, 1, n)
    columns = "fact_id string, key string, valid_from timestamp, valid_until timestamp, retracted_at timestamp, status string"
    rows = [("a", "k", day(1), None, None, "active"), ("b", "k", day(3), day(5), None, "superseded"), ("c", "k", day(4), None, day(6), "retracted"), ("d", "k", day(2), None, None, "compacted")]
    probes = spark.createDataFrame([("k", day(n)) for n in (1, 3, 4, 5, 6, 9)], "key string, at timestamp")
    got = temporal.as_of_lookup(probes, spark.createDataFrame(rows, columns), ["key"]).collect()
    assert {r.at.day: (r.fact_id, r.valid_until) for r in got} == {1: ("a", None), 3: ("b", day(5)), 4: ("c", None), 5: ("c", None), 6: ("a", None), 9: ("a", None)}
