"""Running sums and rank pairs of keys that hold most rows, against plain loops, and how evenly they are spread."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from millrace.operators import running, statistics


@pytest.fixture
def rows(spark):
    some = random.Random(8)
    return [(some.choice([1, 1, 1, 2, None, 3]), some.randint(0, 40), k, some.choice([None, 1, 2, 5])) for k in range(3000)] + [(9, 1, 5000, None)]


def test_running_sums_by_plain_loop(spark, rows):
    df = spark.createDataFrame(rows, "k int, day int, id int, v int")
    want, order = {}, lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for _, group in groupby(sorted(rows, key=order), key=lambda r: r[0]):
        total = None
        for k, day, i, v in group:
            total = total if v is None else (total or 0) + v
            want[i] = total
    for ranges in (1, 16):
        assert {r.id: r.s for r in running.running_sums(df, ["k"], ["day", "id"], {"s": "v"}, ranges).collect()} == want


def test_ties_share_a_sum(spark, rows):
    df = spark.createDataFrame(rows, "k int, day int, id int, v int")
    want = {}
    for k, day, i, _ in rows:
        mine = [r[3] for r in rows if r[0] == k and r[1] <= day and r[3] is not None]
        want[i] = sum(mine) if mine else None
    assert {r.id: r.s for r in running.with_ties(df, ["k"], "day", {"s": "v"}).collect()} == want


def test_one_key_is_spread_over_tasks(spark):
    df = spark.range(40_000).select(F.lit(7).alias("k"), "id", F.lit(1).alias("v"))
    sizes = [r["count"] for r in running.ranged(df, ["k"], ["id"], 8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8
    assert running.running_sums(df, ["k"], ["id"], {"s": "v"}, 8).where("s <> id + 1").count() == 0
    # what is carried from range to range is one row a range at most
    plan = running.running_sums(df, ["k"], ["id"], {"s": "v"}, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "_nth" in plan


def test_rank_pairs_by_plain_loop(spark):
    some = random.Random(3)
    rows = [(s, some.randint(0, 200), float(some.choice([1, 2, 3, some.random()]))) for s in "ab" for _ in range(150)] + [("c", 5, 1.0), ("d", 1, 2.0), ("d", 2, 1.0), ("e", 1, None), ("e", 2, 1.0)]
    want = {s: float(sum((y > x) - (y < x) for a, i, x in rows for b, j, y in rows if a == b == s and i < j and x is not None and y is not None)) for s in "abde"}
    got = {r.series: r.s for r in statistics.rank_pairs(spark.createDataFrame(rows, "series string, i int, v double"), "i", "v").collect()}
    assert {k: got.get(k, 0.0) for k in want} == want and got.get("c", 0.0) == 0.0
    assert {r.series for r in statistics.mann_kendall(spark.createDataFrame(rows, "series string, i int, v double"), "i", "v").collect()} == set("abde")


def test_a_long_series_without_pairs(spark):
    """40,000 points, 8 * 10**8 pairs: a falling series with one early low point."""
    n = 40_000
    df = spark.range(n).select(F.lit("x").alias("series"), "id", F.when(F.col("id") == 0, -1.0).otherwise((n - F.col("id")).cast("double")).alias("v"))
    assert statistics.rank_pairs(df, "id", "v").first().s == (n - 1) - (n - 1) * (n - 2) / 2
