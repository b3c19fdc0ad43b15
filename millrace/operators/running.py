"""Running sums over ordered rows of a key, spread over tasks however many rows a key has.

A window by the key gives a key to one task. Here the rows are dealt by ranges of (key, order), so that a long key spans
several; each range has its own running sum, and what the ranges before it hold of the same key is added. Only the first
key of a range can have begun before it, so there is at most one such amount a range, and the broadcast of these is
bounded by the number of ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.lineage import cut


def ranged(rows: DataFrame, key: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with _range, the number of their range of (key, order); written, as ranges are drawn anew if recomputed."""
    by = [*key, *order]
    return cut((rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)).withColumn("_range", F.spark_partition_id()), "ranges")


def running_sums(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, str], ranges: int | None = None) -> DataFrame:
    """Adds to each row, for each (name, value) of sums, the sum of value over the rows of its key up to it (ROWS frame; the
    order should have no ties). Null keys are a key. Null values add nothing; a sum of nulls alone is null."""
    placed = ranged(rows, key, order, ranges)
    own = Window.partitionBy("_range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(value).over(own).alias(name) for name, value in sums.items()])
    totals = placed.groupBy("_range", *key).agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
    earlier = Window.partitionBy(*key).orderBy("_range")
    held = totals.select(F.col("_range").alias("_at"), *[F.col(k).alias(f"_key{n}") for n, k in enumerate(key)], F.row_number().over(earlier).alias("_nth"), *[F.sum(f"_{name}").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{name}") for name in sums])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(key)], F.col("_range") == F.col("_at"))
    both = local.join(F.broadcast(held.where("_nth > 1").drop("_nth")), same, "left")
    carried = lambda name: F.coalesce(F.col(name) + F.col(f"_{name}"), F.col(name), F.col(f"_{name}"))
    return both.select(*rows.columns, *[carried(name).alias(name) for name in sums])


def running_sums_with_ties(rows: DataFrame, key: list[str], order: str, sums: dict[str, str], ranges: int | None = None) -> DataFrame:
    """(key, order, sums): of each distinct order value of a key the sum of value over all rows up to it (RANGE frame), so
    that rows with equal values, added up before, share one."""
    added = rows.groupBy(*key, order).agg(*[F.sum(value).alias(f"_own_{name}") for name, value in sums.items()])
    return running_sums(added, key, [order], {name: f"_own_{name}" for name in sums}, ranges).drop(*[f"_own_{name}" for name in sums])


def with_ties(rows: DataFrame, key: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """The rows with the sums of running_sums_with_ties."""
    named = running_sums_with_ties(rows, key, order, sums).withColumnsRenamed({c: f"_tie_{c}" for c in [*key, order]})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_tie_{c}")) for c in [*key, order]])
    return rows.join(named, same).drop(*[f"_tie_{c}" for c in [*key, order]])
