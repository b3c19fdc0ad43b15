"""Sources and materialized models: typed scans, text scans, profiles, full and incremental models, merges.

Tables are snapshots in a place that all executors share: a refresh is written beside what is there, and seen at once or
not at all, so a lost executor or driver never leaves half a table, and a plan may read the table that it refreshes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.lineage import cut
from millrace.sources.snapshots import PART, WHOLE, Snapshots

from .cleansing import quoted


def typed_scan(spark: SparkSession, path: str, schema: str | T.StructType, grain: list[str] | None = None) -> DataFrame:
    """A CSV file with a header by declared columns; what doesn't parse is null. With a grain, repeated keys raise."""
    out = spark.read.schema(schema).option("header", True).csv(path)
    if grain and (twice := out.groupBy(*grain).count().where("count > 1").first()):
        raise ValueError(f"grain {grain} is not unique: {twice.asDict()}")
    return out


def numbered_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Lines of text files that a pattern matches, as file, line number in the file (from 1) and text. Files are read in
    splits, and each split counts its lines; the lines of the splits before it in its file are added to a line's number."""
    split = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    # a line's place within its split is the order in which the split is read: ids that grow within a task, less the split's least
    read = cut(split.withColumn("_id", F.monotonically_increasing_id()).withColumn("hit", F.coalesce(F.col("value").rlike(pattern), F.lit(False))).select("file", "split", "_id", F.when(F.col("hit"), F.col("value")).alias("value")))
    counts = read.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return read.where("value is not null").join(placed, ["file", "split"]).select("file", (F.col("before") + F.col("_id") - F.col("first") + 1).alias("line_no"), "value")


def typed_profile(df: DataFrame, first: int = 10, samples: int = 3) -> DataFrame:
    """Per column of text: rows, non-null and distinct values, the type that its `first` least values suggest, and some
    samples. Only that many values of a column are gathered."""
    melted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("v")) for c in df.columns])).alias("x")).select("x.*")
    counts = melted.groupBy("column_name").agg(F.count("*").alias("n_rows"), F.count("v").alias("non_null"), F.countDistinct("v").alias("distinct_values"))
    least = melted.where("v is not null").distinct().withColumn("k", F.row_number().over(Window.partitionBy("column_name").orderBy("v"))).where(F.col("k") <= first)
    whole, number = F.bool_and(F.col("v").rlike(r"^-?\d+$")), F.bool_and(F.col("v").rlike(r"^-?\d+(\.\d+)?$"))
    kind = F.when(whole, "INTEGER").when(number, "DECIMAL(10,2)").otherwise("VARCHAR")
    seen = least.groupBy("column_name").agg(kind.alias("suggested_type"), F.array_join(F.slice(F.array_sort(F.collect_list("v")), 1, samples), " | ").alias("samples"))
    return counts.join(seen, "column_name", "left").withColumn("suggested_type", F.coalesce("suggested_type", F.lit("VARCHAR")))


def full_model(df: DataFrame, path: str) -> DataFrame:
    """Recomputes and replaces at once; df may read the table that it replaces."""
    table = Snapshots(df.sparkSession, path)
    table.replace(df.withColumn(PART, F.lit(WHOLE)))
    return table.read(df.schema)


def time_range_model(source: DataFrame, path: str, day: str, start: str, end: str, lookback: int = 0) -> DataFrame:
    """Replaces the days from `lookback` before start to end at once, one part a day; days of the range without rows become
    empty, other days stay."""
    spark, table = source.sparkSession, Snapshots(source.sparkSession, path)
    low = F.date_sub(F.lit(start).cast("date"), lookback)
    fresh = source.where(F.col(day).between(low, F.lit(end).cast("date"))).withColumn(PART, F.col(day).cast("date").cast("string"))
    days = spark.range(1).select(low.alias("low"), F.lit(end).cast("date").alias("high")).where("low <= high").select(F.explode(F.sequence("low", "high")).alias("day"))
    table.replace(fresh, [str(r.day) for r in days.collect()])  # of the range, not of the table
    return table.read(T.StructType([*[f for f in source.schema if f.name != day], source.schema[day]]))


def newest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last()))).where("_n = 1").drop("_n")


def unique_key_model(target: DataFrame, source: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert in which the newest row of a key wins, of both sides; equal orders go to the source."""
    rows = target.withColumn("_side", F.lit(0)).unionByName(source.withColumn("_side", F.lit(1)))
    first = Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last(), F.col("_side").desc())
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_side")


def merged(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the merged table with what was done to each: UPDATE where any column differs, null-safe, INSERT, UNCHANGED;
    and DELETE, with the old row, for keys that the source lacks."""
    rest = [c for c in target.columns if c not in key]
    image = lambda df, name: df.select(*key, F.struct(*rest).alias(name))
    both = image(target, "old").join(image(source, "new"), key, "full")
    action = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(F.col("old").eqNullSafe(F.col("new")), "UNCHANGED").otherwise("UPDATE")
    return both.select(*key, F.explode(F.array(F.coalesce("new", "old"))).alias("row"), action.alias("_action")).select(*key, "row.*", "_action")


def action_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_action").agg(F.count("*").alias("n"))


def fact_rows(df: DataFrame, dimension: DataFrame, name: str, natural_key: list[str], order: str) -> DataFrame:
    """Facts with the surrogate id in place of the name; of a natural key the newest row counts."""
    ids = dimension.select(F.col("id").alias(f"{name}_id"), F.col("name").alias(name))
    return newest(df, natural_key, order).join(ids, name).drop(name)


def corpus_fingerprint(manifest: DataFrame, key: str = "doc_id", leaf: int = 500, depth: int | None = None) -> DataFrame:
    """One digest of a corpus from the digests of its documents: a tree over the hex digits of their own digests, of `depth`
    levels or, where that is None, deep enough that a leaf has about `leaf` lines; each node digests its sorted children.
    The lines of a leaf stream through its digest in order, so a leaf may have any number of them."""
    n = manifest.count()
    if depth is None:
        depth = max(1, math.ceil(math.log(max(n, 1) / leaf, 16))) if n > leaf else 1
    lines = manifest.select(F.substring("sha256", 1, depth).alias("at"), F.concat_ws(":", F.col(key).cast("string"), "sha256").alias("line"))
    rows = lines.repartition("at").sortWithinPartitions("at", "line").mapInArrow(leaf_digests, "at string, d string")
    for k in range(depth - 1, -1, -1):
        line = F.concat_ws(":", "at", "d").alias("line")
        node = rows.select("at", line).groupBy((F.substring("at", 1, k) if k else F.lit("")).alias("at"))
        rows = node.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"))
    if not n:
        rows = manifest.sparkSession.range(1).select(F.lit(None).cast("string").alias("d"))
    return rows.select(F.lit(n).cast("long").alias("documents"), F.col("d").alias("fingerprint"))


def leaf_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at and the digest of its lines, joined by line feeds, of rows in order of both; one digest is held at a time."""
    at = digest = None
    row = lambda: pa.RecordBatch.from_pydict({"at": [at], "d": [digest.hexdigest()]})
    for batch in batches:
        for name, line in zip(batch["at"].to_pylist(), batch["line"].to_pylist()):
            if name != at:
                if digest is not None:
                    yield row()
                at, digest = name, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
    if digest is not None:
        yield row()
