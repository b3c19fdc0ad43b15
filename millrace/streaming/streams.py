"""Streaming twins of the event-driven reports, by Structured Streaming over file sources.

State and outputs live in the cluster's shared folder (spark.checkpoint.dir; one of our own only where it is unset).
Windows run in append mode: the watermark closes them, drops what comes later, and bounds the state. Keyed tables and the
ledger are snapshots of hash buckets; a batch changes only the buckets of its keys, and its number is in the version that
it makes, so a batch that runs again changes nothing.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.window import Window

from millrace.functions.lineage import shared_folder
from millrace.operators import ledger
from millrace.sources.canonical import CANONICAL
from millrace.sources.snapshots import PART, Snapshots, bucket_of


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet file or folder at a path, with the schema that it has. As a glob, the path may be one
    file, which the source else refuses."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def canonical_events(events: DataFrame) -> DataFrame:
    """Ledger events of a stream of the events table."""
    return events.sparkSession.sql(CANONICAL["gl_events"], events=events)


class Progress(StreamingQueryListener):
    """What the batches of a query tell: rows observed under `name`, and groups dropped behind the watermark."""

    def __init__(self, name: str):
        self.name, self.rows, self.dropped, self.over = name, 0, 0, threading.Event()
        self.run, self.early = None, []

    def follow(self, run) -> None:
        """Takes up the events of a run; those that came before its number was known count too."""
        self.run = str(run)
        for event, take in self.early:
            take(event)
        self.early = []

    def _take(self, event, what) -> None:
        if self.run is None:
            self.early.append((event, what))
        else:
            what(event)

    def onQueryStarted(self, event) -> None:
        self.run = None

    def onQueryProgress(self, event) -> None:
        self._take(event, self._progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._take(event, self._terminated)

    def _progress(self, event) -> None:
        if str(event.progress.runId) == self.run:
            seen = event.progress.observedMetrics.get(self.name)
            self.rows += seen.n if seen else 0
            self.dropped += sum(x.numRowsDroppedByWatermark for x in event.progress.stateOperators)

    def _terminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.over.set()


#: A time that no event has; its row moves the watermark over all windows of a finite stream.
END = "2200-01-01 00:00:00"


def appended(stream: DataFrame, told: dict | None = None, end: str | None = None) -> DataFrame:
    """Runs a stream in append mode over what is there and returns all it wrote. end: the folder that under_watermark was
    given; once all rows are read the end goes there, which closes the last windows. told: gets `rows` that were observed
    (see counted), and `dropped` groups of late rows."""
    spark, base = stream.sparkSession, folder(stream.sparkSession)
    progress = Progress("rows")
    spark.streams.addListener(progress)
    try:
        for last in (False, True)[: 1 + bool(end)]:
            if last:
                spark.range(1).select(F.lit(END).cast("timestamp").alias("ts")).write.mode("append").parquet(end)
            progress.over.clear()
            query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).format("parquet").start(f"{base}/rows")
            progress.follow(query.runId)
            query.awaitTermination()
            progress.over.wait(60)
    finally:
        spark.streams.removeListener(progress)
    if told is not None:
        told.update(rows=progress.rows, dropped=progress.dropped)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def counted(rows: DataFrame) -> DataFrame:
    """Has the progress of a query count these rows."""
    return rows.observe("rows", F.count(F.lit(1)).alias("n"))


def under_watermark(rows: DataFrame, late: str, end: str | None) -> DataFrame:
    """Rows by event time `ts` under a watermark. end: a folder to which a finite stream's end is written."""
    if end:
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(end)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        rows = rows.unionByName(spark.readStream.schema(rows.schema).parquet(end))
    return rows.withWatermark("ts", late).where(F.col("ts") < F.lit(END).cast("timestamp"))


def daily_counters(events: DataFrame, late: str = "1 day", end: str | None = None) -> DataFrame:
    """Tumbling daily counts and sums by kind, once the watermark has closed the day; rows of closed days are dropped."""
    rows = under_watermark(counted(events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")), late, end)
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("w.start").cast("date").cast("string").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


EVENT = ["source_table", "source_id", "event_type"]


def run_batches(stream: DataFrame, base: str, merge, mode: str = "append") -> None:
    """Runs a stream over what is there; merge(batch, number) takes each batch that has rows."""

    def take(batch: DataFrame, k: int) -> None:
        batch.persist()
        if batch.limit(1).count():
            merge(batch, k)
        batch.unpersist()

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()


def parts_of(batch: DataFrame) -> list[str]:
    return [r[0] for r in batch.select(PART).distinct().collect()]  # a name a bucket


def posted_once(events: DataFrame, base: str | None = None, buckets: int = 32) -> DataFrame:
    """Ledger lines of a stream; an event key posts once, however late it comes again. The ledger is its own list of keys:
    a batch reads the key columns of the buckets of its keys, and adds its lines there. With a base folder a later call
    resumes; a batch whose number the ledger has is skipped."""
    spark, base = events.sparkSession, base or folder(events.sparkSession)
    fresh = canonical_events(events).where("amount > 0 and event_date is not null")
    schema, table = ledger.post_lines(fresh).schema, Snapshots(spark, f"{base}/ledger")

    def post(batch: DataFrame, k: int) -> None:
        if table.manifest()["note"].get("batch", -1) >= k:
            return
        named = batch.dropDuplicates(EVENT).withColumn(PART, bucket_of(EVENT, buckets))
        keys = table.read(schema, parts_of(named)).select(*EVENT)
        lines = ledger.post_lines(named.join(keys, EVENT, "left_anti").drop(PART)).withColumn(PART, bucket_of(EVENT, buckets))
        table.append(lines, {"batch": k})

    run_batches(fresh, base, post)
    return table.read(schema)


def job_balances(events: DataFrame) -> DataFrame:
    """Running work-in-process balance by job."""
    lines = ledger.post_lines(canonical_events(events).where("amount > 0 and event_date is not null")).where("ledger = 'WIP'")
    return lines.groupBy("job_id").agg(F.count("*").alias("postings"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("balance"))


def latest_state(stream: DataFrame, key: list[str], base: str | None = None, buckets: int = 32) -> DataFrame:
    """Runs a stateful aggregate over what is there and returns its last state: a batch's changed groups replace those of the
    same key in their buckets."""
    spark, base = stream.sparkSession, base or folder(stream.sparkSession)
    table = Snapshots(spark, f"{base}/state")

    def merge(batch: DataFrame, k: int) -> None:
        if table.manifest()["note"].get("batch", -1) >= k:
            return
        named = batch.withColumn(PART, bucket_of(key, buckets))
        parts = parts_of(named)
        old = table.read(stream.schema, parts).join(batch.select(*key), key, "left_anti").withColumn(PART, bucket_of(key, buckets))
        table.replace(named.unionByName(old), parts, {"batch": k})

    run_batches(stream, base, merge, "update")
    return table.read(stream.schema)


def apply_changes(queue: DataFrame, key: str, order: str, operation: str, base: str | None = None, buckets: int = 32, remember: int = 100) -> DataFrame:
    """A change queue to a keyed table: the latest change of a key counts, deletes remove. A batch rewrites the buckets of its
    keys and no others. A delete is kept for `remember` batches, so that an older change which comes behind it stays dead,
    and then goes when its bucket is next written. With a base folder a later call resumes."""
    spark, base = queue.sparkSession, base or folder(queue.sparkSession)
    table = Snapshots(spark, f"{base}/table")
    schema = T.StructType([*queue.schema, T.StructField("_batch", T.LongType())])

    def merge(batch: DataFrame, k: int) -> None:
        if table.manifest()["note"].get("batch", -1) >= k:
            return
        parts = parts_of(batch.withColumn(PART, bucket_of([key], buckets)))
        rows = table.read(schema, parts).unionByName(batch.withColumn("_batch", F.lit(k).cast("long")))
        newest = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_batch").desc())
        last = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        alive = last.where((F.col(operation) != "delete") | (F.col("_batch") > k - remember))
        table.replace(alive.withColumn(PART, bucket_of([key], buckets)), parts, {"batch": k})

    run_batches(queue, base, merge)
    return table.read(schema).where(F.col(operation) != "delete").drop("_batch")
