"""Cutting lineage in iterative operators, in a form that survives lost executors; and dealing rows into tasks that don't
grow with the input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Bytes of the files that are read for one partition of what is dealt.
DEALT_BYTES = 12_000_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset a local session gets a folder of its own;
    on a cluster that raises, as executors and driver don't see each other's local folders."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it."""
    spark = df.sparkSession
    path, schema = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing that is still to run reads it."""
    for df in frames:
        if path := getattr(df, "_written_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the keys, into more partitions than spark.sql.shuffle.partitions if it reads large files: what a task
    sorts or groups is held in memory, and would grow with the input if their number stayed. Tables whose size Spark
    doesn't know don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    n = -(-sum(x for x in sizes if x < 1 << 60) // DEALT_BYTES)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)
