"""Tables in a shared folder whose new state appears at once: what the materialized models and the streaming sinks write to.

A table is a set of named parts (a day, a hash bucket, or the one part of a table that is replaced whole). A writer puts
the rows of the parts that it changes beside those that are there, and then renames a small manifest, which lists the
folders of every part, to the next version. Readers take the newest manifest. A driver or executor lost before the rename
leaves the old version, and what it had written is deleted with the versions that nobody reads any more. One writer at a
time: the rename fails if the version is there already.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"
WHOLE = "all"


def bucket_of(key: list[str], buckets: int) -> Column:
    """The part of a key: one of so many hash buckets."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("string")


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._files.listStatus(at)] if self._files.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self._names("manifests") if x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """parts: folders by part; note: what the writer of the version left there."""
        known = self.versions()
        if version is None and not known:
            return {"version": -1, "parts": {}, "note": {}}
        lines = self.spark.read.text(f"{self.path}/manifests/{known[-1] if version is None else version}.json", wholetext=True).first()
        return json.loads(lines[0])

    def read(self, schema: T.StructType, parts: list[str] | None = None) -> DataFrame:
        """The rows of the newest version; of some parts only, if named."""
        has = self.manifest()["parts"]
        folders = [f"{self.path}/{x}" for p in (has if parts is None else parts) for x in has.get(p, [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Writes rows by their column PART into new folders, a task for each part's rows; readers don't see them yet."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        return {x.split("=", 1)[1]: [f"{folder}/{x}"] for x in self._names(folder) if x.startswith(f"{PART}=")}

    def commit(self, before: dict, parts: dict[str, list[str]], note: dict) -> None:
        """Makes these parts the next version."""
        version = before["version"] + 1
        beside = self._path(f"{self.path}/manifests/{uuid.uuid4().hex}.new")
        out = self._files.create(beside)
        out.write(bytearray(json.dumps({"version": version, "parts": parts, "note": note}).encode()))
        out.close()
        at = self._path(f"{self.path}/manifests/{version}.json")
        if self._files.exists(at) or not self._files.rename(beside, at):
            raise RuntimeError(f"version {version} of {self.path} was written by another writer")

    def replace(self, rows: DataFrame, parts: list[str] | None = None, note: dict | None = None, keep: int = 2) -> None:
        """New rows for the named parts, which else become empty; other parts stay. None: the table is these rows."""
        before = self.manifest()
        stay = {p: x for p, x in before["parts"].items() if parts is not None and p not in parts}
        new = self.write(rows)
        self.commit(before, {**stay, **new}, note or {})
        self.forget(keep)

    def append(self, rows: DataFrame, note: dict | None = None, keep: int = 2, most: int = 32) -> None:
        """Adds rows to their parts. A part of over `most` folders is written anew, as one, with the next version."""
        before = self.manifest()
        parts = dict(before["parts"])
        for p, x in self.write(rows).items():
            parts[p] = parts.get(p, []) + x
        if many := {p: x for p, x in parts.items() if len(x) > most}:
            schema = T.StructType([f for f in rows.schema if f.name != PART])
            merged = None
            for p, x in many.items():
                one = self.spark.read.schema(schema).parquet(*[f"{self.path}/{y}" for y in x]).withColumn(PART, F.lit(p))
                merged = one if merged is None else merged.union(one)
            parts.update(self.write(merged))
        self.commit(before, parts, note or {})
        self.forget(keep)

    def forget(self, keep: int) -> None:
        """Deletes all but the last `keep` versions, and folders that none of these lists."""
        known = self.versions()
        used = {x for v in known[-keep:] for folders in self.manifest(v)["parts"].values() for x in folders}
        for v in known[:-keep]:
            self._files.delete(self._path(f"{self.path}/manifests/{v}.json"), False)
        for top in self._names("data"):
            if not any(x.startswith(f"data/{top}/") for x in used):
                self._files.delete(self._path(f"{self.path}/data/{top}"), True)
            else:
                for name in self._names(f"data/{top}"):
                    if name.startswith(f"{PART}=") and f"data/{top}/{name}" not in used:
                        self._files.delete(self._path(f"{self.path}/data/{top}/{name}"), True)
