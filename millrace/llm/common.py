"""What the corpus operators share: table access, materialization in the shared folder, and the word rules of the contracts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.lineage import cut as materialize
from millrace.functions.lineage import release

#: ASCII white space; `bytes.split()` splits at exactly these bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]"
__all__ = ["as_bytes", "chunks", "crc_mod", "crc_mod_py", "materialize", "release", "table", "words_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(texts: list[bytes | None], size: int = 4_000_000) -> Iterator[list[bytes | None]]:
    """Runs of texts of about `size` bytes; the text that reaches it ends the run."""
    begin = total = 0
    for k, x in enumerate(texts):
        total += len(x or b"")
        if total >= size:
            yield texts[begin : k + 1]
            begin, total = k + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space, as the contracts for words ask; other letters stay as they are."""
    return text.lower().split() if text else []


def crc_mod(doc_id, n: int):
    """crc32 of doc_id written as text, modulo n, as a column."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def crc_mod_py(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def as_bytes(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and the text as bytes: Arrow then hands over UTF-8 without decoding it."""
    return df.select(*keep, F.col(text).cast("binary").alias("text"))
