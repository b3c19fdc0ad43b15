"""Query of the SentencePiece codec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .sentencepiece_codec import Vocabulary, default_model, encode


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), Vocabulary.load(default_model()))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLES: dict[str, str] = {}
