"""Query of the hidden Markov language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import hidden_markov
from .common import table


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"))


QUERIES = {"op8_hidden_markov": op8_hidden_markov}
ORACLES: dict[str, str] = {}
