"""Query of the best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import best_fit_packing
from .common import table


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {"op13_best_fit_packing": op13_best_fit_packing}
ORACLES: dict[str, str] = {}
