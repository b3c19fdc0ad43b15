"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import license_scan
from .common import table


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES: dict[str, str] = {}
