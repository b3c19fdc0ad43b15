"""Queries of the quality classifier and the quality rules, and the SQL that states the latter's base statistics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_classifier, quality_rules
from .common import crc_mod, materialize, table


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialize(quality_rules.with_statistics(docs).drop("text"), "rules-stats")
    rules = quality_rules.learn(stats, table(spark, sf_dir, "labels"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"), rules.kept().alias("kept"), rules.fired().alias("rule"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op7_quality_rules": op7_quality_rules, "op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
