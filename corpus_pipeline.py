"""A training-corpus pipeline: each stage reads what the one before it wrote.

Defined cases: null and empty texts are no clean documents (the rules drop every text under 50 words); a null doc_id takes no
part in groups and so stays if its text is good; rows that share a doc_id are judged one by one by the classifier, the rules
and the decontamination, and share a group; labels that are null or disagree evenly teach nothing; with no labels, or none of
one class, the classifier keeps a text if its score is 0.5 or more; an empty table gives empty stages. Columns of documents
that are named like an operator's own pass through unread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, jaccard_join, quality_classifier, quality_rules, sentencepiece_codec
from millrace.llm.common import materialize, release, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier predicts as good."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the decision list, learned from the labels of all documents:
    those that the classifier rejected are what the rules have to learn from."""
    known = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = materialize(quality_rules.with_statistics(known).drop("text"), "stage-rules")  # the counts join labels, not the texts
    rules = quality_rules.learn(counts, table(spark, sf_dir, "labels"))
    release(counts)
    return quality_rules.filter_kept(docs, rules)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of at least 0.8 over five-word shingles."""
    return jaccard_join.keep_one(docs, 5, 80, 100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a passage of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token counts and token ids of every document that is left."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.Vocabulary.load(sentencepiece_codec.default_model()))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", encode),
]
#: SQL can't express the fitted classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over the Parquet that the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{k}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
