"""Keywords by an automaton against a plain search, and the line numbers of files that are read in several splits."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import keywords
from millrace.operators import graph, models

KINDS = [keywords.Automaton] + ([keywords.Compiled] if keywords.ahocorasick else [])


@pytest.mark.parametrize("kind", KINDS)
def test_first_keyword_by_plain_search(kind):
    some = random.Random(6)
    for _ in range(300):
        words = ["".join(some.choices("abé", k=some.randint(0 if some.random() < 0.05 else 1, 5))) for _ in range(some.randint(0, 12))]
        automaton = kind(words)
        for _ in range(10):
            text = "".join(some.choices("abéc", k=some.randint(0, 20)))
            assert automaton.first(text) == next((n for n, w in enumerate(words) if w in text), None)


def test_ten_thousand_keywords_are_one_expression(spark):
    texts = spark.createDataFrame([("xx k00123z and k00045z",), ("none here",), (None,), ("K09999Z",)], "text string")
    few, many = ([(f"k{n:05d}z", f"r{n % 7}") for n in range(m)] for m in (10, 10_000))
    assert [r.route for r in graph.route_by_keyword(texts, many).collect()] == ["r3", "OUT_OF_SCOPE", "OUT_OF_SCOPE", f"r{9999 % 7}"]
    size = lambda routes: len(graph.route_by_keyword(texts, routes)._jdf.queryExecution().toString())
    assert size(many) < 1.1 * size(few)


def test_line_numbers_over_splits(spark, tmp_path):
    some = random.Random(9)
    want = set()
    for name in ("a.log", "b.log", "empty.log"):
        lines = [f"{some.choice(['ERROR', 'INFO', ''])} {'x' * some.randint(0, 60)} {k}" if some.random() < 0.9 else "" for k in range(0 if name == "empty.log" else 2000)]
        (tmp_path / name).write_text("\n".join(lines) + "\n" * (name == "a.log"))
        want |= {(name, k + 1, x) for k, x in enumerate(lines) if x.startswith("ERROR")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = models.numbered_lines(spark, str(tmp_path), "^ERROR")
        splits = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_block_start")).distinct().count()
        found = {(r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits > 5 and found == want
