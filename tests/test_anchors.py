"""Best terms by token overlap, with tokens that most terms and texts have, against a plain loop."""

import random
import re

import pytest

from millrace.operators import graph


@pytest.mark.parametrize("often", [2, 5, 1000])
def test_anchors_by_plain_loop(spark, often):
    some = random.Random(7)
    words = ["all", "most", "some", *[f"w{k}" for k in range(25)]]
    draw = lambda: " ".join(["all"] * (some.random() < 0.9) + ["most"] * (some.random() < 0.7) + some.choices(words, k=some.randint(0, 4)))
    terms = [(k, draw(), draw() if some.random() < 0.5 else None) for k in range(40)] + [(90, None, None), (91, "All!", "all")]
    texts = [(k, draw()) for k in range(60)] + [(98, None), (99, "nothing known"), (100, "ALL, all")]
    cut = lambda x: {t for t in re.split(r"[^\w]+", (x or "").lower()) if t}
    want = set()
    for t, text in texts:
        scores = {k: 2 * len(cut(text) & cut(term)) + len(cut(text) & cut(more)) for k, term, more in terms}
        top = max(scores.values())
        want |= {(t, k, v) for k, v in scores.items() if v == top and v >= 2}
    found = graph.token_anchors(spark.createDataFrame(terms, "term_id int, term string, definition string"), spark.createDataFrame(texts, "text_id int, text string"), 2, often)
    assert {(r.text_id, r.term_id, r.score) for r in found.collect()} == want


def test_a_token_of_all_texts_and_terms_makes_no_pair_of_each(spark):
    terms = spark.range(3000).selectExpr("id as term_id", "concat('all t', id) as term")
    texts = spark.range(3000).selectExpr("id as text_id", "concat('all t', id) as text")
    found = graph.token_anchors(terms, texts, 2, 100)
    assert found.where("text_id = term_id and score = 4").count() == 3000 == found.count()
