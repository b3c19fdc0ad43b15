"""The fixity audit at both ends of the long range, with null ids, and without a record-level join before ranges are known."""

import random

from millrace.llm import warc_audit

SCHEMA = "page_id long, url string, html string, digest string"


def pages(ids, mark=""):
    return [(i, f"http://h/{i}", f"text {i} {'x' * (i % 997 if i else 3)}{mark}", "z") for i in ids]


def found(spark, a, b):
    rows = warc_audit.audit(spark.createDataFrame(a, SCHEMA).repartition(3), spark.createDataFrame(b, SCHEMA), 10, 2048).collect()
    return {(r.page_id, r.kind) for r in rows}


def test_ids_of_any_size(spark):
    some, top = random.Random(4), 2**63 - 1
    ids = [some.randint(-top - 1, top) for _ in range(200)] + [top - k for k in range(40)] + [-top - 1 + k for k in range(40)] + list(range(-30, 30))
    ids = sorted(set(ids))
    altered, missing = set(ids[5::37]), set(ids[9::41])
    extra = [ids[-1] - 1000, ids[0] + 1000, 2**53 + 1]
    other = [*pages([i for i in ids if i not in altered and i not in missing]), *pages([i for i in altered if i not in missing], "!"), *pages(extra)]
    want = {(i, "altered") for i in altered - missing} | {(i, "missing") for i in missing} | {(i, "extra") for i in extra if i not in ids}
    assert found(spark, pages(ids), other) == want
    assert found(spark, pages(ids), pages(ids)) == set()


def test_null_ids_are_told_apart_by_content(spark):
    nameless = [(None, f"u{k % 5}", f"{k % 50}", "z") for k in range(200)]
    assert found(spark, pages(range(20)) + nameless, pages(range(20)) + nameless[::-1]) == set()
    lost = [r for k, r in enumerate(nameless) if k != 7]
    assert found(spark, pages(range(20)) + nameless, pages(range(20)) + lost) == {(None, "missing")}


def test_ranges_come_from_boundaries(spark):
    """The replica's records get their ranges from a window by file over the ranges' first records; nothing joins there."""
    a = warc_audit.with_offsets(warc_audit.records(spark.createDataFrame(pages(range(100)), SCHEMA), 10), 512)
    starts = a.groupBy(*warc_audit.FILE, "range_no").agg({"id": "min"}).withColumnRenamed("min(id)", "id").selectExpr("*", "1 as nth")
    placed = warc_audit.in_ranges(warc_audit.records(spark.createDataFrame(pages(range(0, 100, 3)), SCHEMA), 10), starts)
    assert "Join" not in placed._jdf.queryExecution().executedPlan().toString()
    own = {r.id: r.range_no for r in a.collect()}
    assert {r.id: r.range_no for r in placed.collect()} == {i: own[i] for i in range(0, 100, 3)}
