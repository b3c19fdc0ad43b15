"""Registered queries do the whole job: plain Python over every row of small tables states the result."""

import datetime
import hashlib
import math
import random

import numpy as np
import pytest

from millrace.operators import cleansing, graph, models, semantics, statistics, supply
from millrace.plans import catalog
from millrace.streaming import streams

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A lineitem table of several components, most of its quantities far below 50; and its folder."""
    rng, rows = random.Random(5), []
    for k in range(400):
        group = rng.randrange(12)
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(300))
        rows.append((k, group * 10 + rng.randrange(4), group * 100 + rng.randrange(30), float(rng.randrange(1, 51)), day, rng.choice("RAN"), rng.choice("OF")))
    folder = str(tmp_path_factory.mktemp("lines"))
    schema = "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double, l_shipdate date, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    return folder, rows


def links(rows):
    return {(f"s{r[1]}", f"p{r[2]}") for r in rows}


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_of_all_pairs(spark, lines):
    folder, rows = lines
    found = [tuple(r) for r in catalog.QUERIES["n05_connected_components"](spark, folder).select("id", "component").collect()]
    assert len(set(components(links(rows)).values())) > 5
    assert sorted(found) == sorted(components(links(rows)).items())


def test_components_of_the_smallest_tables(spark):
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_partkey").collect()
    found = [tuple(r) for r in catalog.QUERIES["n05_connected_components"](spark, SMALL).select("id", "component").collect()]
    assert sorted(found) == sorted(components(links(rows)).items())


def test_trend_over_all_days(spark, lines):
    folder, rows = lines
    series = {}
    for r in rows:
        day = series.setdefault(r[6], {}).setdefault(r[4], [0, 0])
        day[0] += r[5] == "R"
        day[1] += 1
    expected = {}
    for name, days in series.items():
        rates = [days[d][0] / days[d][1] for d in sorted(days)]
        expected[name] = (len(rates), sum((v > u) - (v < u) for k, u in enumerate(rates) for v in rates[k + 1 :]))
    late = spark.createDataFrame([("x", i, 0.0 if i <= 210 else float(i)) for i in range(1, 261)], "series string, i int, rate double")
    found = {r["series"]: (r["n"], r["s"]) for r in catalog.QUERIES["a05_mann_kendall"](spark, folder).collect()}
    assert found == expected
    assert {(r["n"], r["trend"]) for r in statistics.mann_kendall(late, "i", "rate").collect()} == {(260, "increasing")}


def test_trend_days_are_not_cut(spark):
    days = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_linestatus", "l_shipdate").distinct().groupBy("l_linestatus").count().collect()
    found = {r["series"]: r["n"] for r in catalog.QUERIES["a05_mann_kendall"](spark, SMALL).collect()}
    assert found == {r["l_linestatus"]: r["count"] for r in days} and max(found.values()) > 200


def test_degrees_and_density_of_all_pairs(spark, lines):
    folder, rows = lines
    degree = {}
    for edge in links(rows):
        for x in edge:
            degree[x] = degree.get(x, 0) + 1
    found = {r["id"]: r["degree"] for r in catalog.QUERIES["n04_degree_centrality"](spark, folder).collect()}
    assert found == degree
    whole = catalog.QUERIES["n04_density"](spark, folder).first()
    assert (whole["nodes"], whole["edges"]) == (len(degree), len(links(rows)))


def test_ranks_of_all_pairs_after_ten_rounds(spark, lines):
    folder, rows = lines
    near = {}
    for a, b in links(rows):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    rank = dict.fromkeys(near, 1.0)
    for _ in range(10):
        before, rank = rank, dict.fromkeys(near, 0.0)
        for x, others in near.items():
            for y in others:
                rank[y] += before[x] / len(others)
    change = sum(abs(rank[x] - before[x]) for x in near) / len(near)
    found = catalog.QUERIES["n06_page_rank"](spark, folder).collect()
    assert {r["id"]: r["rank"] for r in found} == pytest.approx(rank, abs=2e-6)
    assert [r["avg_change"] for r in found] == pytest.approx([change] * len(near), abs=2e-6) and change > 0


def test_p_values_by_plain_integration():
    for df in (1, 2, 5, 30, 400):
        size = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        for t in (0.0, 0.3, 1.0, 2.5, 7.0):
            steps = 20000
            inside = sum((1 + (t * (k + 0.5) / steps) ** 2 / df) ** (-(df + 1) / 2) for k in range(steps)) * t / steps * size
            assert statistics.t_tail(t, df) == pytest.approx(1 - 2 * inside, abs=1e-6)


def test_trend_p_values(spark):
    rows = [("up", k, k + (k % 3)) for k in range(30)] + [("flat", k, (k * 7) % 5) for k in range(30)]
    days = spark.createDataFrame([(s, i, float(v)) for s, i, v in rows], "series string, i int, rate double")
    for op in (statistics.linear_trend, statistics.mann_kendall):
        found = {r["series"]: r["p_value"] for r in op(days, "i", "rate").collect()}
        assert found["up"] < 1e-3 and found["flat"] > 0.2


def test_fingerprint_of_a_deep_tree(spark):
    rows = [(k, f"text {k}") for k in range(60)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    at = [(sha(t), f"{k}:{sha(t)}") for k, t in rows]
    for depth in (2, 1, 0):
        groups = {}
        for key, line in at:
            groups.setdefault(key[:depth], []).append(line)
        at = [(k, f"{k}:{sha(chr(10).join(sorted(v)))}") for k, v in groups.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = models.corpus_fingerprint(cleansing.corpus_manifest(docs), leaf=1).first()
    assert (found["documents"], ":" + found["fingerprint"]) == (60, at[0][1])


def test_path_nodes(spark):
    edges = graph.undirected(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (7, 8)], "src long, dst long"))
    paths = graph.shortest_paths(edges, spark.createDataFrame([(0,)], "id long"))
    found = {r["node"]: r["path"] for r in graph.path_to(paths, spark.createDataFrame([(0, 3), (0, 2), (0, 0), (0, 8)], "source long, node long")).collect()}
    assert found == {3: [0, 4, 3], 2: [0, 1, 2], 0: [0]}


def test_exact_percentiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1.0, 2.5, float(rng.randrange(50))]), float(k)) for k in range(333)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = cleansing.order_statistics(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0])
    for k, c in enumerate("ab"):
        assert found[c] == pytest.approx(list(np.percentile([r[k] for r in rows if r[k] is not None], [0, 25, 50, 90, 100])))
    assert cleansing.order_statistics(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_metric_bindings(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert df.select(semantics.metric(df, "{x} + {y}", {"x": "a", "y": "b"}).alias("s")).first()["s"] == 3
    for bad in ({"x": "a"}, {"x": "a", "y": "b", "z": "a"}, {"x": "a", "y": "5"}):
        with pytest.raises(ValueError):
            semantics.metric(df, "{x} + {y}", bad)


def test_paths_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(24)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "id long")
    found = {r["node"]: r["distance"] for r in graph.shortest_paths(edges, start).collect()}
    assert found == {k: k for k in range(25)}
    with pytest.raises(ValueError):
        graph.shortest_paths(edges.where("dst <= 5"), start, max_depth=4)
    assert graph.shortest_paths(edges.where("dst <= 5"), start, max_depth=5).count() == 6


def test_levels_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(53)], "src long, dst long")
    nodes = spark.range(54)
    found = {r["id"]: r["level"] for r in graph.reference_levels(edges, nodes).collect()}
    assert found == {k: k for k in range(54)}
    with pytest.raises(ValueError):
        graph.reference_levels(edges.where("src <= 5"), nodes, max_depth=4)


def test_top_k_by_blocks_of_queries(spark):
    rng = random.Random(12)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(40)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    queries = vectors.where("id % 4 = 0")

    def cosine(a, b):
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 6)

    expected = set()
    for q, v in rows[::4]:
        best = sorted((-cosine(v, w), x) for x, w in rows if x != q)[:3]
        expected |= {(q, x, rank + 1) for rank, (_, x) in enumerate(best)}
    found = graph.cosine_top_k(vectors, queries, 3, block=3)
    assert {(r["query_id"], r["id"], r["rank"]) for r in found.collect()} == expected
    assert found.count() == len(expected) == 30


def test_pegs_by_plain_loop(spark):
    rng = random.Random(4)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(60))
    orders = [(k, rng.choice(["Open", "Closed", "Shipped"]), day()) for k in range(40)]
    lines = [(k, k % 40, rng.randrange(6), float(rng.randrange(1, 9)), rng.choice([day(), None])) for k in range(120)]
    supply_rows = [(k, rng.randrange(8), rng.choice(["closed", "released"]), float(rng.randrange(1, 9)), rng.choice([day(), None])) for k in range(150)]
    state, placed = {o[0]: o for o in orders}, {}
    used = set()
    for wo, part, status, quantity, due in sorted(supply_rows):
        ways = []
        for line, order, of, ordered, need in lines:
            if of == part:
                when = need or state[order][2]
                fits = (state[order][1] in ("Closed", "Shipped")) == (status == "closed")
                ways.append((line in used, not fits, abs(quantity - ordered), abs((when - due).days) if due else 9999, line))
        if ways:
            placed[wo] = min(ways)[-1]
            used.add(placed[wo])
    found = supply.best_match_pegs(
        spark.createDataFrame(supply_rows, "wo_id long, part_id long, status string, quantity double, required_date date"),
        spark.createDataFrame(lines, "order_line_id long, order_id long, part_id long, order_qty double, need_by_date date"),
        spark.createDataFrame(orders, "order_id long, status string, order_date date"),
    )
    assert {r["wo_id"]: r["order_line_id"] for r in found.collect()} == placed and len(placed) < len(supply_rows)


def test_change_queue_resumes(spark, tmp_path):
    schema, base = "k long, n long, op string", f"file://{tmp_path}/state"
    batches = [[(1, 1, "upsert"), (2, 2, "upsert")], [(1, 3, "delete"), (3, 4, "upsert")], [(1, 5, "upsert"), (2, 1, "upsert")]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/queue")
        queue = spark.readStream.schema(schema).parquet(f"{tmp_path}/queue")
        seen.append(sorted((r["k"], r["n"]) for r in streams.apply_changes(queue, "k", "n", "op", base).collect()))
    assert seen == [[(1, 1), (2, 2)], [(2, 2), (3, 4)], [(1, 5), (2, 2), (3, 4)]]
