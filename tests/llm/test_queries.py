"""The corpus queries themselves on small tables: against their SQL where they have some, else against plain loops; and the
pipeline, stage by stage."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm import decontaminate, hidden_markov, jaccard_join, quality_classifier, quality_rules, registry, sentencepiece_codec
from millrace.sources.canonical import STAR

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{float(value):.6g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in STAR:
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    found, result = registry.QUERIES[name](spark, SMALL), con.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    assert set(columns) <= set(found.columns)
    at = [[c[0] for c in result.description].index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in result.fetchall())


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def test_all_queries_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in registry.QUERIES} and "pipeline" in entry.queries()


def test_tokens_of_all_documents(spark):
    import sentencepiece

    library, texts = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model()), documents(spark)
    rows = registry.QUERIES["op2_sentencepiece"](spark, SMALL).collect()
    assert {r.doc_id: r.token_ids for r in rows} == {k: library.encode(t) for k, t in texts.items()}
    assert all(r.path_score < 0 for r in rows if r.n_tokens)


def test_rules_verdict_by_plain_rules(spark):
    """base_failed and kept from the counts of the query's own rows, by the rules that it learned."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    stats = corpus_pipeline.materialize(quality_rules.with_statistics(docs.select("doc_id", "text")).drop("text"), "test-rules")
    rules, counts = quality_rules.learn(stats, labels), {r.doc_id: r for r in stats.collect()}

    def share(r, name):
        a, b = quality_rules.FEATURES[name]
        return 1000 * r[a] // r[b] if r[b] > 0 else 0

    for r in registry.QUERIES["op7_quality_rules"](spark, SMALL).collect():
        row = counts[r.doc_id]
        failed = row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words
        first = next((k for k, rule in enumerate(rules.rules, 1) if all((share(row, c.feature) >= c.threshold) == c.at_least for c in rule)), None)
        assert (r.base_failed, r.rule, r.kept) == (failed, first, not failed and first is None)


def test_language_model_beats_the_unigram_base(spark):
    rows = [r for r in registry.QUERIES["op8_hidden_markov"](spark, SMALL).collect() if r.held_out and r.n_tokens > 20]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_classifier_by_a_plain_solver():
    """Dual coordinate descent reaches the least hinge loss that subgradient steps find."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(80):
        y = k % 2
        rows.append(np.unique(np.concatenate([rng.choice(20, 6) + 20 * y, rng.choice(40, 4)])))
        labels.append(float(y))
    labels = np.array(labels)
    ratios = quality_classifier.log_count_ratios(rows, labels)
    for j in range(45):  # the ratios by counting
        p, q = ((sum(j in x for x, y in zip(rows, labels) if y == c) + 1) / ((labels == c).sum() + 1) for c in (1, 0))
        assert ratios[j] == pytest.approx(math.log(p / q))
    w, b = quality_classifier.dual_coordinate_descent(rows, ratios, labels, 1.0, 200, 7)
    x = np.zeros((80, 41))
    for k, r in enumerate(rows):
        x[k, r] = ratios[r] / math.sqrt(len(r))
    x[:, 40] = 1.0
    signs = np.where(labels == 1, 1.0, -1.0)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - signs * (x @ v)).sum()
    v, best = np.zeros(41), math.inf
    for k in range(1, 30000):
        v = v - (v - x.T @ (signs * (signs * (x @ v) < 1))) / (k + 10)
        best = min(best, loss(v))
    assert loss(np.append(w[:40], b)) <= best * 1.01


def test_seeds_and_pairs_by_brute_force(spark):
    """Every pair that a plain alignment of whole texts scores high enough is found, and no other."""
    rng = random.Random(8)
    words = [a + b for a in "bdfgk" for b in ("ara", "eto", "ini", "oso", "uvu")]
    items = [(k, " ".join(rng.choices(words, k=25))) for k in range(6)]
    texts = [(k, " ".join(rng.choices(words, k=60))) for k in range(10)]
    for k, (_, t) in enumerate(items):
        w = t.split()
        texts.append((100 + k, " ".join(rng.choices(words, k=9) + w[: 20 - 3 * k] + rng.choices(words, k=9))))
        edited = [x if rng.random() > 0.12 else "other" for x in w]
        texts.append((200 + k, " ".join(rng.choices(words, k=5) + edited)))

    def score(a, b):
        row, best = [0.0] * (len(a) + 1), 0.0
        for y in b:
            new = [0.0]
            for j, x in enumerate(a, 1):
                new.append(max(0.0, row[j - 1] + (1 if x == y else -0.5), row[j] - 0.5, new[j - 1] - 0.5))
            row, best = new, max(best, *new)
        return best / len(b)

    want = {(d, i): score(t.split(), x.split()) for d, t in texts for i, x in items}
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, bench, least=0.4).collect()}
    clear = {k for k, s in want.items() if s >= 0.4}
    assert clear == found.keys() and all(found[k] == pytest.approx(want[k]) for k in clear) and len(clear) >= 10
    block = next(decontaminate.blocks_of(bench, 3, 1_000_000))
    seeds = decontaminate.rare_seeds(docs, block)
    counts = Counter(w for _, t in texts for w in t.split())
    names = {v: w for w, v in block.words.items()}
    for k, item in enumerate(block.items):
        keys = {key for key, where in enumerate(block.where) for i, _ in where if i == k}
        rarity = {key: sum(math.log(1 + counts[names[x]]) for i, q in block.where[key] if i == k for x in [*item[q : q + 3]][:3]) for key in keys}
        chosen = {key for key in keys if seeds[key]}
        rest = [rarity[key] for key in keys - chosen]
        assert len(chosen) >= min(len(keys), decontaminate.MIN_SEEDS) and (not rest or max(rest) >= min(rarity[key] for key in chosen))


WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "pe", "ru") for b in ("ra", "to", "ni", "su", "", "vel", "xa")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents with every odd row, a column that clashes, labels with nulls and ties, and a benchmark."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(k, text(90)) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(12)]  # copies
    rows += [(200 + k, rows[20 + k][1].replace(" ", " zz ", 1)) for k in range(8)]  # near copies
    items = [(k, " ".join(rng.choice(WORDS) + rng.choice("qw") for _ in range(30))) for k in range(4)]
    rows += [(300 + k, text(60) + " " + items[k][1] + " " + text(40)) for k in range(4)]  # leaks
    rows += [(400 + k, " ".join("##" + w.upper() + "$$" for w in text(80).split())) for k in range(40)]  # bad
    rows += [(500, None), (501, ""), (502, " \n"), (503, text(5)), (None, text(80)), (5, rows[5][1]), (504, text(4000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, quality int")
    labels = [(i, int(i < 400), 0) for i, _ in rows if i is not None and i % 2 == 0 and i < 500] + [(None, 1, 0), (3, None, 0), (7, 0, 0), (7, 1, 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs.coalesce(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_pipeline_by_brute_force(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, columns = [x for x, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["quality classifier", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), f"test-{k}")
        if k < 4:
            assert docs.columns == columns
            have, had = (Counter((r.doc_id, r.text, r.quality) for r in x.collect()) for x in (docs, before))
            assert have <= had
            kept.append(have)
    ids = [{i for i, _, _ in x} for x in kept]
    assert not ids[0] & set(range(400, 440)) and set(range(60)) <= ids[0]  # bad ones go, clean ones stay
    assert ids[1] == {i for i, t, _ in kept[0] if len((t or "").split()) >= 50}
    texts = defaultdict(set)
    for i, t, _ in kept[1]:
        texts[i] |= {t}
    sets = [(i, shingles(t)) for i, ts in texts.items() if i is not None for t in ts]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a < b and 100 * len(s & t) >= 80 * len(s | t):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert ids[2] == {i for i in root if find(i) == i} | {None} and not ids[2] & set(range(100, 112)) and not ids[2] & set(range(200, 208))
    assert ids[3] == ids[2] - {300, 301, 302, 303}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    got = sorted(((r.doc_id, r.token_ids) for r in docs.collect()), key=str)
    assert got == sorted(((i, library.encode(t)) for (i, t, _), n in kept[3].items() for _ in range(n)), key=str)


def test_pipeline_of_no_documents(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, quality int, n_tokens string, component_id string, words string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    vocabulary = sentencepiece_codec.Vocabulary.load(sentencepiece_codec.default_model())
    assert sentencepiece_codec.encode(empty, vocabulary).count() == 0
    assert quality_classifier.score(empty, quality_classifier.train(empty, labels)).count() == 0
    odd = spark.createDataFrame([(k, f"ba do ki lu {k} me no", 9, "a", "b", "c") for k in range(30)], empty.schema)
    ties = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(k, 1 - k % 2) for k in range(30)], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.score(odd, quality_classifier.train(odd, ties)).collect()} == {0.5}
    assert sentencepiece_codec.encode(odd, vocabulary).count() == 30 and jaccard_join.groups(odd).count() == 30
    assert hidden_markov.score(odd, states=2, rounds=1).count() == 30


def test_dated_lists_of_no_rows(spark):
    from millrace.llm import temporal_lists

    entries = spark.createDataFrame([], "pattern string, verdict string, since date")
    captures = spark.createDataFrame([(1, "http://a.com/x", None, "z")], "page_id long, url string, fetched date, verdict string")
    assert temporal_lists.evaluate(captures.limit(0).drop("verdict"), entries).count() == 0
    assert [r.verdict for r in temporal_lists.evaluate(captures.drop("verdict"), entries).collect()] == ["none"]
    assert zlib.crc32(b"1") % 3 in (0, 1, 2)
