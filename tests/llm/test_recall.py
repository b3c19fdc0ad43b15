"""The decontamination's seeds lose no copy that a full alignment of every pair finds; long items are aligned in bounded arrays."""

import random

import numpy as np

from millrace.llm import decontaminate

SCHEMA = "doc_id long, text string"


def edited(some, words, vocabulary, weights, share):
    """A copy of words in which about this share is replaced, and a few words come or go."""
    out = []
    for w in words:
        r = some.random()
        if r < share:
            out.append(some.choices(vocabulary, weights)[0])
        elif r > 0.02 + share or r < share + 0.01:
            out.append(w)
        if some.random() < 0.01:
            out.append(some.choices(vocabulary, weights)[0])
    return out


def test_no_copy_is_lost_for_its_seeds(spark):
    some = random.Random(23)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "s", "t", "l", "x")]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]  # frequent words are very frequent
    words = lambda n: some.choices(vocabulary, weights, k=n)
    items = [words(some.choice([12, 25, 60])) for _ in range(100)]
    rows, pairs = [], []
    for k in range(400):
        item = k % len(items)
        rows.append((k, " ".join([*words(some.randint(0, 40)), *edited(some, items[item], vocabulary, weights, some.uniform(0.1, 0.35)), *words(some.randint(0, 40))])))
        pairs.append((k, item))
    docs = spark.createDataFrame(rows, SCHEMA)
    block = next(decontaminate.blocks_of(spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string"), 3, 1_000_000))
    found = {(t, block.item_ids[i]) for t, i, *_ in decontaminate.matches(block, decontaminate.rare_seeds(docs, block), [x.encode() for _, x in rows], 0.4)}
    place = {item: k for k, item in enumerate(block.item_ids)}
    numbers = [block.numbers([rows[k][1].encode()])[0] for k, _ in pairs]
    own = [block.items[place[i]] for _, i in pairs]
    scores, _ = decontaminate.align(decontaminate.padded(numbers, -1), decontaminate.padded(own, -2))
    copies = {pair for pair, score, item in zip(pairs, scores, own) if score >= 0.4 * len(item)}
    assert len(copies) > 350 and copies <= found


def test_groups_hold_few_cells():
    sizes = [1] * 1000 + [50] * 10 + [10_000]
    groups = list(decontaminate.groups_of(list(range(len(sizes))), sizes, 256))
    assert [x for g in groups for x in g] == list(range(len(sizes)))
    assert all(len(g) == 1 or len(g) * max(sizes[k] for k in g) <= 256 for g in groups)
    assert list(decontaminate.groups_of([], [], 256)) == []


def test_a_long_item_and_its_copy(spark):
    some = random.Random(2)
    item = [f"w{some.randint(0, 3000)}" for _ in range(6000)]
    rows = [(1, " ".join(item)), (2, " ".join(item[3000:])), (3, " ".join(item[:500]))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "short one here")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert set(found) == {(1, 7), (2, 7)} and found[1, 7] == 1.0 and abs(found[2, 7] - 0.5) < 0.01


def test_models_that_normalize_are_refused(tmp_path):
    """The public model with settings of a normalizer that changes texts: a table of characters, or blanks that go."""
    import pytest

    from millrace.llm import sentencepiece_codec as codec

    with open(codec.default_model(), "rb") as f:
        model = f.read()
    codec.check_normalizer(codec.default_model())
    for settings in (b"\x12\x01x", b"\x18\x00", b"\x20\x01", b"\x28\x00"):
        path = tmp_path / "other.model"
        spec = settings if settings[:1] == b"\x20" else settings + b"\x20\x00"
        path.write_bytes(b"".join([b"\x1a", bytes([len(spec)]), spec]) + model)  # the first one that is read counts
        with pytest.raises(ValueError):
            codec.Vocabulary.load(str(path))


def test_repeated_rows_teach_once(spark):
    from millrace.llm import quality_classifier

    some = random.Random(3)
    text = lambda good: " ".join(some.choices(["clear", "plain", "words", "about", "things"] if good else ["buy", "now", "!!!", "win", "$$$"], k=30))
    rows = [(k, text(k % 2)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    once = quality_classifier.train(spark.createDataFrame(rows, SCHEMA), labels)
    many = quality_classifier.train(spark.createDataFrame(rows * 5, SCHEMA).repartition(4), labels)
    assert np.array_equal(once.weights, many.weights)
