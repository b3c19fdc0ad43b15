"""Collocations, hard negatives and packing: against plain loops on small and odd tables."""

import bisect
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import best_fit_packing, collocations, hard_negatives

DOCS = "doc_id long, text string, lang string, rank string, h string, k long"


def texts(seed=5, n=60):
    """Documents of few words, some with a passage that all share; odd ones among them."""
    some = random.Random(seed)
    words = ["a", "b", "the", "É", "x\x00", "w" * 90, "c", "d", "ΣΣ", "e"]
    rows = []
    for k in range(n):
        body = "".join(some.choices(words, [9, 7, 6, 1, 1, 1, 3, 3, 1, 1])[0] + some.choice([" ", " ", " ", "\t", ", ", ".\n"]) for _ in range(some.randint(0, 40)))
        rows.append((k, body + ("One long passage that Every text repeats" if k % 3 else "a b a b"), some.choice(["en", "fr", None, "und"]), "r", "h", k))
    return rows + [(1, None, "en", None, None, None), (None, "", None, None, None, None), (7, "a b", "", None, None, None), (7, "the the the the the the the " * 3000, "en", None, None, None)]


def plain_collocations(rows, least, most):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang, text = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(mark, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in often.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    inside[p[k : k + size]] = max(inside[p[k : k + size]], a)
        found = []
        for p, a in often.items():
            if 100 * inside[p] < 80 * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize("dictionary", [collocations.DICTIONARY, 4, 0])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_collocations_by_plain_counts(spark, dictionary, batch):
    """Whatever the dictionary, and wherever the batches that the sums read end."""
    rows = texts()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(3), 4, 25, dictionary=dictionary).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found) == plain_collocations(rows, 4, 25)


def test_paths_of_repeated_passages(spark):
    """The passage of seven words is a unary path: of its phrases none of two or three words stays, and the path has its length."""
    rows = [(k, "Zz one long passage that every text repeats" if k % 2 else "one long passage that every text repeats", "en", "", "", 0) for k in range(40)]
    found = {r.phrase: r for r in collocations.collocations(spark.createDataFrame(rows, DOCS), 4, 50).collect()}
    assert found["that every text repeats"].path_words == 7 and found["one long passage that"].a == 40
    assert not any(len(p.split()) < 4 for p in found)


def test_collocations_without_words(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", "", 0), (2, " ;", "en", "", "", 0)], DOCS)).collect() == []


def test_scores_whose_products_pass_64_bits(spark):
    rows = [(10**17 + 3, 10**18, 3 * 10**18 + 7), (999_999_999_999_999_999,) * 3, (30, 30, 31)]
    found = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.floored_score("a", "l", "r").alias("s")).collect()
    assert all(r.s == 2_000_000 * r.a // (r.l + r.r) for r in found)


def plain_negatives(rows, every=100, positives=5, negatives=10):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256.0 * x) for x in v)

    good = [(i, label, [math.floor(256.0 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and usable(v)]
    anchors, out = {}, []
    for i, label, v in sorted(good):
        if i % every == 0:
            anchors.setdefault(i, (label, v))
    for i, (label, v) in anchors.items():
        scored = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, other) for j, other, w in good if j != i]
        best = sorted(((-s, j) for s, j, other in scored if other == label))[:positives]
        for p, j in best:
            hard = sorted((-s, n) for s, n, other in scored if other != label and 30 * -p <= 100 * s <= 90 * -p)[:negatives]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n) in enumerate(hard)]
    return sorted(out)


def vectors(seed, n, scale=1.0):
    some = random.Random(seed)
    rows = []
    for k in range(n):
        v = [some.gauss(0.3, 0.4) * scale for _ in range(8)]
        rows.append((k * 10 - 300, v, some.randint(0, 3)))
    return rows


ODD = [(5, None, 1), (6, [0.1, None, 1.0], 1), (8, [float("nan")] * 8, 0), (9, [float("inf")] * 8, 0), (11, [1.0, 2.0], 2), (12, [], 2), (None, [0.5] * 8, 1), (13, [0.5] * 8, None), (14, [0.5] * 8, 0), (14, [0.5] * 8, 0), (15, [0.5] * 9, 1), (200, [0.2] * 8, 1), (200, [0.2] * 8, 1), (300, [0.4] * 8, 3), (300, [0.1] * 8, 2)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e16])
@pytest.mark.parametrize("block", [1024, 3])
def test_negatives_by_plain_search(spark, scale, block):
    rows = vectors(3, 120, scale) + ODD
    docs = spark.createDataFrame([(*r, "s") for r in rows], "vec_id long, embedding array<double>, label int, score string").repartition(3)
    found = hard_negatives.mine(docs, block=block).collect()
    assert sorted(map(tuple, found)) == plain_negatives(rows)


def test_negatives_of_copies(spark):
    """Half of the rows are one vector with labels that alternate: ties go to the smaller id."""
    rows = vectors(4, 60) + [(1000 + k, [0.3] * 8, k % 2) for k in range(60)]
    found = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    assert sorted(map(tuple, found)) == plain_negatives(rows)


def test_negatives_without_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], schema)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1)], schema)).collect() == []


def plain_best_fit(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        if at == len(rooms):
            n, room = n + 1, capacity
        else:
            room = rooms.pop(at)
        bisect.insort(rooms, room - x)
    return n, sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_runs_are_best_fit_decreasing(seed):
    """Runs give the number of sequences and the rooms that one placing after another gives, without gaps or overlaps."""
    some = random.Random(seed)
    capacity = some.choice([1, 7, 16, 60, 100, 2048])
    lengths = [some.randint(1, capacity) if some.random() < 0.7 else max(1, capacity // 3) for _ in range(some.randint(0, 400))]
    placed = defaultdict(list)
    runs = best_fit_packing.best_fit(dict(Counter(lengths)), capacity)
    for length, first, n, sequence, each, offset in runs:
        for r in range(n):
            placed[sequence + r // each].append((offset + r % each * length, length))
    for row in placed.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(x for row in placed.values() for _, x in row) == sorted(lengths)
    assert (len(placed), sorted(capacity - sum(x for _, x in row) for row in placed.values())) == plain_best_fit(lengths, capacity)
    for length in set(lengths):
        assert sorted(k for x, first, n, *_ in runs if x == length for k in range(first, first + n)) == list(range(lengths.count(length)))


def test_tightest_room():
    tree, some, open_rooms = best_fit_packing.Tightest(37), random.Random(1), set()
    for _ in range(500):
        room = some.randint(0, 37)
        (open_rooms.discard if room in open_rooms else open_rooms.add)(room)
        tree.set(room, room in open_rooms)
        wanted = some.randint(1, 37)
        assert tree.at_least(wanted) == min((x for x in open_rooms if x >= wanted), default=None)


TEXTS = [None, "", "  ", "a", "don't stop it's 3.14%", "<|endoftext|>x <|startoftext|>", "é é ÀÉ×÷ ñ", "x≠y ≠", "Σας ΟΔΟΣ İstanbul",
         "12ab34 foo_bar--baz", "\x00a\x1cb nb em !\x7f!", "日本語 가가", "ß straße þ,ÿ;", "'s 'tis rock'n'roll I'LL", "#$%^ &*()", "ＡＢ", "long words " * 5000, "y" * 30_000]


def test_pieces_of_odd_texts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(best_fit_packing.default_tokenizer())
    rows = [(k, x, "p") for k, x in enumerate(TEXTS)] + [(3, "a", "p"), (None, "b b", "p")]
    found = best_fit_packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3), capacity=64).collect()
    want = []
    for doc_id, x, _ in rows:
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((doc_id, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r)[:5] for r in found) == order(want)
    filled = defaultdict(list)
    for r in found:
        filled[r.sequence_id].append((r.offset, r.length))
    assert all(sum(x for _, x in row[:k]) == row[k][0] for row in map(sorted, filled.values()) for k in range(len(row)))
    assert len(filled) == plain_best_fit([r.length for r in found], 64)[0]


def test_packing_of_equal_documents(spark):
    """One length that all documents have, in several tasks: 3 tokens each, so 682 documents a sequence."""
    found = best_fit_packing.pack(spark.range(2000).selectExpr("id as doc_id", "'same text' as text").repartition(4)).collect()
    assert len(found) == 2000 and len({r.sequence_id for r in found}) == -(-2000 // 682) and len({(r.sequence_id, r.offset) for r in found}) == 2000


def test_packing_without_documents(spark):
    assert best_fit_packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_tokenizers_read_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = best_fit_packing.Encoder(open(path).read(), 0)
    ids, at = encoder.encode([b"two  words", None, b"x"])
    assert not encoder.by_words and at.tolist()[0] == 0 and ids[: at[1] - 1].tolist() == Tokenizer.from_file(path).encode("two  words", add_special_tokens=False).ids
