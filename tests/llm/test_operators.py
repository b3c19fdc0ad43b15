"""Corpus operators against brute force, round trips and edge rows: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import chat_template, decontaminate, hidden_markov, jaccard_join, license_scan, quality_classifier, quality_rules, sentencepiece_codec, temporal_lists, warc_audit
from millrace.llm.queries_chat import DIGESTS, _arrow, digest

random.seed(3)
WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no") for b in ("ra", "to", "ni", "su", "", "vel")]
text = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
SCHEMA = "doc_id long, text string, n_words string, score string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_template_folds_and_escapes():
    nodes = chat_template.fold(chat_template.parse("{{ 'a' + 'b' }}c{% if 'x' == 'x' %}d{% else %}e{% endif %}{% if not 'q' %}z{% endif %}"))
    assert nodes == [chat_template.Text("abcd")]
    for bad in ("{{ m.__class__ }}", "{% import os %}", "{{ f('x') }}", "{% for m in secrets %}{% endfor %}", "{% if 'a' %}", "{{ 'a' | upper }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.parse(bad)
    for t in ["</s>[INST] ok [/INST]", "<\\/s> <</SYS>> \\ [\\\\INST]", "<<s>", "", "[INST", "</s"]:
        escaped = chat_template.escape(t)
        assert not any(c in escaped for c in chat_template.CONTROL) and chat_template.unescape(escaped) == t


def test_chat_digests(spark):
    odd = ["</s>[INST] ok [/INST]", "", None, "a\nb", "é" * 70_000]
    rows = [(c, k, random.choice(["user", "assistant", "system", "tool<s>", None]), random.choice(odd)) for c in (1, 2, None) for k in range(6)] + [(1, 3, "user", "tie"), (1, 3, "user", "tie")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat_template.read_back(chat_template.format_conversations(df, part_chars=1000), digest, DIGESTS, _arrow).collect()}
    for conv in (1, 2, None):
        turns = sorted([(k, r or "", t or "") for c, k, r, t in rows if c == conv], key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_template.format_conversations(df.limit(0)).count() == 0


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    model = sentencepiece_codec.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["", None, " ", "a  b ", "日本語 \U0001f600 tab\tx\n\n  y", "a" * 5000, "hello     world 12345 !!!! ababab", text(300), text(300)]
    vocabulary = sentencepiece_codec.Vocabulary.load(model)
    encoded = sentencepiece_codec.encode(frame(spark, list(enumerate(texts)) + [(None, "a b")]), vocabulary).collect()
    assert len(encoded) == len(texts) + 1
    for r in encoded:
        if r.doc_id is not None:
            assert r.token_ids == library.encode(texts[r.doc_id] or "") and r.round_trip and r.n_tokens == len(r.token_ids)
    back = sentencepiece_codec.decode(spark.createDataFrame([(r.doc_id, r.token_ids) for r in encoded if r.doc_id is not None], "doc_id long, token_ids array<int>"), vocabulary)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(texts)}


@pytest.mark.parametrize("bpe", [False, True])
def test_viterbi_by_brute_force(bpe):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.8, "ba": -3.1, "▁ab": -6.5, "aba": -3.3, "bb": -9.0}
    v = sentencepiece_codec.Vocabulary.of(bpe, scores, {p: 300 + k for k, p in enumerate(scores)}, [b""] * 400, list(range(256)), -20.0)
    names = {300 + k: p for k, p in enumerate(scores)}
    meet = lambda a, b: not bpe or a is None or sentencepiece_codec.merged(a + b, scores) == [a, b]

    def best(w, left=None):
        """The greatest sum of scores over all cuts of w into pieces, of which neighbours may stand side by side."""
        if not w:
            return 0.0
        ways = [scores[w[:k]] + best(w[k:], w[:k]) for k in (1, 2, 3) if w[:k] in scores and meet(left, w[:k]) and (not bpe or sentencepiece_codec.merged(w[:k], scores) == [w[:k]])]
        return max(ways + ([-20.0 + best(w[1:])] if w[0] not in scores else []), default=-math.inf)

    words = sorted({"▁" + "".join(random.choice("abx") for _ in range(random.randint(1, 7))) for _ in range(80)})
    for w, ids, score in v.segment(words, {}):
        pieces = [names.get(i) for i in np.frombuffer(ids, np.int32)]
        assert sum(scores[p] if p else -20.0 for p in pieces) == pytest.approx(score) == pytest.approx(best(w))
        assert sum(v.values[i] for i in np.frombuffer(ids, np.int32)) == pytest.approx(score)
        if bpe:
            assert "".join(p or "x" for p in pieces) == w and [p or "x" for p in pieces] == sentencepiece_codec.merged(w, scores)


def test_sentencepiece_equals_library_on_odd_texts():
    import sentencepiece

    model = sentencepiece_codec.default_model()
    library, v = sentencepiece.SentencePieceProcessor(model_file=model), sentencepiece_codec.Vocabulary.load(model)
    alphabet = ["a", "b", "th", "er", "ing", " ", " ", "  ", "\n", "é", "ß", "日", "\U0001f600", "1", "23", "!", "▁", "\t", "\u200b", "İ"]
    for _ in range(400):
        t = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
        words = sentencepiece_codec.marked_words(t)
        known = v.ids_of(set(words), 1000)
        assert np.frombuffer(b"".join(known[w] for w in words), np.int32).tolist() == library.encode(t), t


def test_jaccard_groups_by_brute_force(spark):
    base = [text(60).split() for _ in range(6)]
    common = text(40)
    rows = [(0, None), (1, ""), (2, " \n "), (3, "ba do"), (4, "BA do"), (5, "ba")]
    for k in range(90):
        words = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            words[random.randrange(len(words))] = random.choice(WORDS) + str(k)
        rows.append((10 + k, " ".join(words)))
    rows += [(200 + k, common + " " + text(random.choice([3, 6, 40]))) for k in range(25)] + [(300, rows[20][1]), (300, text(50))]
    found = jaccard_join.groups(frame(spark, [*rows, (None, "ba do")]), 4, 85, 100).collect()
    sets = [(i, shingles(t, 4)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= 85 * len(s | t):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id is not None) == sorted((i, root(i)) for i, _ in rows)
    assert Counter((r.doc_id, r.n_shingles) for r in found if r.doc_id is not None) == Counter((i, len(s)) for i, s in sets)
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    kept = {r.doc_id for r in jaccard_join.keep_one(frame(spark, rows), 4, 85, 100).collect()}
    assert kept == {root(i) for i, _ in rows}
    assert jaccard_join.groups(frame(spark, []), 4, 85, 100).count() == 0


def test_leaks_exact_edited_and_absent(spark):
    items = [(k, " ".join(random.choice(WORDS) + random.choice("qwxz") for _ in range(40))) for k in range(8)] + [(98, None), (99, ""), (None, "ba do ki")]
    rows = [(0, None), (1, ""), (2, text(2000))]
    for k in range(8):
        words = items[k][1].split()
        rows.append((100 + k, text(30) + "\n" + " ".join(words).upper().replace(" ", ", ") + ".\n" + text(30)))
        edited = list(words)
        for j in range(3, 40, 7):
            edited[j] = "other"
        rows.append((200 + k, text(50) + " " + " ".join(edited[:20] + ["added"] + edited[21:]) + " " + text(9)))
    rows += [(300 + k, rows[3][1]) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = defaultdict(set)
    for r in decontaminate.leaks(frame(spark, rows), bench).collect():
        got[r.doc_id].add(r.item_id)
    assert got == {**{100 + k: {k} for k in range(8)}, **{200 + k: {k} for k in range(8)}, **{300 + k: {0} for k in range(40)}}
    assert {r.doc_id for r in decontaminate.keep_clean(frame(spark, rows), bench).collect()} == {0, 1, 2}
    assert decontaminate.leaks(frame(spark, rows), bench, block_words=20).count() == 56
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0


def test_smith_waterman_by_plain_loop():
    def plain(a, b):
        h = [[0.0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for i, y in enumerate(b, 1):
            for j, x in enumerate(a, 1):
                h[i][j] = max(0.0, h[i - 1][j - 1] + (1 if x == y and x >= 0 else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
        return max(map(max, h))

    pairs = [([random.randrange(-1, 6) for _ in range(random.randint(1, 30))], [random.randrange(6) for _ in range(random.randint(1, 12))]) for _ in range(50)]
    scores, _ = decontaminate.align(decontaminate.padded([np.array(a) for a, _ in pairs], -1), decontaminate.padded([np.array(b) for _, b in pairs], -2))
    assert scores.tolist() == pytest.approx([plain(a, b) for a, b in pairs])


def test_rule_statistics_and_learning(spark):
    texts = [None, "", " \t\n ", "a b c a b c", "a a a a", "x y z\n\nx y z\n x y z", text(500), "é#ü **\x0bok\x0cno", "a b a b", "b a a b c b a a b", text(3000) + " " + text(5) * 3]
    got = {r.doc_id: r for r in quality_rules.with_statistics(frame(spark, enumerate(texts)).drop("n_words", "score")).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
    rows = [(k, text(80) if k % 3 else " ".join(w + "###" for w in text(80).split())) for k in range(150)] + [(200, text(80) + " THE END")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(150)] + [(None, 0), (5, None)], "doc_id long, quality int")
    rules = quality_rules.learn(quality_rules.with_statistics(docs.select("doc_id", "text")), labels, min_gain=1.0)
    assert rules.rules
    assert {r.doc_id for r in quality_rules.filter_kept(docs, rules).collect()} == {k for k in range(150) if k % 3} | {200}
    nothing = quality_rules.learn(quality_rules.with_statistics(docs.select("doc_id", "text")), labels.limit(0))
    assert nothing.rules == [] and quality_rules.filter_kept(docs, nothing).count() == 151


def test_classifier_learns_and_never_sees_held_out_labels(spark):
    rows = [(k, text(60) if k % 4 else "$$ " + text(50).upper()) for k in range(240)] + [(900, None), (901, "")]
    docs = frame(spark, rows)
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    labels = [(k, int(k % 4 > 0) if not held(k) else 0) for k in range(240)] + [(None, 1), (3, None)]
    model = quality_classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    assert all(got[k].predicted == int(k % 4 > 0) for k in range(240)) and all(0 <= r.score <= 1 for r in got.values())
    assert {900, 901} <= got.keys() and got[900].score == got[901].score
    assert quality_classifier.keep_good(docs, model).columns == docs.columns
    empty = quality_classifier.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_classifier.score(docs, empty).collect()} == {0.5}
    assert quality_classifier.score(frame(spark, []), model).count() == 0


def paths(model, e):
    """Every sequence of states of a text with emissions e, and its probability together with the text."""
    for s in itertools.product(range(len(model.initial)), repeat=len(e)):
        p = model.initial[s[0]] * e[0, s[0]]
        for k in range(1, len(e)):
            p *= model.transition[s[k - 1], s[k]] * e[k, s[k]]
        yield s, p


def plain_forward(model, e):
    """Log10 likelihood of a text by a loop over its tokens."""
    a, log = None, 0.0
    for row in e:
        a = (model.initial if a is None else a @ model.transition) * row
        log += math.log10(a.sum())
        a = a / a.sum()
    return log


@pytest.mark.parametrize("segment", [1, 2, 3, 512])
def test_forward_and_expected_counts_by_plain_sums(segment):
    model = hidden_markov.Model.start(np.array([5.0, 3.0, 2.0]), 2, 1)
    model.transition = np.array([[0.7, 0.3], [0.2, 0.8]])
    sequences = [np.array(x) for x in ([0, 1, 2, 0, 2, 1, 1], [2], [1, 1], [0, 2, 2, 1, 0, 0])]
    lengths, x = np.array([len(s) for s in sequences]), np.concatenate(sequences)
    e = model.emission[x]
    parts = np.split(e, np.cumsum(lengths)[:-1])
    logs = [math.log10(sum(p for _, p in paths(model, part))) for part in parts]
    assert model.log10_likelihood(e, lengths, segment) == pytest.approx(logs) == [plain_forward(model, part) for part in parts]
    initial, transition, gamma = np.zeros(2), np.zeros((2, 2)), []
    for part in parts:
        whole, here = sum(p for _, p in paths(model, part)), np.zeros_like(part)
        for s, p in paths(model, part):
            initial[s[0]] += p / whole
            for k in range(len(part)):
                here[k, s[k]] += p / whole
                if k:
                    transition[s[k - 1], s[k]] += p / whole
        gamma.append(here)
    i, t, g, log = model.expected(e, lengths, segment)
    assert i == pytest.approx(initial) and t == pytest.approx(transition) and g == pytest.approx(np.concatenate(gamma)) and log == pytest.approx(sum(logs))


def plain_markov(rows, states, rounds, frequent, symbols, seed=11):
    """The scores of texts by loops over whole sequences, with one dict of emissions for all words."""
    h = hidden_markov
    texts = [(i, (t or "").lower().encode().split() + [b""]) for i, t in rows]
    train = [w for i, w in texts if not h.held_out_py(i)]
    counts = Counter(x for w in train for x in w)
    by_width = Counter(math.floor(math.log2(c) * 16) for c in counts.values())
    total = own = 0
    for k in sorted(by_width, reverse=True):
        total += by_width[k]
        if total > frequent:
            break
        own = total if total <= symbols else own
    ranked = sorted(counts, key=lambda w: (-counts[w], w))[:own]
    symbol = {w: k for k, w in enumerate(ranked)}
    of = lambda w: symbol.get(w, own + h.tail_class(w))
    shares = np.zeros(own + h.TAIL)
    for w, c in counts.items():
        shares[of(w)] += c
    model = first = h.Model.start(shares + h.ALPHA, states, seed)
    for _ in range(rounds):
        first, n = model, {w: np.zeros(states) for w in counts}
        initial, moves, emission = np.ones(states), np.ones((states, states)), np.zeros(model.emission.shape)
        for words in train:
            e = model.emission[[of(w) for w in words]]
            alpha, beta = [model.initial * e[0]], [np.ones(states)]
            for row in e[1:]:
                alpha.append((alpha[-1] / alpha[-1].sum()) @ model.transition * row)
            for row in e[:0:-1]:
                beta.insert(0, model.transition @ (row * beta[0] / (row * beta[0]).sum()))
            for k, w in enumerate(words):
                g = alpha[k] * beta[k] / (alpha[k] @ beta[k])
                emission[of(w)] += g
                n[w] += g
                if k == 0:
                    initial += g
                else:
                    x = np.outer(alpha[k - 1], e[k] * beta[k]) * model.transition
                    moves += x / x.sum()
        prior = first.emission.mean(1, keepdims=True)
        emission += 50.0 * prior / prior.sum() + h.ALPHA / states
        model = h.Model(initial / initial.sum(), moves / moves.sum(1, keepdims=True), emission / emission.sum(0))
    tails = defaultdict(list)
    for w in counts:
        if w not in symbol:
            tails[h.tail_class(w)].append(w)

    def emit(w):
        if w in symbol:
            return model.emission[symbol[w]]
        k = h.tail_class(w)
        q = (counts[w] + 0.1) / (sum(counts[v] for v in tails[k]) + 0.1 * (len(tails[k]) + 1))
        return model.emission[own + k] * (n.get(w, np.zeros(states)) + h.MIX * q) / (sum((n[v] for v in tails[k]), np.zeros(states)) + h.MIX)

    return [(i, plain_forward(model, np.array([emit(w) for w in words]))) for i, words in texts], model, emit, counts


@pytest.mark.parametrize("sizes", [{"frequent": 30, "symbols": 12}, {"frequent": 12, "symbols": 12}, {}])
def test_hidden_markov_scores(spark, sizes):
    rows = [(k, text(random.randint(0, 60))) for k in range(80)] + [(500, None), (501, "unseen Words"), (7, "repeated id"), (None, "null id"), (502, text(900))]
    told = []
    got = hidden_markov.score(frame(spark, rows), states=3, rounds=2, segment=16, tokens=300, told=told, **sizes).collect()
    n_and_v = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            n_and_v.update((t or "").lower().split() + [""])
    n, v = sum(n_and_v.values()), len(n_and_v)
    want = Counter()
    for i, t in rows:
        words = (t or "").lower().split() + [""]
        base = sum(math.log10((n_and_v[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want[i, len(words), sum(n_and_v[w] > 0 for w in words), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    plain, model, emit, counts = plain_markov(rows, 3, 2, sizes.get("frequent", hidden_markov.FREQUENT), sizes.get("symbols", hidden_markov.SYMBOLS))
    by = lambda pairs: sorted(pairs, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert [x[1] for x in by((r.doc_id, r.score) for r in got)] == pytest.approx([x[1] for x in by(plain)], rel=1e-5)
    assert told[1] > told[0]
    unseen = sum(emit(b"\xff" + w[-2:] + (b"" if len(w) < 3 else b"")) for w in [b""])  # some unseen word
    assert (sum(emit(w) for w in counts) <= 1 + 1e-9).all() and (unseen > 0).all()


def test_hidden_markov_without_training_or_rows(spark):
    held = [k for k in range(200) if hidden_markov.held_out_py(k)][:3]
    got = hidden_markov.score(frame(spark, [(k, "ba do") for k in held]), states=2, rounds=2).collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)
    assert hidden_markov.score(frame(spark, []), states=2, rounds=1).count() == 0
    small = hidden_markov.score(frame(spark, [(k, " ".join(f"w{random.randrange(400)}" for _ in range(30))) for k in range(60)]))
    assert small.count() == 60


def plain_scan(texts):
    """Places, labels and scores of all notices by a loop over every place of every text."""
    cut = {k: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w] for k, t in texts}
    n, df = len(texts), Counter(w for words in cut.values() for w in set(words))
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in license_scan.template_words(license_scan.TEMPLATES)}
    for k, words in cut.items():
        base, labels, base_labels, score = [], set(), set(), 0.0
        for t in license_scan.TEMPLATES:
            phrase, notice = t.phrase.split(), t.notice.split()
            ahead = next(j for j in range(len(notice)) if notice[j : j + len(phrase)] == phrase)
            for at in [j for j in range(len(words)) if words[j : j + len(phrase)] == phrase]:
                labels.add(t.label)
                if t.base:
                    base.append(at)
                    base_labels.add(t.label)
                stand = [w for j, w in enumerate(notice) if 0 <= at - ahead + j < len(words) and words[at - ahead + j] == w]
                score = max(score, sum(idf[w] for w in stand) / sum(idf[w] for w in notice))
        yield k, len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), pytest.approx(score)


def test_license_scan_by_brute_force(spark):
    pool = sorted({w for t in license_scan.TEMPLATES for w in t.notice.split()})
    odd = [None, "", "...", "Under THE mit-License; under the MIT license", "the Apache License, Version 2.0", "cc by nc cc by-nc", "under mit license", "x " * 4000 + "CC BY NC", "under the mit license " * 30]
    mixed = []
    for _ in range(60):
        parts = [random.choice([t.notice, t.phrase, t.notice.upper().replace(" ", ", "), " ".join(random.choices(pool, k=6)), text(3)]) for t in random.choices(license_scan.TEMPLATES, k=random.randint(1, 5))]
        mixed.append(random.choice([" ", "\n", " - ", "é "]).join(parts))
    texts = list(enumerate([*odd, *mixed, odd[3], odd[3]]))
    rows = license_scan.scan(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows}
    assert [got[x[0]] for x in plain_scan(texts)] == list(plain_scan(texts))
    assert got[3][5] == "mit" and sum(bool(x[6]) for x in got.values()) > 20
    again = license_scan.scan(frame(spark, [(1, odd[3]), (1, odd[3]), (None, odd[3])])).collect()
    assert [(r.n_base, r.labels) for r in again] == [(2, "mit")] * 3
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_dated_lists(spark):
    import datetime as dt

    day = lambda d: dt.date(2024, 1, d)
    entries = spark.createDataFrame(
        [("a.com", "block", day(5)), ("a.com", "remove", day(10)), ("b.a.com", "allow", day(7)), ("a.com/x", "block", day(1)), ("t.org", "allow", day(3)), ("t.org", "block", day(3)), (None, "block", day(1)), ("n.com", None, day(1))],
        "pattern string, verdict string, since date",
    )
    cases = [("http://A.com/p", 4, "none"), ("http://a.com/p", 5, "block"), ("http://a.com:80/p", 9, "block"), ("http://a.com/p", 10, "none"), ("http://u@b.a.com/", 8, "allow"), ("http://b.a.com/", 6, "block"), ("http://a.com/x/y", 4, "block"), ("http://t.org", 3, "block"), ("nonsense", 5, "none"), (None, 5, "none"), ("http://a.com/p", None, "none"), ("http://a.com/p", 5, "block")]
    captures = spark.createDataFrame([(k, u, day(d) if d else None) for k, (u, d, _) in enumerate(cases)] + [(1, "http://a.com/p", day(5))], "page_id long, url string, fetched date")
    got = temporal_lists.evaluate(captures, entries).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == sorted([(k, v) for k, (_, _, v) in enumerate(cases)] + [(1, "block")])


def test_audit_finds_just_the_faults(spark):
    rows = [(k, f"http://h{k % 7}.com/{k}", "x" * random.randint(0, 3000)) for k in range(300)] + [(5, "http://h5.com/again", None), (None, None, "null id")]
    schema = "page_id long, url string, html string"
    same = spark.createDataFrame(rows, schema)
    assert warc_audit.audit(same, same.orderBy("html"), 50, 4096).count() == 0
    other = [(i, u, (h or "") + ("!" if i == 44 else "")) for i, u, h in rows if i != 120] + [(-40, "http://new.com", "n"), (5000, "http://new.com", "n")]
    got = {(r.page_id, r.kind) for r in warc_audit.audit(same, spark.createDataFrame(other, schema), 50, 4096).collect()}
    assert got == {(44, "altered"), (120, "missing"), (-40, "extra"), (5000, "extra")}
    assert warc_audit.audit(same.limit(0), same.limit(0)).count() == 0 and warc_audit.audit(same, same.limit(0)).count() == len(rows)
