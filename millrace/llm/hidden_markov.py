"""Language-model scoring with a hidden Markov model.

Latent states are trained by Baum-Welch over all training texts, each as one whole sequence: every task returns expected
counts (initial, transition, emission), which are summed across tasks. A text's score is exact: the scaled forward
recursion over its whole sequence of words.

Emissions: the SYMBOLS most frequent words have a row of the emission matrix each. While the states are trained, any
other word counts as one of TAIL classes by the shape of its ending; the last round also returns the expected counts of
each of those words by state, which a shuffle sums, and from which each word has its own emission in the final model:

    P(w | s) = P(class | s) * (n(w, s) + MIX * q(w)) / (n(class, s) + MIX),

q(w) being the word's smoothed share of its class over all states. Words that training texts don't have share the one
place of their class that is left, so the emissions of a state sum to 1.

Long texts: a text is cut into segments so that many segments are one array; a segment's transfer matrix carries the
forward and backward messages over its borders, so the counts and the likelihood are those of the whole sequence, and
`segment` only bounds memory.

Scale: broadcast are the FREQUENT most frequent words and the model, both of fixed size. Other words never reach one
place: their counts and emissions are tables, joined with the (text, word) rows of the texts that have them. Words are
told apart by 64-bit hashes where texts are read (`byte_words`). Texts are kept as arrays in the shared folder and reread each round.

Defined cases: null and empty text are the end token alone; with no training text every count is 0 and smoothing alone
speaks (V is 0, so the end has probability 1); a corpus without tail words has an empty table of them; rows that share a
doc_id are scored one by one. Only doc_id and text are read; a null doc_id is never held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_words
from .common import as_bytes, chunks, materialize, release

ALPHA = 0.1
#: Bound of the frequent words (broadcast with their counts), of those that have a row of the emission matrix, of classes.
FREQUENT = 1 << 18
SYMBOLS = (1 << 15) - (1 << 8)
TAIL = 1 << 8
#: How many expected counts of a class in a state its words' shares over all states are worth.
MIX = 4.0
#: The end of a text counts as a token; no word is empty.
END = b""
_kinds = byte_words.kinds(b" \t\n\x0b\x0c\r")


def tail_class(word: bytes) -> int:
    """One of TAIL classes: by the last two bytes and whether the word is short."""
    return zlib.crc32(word[-2:] + (b"s" if len(word) < 6 else b"l")) % TAIL


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, as signed longs; the end's is 0."""
    ends = np.cumsum(np.array([len(w) for w in words], np.int64))
    return byte_words.hashes(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1])[: len(words)], ends).view(np.int64)


def held_out_py(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def cut(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, lower-cased; the place behind each of them; ends, starts and hashes (int64) of their words."""
    joined = b" ".join(x or b"" for x in texts).lower()
    data = np.frombuffer(joined, np.uint8)
    starts, ends, _ = byte_words.spans(data, _kinds)
    return joined, np.cumsum([len(x or b"") + 1 for x in texts]), ends, starts, byte_words.hashes(data, starts, ends).view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training texts, ends included: counted per slice, then summed by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learned = pa.array([not held_out_py(x) for x in batch["doc_id"].to_pylist()], pa.bool_())
            for texts in chunks(batch["text"].filter(learned).to_pylist()):
                joined, _, ends, starts, h = cut(texts)
                _, at, c = np.unique(h, return_index=True, return_counts=True)
                words = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([*words, END], pa.binary()), pa.array([*c.tolist(), len(texts)], pa.int64())], names=["word", "c"])

    return as_bytes(docs, "doc_id").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Frequent words by rank; what else of the counts a task needs."""

    rank: dict[bytes, int]
    counts: np.ndarray  # by rank
    total: int  # N
    distinct: int  # V
    own: int  # so many words, the most frequent, have a row of the emission matrix

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed unigram probability."""
        return np.log10((counts + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))


def lexicon_of(counts: DataFrame, frequent: int = FREQUENT, symbols_most: int = SYMBOLS) -> Lexicon:
    """At most `frequent` words with their counts, at most `symbols_most` of them with emissions of their own from the
    start, and the totals. Both are all words from some count on."""
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    width = F.floor(F.log2("c") * 16).cast("int")
    found = own = 0
    least = None
    for r in sorted(counts.groupBy(width.alias("w")).count().collect(), key=lambda r: -r.w):
        if found + r["count"] > frequent:
            break
        found, least = found + r["count"], r.w
        if found <= symbols_most:
            own = found
    if least is None:
        words, c = [], np.empty(0, np.int64)
    else:
        got = counts.where(width >= least).toArrow()
        order = sorted(range(got.num_rows), key=lambda k, c=got["c"].to_pylist(), w=got["word"].to_pylist(): (-c[k], w[k]))
        words, c = got["word"].take(pa.array(order, pa.int64())).to_pylist(), got["c"].to_numpy()[order]
    return Lexicon({w: k for k, w in enumerate(words)}, c, int(whole.n or 0), int(whole.v), own)


def class_counts(words: DataFrame) -> np.ndarray:
    """Training tokens of these words by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.bincount([tail_class(w) for w in batch["word"].to_pylist()] or np.empty(0, np.int64), batch["c"].to_numpy(), TAIL).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL)), pa.array(found)], names=["k", "n"])

    out = np.zeros(TAIL)
    for r in words.mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


#: One row a text: its symbols (uint16), its tail words in order (uint32: the rank of a frequent word, or RARE and the place in
#: the list `rare`), and the sorted distinct hashes of its words that aren't frequent.
READ = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, head_base double, symbols binary, tail binary, rare array<long>"
_read = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("head_base", pa.float64()), ("symbols", pa.binary()), ("tail", pa.binary()), ("rare", pa.list_(pa.int64()))])


RARE = 1 << 31


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of values of these lengths, each as bytes."""
    ends = np.append(0, np.cumsum(lengths)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def read_texts(docs: DataFrame, lexicon) -> DataFrame:
    """Each whole text as symbols and tail words, with what its frequent words add to the base score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Lexicon = lexicon.value
        own, rare = x.own, len(x.counts)
        frequent = word_hashes(list(x.rank))
        order = np.argsort(frequent, kind="stable")
        base = np.append(x.base(x.counts), 0.0)
        symbol = np.concatenate([np.arange(own), [own + tail_class(w) for w in list(x.rank)[own:]], [0]]).astype(np.uint16)
        for batch in batches:
            begin = 0
            for texts in chunks(batch["text"].to_pylist()):
                part = batch.slice(begin, len(texts))
                begin += len(texts)
                joined, behind, ends, starts, h = cut(texts)
                distinct, where, which = np.unique(h, return_index=True, return_inverse=True)
                distinct, where = np.append(distinct, 0), np.append(where, -1)  # the last is the end
                at = np.full(len(distinct), rare)
                if rare:
                    place = order[np.minimum(np.searchsorted(frequent, distinct, sorter=order), rare - 1)]
                    at = np.where(frequent[place] == distinct, place, rare)
                unknown = np.flatnonzero(at == rare)
                found = symbol[at]
                found[unknown] = [own + tail_class(joined[starts[k] : ends[k]] if k >= 0 else END) for k in where[unknown].tolist()]
                upto = np.searchsorted(starts, behind)
                word = np.insert(which, upto, len(distinct) - 1)  # of each token, ends included
                lengths = np.diff(upto, prepend=0) + 1
                text = np.repeat(np.arange(len(texts)), lengths)
                seldom = np.flatnonzero(at[word] == rare)
                lists, place = np.unique(text[seldom] * len(distinct) + word[seldom], return_inverse=True)
                first = np.searchsorted(lists, np.arange(len(texts) + 1) * len(distinct))
                code = at[word].astype(np.uint32)
                code[seldom] = RARE + place - first[text[seldom]]
                tail = found[word] >= own
                yield pa.RecordBatch.from_arrays([
                    part["row"], part["doc_id"], pa.array([held_out_py(k) for k in part["doc_id"].to_pylist()], pa.bool_()), pa.array(lengths), pa.array(lengths - np.bincount(text[seldom], minlength=len(texts))),
                    pa.array(np.bincount(text, base[at[word]], len(texts))), packed(found[word], lengths), packed(code[tail], np.bincount(text[tail], minlength=len(texts))),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(distinct[lists % len(distinct)])),
                ], schema=_read)

    return as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id()), "row", "doc_id").mapInArrow(run, READ)


class Layout:
    """Texts, one behind the other, cut into segments of at most `segment` tokens: places of segments and steps."""

    def __init__(self, lengths: np.ndarray, segment: int):
        n = -(-lengths // segment)
        text = np.repeat(np.arange(len(lengths)), n)
        self.rank = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        self.begin = (np.cumsum(lengths) - lengths)[text] + self.rank * segment
        self.length = np.minimum(segment, lengths[text] - self.rank * segment)
        self.first, self.last = self.rank == 0, self.rank == n[text] - 1
        self.text = text

    def steps(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some segments: their order, the longest first, and how many of them have a token at each step."""
        order = which[np.argsort(-self.length[which], kind="stable")]
        longest = int(self.length[order[0]]) if len(order) else 0
        return order, np.searchsorted(-self.length[order], -np.arange(1, longest + 1), side="right")


@dataclass
class Model:
    initial: np.ndarray  # K
    transition: np.ndarray  # K x K
    emission: np.ndarray  # symbols x K

    @staticmethod
    def start(counts: np.ndarray, states: int, seed: int) -> Model:
        """Sticky states whose emissions are the unigram shares, perturbed so that they can part."""
        noise = np.exp(0.5 * np.random.default_rng(seed).standard_normal((len(counts), states)))
        emission = counts[:, None] * noise
        transition = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(transition, 0.9)
        return Model(np.full(states, 1 / states), transition / transition.sum(1, keepdims=True), emission / emission.sum(0))

    def transfers(self, e: np.ndarray, at: Layout) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment of a text with several: the matrix from its first state to its last one with all its tokens
        emitted, scaled, and log10 of the scale."""
        states = len(self.initial)
        matrix, logs = np.zeros((len(at.begin), states, states)), np.zeros(len(at.begin))
        order, running = at.steps(np.flatnonzero(~(at.first & at.last)))
        if not len(order):
            return matrix, logs
        begin = at.begin[order]
        a, total = np.eye(states)[None] * e[begin][:, None, :], np.zeros(len(order))
        for t in range(1, len(running)):
            m = running[t]
            step = (a[:m].reshape(-1, states) @ self.transition).reshape(m, states, states) * e[begin[:m] + t][:, None, :]
            scale = step.sum((1, 2))
            a[:m] = step / scale[:, None, None]
            total[:m] += np.log10(scale)
        matrix[order], logs[order] = a, total
        return matrix, logs

    def into(self, matrix: np.ndarray, at: Layout) -> tuple[np.ndarray, np.ndarray]:
        """For each segment the share of states before its first token is emitted; and log10 of each step between."""
        u, logs = np.broadcast_to(self.initial, (len(at.begin), len(self.initial))).copy(), np.zeros(len(at.begin))
        for j in range(int(at.rank.max(initial=0)) + 1):
            here = np.flatnonzero((at.rank == j) & ~(at.first & at.last))
            end = np.einsum("mk,mkl->ml", u[here], matrix[here])
            scale = end.sum(1)
            logs[here] = np.log10(scale)
            go = ~at.last[here]
            u[here[go] + 1] = (end[go] / scale[go, None]) @ self.transition
        return u, logs

    def log10_likelihood(self, e: np.ndarray, lengths: np.ndarray, segment: int = 512) -> np.ndarray:
        """Scaled forward recursion over whole sequences; e has the emissions of all tokens by state."""
        at = Layout(lengths, segment)
        matrix, logs = self.transfers(e, at)
        _, between = self.into(matrix, at)
        out = np.bincount(at.text, logs + between, len(lengths))
        order, running = at.steps(np.flatnonzero(at.first & at.last))
        begin, total = at.begin[order], np.zeros(len(order))
        alpha = np.broadcast_to(self.initial, (len(order), len(self.initial)))
        for t, m in enumerate(running):
            alpha = (alpha[:m] if t == 0 else alpha[:m] @ self.transition) * e[begin[:m] + t]
            scale = alpha.sum(1)
            alpha = alpha / scale[:, None]
            total[:m] += np.log10(scale)
        out[at.text[order]] = total
        return out

    def expected(self, e: np.ndarray, lengths: np.ndarray, segment: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Of whole sequences: expected counts of first states and of transitions, each token's share of states, and the
        log10 likelihood."""
        at = Layout(lengths, segment)
        states, step = len(self.initial), self.transition
        matrix, _ = self.transfers(e, at)
        u, _ = self.into(matrix, at)
        behind = np.ones((len(at.begin), states))  # the backward message at each segment's last token
        for j in range(int(at.rank.max(initial=0)), -1, -1):
            here = np.flatnonzero((at.rank == j) & ~at.last)
            message = np.einsum("mkl,ml->mk", matrix[here + 1], behind[here + 1]) @ step.T
            behind[here] = message / message.sum(1, keepdims=True)
        order, running = at.steps(np.arange(len(at.begin)))
        begin, alpha, scale = at.begin[order], np.empty((len(e), states)), np.empty(len(e))
        a = u[order]
        for t, m in enumerate(running):
            rows = begin[:m] + t
            a = (a[:m] if t == 0 else a[:m] @ step) * e[rows]
            s = a.sum(1)
            a = a / s[:, None]
            alpha[rows], scale[rows] = a, s
        end = alpha[begin + at.length[order] - 1]
        beta = behind[order]
        beta /= (end * beta).sum(1, keepdims=True)
        moves = np.zeros((states, states))
        for t in range(len(running) - 1, -1, -1):
            rows = begin[: running[t]] + t
            if t + 1 < len(running):
                j = running[t + 1]
                ahead = e[rows[:j] + 1] * beta[:j] / scale[rows[:j] + 1, None]
                moves += alpha[rows[:j]].T @ ahead
                beta[:j] = ahead @ step.T
            alpha[rows] *= beta[: running[t]]
        # moves from a segment's last token to the next one's first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        here = np.flatnonzero(~at.last)
        left, ahead = end[place[here]], e[at.begin[here + 1]] * beta[place[here + 1]]
        moves += left.T @ (ahead / ((left @ step) * ahead).sum(1, keepdims=True))
        return alpha[at.begin[at.first]].sum(0), moves * step, alpha, float(np.log10(scale).sum())


def slices(lengths: np.ndarray, tokens: int) -> Iterator[slice]:
    """Runs of texts of about so many tokens."""
    begin = total = 0
    for k, n in enumerate(lengths):
        total += n
        if total >= tokens:
            yield slice(begin, k + 1)
            begin, total = k + 1, 0
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def joined(parts, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in parts), kind)


def hashes_of(code: np.ndarray, rare: pa.Array, texts: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Hashes of tail words from their codes; texts: which text of the lists `rare` each is in, frequent: by rank."""
    out = np.empty(len(code), np.int64)
    seldom = code >= RARE
    out[~seldom] = frequent[code[~seldom]]
    ends = rare.offsets.to_numpy().astype(np.int64)
    out[seldom] = rare.values.to_numpy()[ends[texts[seldom]] + (code[seldom] - np.uint32(RARE)).astype(np.int64)]
    return out


def expected_counts(texts: DataFrame, model: Model, held, own: int, segment: int, tokens: int, by_word: bool) -> DataFrame:
    """Expected counts of all texts, summed by a shuffle. Rows with `at` are the parameters: symbols, then the first
    states, the transitions by state, and the log10 likelihood (in n0). With by_word also a row for each tail word: hash,
    class, count, and its expected count in each state but the last, which is what is left of the count."""
    states, size = len(model.initial), len(model.emission)
    ns = [f"n{s}" for s in range(states)]
    schema = pa.schema([("at", pa.int64()), ("h", pa.int64()), ("k", pa.int32()), ("c", pa.int64()), *[(n, pa.float64()) for n in ns]])

    def rows(at, h, k, c, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(n), f.type) if x is None else pa.array(x, f.type) for x, f in zip((at, h, k, c), schema)], *[pa.array(np.ascontiguousarray(x)) for x in n.T], *[pa.nulls(len(n), pa.float64())] * (states - n.shape[1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, frequent = held.value
        total = np.zeros((size + 2 + states, states))
        for batch in batches:
            lengths = batch["n_tokens"].to_numpy()
            for part in slices(lengths, tokens):
                x = joined(batch["symbols"][part], np.uint16)
                first, moves, gamma, log = m.expected(m.emission[x], lengths[part], segment)
                for s in range(states):
                    total[:size, s] += np.bincount(x, gamma[:, s], size)
                total[size] += first
                total[size + 1 : -1] += moves
                total[-1, 0] += log
                if by_word:
                    tail = x >= own
                    text = np.repeat(np.arange(part.stop - part.start), lengths[part])[tail]
                    h = hashes_of(joined(batch["tail"][part], np.uint32), batch["rare"][part], text, frequent)
                    words, where, c = np.unique(h, return_inverse=True, return_counts=True)
                    kind = np.zeros(len(words), np.int32)
                    kind[where] = x[tail].astype(np.int32) - own
                    yield rows(None, words, kind, c, np.stack([np.bincount(where, gamma[tail, s], len(words)) for s in range(states - 1)], 1))
        some = np.flatnonzero(total.any(1))
        yield rows(some, None, None, None, total[some])

    found = texts.mapInArrow(run, "at long, h long, k int, c long, " + ", ".join(f"{n} double" for n in ns))
    return found.groupBy("at", "h").agg(F.first("k").alias("k"), F.sum("c").alias("c"), *[F.sum(n).alias(n) for n in ns])


def maximized(sums: DataFrame, first: Model) -> tuple[Model, float]:
    """The model of the greatest likelihood for the expected counts, a little smoothed; and the old one's likelihood."""
    size, states = first.emission.shape
    got = sums.where("at is not null").select("at", *[f"n{s}" for s in range(states)]).toArrow()
    total = np.zeros((size + 2 + states, states))
    total[got["at"].to_numpy()] = np.stack([got[f"n{s}"].to_numpy() for s in range(states)], 1)
    prior = first.emission.mean(1, keepdims=True)  # each symbol keeps a little of the unigram share, and no less than ALPHA in all
    initial, transition, emission = total[size] + 1, total[size + 1 : -1] + 1, total[:size] + 50.0 * prior / prior.sum() + ALPHA / states
    return Model(initial / initial.sum(), transition / transition.sum(1, keepdims=True), emission / emission.sum(0)), float(total[-1, 0])


@dataclass
class Tail:
    """What the emissions of tail words need: totals by class, and the words among the frequent ones, by hash."""

    class_n: np.ndarray  # class x K expected counts
    class_c: np.ndarray
    class_v: np.ndarray
    h: np.ndarray  # sorted
    c: np.ndarray
    n: np.ndarray

    def share(self, k: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P(word | class, state) of words with these classes, counts and expected counts."""
        q = (c + ALPHA) / (self.class_c[k] + ALPHA * (self.class_v[k] + 1))
        return (n + MIX * q[:, None]) / (self.class_n[k] + MIX)


def with_last(words: DataFrame, states: int) -> DataFrame:
    """Tail words with their expected count in the last state too."""
    rest = F.col("c") - sum((F.col(f"n{s}") for s in range(states - 1)), F.lit(0.0))
    return words.withColumn(f"n{states - 1}", F.greatest(rest, F.lit(0.0)))


def tail_of(words: DataFrame, states: int, least: int) -> Tail:
    """Totals by class, and the rows of the words with counts from `least` on, of which there are FREQUENT at most."""
    ns = [f"n{s}" for s in range(states)]
    out = Tail(np.zeros((TAIL, states)), np.zeros(TAIL), np.zeros(TAIL), *[np.empty(0)] * 3)
    for r in words.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v"), *[F.sum(n).alias(n) for n in ns]).collect():
        out.class_c[r.k], out.class_v[r.k], out.class_n[r.k] = r.c, r.v, [r[n] for n in ns]
    got = words.where(F.col("c") >= least).toArrow().sort_by("h")
    out.h, out.c, out.n = got["h"].to_numpy(), got["c"].to_numpy(), np.stack([got[n].to_numpy() for n in ns], 1)
    return out


def emissions(model: Model, tail: Tail, own: int, x: np.ndarray, code: np.ndarray, texts: np.ndarray, seen: pa.Array, frequent: np.ndarray, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(token | state) of symbols x of several texts, whose tail words have these codes; and which tokens aren't frequent
    words, with their counts. seen: for each text the places, counts and expected counts of its rare words that training
    texts have; a word that isn't there wasn't seen."""
    e = model.emission[x]
    at = np.flatnonzero(x >= own)
    c, n, seldom = np.zeros(len(at)), np.zeros((len(at), e.shape[1])), code >= RARE
    if len(tail.h) and not seldom.all():
        place = np.searchsorted(tail.h, frequent[code[~seldom]])
        c[~seldom], n[~seldom] = tail.c[place], tail.n[place]
    rows = seen.flatten()
    if len(rows) and seldom.any():
        counts = pa.compute.fill_null(pa.compute.list_value_length(seen), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        column = lambda name: rows.field(name).to_numpy(zero_copy_only=False)
        keys = (np.repeat(np.arange(len(seen)), counts) << 32) | column("i").astype(np.int64)
        order = np.argsort(keys)
        wanted = (texts[at][seldom] << 32) | (code[seldom] - np.uint32(RARE)).astype(np.int64)
        place = order[np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)]
        here = keys[place] == wanted
        found = np.flatnonzero(seldom)[here]
        c[found], n[found] = column("c")[place[here]], np.stack([column(k)[place[here]] for k in columns], 1)
    e[at] *= tail.share(x[at].astype(np.int64) - own, c, n)
    return e, at[seldom], c[seldom]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, states: int = 6, rounds: int = 3, segment: int = 512, tokens: int = 500_000, seed: int = 11, frequent: int = FREQUENT, symbols: int = SYMBOLS, told: list[float] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. `tokens`: about how many
    are in memory at once. told: gets the log10 likelihood of the training texts, tail words by class, before each round."""
    counts = materialize(word_counts(docs), "counts")
    lexicon = lexicon_of(counts, frequent, symbols)
    own, least = lexicon.own, int(lexicon.counts[-1]) if len(lexicon.counts) else 1
    shares = np.concatenate([lexicon.counts[:own].astype(float), class_counts(counts if not own else counts.where(F.col("c") < int(lexicon.counts[own - 1])))]) + ALPHA
    release(counts)
    context = docs.sparkSession.sparkContext
    held = context.broadcast(lexicon)
    read = materialize(read_texts(docs, held), "read")
    held.destroy()
    texts = read.where("not held_out").select("n_tokens", "symbols", "tail", "rare")
    frequent_h = word_hashes(list(lexicon.rank))
    model = Model.start(shares, states, seed)
    for k in range(rounds):
        sent = context.broadcast((model, frequent_h))
        sums = materialize(expected_counts(texts, model, sent, own, segment, tokens, k == rounds - 1), "sums")
        model, likelihood = maximized(sums, model)
        sent.destroy()
        if told is not None:
            told.append(likelihood)
        if k < rounds - 1:
            release(sums)
    words = with_last(sums.where("h is not null"), states)
    fitted = context.broadcast((model, tail_of(words, states, least), frequent_h))
    ns = [f"n{s}" for s in range(states)]
    rare = read.select("row", F.posexplode("rare").alias("i", "h")).join(words.where(F.col("c") < least).select("h", "c", *[F.col(n).cast("float").alias(n) for n in ns]), "h")
    of_row = rare.groupBy("row").agg(F.collect_list(F.struct("i", F.col("c").cast("int").alias("c"), *ns)).alias("seen"))
    total, distinct = lexicon.total, lexicon.distinct

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tail, frequent = fitted.value
        for batch in batches:
            lengths = batch["n_tokens"].to_numpy()
            for part in slices(lengths, tokens):
                some = batch.slice(part.start, part.stop - part.start)
                texts = np.repeat(np.arange(len(some)), lengths[part])
                e, at, c = emissions(m, tail, own, joined(some["symbols"], np.uint16), joined(some["tail"], np.uint32), texts, some["seen"], frequent, ns)
                text = texts[at]
                known = some["n_known"].to_numpy() + np.bincount(text, c > 0, len(some)).astype(np.int64)
                base = some["head_base"].to_numpy() + np.bincount(text, Lexicon({}, c, total, distinct, 0).base(c), len(some))
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["held_out"], some["n_tokens"], pa.array(known), pa.array(base), pa.array(m.log10_likelihood(e, lengths[part], segment))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = read.join(of_row, "row", "left").select("doc_id", "held_out", "n_tokens", "n_known", "head_base", "symbols", "tail", "seen").mapInArrow(forward, SCORED)
    out = materialize(scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"), "scores")
    release(read, sums)
    return out
