"""Best-fit packing: documents as token ids into sequences of a fixed length, with as few sequences as best-fit decreasing gives.

A document is the ids of its text and one end id; one longer than a sequence is cut into pieces of a whole sequence, the
last of which may be shorter. Best-fit decreasing puts the longest piece first, each into the open sequence in which it
leaves the least room. Pieces of one length are alike, and so are open sequences with the same room, so the choice needs
only how many pieces of each length there are: a segment tree over the possible rooms finds the tightest open sequences
for all pieces of a length in logarithmic time, and what it gives are runs: pieces number r to r + n of this length go to
sequences number s on, so many in each. The work on the driver is bounded by the sequence length, whatever the number of
documents, and the packing is that of one best-fit decreasing over the whole table.

Scale: texts are read once and never shuffled. Each task numbers its pieces of a length; the counts by task and length
give a piece its number among all pieces of that length, and by the runs its place. A length that most documents have
needs no group of its own.

Tokens: the tokenizer here cuts texts at white space, between letters and marks, and around digits, and encodes what it
cuts independently. So each distinct run of a slice is encoded once, and a text's ids are put together from them
(`independent_words` says for which tokenizers this holds; with others whole texts are encoded).

Defined cases: null and empty texts are the end id alone; rows that share a doc_id are packed one by one, a null doc_id
like others; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import byte_words
from .common import as_bytes, chunks, materialize

#: Classes of bytes: white space, letter, digit, mark, and what makes its word one that only the tokenizer itself cuts.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
_classes = np.full(256, ODD, np.uint8)
_classes[33:127] = MARK
_classes[list(b" \t\n\x0b\x0c\r")] = SPACE
_classes[list(range(65, 91)) + list(range(97, 123)) + [0xC3]] = LETTER
_classes[48:58] = DIGIT
_classes[list(b"'<")] = ODD
#: Words that a worker remembers the ids of.
REMEMBERED = 1 << 19
SLICE_BYTES = 4_000_000


def runs_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that the tokenizer cuts by itself, so that each can be encoded alone: letters, single
    digits or other marks. A word with an apostrophe, a '<', control characters, or letters beyond Latin-1 stays whole."""
    kind = _classes[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3  # what follows is a letter of Latin-1, but for the signs x and :
    kind[after & (data != 0x97) & (data != 0xB7)] = LETTER
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    word = np.flatnonzero((kind != SPACE) & (before == SPACE))
    end = np.flatnonzero(np.append(kind == SPACE, True) & (np.append(before, kind[-1:]) != SPACE))
    odd = np.flatnonzero(kind == ODD)
    whole = np.searchsorted(odd, end) > np.searchsorted(odd, word)
    start = np.flatnonzero((kind != SPACE) & ((kind != before) | (kind == DIGIT)))
    of = np.searchsorted(word, start, "right") - 1
    keep = ~whole[of] | (start == word[of])
    start, of = start[keep], of[keep]
    return start, np.minimum(np.append(start[1:], len(data)), end[of])


def default_tokenizer() -> str:
    """Path of the public tokenizer of 49 k ids that the container has."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def independent_words(definition: str) -> bool:
    """Whether white space always parts tokens and leaves none itself: the pre-tokenizer keeps only what is no white space,
    and neither the normalizer nor added tokens look across it."""
    parts = json.loads(definition)
    pre, norm = parts.get("pre_tokenizer") or {}, parts.get("normalizer") or {}
    splits = [x for x in pre.get("pretokenizers", [pre]) if x.get("type") == "Split"]
    safe = {"NFC", "Lowercase", "Replace"}
    kept = all(x["type"] in safe and (x["type"] != "Replace" or x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in norm.get("normalizers", [norm] if norm else []))
    return bool(splits) and splits[0].get("invert", False) and splits[0].get("behavior") == "Removed" and kept and not any(c.isspace() for x in parts.get("added_tokens", []) for c in x["content"])


@lru_cache(2)
def _loaded(definition: str):
    """The tokenizer and the ids of words so far, which a worker keeps from task to task."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition), {}


class Encoder:
    """Token ids of texts."""

    def __init__(self, definition: str, end_id: int):
        (self.tokenizer, self.known), self.end = _loaded(definition), end_id
        self.by_words = independent_words(definition)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts with their ends, one after another, and where each text begins; one more entry is the end."""
        if self.by_words:
            return self.put_together(texts)
        each = [[*x.ids, self.end] for x in self.tokenizer.encode_batch_fast([(x or b"").decode() for x in texts], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.cumsum([0, *map(len, each)])

    def ids_of(self, words: list[bytes]) -> list[list[int]]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = words
        # a run of printable ASCII is what the model itself gets; its bytes stand for themselves there
        simple = [w for w in new if w.isascii() and (w.isalpha() or b"'" not in w and b"<" not in w and w.decode().isprintable())]
        for w in simple:
            self.known[w] = [x.id for x in self.tokenizer.model.tokenize(w.decode())]
        rest = [w for w in new if w not in self.known]
        for w, x in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            self.known[w] = x.ids
        return [self.known[w] for w in words]

    def put_together(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        joined = b" ".join(x or b"" for x in texts).lower()
        data = np.frombuffer(joined, np.uint8)
        starts, ends = runs_of(data)
        distinct, at, which = np.unique(byte_words.hashes(data, starts, ends), return_index=True, return_inverse=True)
        words = self.ids_of([joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
        # the last entry of the table is the end id, which follows the words of each text
        sizes = np.array([*map(len, words), 1], np.int64)
        flat = np.fromiter(chain(chain.from_iterable(words), [self.end]), np.uint32, sizes.sum())
        begins = np.cumsum(sizes) - sizes
        closes = np.cumsum([len(x or b"") + 1 for x in texts])
        upto = np.searchsorted(starts, closes)  # words before the end of each text
        order = np.insert(which, upto, len(distinct))
        n = sizes[order]
        out = np.cumsum(n) - n
        ids = flat[np.repeat(begins[order] - out, n) + np.arange(n.sum())]
        return ids, np.append(0, out[upto + np.arange(len(texts))] + 1)


def pieces(docs: DataFrame, definition: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, with the task (part) and the piece's number among those of
    its length in the task (nth)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(definition, end_id), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            begin = 0
            for texts in chunks(batch["text"].to_pylist(), SLICE_BYTES):
                ids, at = encoder.encode(texts)
                rows = []
                for doc_id, low, high in zip(batch["doc_id"][begin : begin + len(texts)].to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    for k, x in enumerate(range(low, high, capacity)):
                        length = min(capacity, high - x)
                        rows.append((doc_id, k, x - low, length, zlib.crc32(ids[x : x + length].astype("<u4").tobytes()), part, seen[length]))
                        seen[length] += 1
                begin += len(texts)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


class Tightest:
    """Segment tree over rooms 0 to capacity: which rooms have open sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        at = room + self.leaves
        self.open[at] = is_open
        while at := at >> 1:
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def at_least(self, room: int) -> int | None:
        """The smallest open room that is `room` or more."""
        at = room + self.leaves
        while not self.open[at]:
            while at & 1:
                at >>= 1
                if not at:
                    return None
            at += 1
            if at & (at - 1) == 0:  # over the right edge of its level
                return None
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, n, sequence, each, offset): of the pieces of a length, numbers first to first + n go to the
    sequences from `sequence` on, `each` of them in a sequence, at `offset` there. Longest first, tightest room first."""
    tree, ranges, runs, sequences = Tightest(capacity), defaultdict(deque), [], 0

    def put(room: int, begin: int, n: int) -> None:
        if n and room:
            if not ranges[room]:
                tree.set(room, True)
            ranges[room].append((begin, n))

    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            room = tree.at_least(length)
            if room is None:
                room, begin, have = capacity, sequences, -(-(n - done) // (capacity // length))
                sequences += have
            else:
                begin, have = ranges[room].popleft()
                if not ranges[room]:
                    tree.set(room, False)
            each = room // length
            whole = min(have, (n - done) // each)  # sequences that get as many as they hold
            rest = min(n - done - whole * each, each) if whole < have else 0
            runs.append((length, done, whole * each + rest, begin, each, capacity - room))
            done += whole * each + rest
            put(room - each * length, begin, whole)
            if rest:
                put(room - rest * length, begin + whole, 1)
            used = whole + bool(rest)
            put(room, begin + used, have - used)
    return runs


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    definition = Path(tokenizer or default_tokenizer()).read_text()
    found = materialize(pieces(docs, definition, capacity, end_id), "pieces")
    by_task = materialize(found.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length: at most `capacity`
    runs = np.array(sorted(best_fit(counts, capacity)), np.int64).reshape(-1, 6)
    held = spark.sparkContext.broadcast(runs)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = found.join(by_task.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = held.value
        begins = {k: np.searchsorted(runs[:, 0], (k, k + 1)) for k in np.unique(runs[:, 0]).tolist()}
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            at = np.empty(len(length), np.int64)
            for k in np.unique(length).tolist():
                low, high = begins[k]
                mine = length == k
                at[mine] = low + np.searchsorted(runs[low:high, 1], number[mine], "right") - 1
            _, first, _, sequence, each, offset = runs[at].T
            r = number - first
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(sequence + r // each), pa.array(offset + r % each * length)], schema=schema)

    return numbered.select(*columns, "number").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
