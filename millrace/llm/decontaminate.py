"""Benchmark decontamination: rare n-gram seeds find candidate places, Smith-Waterman alignment scores them.

Words are runs of letters and digits (A-Z lower-cased), so changed punctuation doesn't hide a copy. Every word of the
test items is counted over all texts; of an item's n-grams the SHARE with the rarest words are its rare seeds (at least
MIN_SEEDS, or all), the others its common ones. Words are counted, not n-grams: an n-gram that leaks is frequent for that
very reason, and the n-grams that an edited copy has lost would seem the rarest. Rarity is relative within an item, so an
item that many texts leak keeps its seeds. A place of a text that has a rare seed, or common ones twice, is aligned with
the item: match +1, mismatch and gap -0.5 a word, local, over the item's length; edited, cut or reworded copies score by
how much of the item they keep. A copy that isn't aligned has no rare n-gram of the item and at most one common one;
n-grams of short items (SHORT) that edits have broken up are found by those of one word less, which count as common ones.

Scale: two narrow passes over the texts, no shuffle of text. Broadcast is a block of items of at most about
`block_words` words; a larger benchmark is taken in several such blocks, each against all texts. Pairs are aligned in
groups of at most CELLS words of texts, or one by one: a pair with an item of m words takes memory in proportion to m.

Defined cases: null or empty texts and items match nothing; an item with fewer than n words is one seed; repeated items
and texts are matched one by one, so a pair can appear once per repeated row of its text; null item ids are ignored.
Only doc_id and text are read, and only item_id and text of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks

MIN_SEEDS = 8
#: Share of an item's n-grams of which one is enough; of the others two are. The tests hold the found pairs against all.
SHARE = 0.75
#: Items of fewer words also have seeds of one word less, which are common ones.
SHORT = 32
CELLS = 1 << 18
MISMATCH = 0.5
GAP = 0.5
#: Bytes to bytes: A-Z to a-z, other ASCII that is no letter or digit to a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


@dataclass
class Block:
    """Items as word numbers, and their n-grams as keys with the (item, place) pairs that have them."""

    n: int
    words: dict[bytes, int]
    item_ids: list[int]
    items: list[np.ndarray]
    keys: np.ndarray  # sorted distinct n-gram keys
    where: list[list[tuple[int, int]]]  # of each key
    width: list[int]

    @staticmethod
    def of(rows: list[tuple[int, bytes]], n: int) -> Block:
        words: dict[bytes, int] = {}
        ids, items = [], []
        for item_id, text in rows:
            found = plain_words(text)
            if found:
                ids.append(item_id)
                items.append(np.array([words.setdefault(w, len(words)) for w in found], np.int64))
        found_at: dict[int, list[tuple[int, int]]] = {}
        width_of: dict[int, int] = {}
        for k, item in enumerate(items):
            for width in (n, n - 1) if n <= len(item) < SHORT and n > 1 else (n,):
                for q, key in enumerate(keys_of(item, width).tolist()):
                    found_at.setdefault(key, []).append((k, q))
                    width_of[key] = min(width, len(item))
        keys = np.array(sorted(found_at), np.int64)
        return Block(n, words, ids, items, keys, [found_at[x] for x in keys.tolist()], [width_of[x] for x in keys.tolist()])

    def numbers(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' words as numbers (-1: in no item), n - 1 gaps of -1 behind each text; and where texts begin."""
        get, parts, begin, at = self.words.get, [], [], 0
        for text in texts:
            words = plain_words(text)
            begin.append(at)
            at += len(words) + self.n - 1
            parts.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
            parts.append(np.full(self.n - 1, -1, np.int64))
        return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(begin, np.int64)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, key places) of the n-grams of the texts that items have."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        shortest = min(min(map(len, self.items)), self.n - (self.n > 1 and any(len(x) < SHORT for x in self.items)))
        places, which = [], []
        for width in range(min(self.n, shortest), self.n + 1):  # items shorter than n have a key of their own width
            keys = keys_of(numbers, width, whole=False)
            at = np.flatnonzero(keys >= 0)
            k = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            same = self.keys[k] == keys[at]
            places.append(at[same])
            which.append(k[same])
        return np.concatenate(places), np.concatenate(which)


def keys_of(numbers: np.ndarray, n: int, whole: bool = True) -> np.ndarray:
    """A key for each n-gram of word numbers, -1 where one of them isn't in any item. whole: a shorter sequence is one
    n-gram of its own width. The width is part of the key."""
    if len(numbers) < n:
        return keys_of(numbers, len(numbers)) if whole and len(numbers) else np.empty(0, np.int64)
    out = np.zeros(len(numbers) - n + 1, np.uint64)
    good = np.ones(len(out), bool)
    for k in range(n):
        part = numbers[k : len(numbers) - n + 1 + k]
        good &= part >= 0
        out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = (out + np.uint64(n)) >> np.uint64(1)
    return np.where(good, out.astype(np.int64), -1)


def align(texts: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over rows of word numbers, many pairs at once: best score and the place in the text where it
    ends. A row of the matrix needs its left neighbours; a running maximum over score + GAP * place gives them."""
    ramp = GAP * np.arange(texts.shape[1] + 1)
    above = np.zeros((len(texts), texts.shape[1] + 1))
    best, end = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i in range(items.shape[1]):
        here = np.zeros_like(above)
        step = np.where((texts == items[:, i : i + 1]) & (texts >= 0), 1.0, -MISMATCH)
        here[:, 1:] = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] - GAP), 0.0)
        above = np.maximum.accumulate(here + ramp, axis=1) - ramp
        at = above.argmax(1)
        top = above[np.arange(len(above)), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
    return best, end


def padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def groups_of(order: list, sizes: list[int], cells: int) -> Iterator[list]:
    """Runs of pairs, the smallest first, of at most `cells` padded words each, or of one pair."""
    begin = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k + 1 - begin) * sizes[k] > cells:
            yield order[begin:k]
            begin = k


def matches(block: Block, seeds: np.ndarray, texts: list[bytes | None], least: float, cells: int = CELLS) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, behind the last word) of every pair that scores at least `least`. seeds: which keys
    are enough alone."""
    numbers, begin = block.numbers(texts)
    places, which = block.hits(numbers)
    windows: dict[tuple[int, int, int], int] = {}
    text_of = np.searchsorted(begin, places, side="right") - 1
    for t, p, k in zip(text_of.tolist(), (places - begin[text_of]).tolist(), which.tolist()):
        for item, q in block.where[k]:
            window = (t, item, (p - q) // len(block.items[item]))
            windows[window] = windows.get(window, 0) + (2 if seeds[k] else 1)
    # a shift that an edit makes can part the two hits of a pair: those of the neighbour before count too
    wanted = [w for w, n in windows.items() if n + windows.get((w[0], w[1], w[2] - 1), 0) > 1 or n + windows.get((w[0], w[1], w[2] + 1), 0) > 1]
    ends = np.append(begin[1:], len(numbers)) - (block.n - 1)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    order = sorted(wanted, key=lambda w: len(block.items[w[1]]))
    for some in groups_of(order, [4 * len(block.items[w[1]]) for w in order], cells):
        items = [block.items[i] for _, i, _ in some]
        pads = [len(x) // 2 + 1 for x in items]
        starts = [max(0, b * len(x) - pad) for (_, _, b), x, pad in zip(some, items, pads)]
        parts = [numbers[begin[t] + s : min(begin[t] + (b + 2) * len(x) + pad, ends[t])] for (t, _, b), x, pad, s in zip(some, items, pads, starts)]
        scores, stops = align(padded(parts, -1), padded(items, -2))
        good = [j for j in range(len(some)) if scores[j] >= least * len(items[j])]
        if not good:
            continue
        # the same from behind, up to where the best alignment ends, tells where it begins
        _, back = align(padded([parts[j][: stops[j]][::-1] for j in good], -1), padded([items[j][::-1] for j in good], -2))
        for j, length in zip(good, back.tolist()):
            t, i, _ = some[j]
            stop = starts[j] + int(stops[j])
            found[t, i] = max(found.get((t, i), (-1.0, 0, 0)), (float(scores[j]) / len(items[j]), stop - length, stop))
    return [(t, i, *v) for (t, i), v in sorted(found.items())]


def blocks_of(benchmark: DataFrame, n: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks that fit the driver and a broadcast: items are dealt by a hash of their id."""
    items = as_bytes(benchmark.where("item_id is not null and text is not null").withColumn("item_id", F.col("item_id").cast("long")), "item_id")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-int(size) // (6 * block_words)) or 1
    for k in range(n_blocks):
        mine = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        yield Block.of(sorted((r.item_id, bytes(r.text)) for r in mine.collect()), n)


def rare_seeds(docs: DataFrame, block: Block) -> np.ndarray:
    """Which keys of the block are rare seeds: of each item the SHARE n-grams whose words are the rarest over all texts."""
    held = docs.sparkSession.sparkContext.broadcast(block)
    size = len(block.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text_slice in chunks(batch["text"].to_pylist()):
                total += np.bincount(b.numbers(text_slice)[0] + 1, minlength=size + 1)
        at = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1:][at])], names=["at", "n"])

    counts = np.ones(size)
    for r in as_bytes(docs).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] += r.n
    held.unpersist()
    weight = np.log(counts)
    of_item: list[dict[int, float]] = [{} for _ in block.items]
    for k, where in enumerate(block.where):
        for item, q in where:
            if block.width[k] == min(block.n, len(block.items[item])):
                of_item[item][k] = float(weight[block.items[item][q : q + block.n]].sum())
    out = np.zeros(len(block.keys), bool)
    for keys in of_item:
        rarest = sorted(keys, key=lambda k: (keys[k], k))
        out[rarest[: max(MIN_SEEDS, int(np.ceil(SHARE * len(rarest))))]] = True
    return out


PAIRS = "doc_id long, item_id long, score double, first_word long, end_word long"
_pairs = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.4, block_words: int = 1_000_000) -> DataFrame:
    """One row per (document, test item) whose alignment keeps at least `least` of the item."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    out = None
    for block in blocks_of(benchmark, n, block_words):
        held = docs.sparkSession.sparkContext.broadcast((block, rare_seeds(docs, block)))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b, seeds = held.value
            for batch in batches:
                ids, at = batch["doc_id"].to_pylist(), 0
                for texts in chunks(batch["text"].to_pylist()):
                    got = matches(b, seeds, texts, least)
                    yield pa.RecordBatch.from_pylist([{"doc_id": ids[at + t], "item_id": b.item_ids[i], "score": s, "first_word": first, "end_word": end} for t, i, s, first, end in got], schema=_pairs)
                    at += len(texts)

        found = as_bytes(docs, "doc_id").mapInArrow(scan, PAIRS)
        out = found if out is None else out.union(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.4, block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs, with all their columns, in which no test item scores at least `least`."""
    out = docs
    for block in blocks_of(benchmark, n, block_words):
        held = docs.sparkSession.sparkContext.broadcast((block, rare_seeds(docs, block)))

        def kept(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b, seeds = held.value
            for batch in batches:
                at, bad = 0, np.zeros(batch.num_rows, bool)
                for texts in chunks(batch["text"].cast(pa.binary()).to_pylist()):
                    bad[[at + m[0] for m in matches(b, seeds, texts, least)]] = True
                    at += len(texts)
                yield batch.filter(pa.array(~bad))

        out = out.mapInArrow(kept, docs.schema)
    return out
