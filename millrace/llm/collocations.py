"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are sequences of three words, edges sequences of four: the longest grams, which join nodes that overlap in two words.
Only edges are gathered: each place of a text gives one row, its longest gram, cut where its piece ends (a correction at
the piece's end). The count of a shorter gram is the flow through it: the sum over the rows that begin with it, edges and
corrections alike. So one sort of the rows by their words gives the counts of all four lengths at once.

Edges that must follow each other (the node between has no other edge, begin or end, so all three have one count) form a
unary path. Paths are compacted by pointer doubling into (path, place); behind its first edge a path adds only what each
next word adds to the phrases it contains, all with the path's count.

Codes: words among the `dictionary` most frequent (2,097,150 at most, a broadcast of bounded size) have a code of 21 bits, so
that three of them are one long, and the fourth an int. Rows end before a word that too few places have. Other words that the
dictionary lacks are kept in a bitmap of fixed size, and so are their pairs with a neighbour that have enough places. Grams
with such a word are rows of their own, of up to four 64-bit word hashes, that end where a pair isn't in the bitmap; their
flow counts for the lengths from that word on, and from two words on. Results don't depend on the dictionary or on false
hits of the bitmaps.

Scale: a slice's rows are summed before the shuffle. They are dealt by language and first two words; pairs that a slice
has often (HOT of all places or more, 2 / HOT pairs at most) are dealt by three words, and their sums meet once more.
Behind the sums only grams of `least` places or more go on; a part of such a gram has as many places, so none is lost.

Scores are compared after floor(2000000 * a / (l + r)), in decimals of 38 digits. Words are told apart by 64-bit hashes
(`byte_words`). Defined cases: a null lang is `und` (and so the same as that text); null and empty texts have no words;
rows that share a doc_id count one by one; an empty table gives no rows. Only text and lang are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import byte_words
from .common import as_bytes, materialize, release

SLICE_BYTES = 4_000_000
#: Bits of a code, and the most words that have one.
BITS = 21
DICTIONARY = (1 << BITS) - 2
#: Bits of the filter of words that the dictionary lacks.
BITMAP = 1 << 24
#: Share of all places from which a word pair is dealt by three words.
HOT = 1 / 1000
#: Longest word of the dictionary, in bytes.
LONGEST = 64
_kinds = byte_words.kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
_mix = np.uint64(0x94D049BB133111EB)
_u64 = np.uint64


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, bytes, starts, ends, hash, opens) for the words of runs of texts of one language; opens: first of its piece.
    Texts wait by language until there are SLICE_BYTES of one, or four times as many of all."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def words(lang: str):
        joined = b"\n".join(held.pop(lang)).lower()
        del size[lang]
        data = np.frombuffer(joined, np.uint8)
        starts, ends, opens = byte_words.spans(data, _kinds)
        return (lang, joined, starts, ends, byte_words.hashes(data, starts, ends), opens) if len(starts) else None

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
                held.setdefault(lang, []).append(text or b"")
                size[lang] = size.get(lang, 0) + len(text or b"") + 1
                if size[lang] >= SLICE_BYTES and (found := words(lang)):
                    yield found
            while sum(size.values()) > 4 * SLICE_BYTES:
                if found := words(max(size, key=size.get)):
                    yield found
    for lang in sorted(held):
        if found := words(lang):
            yield found


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ^ (a >> _u64(31))) * _mix + b


def following(x: np.ndarray, piece: np.ndarray, by: int) -> np.ndarray:
    """The value `by` places further in the same piece, else 0."""
    out = np.zeros_like(x)
    same = piece[by:] == piece[:-by] if by < len(x) else np.zeros(0, bool)
    out[: len(same)][same] = x[by:][same]
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, word, c) for the words of a slice, (lang, pair, null, c) for its frequent pairs."""
    for lang, data, starts, ends, h, opens in slices(batches):
        distinct, at, c = np.unique(h, return_index=True, return_counts=True)
        words = [data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
        pairs, often = np.unique(pair_hash(h[:-1], h[1:])[~opens[1:]], return_counts=True)
        hot = often >= max(2, HOT / 2 * len(h))
        keys = np.concatenate([distinct, pairs[hot]]).view(np.int64)
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.array(keys), pa.array(words + [None] * int(hot.sum()), pa.binary()), pa.array(np.concatenate([c, often[hot]]))], names=["lang", "h", "word", "c"])


class Codes:
    """The dictionary (sorted word hashes and their codes from 1, and the hash of each code), the hot pairs, and the bitmap
    of other words with enough places."""

    def __init__(self, words: np.ndarray, hot: list[int], others: np.ndarray):
        self.of_code = np.append(0, words).astype(np.int64).view(np.uint64)
        order = np.argsort(self.of_code[1:], kind="stable")
        self.sorted, self.codes = self.of_code[1:][order], (order + 1).astype(np.uint64)
        self.hot, self.others = np.sort(np.array(hot, np.int64).view(np.uint64)), others

    @staticmethod
    def places(x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, x), max(len(among) - 1, 0))
        return at, among[at] == x if len(among) else np.zeros(len(x), bool)

    def code(self, h: np.ndarray) -> np.ndarray:
        """Codes of words, 0 for those that the dictionary lacks."""
        at, found = self.places(h, self.sorted)
        return np.where(found, self.codes[at], _u64(0)) if len(self.sorted) else np.zeros(len(h), np.uint64)


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & _u64(BITMAP - 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & _u64(1) == 1


def pair_in(lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of words of a language."""
    return pair_hash(pair_hash(np.full(len(a), zlib.crc32(lang.encode()), np.uint64), a), b)


def _other_pairs(held):
    """(h, c): pairs of neighbours of which the dictionary lacks one or both, each with enough places by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = held.value
        for lang, _, _, _, h, opens in slices(batches):
            coded = codes.code(h) != 0
            other = ~coded & in_bitmap(codes.others, h)
            first = np.flatnonzero(~opens[1:] & (coded | other)[1:] & (coded | other)[:-1] & (other[1:] | other[:-1]))
            pairs, c = np.unique(pair_in(lang, h[first], h[first + 1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(c, pa.int32())], names=["h", "c"])

    return run, "h long, c int"


def _coded_edges(held):
    """(lang, k, d, hot, c): the longest gram at each place as codes (three in k, the fourth in d), up to the first word without
    one; summed by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = held.value
        for lang, _, _, _, h, opens in slices(batches):
            piece, own = np.cumsum(opens), codes.code(h)
            k, d, alive = own << _u64(2 * BITS), np.zeros(len(own), np.uint32), own != 0
            for j in (1, 2, 3):
                word = following(own, piece, j)
                alive &= word != 0
                word[~alive] = 0
                if j < 3:
                    k |= word << _u64(BITS * (2 - j))
                else:
                    d = word.astype(np.uint32)
            # equal rows stand together in order of a hash of both
            distinct, at, c = np.unique(pair_hash(k, d.astype(np.uint64)), return_index=True, return_counts=True)
            at, c = at[own[at] != 0], c[own[at] != 0]
            hot = codes.places(pair_hash(h[at], following(h, piece, 1)[at]), codes.hot)[1]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(c)), pa.array(k[at].view(np.int64)), pa.array(d[at].view(np.int32)), pa.array(hot), pa.array(c, pa.int32())], names=["lang", "k", "d", "hot", "c"])

    return run, "lang string, k long, d int, hot boolean, c int"


def _other_edges(held, pairs):
    """(lang, k, hot, c, cut): the grams with a word that the dictionary lacks, as four hashes; cut: the number of words up
    to the first such word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = held.value
        for lang, _, _, _, h, opens in slices(batches):
            piece, coded = np.cumsum(opens), codes.code(h) != 0
            other = ~coded & in_bitmap(codes.others, h)
            usable, near = coded | other, other.copy()
            for j in (1, 2, 3):
                near |= following(other, piece, j)
            places = np.flatnonzero(near & usable)
            grams, alive = np.zeros((len(places), 4), np.uint64), np.ones(len(places), bool)
            first = np.full(len(places), 4)
            for j in range(4):
                at = np.minimum(places + j, len(h) - 1)
                alive &= (places + j < len(h)) & (piece[at] == piece[places]) & usable[at]
                if j:
                    alive &= ~(other[at] | other[at - 1]) | in_bitmap(pairs.value, pair_in(lang, h[at - 1], h[at]))
                grams[alive, j] = h[at[alive]]
                first = np.where(alive & other[at] & (first == 4), j, first)
            some = (first < 4) & (grams[:, 1] != 0)  # single words have been counted
            grams, first = grams[some], first[some]
            rows, at, c = np.unique(grams.astype(">u8").view("V32").ravel(), return_index=True, return_counts=True)
            hot = codes.places(pair_hash(grams[at, 0], grams[at, 1]), codes.hot)[1]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(c)), fixed(rows.view(np.uint8), len(c), 32), pa.array(hot), pa.array(c, pa.int32()), pa.array(first[at] + 1, pa.int32())], names=["lang", "k", "hot", "c", "cut"])

    return run, "lang string, k binary, hot boolean, c int, cut int"


def fixed(data: np.ndarray, n: int, width: int) -> pa.Array:
    """n binary values of one width."""
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


class Flow:
    """Sums over one language's rows, in order of their words: what has been read of the group that is open at each length."""

    def __init__(self, least: int, of_code: np.ndarray | None):
        self.least, self.of_code = least, of_code  # of_code: words are codes, else hashes
        self.last, self.sums = None, [0] * 4

    def add(self, words: np.ndarray, cut: np.ndarray, hot: np.ndarray, c: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Closed groups (length, words, f), given the next rows."""
        out = []
        new = np.zeros(len(c), bool)
        for j in range(4):
            new[1:] |= words[1:, j] != words[:-1, j]
            new[0] = not self.last or new[0] or words[0, j] != self.last[0][0, j]
            at = np.flatnonzero(new)
            sums = np.add.reduceat(c, at) if len(at) else np.empty(0, np.int64)
            self.sums[j] += int(c[: at[0]].sum() if len(at) else c.sum())
            if len(at):
                if self.last:
                    self.keep(out, j, np.array([self.sums[j]]), *self.last)
                self.keep(out, j, sums[:-1], words[at[:-1]], cut[at[:-1]], hot[at[:-1]])
                self.sums[j] = int(sums[-1])
        self.last = (words[-1:].copy(), cut[-1:], hot[-1:])
        return out

    def keep(self, out: list, j: int, f: np.ndarray, words: np.ndarray, cut: np.ndarray, hot: np.ndarray) -> None:
        """A group counts at a length if its gram is that long, and the dictionary lacks one of its words, if of any. Counts of
        single words and of hot pairs are parts of sums, and all kept."""
        if j == 0 and self.of_code is None:
            return
        counts = (words[:, j] != 0) & (cut <= j + 1) & ((f >= self.least) | (j == 0) | (hot & (j == 1)))
        if counts.any():
            key = words[counts, : j + 1]
            out.append((j + 1, key if self.of_code is None else self.of_code[key.astype(np.int64)], f[counts]))

    def close(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out = []
        for j in range(4) if self.last else ():
            self.keep(out, j, np.array([self.sums[j]]), *self.last)
        return out


def _flow(held, least: int, coded: bool):
    """(lang, level, key, f) of the groups of rows in order of k."""
    shifts, mask = np.array([2 * BITS, BITS, 0], np.uint64), _u64((1 << BITS) - 1)

    def rows(lang: str, found: list) -> Iterator[pa.RecordBatch]:
        for level, words, f in found:
            n = len(f)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.repeat(pa.scalar(level, pa.int32()), n), fixed(words.astype(">u8").view(np.uint8), n, 8 * level), pa.array(f)], names=["lang", "level", "key", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flows: dict[str, Flow] = {}
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            for n, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(langs.indices.to_numpy() == n)
                part = batch if len(mine) == batch.num_rows else batch.take(pa.array(mine))
                if coded:
                    three = (part["k"].to_numpy().view(np.uint64)[:, None] >> shifts) & mask
                    words, cut = np.column_stack([three, part["d"].to_numpy().astype(np.uint64)]), np.zeros(len(mine), np.int64)
                else:
                    words, cut = np.frombuffer(b"".join(part["k"].to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64), part["cut"].to_numpy()
                flow = flows.setdefault(lang, Flow(least, held.value.of_code if coded else None))
                yield from rows(lang, flow.add(words, cut, part["hot"].to_numpy(zero_copy_only=False), part["c"].to_numpy().astype(np.int64)))
        for lang, flow in flows.items():
            yield from rows(lang, flow.close())

    return run, "lang string, level int, key binary, f long"


def bitmap_of(counted: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashes h, of BITMAP / 64 longs, and how many it has."""
    bits = counted.select(F.expr(f"h & {BITMAP - 1}L").alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"), F.count("*").alias("n")).toArrow()
    out = np.zeros(BITMAP >> 6, np.int64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return out.view(np.uint64), int(bits["n"].to_numpy().sum())


def gram_counts(docs: DataFrame, least: int, dictionary: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, level, key, f) of the grams with at least `least` places, key being the hashes of their words; (lang, n); and
    (lang, h, word) of the words among them."""
    spark = docs.sparkSession
    texts = as_bytes(docs.withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("und"))), "lang")
    seen = texts.mapInArrow(_counts, "lang string, h long, word binary, c long")
    counted = materialize(seen.groupBy("lang", "h", F.col("word").isNull().alias("pair")).agg(F.sum("c").alias("c"), F.min("word").alias("word")), "words")
    total = counted.where("not pair").agg(F.sum("c")).first()[0] or 0
    of_word = counted.where(~F.col("pair")).groupBy("h").agg(F.sum("c").alias("c"), F.max(F.octet_length("word")).alias("bytes")).where(F.col("c") >= least)
    short, most = of_word.where(F.col("bytes") <= LONGEST), min(dictionary, DICTIONARY)
    known = materialize((short if short.count() <= most else short.orderBy(F.desc("c"), "h").limit(most)).select("h"), "dictionary")
    some = known.toArrow()["h"].to_numpy()  # `most` at most
    rare = materialize(of_word.join(known, "h", "left_anti").select("h"), "other-words")
    others, n_others = bitmap_of(rare)
    hot = [r.h for r in counted.where("pair").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT / 2 * total).select("h").collect()]  # 2 / HOT rows at most
    held = spark.sparkContext.broadcast(Codes(some, hot, others))
    first = lambda n: F.xxhash64(F.substring("k", 1, 8 * n))
    code = lambda n: F.xxhash64(F.shiftrightunsigned("k", BITS * (3 - n)))
    sums = None
    passes = [(_coded_edges(held), code, True)] * bool(len(some))
    if n_others:
        run, schema = _other_pairs(held)
        pairs = texts.mapInArrow(run, schema).groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
        passes.append((_other_edges(held, spark.sparkContext.broadcast(bitmap_of(pairs)[0])), first, False))
    for (run, schema), begin, coded in passes:
        rows = texts.mapInArrow(run, schema).repartition("lang", F.when(F.col("hot"), begin(3)).otherwise(begin(2))).sortWithinPartitions(*(["k", "d"] if coded else ["k"]))
        run, schema = _flow(held, least, coded)
        parts = rows.mapInArrow(run, schema)
        sums = parts if sums is None else sums.union(parts)
    single = counted.where(~F.col("pair")).join(rare, "h", "left_semi").select("lang", F.lit(1).alias("level"), F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("key"), F.col("c").alias("f"))
    sums = single if sums is None else sums.union(single)
    sums = materialize(sums.groupBy("lang", "level", "key").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "grams")
    held.destroy()
    n = counted.where("not pair").groupBy("lang").agg(F.sum("c").alias("n"))
    return sums, n, counted.where(~F.col("pair") & (F.col("c") >= least)).select("lang", "h", "word")


def cut_key(first: int | Column, n: int | Column) -> Column:
    """The n words of a key from number `first` (from 0) on."""
    return F.substring("key", F.lit(first) * 8 + 1, F.lit(n) * 8)


def floored_score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)), exactly; a has at most 18 digits."""
    return F.expr(f"cast(2000000 as decimal(20,0)) * cast({a} as decimal(18,0)) div (cast({l} as decimal(19,0)) + cast({r} as decimal(19,0)))")


def unary_paths(grams: DataFrame) -> DataFrame:
    """(lang, key, f, path, place) of all edges: the first edge of the edge's path, and how many edges after it this is. A
    node continues a path if one edge leads to it and one from it, both with all of its flow."""
    edges = grams.where("level = 4").select("lang", "key", "f")
    nodes = grams.where("level = 3").select("lang", F.col("key").alias("node"), F.col("f").alias("flow"))
    into = edges.select("lang", cut_key(1, 3).alias("node"), "f", F.col("key").alias("before"))
    inner = nodes.join(into, ["lang", "node"]).where("f = flow").select("lang", "node", "flow", "before")
    after = edges.withColumn("node", cut_key(0, 3)).join(inner, ["lang", "node"], "left")
    after = after.withColumn("before", F.when(F.col("f") == F.col("flow"), F.col("before")))
    single = materialize(after.select("lang", "key", "f", "before"), "paths")
    # pointer doubling over the edges that continue a path: `at` points back `place` edges until it reaches a first edge
    now = materialize(single.where("before is not null").select("lang", "key", F.col("before").alias("at"), F.lit(1).cast("long").alias("place")), "pointers")
    while True:
        to = now.select("lang", F.col("key").alias("at"), F.col("at").alias("further"), F.col("place").alias("more"))
        step = now.join(to, ["lang", "at"], "left").select("lang", "key", F.coalesce("further", "at").alias("at"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("further").isNotNull().alias("moved"))
        later = materialize(step, "pointers")
        release(now)
        now = later.drop("moved")
        now._written_at = later._written_at
        if not later.where("moved").limit(1).count():
            break
    out = materialize(single.join(now, ["lang", "key"], "left").select("lang", "key", "f", F.coalesce("at", "key").alias("path"), F.coalesce("place", F.lit(0)).alias("place")), "paths")
    release(single, now)
    return out


def held_inside(grams: DataFrame, paths: DataFrame) -> DataFrame:
    """(lang, key, most) of grams of two and three words: the highest count of a longer gram that contains them. A path's
    first edge contains five; a next edge adds the two that end in its last word."""
    first = F.array(*(cut_key(k, n) for n in (2, 3) for k in range(5 - n)))
    added = F.array(cut_key(2, 2), cut_key(1, 3))
    of_paths = paths.select("lang", "f", F.explode(F.when(F.col("place") == 0, first).otherwise(added)).alias("key"))
    of_nodes = grams.where("level = 3").select("lang", "f", F.explode(F.array(cut_key(0, 2), cut_key(1, 2))).alias("key"))
    return of_paths.union(of_nodes).groupBy("lang", "key").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, share: tuple[int, int] = (80, 100), dictionary: int = DICTIONARY) -> DataFrame:
    """Each language's first `most` phrases: lang, rank, phrase, a, l, r, n, score, and path_words, the length of the unary
    path that a phrase of four words lies on (of others, their own)."""
    num, den = share
    often, n, words = gram_counts(docs, least, dictionary)
    paths = unary_paths(often)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    inside = held_inside(often, paths)
    left = often.where("level > 1").join(inside, ["lang", "key"], "left").where(F.col("most").isNull() | (den * exact("most") < num * exact("f")))
    cuts = left.select("lang", "key", "level", "f", F.explode(F.sequence(F.lit(1), F.col("level") - 1)).alias("cut"))
    part = often.select("lang", F.col("key").alias("part"), F.col("f").alias("of_part"))
    first = cuts.withColumn("part", cut_key(0, F.col("cut"))).join(part, ["lang", "part"]).withColumnRenamed("of_part", "l").drop("part")
    both = first.withColumn("part", cut_key(F.col("cut"), F.col("level") - F.col("cut"))).join(part, ["lang", "part"]).withColumnRenamed("of_part", "r").drop("part")
    scored = both.withColumn("score", floored_score("f", "l", "r"))
    lowest = scored.groupBy("lang", "key", "level", F.col("f").alias("a")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "key", "level", "a", "x.l", "x.r", "x.score")
    up_to = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    some = materialize(lowest.withColumn("up_to", up_to).where(F.col("up_to") <= most).drop("up_to"), "top")
    # the words of what is left
    at = some.select("lang", "key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("level") - 1), lambda k: F.conv(F.hex(F.substring(F.col("key"), k * 8 + 1, F.lit(8))), 16, -10).cast("long"))).alias("k", "h"))
    spelt = at.join(words, ["lang", "h"]).groupBy("lang", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("word").cast("string").alias("w")))), lambda x: x["w"]), " ").alias("phrase"))
    length = paths.join(some.select("lang", "key"), ["lang", "key"], "left_semi").select("lang", "key", "path")
    of_path = paths.join(length.select("lang", "path").distinct(), ["lang", "path"], "left_semi").groupBy("lang", "path").agg((F.max("place") + 4).alias("path_words"))
    out = some.join(spelt, ["lang", "key"]).join(length.join(of_path, ["lang", "path"]).drop("path"), ["lang", "key"], "left").join(n, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.coalesce("path_words", F.col("level").cast("long")).alias("path_words"))
