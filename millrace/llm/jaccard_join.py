"""N-gram Jaccard join by vertical partitioning, and the groups that its links form.

Every text is the set of its distinct word n-grams, as 64-bit hashes. The global n-gram order is cut into fragments at
fixed hash values; of two sets, each fragment is intersected on its own, and the partial overlaps are summed per pair.

1. *First fragment, all sets.* A set can lack at most a fixed share of its n-grams in any partner, so of its n-grams in
   the first fragment nearly all must be in some other set as well. Sets that fail this are done: they have no link.
2. *Fronts.* The n-grams of the sets that are left are put in order of frequency, rarest first. Partners share an n-gram
   in the front of their sets, early enough that what follows it can reach the threshold.
3. *All fragments.* Pairs that are left are intersected fragment by fragment and summed.

Big groups: equal sets are one class from the start, so copies never pair up. Inside a bucket (sets with the same front
n-gram), pairs are first counted against one hub only; what those links already connect is not compared again, and only
pairs of sets from different components of one bucket follow, as far as their sizes and places allow a link. A group of
k near copies thus costs about k pairs, not k * k, and every link between components is found: the result is exact but
for collisions of 64-bit n-gram hashes (below 1e-9 for a pair) and 128-bit set digests. The operator gives the classes
that the links form, not the list of links: pairs inside of a class that is connected already are never counted.

Scale: texts are reread instead of shuffled (two narrow passes, and one over the sets that step 1 leaves). Shuffled are
the first fragment of all sets (27 % of the n-grams at 0.85), combined per slice of texts before, so that a frequent
n-gram sends one row a slice; then the n-grams of the sets of step 2. Behind that nothing is windowed by an n-gram: hubs
and counts are aggregates joined back, which adaptive execution splits where one n-gram is hot. Those joins merge at every
size, so what a small table shows of shuffle and disk holds for a large one. Broadcast is a bitmap of BITMAP bits (8 MB).

Defined cases: null or empty text, or text without words: no n-grams, linked with nothing, its own group; fewer than n
words: the whole sequence is the one n-gram. Rows that share a doc_id count as one document with one group; a null
doc_id takes no part and has a null group. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, chunks, materialize, release, words_of

BITMAP = 1 << 26
FRAGMENTS = 4
#: The first fragment's share of the n-grams beyond the share that a partner can lack.
MARGIN = 0.12
SLICE_BYTES = 16_000_000
#: Multipliers of a public 64-bit mixer (fixed values).
_mix = np.uint64(0xBF58476D1CE4E5B9)
_mix2 = np.uint64(0x94D049BB133111EB)
_step = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of a word, kept for the batch."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes (uint64) of a text's word n-grams."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):  # word by word, so that words in another order give another hash
        total ^= h[k : len(h) - width + 1 + k]
        total *= _step
        total ^= total >> np.uint64(29)
    total ^= total >> np.uint64(30)
    total *= _mix
    total ^= total >> np.uint64(27)
    total *= _mix2
    total ^= total >> np.uint64(31)
    return np.unique(total)


def node_of(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def tag_of(node: bytes) -> int:
    """Half of a set's digest, as a long."""
    return int.from_bytes(node[:8], "little", signed=True)


class Cuts:
    """Where the hash order is cut: the first fragment, and the rest in equal parts."""

    def __init__(self, num: int, den: int):
        first = int(min(0.95, (den - num) / den + MARGIN) * 2**64)
        rest = (2**64 - first) // (FRAGMENTS - 1)
        self.at = np.array([first + k * rest for k in range(FRAGMENTS - 1)], np.uint64)

    def first(self, found: np.ndarray) -> np.ndarray:
        return found[: np.searchsorted(found, self.at[0])]

    def split(self, found: np.ndarray) -> list[np.ndarray]:
        return np.split(found, np.searchsorted(found, self.at))


def _survey(n: int):
    """Each text's size and digest."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("tag", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes, nodes = WordHashes(), [], []
            for x in batch["text"]:
                found = shingles(x.as_py(), n, hashes)
                sizes.append(len(found))
                nodes.append(node_of(found))
            tags = [None if node is None else tag_of(node) for node in nodes]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(tags, pa.int64())], schema=schema)

    return run, "doc_id long, n_shingles long, node binary, tag long"


def _first_fragment(n: int, cuts: Cuts):
    """Of every slice of texts: (gram, tag) for the n-grams of the first fragment that one set of the slice has, (gram,
    null) for those that more of them have, and (null, tag, held, local) for each set: its n-grams in the fragment, and
    how many of them another set of the slice has."""
    schema = pa.schema([("gram", pa.int64()), ("tag", pa.int64()), ("held", pa.int32()), ("local", pa.int32())])

    def rows(gram, tag, held, local) -> pa.RecordBatch:
        size = len(next(x for x in (gram, tag) if x is not None))
        return pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if x is None else pa.array(x, f.type) for x, f in zip((gram, tag, held, local), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = WordHashes()
            for texts in chunks(batch["text"].to_pylist(), SLICE_BYTES):
                parts: dict[int, np.ndarray] = {}
                for x in texts:
                    found = shingles(x, n, hashes)
                    if len(found):
                        parts.setdefault(tag_of(node_of(found)), cuts.first(found))
                if not parts:
                    continue
                tags, held = np.fromiter(parts, np.int64, len(parts)), np.array([len(x) for x in parts.values()])
                grams, own = np.concatenate(list(parts.values())), np.repeat(np.arange(len(parts)), held)
                distinct, at, count = np.unique(grams, return_inverse=True, return_counts=True)
                often = count[at] > 1
                yield rows(grams[~often].view(np.int64), tags[own[~often]], None, None)
                yield rows(distinct[count > 1].view(np.int64), None, None, None)
                yield rows(None, tags, held, np.bincount(own[often], minlength=len(parts)))

    return run, "gram long, tag long, held int, local int"


def bitmap(ids: DataFrame) -> np.ndarray:
    """A fixed-size filter of doc_ids: at most BITMAP / 64 words reach the driver, whatever the number of ids."""
    bit = F.col("bit")
    words = ids.select(bit_of("doc_id").alias("bit")).groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP >> 6, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def bit_of(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BITMAP))


def _segments(n: int, cuts: Cuts, wanted):
    """(doc_id, node, fragment, grams) of the texts that the bitmap lets through."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            at = batch["bit"].to_numpy(zero_copy_only=False).astype(np.uint64)
            batch = batch.filter(pa.array((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1))
            hashes = WordHashes()
            begin = 0
            for texts in chunks(batch["text"].to_pylist(), SLICE_BYTES):
                out: list[tuple] = []
                for doc_id, x in zip(batch["doc_id"][begin : begin + len(texts)].to_pylist(), texts):
                    found = shingles(x, n, hashes)
                    node = node_of(found)
                    if node is None:
                        continue
                    out.extend((doc_id, node, k, part.view(np.int64)) for k, part in enumerate(cuts.split(found)) if len(part))
                begin += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)

    return run, "doc_id long, node binary, fragment int, grams array<long>"


def least_overlap(a: Column, b: Column, num: int, den: int) -> Column:
    """The overlap from which den * intersection >= num * union holds for sets of these sizes."""
    return F.ceil((num * (a.cast("long") + b.cast("long"))) / F.lit(num + den)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for the nodes of edges (a, b), comp being the least node of the component: rounds of large and small
    stars, each an aggregate over a node's neighbours joined back, until the edges stay the same."""
    now = materialize(edges.select("a", "b").where("a <> b"), "stars")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node move to the least of its neighbourhood
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        # small star: a node and its neighbours below it move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        after = materialize(large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "stars")
        release(now, large)
        now = after
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before:
            out = materialize(now.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()), "labels")
            release(now)
            return out
        before = (state.n, state.h)


class Join:
    """One run of the join over documents; the intermediate tables are in the shared folder."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int):
        self.n, self.num, self.den, self.cuts = n, num, den, Cuts(num, den)
        self.spark = docs.sparkSession
        self.texts = as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
        run, schema = _survey(n)
        self.docs = materialize(self.texts.mapInArrow(run, schema), "survey")
        sets = self.docs.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("tag").alias("tag"), F.first("n_shingles").cast("int").alias("size"))
        self.sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
        self.links: list[DataFrame] = []

    def lack(self, size: str) -> Column:
        """How many n-grams of a set of this size a partner can lack."""
        return F.floor((self.den - self.num) * F.col(size) / F.lit(self.den)).cast("int")

    def suspects(self) -> DataFrame:
        """The sets of which another set, or others together, have enough of the first fragment."""
        run, schema = _first_fragment(self.n, self.cuts)
        rows = self.texts.where("doc_id is not null").select("text").mapInArrow(run, schema).withColumn("k", F.coalesce("gram", "tag"))
        same = Window.partitionBy("k")
        shared = (F.min("tag").over(same) != F.max("tag").over(same)) | (F.max(F.col("tag").isNull()).over(same))
        flagged = rows.withColumn("shared", shared).where("tag is not null and (held is not null or shared)")
        # copies in several slices count more than once, which only keeps more sets
        counts = flagged.groupBy("tag").agg(F.max("held").alias("held"), F.max("local").alias("local"), F.count_if(F.col("held").isNull()).alias("others"))
        rest = self.sets.join(counts.hint("merge"), "tag").where(F.col("local") + F.col("others") >= F.col("held") - self.lack("size"))
        return materialize(rest.select("id", "doc_id", "node", "size"), "suspects")

    def segments(self, suspects: DataFrame) -> DataFrame:
        """(id, size, fragment, grams) of the suspects, each fragment once."""
        wanted = self.spark.sparkContext.broadcast(bitmap(suspects))
        run, schema = _segments(self.n, self.cuts, wanted)
        found = self.texts.where("doc_id is not null").withColumn("bit", bit_of("doc_id")).mapInArrow(run, schema)
        out = found.join(suspects.hint("merge"), ["doc_id", "node"]).dropDuplicates(["doc_id", "node", "fragment"])
        out = materialize(out.select("id", "size", "fragment", "grams"), "segments")
        wanted.destroy()
        return out

    def fronts(self, suspects: DataFrame) -> DataFrame:
        """(gram, id, size, place, weight): the front of each set in the global order by frequency. N-grams that no other
        suspect has come first, and are left out; a set whose front has no others is done."""
        each = self.all_segments.select("id", F.explode("grams").alias("gram"))
        often = each.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1")
        listed = each.join(often.hint("merge"), "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("l"))
        alone = F.col("size") - F.size("l")
        front = F.slice("l", F.lit(1), F.greatest(self.lack("size") + 1 - alone, F.lit(0)))
        places = F.transform("front", lambda x, i: F.struct(x["gram"].alias("gram"), (i + alone).alias("place")))
        weight = F.aggregate("front", F.lit(0).cast("long"), lambda s, x: s + x["sets"])
        rows = suspects.select("id", "size").join(listed.hint("merge"), "id").withColumn("front", front).select("id", "size", weight.alias("weight"), F.explode(places).alias("x"))
        return materialize(rows.select("x.gram", "id", "size", "x.place", "weight"), "fronts")

    def buckets(self, at: DataFrame, seed: int) -> DataFrame:
        """Of each front n-gram in two or more components: the hub, the component with most rows, and how many pairs of
        rows from different components there are. The first hub is the set whose buckets are the largest; later ones are
        drawn by a hash."""
        if seed:
            at = at.withColumn("weight", F.xxhash64("id", F.lit(seed)))
        of_comp = at.groupBy("gram", "comp").agg(F.count("*").alias("n"), F.max(F.struct("weight", "id", "size", "place")).alias("hub"))
        of_gram = of_comp.groupBy("gram").agg(
            F.count("*").alias("comps"), F.max(F.struct("hub.weight", "hub.id", "hub.size", "hub.place", "comp")).alias("hub"), F.max(F.struct("n", "comp")).alias("most"),
            ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"), F.sum("n").alias("n_rows"),
        )
        return of_gram.where("comps > 1").select("gram", "hub", F.col("most.comp").alias("most"), "pairs", "n_rows")

    def counted(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b, a_size, b_size) the links (a, b): fragments are intersected, then summed per pair."""
        pairs = materialize(pairs, "pairs")
        left = self.all_segments.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("a_grams"))
        right = self.all_segments.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("b_grams"))
        partial = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "fragment"]).select("a", "b", "a_size", "b_size", F.size(F.array_intersect("a_grams", "b_grams")).alias("overlap"))
        summed = partial.groupBy("a", "b", "a_size", "b_size").agg(F.sum("overlap").alias("overlap"))
        out = materialize(summed.where(F.col("overlap") >= least_overlap(F.col("a_size"), F.col("b_size"), self.num, self.den)).select("a", "b"), "links")
        release(pairs)
        return out

    def enough(self) -> Column:
        """Whether two rows x_, y_ of a bucket leave both sets enough from here on: so it is at the first n-gram that the
        sets of a link share."""
        need = least_overlap(F.col("x_size"), F.col("y_size"), self.num, self.den)
        near = self.num * F.greatest("x_size", "y_size").cast("long") <= self.den * F.least("x_size", "y_size").cast("long")
        return near & (F.col("x_size") - F.col("x_place") >= need) & (F.col("y_size") - F.col("y_place") >= need)

    def pairs(self, met: DataFrame) -> DataFrame:
        pick = lambda a, b: F.when(F.col("x_id") < F.col("y_id"), F.col(a)).otherwise(F.col(b))
        return met.select(pick("x_id", "y_id").alias("a"), pick("y_id", "x_id").alias("b"), pick("x_size", "y_size").alias("a_size"), pick("y_size", "x_size").alias("b_size")).distinct()

    def against_hubs(self, rows: DataFrame, buckets: DataFrame) -> DataFrame:
        """Candidate pairs of each bucket's hub with its rows of other components."""
        names = lambda p, of="": [F.col(of + c).alias(p + c) for c in ("id", "size", "place", "comp")]
        met = rows.select("gram", *names("x_")).join(buckets.select("gram", *names("y_", "hub.")).hint("merge"), "gram")
        return self.pairs(met.where((F.col("x_comp") != F.col("y_comp")) & self.enough()))

    def across(self, rows: DataFrame, buckets: DataFrame) -> DataFrame:
        """Candidate pairs of rows of one bucket in different components. Of two components one isn't the bucket's largest,
        so the rows of the largest meet only the others."""
        ranked = rows.join(buckets.select("gram", "most").hint("merge"), "gram").withColumn("other", F.col("comp") != F.col("most"))
        side = lambda p: [F.col(c).alias(p + c) for c in ("gram", "id", "size", "place", "comp", "other")]
        x, y = ranked.where("other").select(side("x_")), ranked.select(side("y_"))
        once = ~F.col("y_other") | (F.col("x_id") < F.col("y_id"))
        return self.pairs(x.join(y.hint("merge"), (F.col("x_gram") == F.col("y_gram")) & (F.col("x_comp") != F.col("y_comp")) & once & self.enough()))

    def run(self, rounds: int = 6, enough: int = 8) -> DataFrame | None:
        """(id, comp) of every set that has a link. Each round counts the buckets' hubs against their rows of other
        components. The last one, which comes once there are at most `enough` pairs of rows for a row, or a round has
        found nothing, or after `rounds`, counts all pairs across components."""
        suspects = self.suspects()
        self.all_segments = self.segments(suspects)
        rows, labels = self.fronts(suspects), None
        release(suspects)
        for k in range(rounds + 1):
            at = rows.withColumn("comp", F.col("id")) if labels is None else rows.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            buckets = materialize(self.buckets(at, k), "buckets")
            still = materialize(at.join(buckets.select("gram").hint("merge"), "gram", "left_semi").drop("comp"), "fronts")
            release(rows)
            rows = still
            at = rows.withColumn("comp", F.col("id")) if labels is None else rows.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            total = buckets.agg(F.sum("pairs").alias("pairs"), F.sum("n_rows").alias("n_rows")).first()
            last = k == rounds or (k > 0 and (not found or (total.pairs or 0) <= enough * (total.n_rows or 0)))
            links = self.counted(self.across(at, buckets) if last else self.against_hubs(at, buckets))
            release(buckets)
            found = links.limit(1).count()
            self.links.append(links)
            if found:
                edges = links if labels is None else links.union(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")))
                after = components(edges)
                if labels is not None:
                    release(labels)
                labels = after
            if last:
                break
        release(rows, self.all_segments)
        return labels


def groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links reach) of every row of docs."""
    join = Join(docs, n, num, den)
    labels = join.run()
    sets = join.sets.select("node", "id", F.col("doc_id").alias("least"))
    rows = join.docs.where("node is not null and doc_id is not null")
    twice = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    several = twice.limit(1).count() > 0
    if several:  # rows of one doc_id with different texts: that document links them
        number = sets.select("node", "id")
        of_id = rows.join(twice.select("doc_id", F.col("a").alias("first")), "doc_id").where("node <> first").select("first", "node").distinct()
        edges = of_id.join(number.select(F.col("node").alias("first"), F.col("id").alias("a")), "first").join(number.withColumnRenamed("id", "b"), "node").select("a", "b")
        labels = components(edges if labels is None else edges.union(labels.select(F.col("id").alias("a"), F.col("comp").alias("b"))))
    if labels is None:
        known = sets.select("node", F.col("least").alias("component_id"))
    else:
        of_comp = sets.join(labels, "id").groupBy("comp").agg(F.min("least").alias("of_comp"))
        known = sets.join(labels.join(of_comp, "comp"), "id", "left").select("node", F.coalesce("of_comp", "least").alias("component_id"))
    out = join.docs.join(known.hint("merge"), "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    if several:
        out = out.drop("component_id").join(out.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    done = materialize(out, "groups")
    release(join.docs, join.sets, *join.links, *([] if labels is None else [labels]))
    return done


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in gone. A bitmap of the ids, of BITMAP / 64 words at most, is broadcast as a table
    and lets most texts stay where they are; only those that it marks are shuffled to the ids themselves."""
    number = F.col("doc_id").cast("long")
    bit = F.pmod(F.xxhash64(number), F.lit(BITMAP))
    words = gone.select(bit.alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__bit & 63 as int))")).alias("__bits"))
    at = docs.withColumn("__bit", bit).withColumn("__at", F.shiftright("__bit", 6)).join(F.broadcast(words), "__at", "left")
    marked = F.coalesce(F.expr("(shiftright(__bits, cast(__bit & 63 as int)) & 1L) = 1L"), F.lit(False))
    own = [F.col(f"`{c}`") for c in docs.columns]
    some = at.where(marked).withColumn("__id", number).join(gone.select(number.alias("__id")), "__id", "left_anti")
    return at.where(~marked).select(*own).union(some.select(*own))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group; repeated rows of that doc_id and null ids stay."""
    gone = groups(docs, n, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    return without(docs, gone)
