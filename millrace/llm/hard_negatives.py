"""Hard-negative mining: for each anchor and each of its positives, the best rows of other labels whose score lies in a window
below the positive's.

Scores are integer inner products of vectors whose components are floor(256 * x). An anchor's positives are its best rows
of the same label. The windows of an anchor's positives overlap, so rows aren't looked for window by window: the upper
limits of the windows cut the scores into disjoint slots. Tasks keep the best rows of each slot, a shuffle merges those of
the tasks, and from the lowest slot up each slot's list, followed by the merged list of the slots below it and cut, answers
the windows that begin in it.

Scale: the two searches (positives, then slots) are matrix products of slices of the rows with blocks of about `block`
anchors, dealt by a hash of the id and broadcast. What is shuffled are at most `positives` rows, then `positives` times
`negatives` rows, for an anchor and task. No rows are grouped by label or vector, so neither needs to be even. The anchors
are a stated query set: one row in `every`, against all rows.

Defined cases: rows with a null id, label or vector, or a null or non-finite component (also after the factor 256), take
no part. Of anchor rows that share an id the least (label, then vector) is the anchor, and none of that id's rows is its
positive or negative; other rows that share an id count one by one. A component that a shorter vector lacks counts as 0.
Scores beyond 64 bits count as the largest or least long. A positive with a score below 0 has an empty window. Ties go to
the smaller id. No anchors or no rows give no rows. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Rows of a slice that is multiplied with a block at once.
SLICE = 2048
#: Below this, products of components add up exactly in doubles.
EXACT = float(1 << 53)
NONE = -np.inf
_far = (1 << 63) - 1


def whole_vectors(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and the matrix of whole components of a batch's usable rows, by id; short vectors are filled with 0."""
    v = batch["v"]
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = np.diff(v.offsets.to_numpy())
    flat = np.floor(256.0 * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    m = np.zeros((len(size), int(size.max(initial=0))))
    m[np.arange(m.shape[1]) < size[:, None]] = flat
    ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
    good = np.flatnonzero(np.isfinite(m).all(1))
    order = good[np.argsort(ids[good], kind="stable")]
    return ids[order], labels[order], m[order]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b: doubles where these are exact, else whole numbers as objects."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1) < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -_far - 1, _far)


def best(s: np.ndarray, wanted: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best wanted columns of each row, in any order; columns are in order of id. Where a row has
    fewer, the score is None (objects) or NONE."""
    n = s.shape[1]
    if s.dtype == object or np.abs(s).max(initial=0) * n >= EXACT:
        key = np.full(s.shape, None, object)
        key[wanted] = s[wanted]
        order = np.array([sorted(range(n), key=lambda j, row=row: (row[j] is None, -(row[j] or 0), j))[:k] for row in key], np.int64).reshape(len(s), min(k, n))
    else:
        key = np.where(wanted, s * n - np.arange(n), NONE)
        order = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), s.shape)
        key = np.where(wanted, s, NONE)
    return np.take_along_axis(key, order, 1), ids[order]


class Kept:
    """The k best (score, id) so far of each of some lists."""

    def __init__(self, lists: int, k: int):
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(lists)]
        self.k = k

    def add(self, lists: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> None:
        s, ids = found
        for at, row, some in zip(lists.tolist(), s.tolist(), ids.tolist()):
            new = [(int(x), i) for x, i in zip(row, some) if x is not None and x != NONE]
            if new:
                self.rows[at] = sorted(self.rows[at] + new, key=lambda x: (-x[0], x[1]))[: self.k]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield whole_vectors(batch.slice(at, SLICE))


def find_positives(rows: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """(anchor_id, score, id): a task's k best rows of the label of each anchor of the block."""
    held = rows.sparkSession.sparkContext.broadcast(whole_vectors(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, a = held.value
        kept, every = Kept(len(anchor_ids), k), np.arange(len(anchor_ids))
        for ids, labels, m in _slices(batches):
            if len(ids) and len(anchor_ids):
                wanted = (anchor_labels[:, None] == labels) & (anchor_ids[:, None] != ids)
                kept.add(every, best(scores(a, m), wanted, ids, k))
        out = [(int(anchor_ids[n]), *x) for n, row in enumerate(kept.rows) for x in row]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 3)], names=["anchor_id", "score", "id"])

    return rows.mapInArrow(run, "anchor_id long, score long, id long")


def find_in_slots(rows: DataFrame, block: pa.Table, slots: pa.Table, k: int) -> DataFrame:
    """(anchor_id, slot, score, id): a task's k best rows of other labels in each slot (above bottom, up to top) of each anchor."""
    anchors = whole_vectors(block)
    place = {x: n for n, x in enumerate(anchors[0].tolist())}
    held = rows.sparkSession.sparkContext.broadcast((anchors, [(place[x["anchor_id"]], x["slot"], x["top"], x["bottom"]) for x in slots.to_pylist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (anchor_ids, anchor_labels, a), slots = held.value
        at, slot, top, bottom = np.array(slots, np.int64).reshape(-1, 4).T
        kept = Kept(len(at), k)
        for ids, labels, m in _slices(batches):
            if not (len(ids) and len(at)):
                continue
            s = scores(a, m)
            other = (anchor_labels[:, None] != labels) & (anchor_ids[:, None] != ids)
            for x in np.unique(slot):
                mine = np.flatnonzero(slot == x)
                part = s[at[mine]]
                wanted = other[at[mine]] & ((part <= top[mine, None]) & (part > bottom[mine, None])).astype(bool)
                some = np.flatnonzero(wanted.any(1))
                kept.add(mine[some], best(part[some], wanted[some], ids, k))
        out = [(int(anchor_ids[at[n]]), int(slot[n]), *x) for n, row in enumerate(kept.rows) for x in row]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)], names=["anchor_id", "slot", "score", "id"])

    return rows.mapInArrow(run, "anchor_id long, slot long, score long, id long")


def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("nth", order).where(F.col("nth") <= k)


def slots_of(positives: DataFrame, low: int, high: int, den: int) -> DataFrame:
    """The slots of each anchor: the highest upper limit has slot 0. A slot ends above the next limit, the last one below
    the least lower limit."""
    p = F.col("score").cast("decimal(25,0)")
    limits = positives.where("score >= 0").select("anchor_id", F.floor(p * high / den).cast("long").alias("top"), F.ceil(p * low / den).cast("long").alias("least"))
    of_top = limits.groupBy("anchor_id", "top").agg(F.min("least").alias("least"))
    here = Window.partitionBy("anchor_id")
    down = here.orderBy(F.desc("top"))
    return of_top.select("anchor_id", (F.row_number().over(down) - 1).cast("long").alias("slot"), "top", F.coalesce(F.lead("top").over(down), F.min("least").over(here) - 1).alias("bottom"))


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int, int] = (30, 90, 100), block: int = 1024, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows whose id is divisible
    by `every`; window is (low, high, den): low * positive <= den * negative <= high * positive."""
    low, high, den = window
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).where("id is not null and label is not null and v is not null")
    of_id = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"))
    anchors = materialize(of_id.select("id", "x.label", "x.v"), "anchors")
    blocks = max(1, -(-anchors.count() // block))
    all_positives = all_found = None
    for n in range(blocks):
        held = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toArrow()
        best_same = materialize(first(find_positives(rows, held, positives), ["anchor_id"], positives), "positives")
        slots = materialize(slots_of(best_same, low, high, den), "slots")
        found = materialize(first(find_in_slots(rows, held, slots.toArrow(), negatives), ["anchor_id", "slot"], negatives), "in-slots")
        same = best_same.join(slots.select("anchor_id", "slot", "top"), "anchor_id").where(F.col("top") == F.floor(F.col("score").cast("decimal(25,0)") * high / den))
        all_positives, all_found = (same, found) if n == 0 else (all_positives.union(same), all_found.union(found))
    item = F.struct("nth", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    lists = all_found.groupBy("anchor_id", "slot").agg(F.array_sort(F.collect_list(item)).alias("list"))  # `negatives` rows at most
    merged = lists.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "list"))).alias("of_slot"))
    nothing = F.slice(F.array(F.struct(F.lit(0).alias("nth"), F.lit(0).cast("long").alias("negative_id"), F.lit(0).cast("long").alias("negative_score"))), 1, 0)
    from_below = F.aggregate(
        F.sequence(F.lit(positives - 1).cast("long"), F.lit(0).cast("long"), F.lit(-1).cast("long")), F.array(nothing),
        lambda below, k: F.concat(F.array(F.slice(F.concat(F.coalesce(F.element_at("of_slot", k), nothing), below[0]), 1, negatives)), below),
    )
    answers = merged.select("anchor_id", from_below.alias("of_slot"))
    pairs = all_positives.join(answers, "anchor_id").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(F.element_at("of_slot", (F.col("slot") + 1).cast("int"))).alias("k", "x"))
    fits = F.col("x.negative_score").cast("decimal(25,0)") * den >= F.col("positive_score").cast("decimal(25,0)") * low
    return pairs.where(fits).select("anchor_id", "positive_id", (F.col("k") + 1).cast("int").alias("rank"), "x.negative_id", "positive_score", "x.negative_score")
