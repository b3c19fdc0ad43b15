"""Quality classifier: naive Bayes support vectors.

Byte 3-gram indicators, and a few indicators of repetition, are scaled by their class log-count ratios; a linear
hinge-loss model is then fitted on the scaled indicators by dual coordinate descent, and its margin is mapped to
0..1 by a logistic curve fitted on rows that the descent didn't see.

Scale: the model is fitted on at most `max_rows` labelled rows (the only sample, chosen by a hash of doc_id); the
fitted weights are a fixed 2**BITS floats, so what is broadcast doesn't grow. Scoring is one narrow pass: no shuffle.

Defined cases: null text scores like the empty text, which has no indicator but the shortest-length one; a document
whose labels disagree evenly isn't learned from; null labels and null ids are ignored in training; with no labels, or
one class only, every score is the share of label 1 among the training rows (0.5 without rows). Repeated rows are
scored one by one; extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod

BITS = 18
SIZE = 1 << BITS
#: The last places hold the indicators of repetition and length; hashed 3-grams take the rest.
SHAPE_AT = SIZE - 64


def indicators(text: bytes | None) -> np.ndarray:
    """Sorted distinct indicator numbers of a whole text."""
    text = text or b""
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(a) >= 3:
        grams = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        if len(grams) > 20_000:  # marking beats sorting for long texts
            seen = np.zeros(1 << 24, bool)
            seen[grams] = True
            grams = np.flatnonzero(seen).astype(np.uint32)
        else:
            grams = np.unique(grams)
        hashed = ((grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64) % SHAPE_AT
        hashed = np.unique(hashed)
    else:
        hashed = np.empty(0, np.int64)
    words = text.split()
    n = len(words)
    distinct = len(set(words)) / n if n else 1.0
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    once = len(set(lines)) / len(lines) if lines else 1.0
    upper = sum(map(bytes.isupper, words)) / n if n else 0.0
    size = min(7, int(np.log2(n + 1) / 2))
    shape = [int(distinct * 9.999) + 10 * (n >= 50), 20 + int(pairs * 9.999), 30 + int(once * 9.999), 40 + int(upper * 9.999), 50 + size]
    return np.concatenate([hashed, np.array(shape, np.int64) + SHAPE_AT])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: bytes | None) -> float:
        x = indicators(text)
        margin = float(self.weights[x].sum()) / np.sqrt(len(x)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of (smoothed share of an indicator among label 1) / (among label 0)."""
    counts = [np.full(SIZE, alpha), np.full(SIZE, alpha)]
    for x, y in zip(rows, labels):
        counts[int(y)][x] += 1
    p, q = (c / (alpha + (labels == k).sum()) for k, c in ((1, counts[1]), (0, counts[0])))
    return np.log(p / q)


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """L2-regularized hinge loss: one dual variable a row, kept in [0, cost of its class]; stops when none moves."""
    w, b = np.zeros(SIZE), 0.0
    signs = np.where(labels == 1, 1.0, -1.0)
    share = max(1e-9, (labels == 1).mean())
    most = np.where(labels == 1, cost * 0.5 / share, cost * 0.5 / max(1e-9, 1 - share))
    scaled = lambda x: scale[x] / np.sqrt(len(x))  # noqa: E731  # anew at each visit: kept, they are twice the bytes of the rows
    curve = np.array([(scaled(x) ** 2).sum() + 1.0 for x in rows])
    dual, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, y = rows[i], signs[i]
            v = scaled(x)
            gradient = y * (float(w[x] @ v) + b) - 1.0
            new = min(max(dual[i] - gradient / curve[i], 0.0), most[i])
            if step := new - dual[i]:
                dual[i] = new
                w[x] += step * y * v
                b += step * y
                moved = max(moved, abs(gradient))
        if moved < 1e-2:
            break
    return w, b


def fit_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve over margins by damped Newton steps."""
    a, c = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -30, 30)))
        g = np.array([((p - labels) * margins).sum() + 1e-2 * (a - 1), (p - labels).sum() + 1e-2 * c])
        s = p * (1 - p)
        h = np.array([[(s * margins * margins).sum() + 1e-2, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
    return (a, c) if a > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    aside = np.arange(len(labels)) % 5 == 4
    if len(np.unique(labels[aside])) < 2:
        aside[:] = False
    learn = [x for x, out in zip(rows, aside) if not out]
    scale = log_count_ratios(learn, labels[~aside])
    w, b = dual_coordinate_descent(learn, scale, labels[~aside], cost, epochs, seed)
    w = w * scale
    held = rows if not aside.any() else [x for x, out in zip(rows, aside) if out]
    margins = np.array([w[x].sum() / np.sqrt(len(x)) + b for x in held])
    slope, shift = fit_curve(margins, labels if not aside.any() else labels[aside])
    return Model(w, b, slope, shift)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, held_out_remainder: int | None = 1) -> Model:
    """Fits on at most max_rows labelled rows, those with the least hash of doc_id; rows whose crc32(doc_id as text)
    mod 3 is held_out_remainder are never learned from (None: all may be)."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    if held_out_remainder is not None:
        known = known.where(crc_mod("doc_id", 3) != held_out_remainder)
    known = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality")).where("quality <> 0.5")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indicators(x.as_py()).astype(np.int32).tobytes() for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(found, pa.binary())], names=["doc_id", "quality", "found"])

    picked = as_bytes(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "quality")
    # rows that share a doc_id become one before they leave the executors
    each = picked.mapInArrow(numbers, "doc_id long, quality double, found binary").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("found").alias("found"))
    # as one Arrow table, whose buffers the rows share: a Python row for each would take the driver several times its bytes
    got = each.toArrow().sort_by("doc_id")
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in got["found"]]
    return fit(rows, (got["quality"].to_numpy() > 0.5).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (double) and predicted (int) of every row: one narrow pass over the texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            s = [m.score(x.as_py()) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(scored, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model predicts as label 1, with all their columns; one narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch["text"].cast(pa.binary()) if batch.num_rows else []
            yield batch.filter(pa.array([m.score(x.as_py()) >= 0.5 for x in texts], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
