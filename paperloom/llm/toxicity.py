"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, their stems (first STEMS bytes, which stand for inflected forms), pairs of
neighbours and pairs with one word between them, of the lower-cased text, hashed to 2^BITS places;
a document has each of its features once. Training is sequential
FTRL-proximal with per-coordinate rates and L1, over a bounded sample of labelled rows; the weights
that L1 leaves are few and are sent to all workers, which score whole texts.

Training is one task, over MOST_ROWS labelled rows of MOST_BYTES of text at most, with all their
features; everything else is spread. The strength of L1 is chosen among L1S by the log loss of a fifth
of those rows, which are all learnable. STEMS, ALPHA and PASSES were chosen the same way, by the log
loss of a fifth of the learnable rows; MOST_ROWS and MOST_BYTES say what one task can hold and are
no choice by quality. Held-out rows take no part in any of them.

Defined results: null and empty texts have the bias alone; without labels of both kinds every score
is the share of toxic labels (0.5 without any); null labels and labels that contradict each other
are left out; rows that repeat a doc_id are scored each on their own, a null doc_id is never held
out; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS, THRESHOLD = 20, 0.7
STEMS = (4, 5, 6, 7, 8)
#: Labelled rows that training takes at most: those with the smallest hash of doc_id.
MOST_ROWS = 1 << 14
#: Bytes of their texts at most, by rising hash: a row that no longer fits is passed over. A byte of text makes 16 bytes of features at most.
MOST_BYTES = 64 << 20
#: Places that fewer sampled rows have are not learned; 1 learns all.
LEAST_ROWS = 1
ALPHA, BETA, L2, PASSES = 1.0, 1.0, 1e-3, 3
#: L1 to choose from, and the one where there is nothing to choose by.
L1S, L1 = (1.0, 2.0, 3.0, 4.0), 3.0
#: One of so many learnable rows judges the choice of L1.
INNER = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"'()[]{}|#*$%&<>")] = True


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) of all rows, sorted. Punctuation splits words as white space does."""
    clean = _LOWER[data]
    clean[_PUNCT[data]] = 32
    lo, hi, row = C.word_bounds(clean, at)
    h = C.hashes(clean, lo, hi)
    parts, rows = [h], [row]
    for k in STEMS:
        long = hi - lo > k
        parts.append(C.hashes(clean, lo[long], lo[long] + k, k))
        rows.append(row[long])
    for gap, seed in ((1, 1), (2, 2)):
        if len(h) > gap:
            near = row[:-gap] == row[gap:]
            parts.append(C.mix64(C.pair(h[:-gap][near], h[gap:][near]) + np.uint64(seed)))
            rows.append(row[:-gap][near])
    key = (np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(parts) >> np.uint64(64 - BITS))
    key = np.unique(key)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in C.slices(batch):
            row, place = features(data, at)
            yield pa.RecordBatch.from_arrays([rows.column("y"), rows.column("h"), C.lists(place.astype(np.int32), np.bincount(row, minlength=rows.num_rows), pa.int32())], names=["y", "h", "x"])


def ftrl(x: list[np.ndarray], y: np.ndarray, passes: int = PASSES, strength: float = L1) -> np.ndarray:
    """Weights, the bias last; FTRL-proximal with an L1 of `strength`, one row at a time in the order given."""
    n_places = (1 << BITS) + 1
    z, n = np.zeros(n_places), np.zeros(n_places)
    bias = n_places - 1
    if LEAST_ROWS > 1:
        rows = np.bincount(np.concatenate(x), minlength=n_places)  # a row has a place once
        x = [v[rows[v] >= LEAST_ROWS] for v in x]
    for _ in range(passes):
        for places, label in zip(x, y, strict=True):
            i = np.append(places, bias)
            zi, ni = z[i], n[i]
            rate = (BETA + np.sqrt(ni)) / ALPHA + L2
            l1 = np.where(i == bias, 0.0, strength)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / rate)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    l1 = np.full(n_places, strength)
    l1[bias] = 0
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def strength(x: list[np.ndarray], y: np.ndarray, judge: np.ndarray, among: tuple[float, ...] = L1S) -> float:
    """The L1 whose weights, learned from the other rows, give the rows of `judge` the least log loss; of equal ones the strongest. L1 itself where either part has labels of one kind alone."""
    if any(len(np.unique(y[part])) < 2 for part in (judge, ~judge)):
        return L1
    losses = []
    for l1 in among:
        w = ftrl([v for v, own in zip(x, judge, strict=True) if not own], y[~judge], strength=l1)
        s = np.array([w[v].sum() + w[-1] for v, own in zip(x, judge, strict=True) if own])
        losses.append((float(np.logaddexp(0, np.where(y[judge] > 0, -s, s)).mean()), -l1))
    return -min(losses)[1]


def _train(t: pa.Table) -> pa.Table:
    t = t.sort_by("h").combine_chunks()
    lists = t.column("x").combine_chunks()
    at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    x, y = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], t.column("y").to_numpy()
    w = ftrl(x, y, strength=strength(x, y, t.column("h").to_numpy() % INNER == 0))
    place = np.flatnonzero(w)
    return pa.table({"place": pa.array(place.astype(np.int64)), "weight": pa.array(w[place])})


def fitting(sizes: list[tuple[int, int]], most_bytes: int) -> list[int]:
    """Of (hash, bytes), the hashes that fit into most_bytes, taken by rising hash; one that doesn't fit any more is passed over."""
    out, left = [], most_bytes
    for h, size in sorted(sizes):
        if size <= left:
            out.append(h)
            left -= size
    return out


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> dict[int, float]:
    """Weights by place; place 2^BITS is the bias. labels: doc_id, y."""
    clear = labels.where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", F.col("y").cast("double").alias("y"), F.xxhash64("doc_id").alias("h"))
    sample = C.at_most(clear, most_rows)
    share = sample.agg(F.avg("y")).first()[0]
    if share in (None, 0.0, 1.0):
        p = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        return {1 << BITS: float(np.log(p / (1 - p)))}
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")  # at most most_rows rows of three numbers
    sizes = [(r[0], r[1] or 0) for r in texts.groupBy("h").agg(F.sum(F.octet_length("text"))).collect()]  # at most most_rows pairs
    if sum(size for _, size in sizes) > most_bytes:
        fit = docs.sparkSession.createDataFrame([(h,) for h in fitting(sizes, most_bytes)], "h long")
        texts = texts.join(F.broadcast(fit), "h", "left_semi")
    made = texts.select("y", "h", "text").mapInArrow(_featured, "y double, h long, x array<int>")
    return {r[0]: r[1] for r in made.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_train, "place long, weight double").collect()}


def score(docs: DataFrame, weights: dict[int, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((np.fromiter(weights, np.int64, len(weights)), np.fromiter(weights.values(), float, len(weights))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        w[sent.value[0]] = sent.value[1]
        for batch in batches:
            for rows, data, at in C.slices(batch):
                row, place = features(data, at)
                s = np.bincount(row, weights=w[place], minlength=rows.num_rows) + w[-1]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; only labels of rows that aren't held out are learned from."""
    own = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("y"))
    with C.scratch(docs.sparkSession):
        weights = train(docs, own)
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def query(spark, sf_dir):
    return toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
