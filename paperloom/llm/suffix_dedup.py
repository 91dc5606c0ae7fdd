"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that starts anywhere else.

Distributed prefix doubling over a sparse suffix array. A window of `length` bytes owns one sampled
position: the least of the hashed 16-byte strings that start in its first half. It depends on the
window's bytes alone, so equal windows sample the same place, and there is about one position for a
hundred bytes. Sampled suffixes are ranked by their first quarter of `length`, then by pairs of such
ranks at that offset (the first half); each round Spark groups the (rank, rank at the offset) pairs
and goes on with those that aren't unique. What is left is decided at full length: the windows of a
position span one string, its context; if the context occurs twice so do all its windows, and
otherwise each window is ranked by its whole `length` bytes, doubling from 8 on, among the different
contexts of its class. A group of copies is one context, whatever its size.

Ranks are 64-bit hashes, compared within a class that agrees on two others. Rows are told apart by
doc_id and a hash of the text, so rows that repeat a doc_id are documents of their own, and copies of
each other if their texts are equal; a null doc_id is an id like others. Defined results: null and
empty texts have no bytes and no spans; texts shorter than `length` lose nothing; an empty table gives
an empty result; other columns are not looked at. Cuts may fall inside a character: the result is
bytes. A text holds less than 2 GB, as any value of Spark's does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM = 400, 16
#: Bytes that a context may have and still be hashed without a digest.
_CONTEXT = 1 << 12
#: Rounds in which windows are ranked.
PARTS = 3


def least(key: np.ndarray, width: int) -> np.ndarray:
    """Where the least of every `width` keys in a row is; of equal ones the first."""
    at, have = np.arange(len(key)), 1
    while have < width:
        step = min(have, width - have)
        later = key[step:] < key[: len(key) - step]
        key, at = np.where(later, key[step:], key[: len(key) - step]), np.where(later, at[step:], at[: len(at) - step])
        have += step
    return at


def _sampled(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that own the same position: first and last start, and the position."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3
    eight = C.eights(data)
    own = least(C.pair(eight[: len(data) - GRAM + 1], eight[8 : len(data) - GRAM + 9]), length - 2 * (length // 4) + 1)
    lens = np.diff(at)
    starts = np.maximum(lens - length + 1, 0)
    ends = np.cumsum(starts)
    s = np.arange(int(ends[-1])) + np.repeat(at[:-1] - (ends - starts), starts)
    if not len(s):
        return (np.zeros(0, np.int64),) * 3
    own = own[s]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    last = np.append(first[1:], len(s)) - 1
    return s[first], s[last], own[first]


def _positions(length: int):
    block = length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in C.slices(batch):
                lo, hi, a = _sampled(data, at, length)
                r = np.searchsorted(at, lo, "right") - 1
                keys = [pa.array(rows.column(c).to_numpy(zero_copy_only=False)[r]) for c in C.ROW]
                long = lambda x: pa.array(x.view(np.int64))
                rank = lambda lo, hi, seed: long(C.hashes(data, lo, hi, seed, _CONTEXT))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*keys, pa.array((a - at[r]).astype(np.int32)), pa.array((a - hi).astype(np.int32)), pa.array((a - lo).astype(np.int32)), rank(a, a + block, 1), rank(a + block, a + 2 * block, 2), rank(lo, hi + length, 3)], names=[*C.ROW, "a", "near", "far", "r0", "r1", "context"])

    return run


def _windows(length: int):
    """Ranks at full length of all windows of the wanted positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in C.slices(batch):
                ranked = C.windows(C.eights(data)[: max(0, len(data) - 7)], length - 7)
                out: list[list] = [[], [], []]
                counts, ranks = [], []
                wants = rows.column("want").to_pylist()
                for i, want in enumerate(wants):
                    for w in want:
                        d = np.arange(w["near"], w["far"] + 1)
                        s = at[i] + w["a"] - d
                        ranks.append(C.mix64(ranked[s] + d.astype(np.uint64)))  # equal windows at the same distance
                        counts.append(len(s))
                        for column, v in zip(out, (w["class"], w["settled"], w["a"] - w["near"]), strict=True):
                            column.append(v)
                of = np.repeat(np.arange(rows.num_rows), [len(w) for w in wants])
                keys = [pa.array(rows.column(c).to_numpy(zero_copy_only=False)[of]) for c in C.ROW]
                flat = np.concatenate([*ranks, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.bool_(), pa.int32()), strict=True)), C.lists(flat, np.array(counts, np.int64), pa.int64())], names=[*C.ROW, "class", "settled", "last", "ranks"])

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Runs that these (from, to) cover, sorted; runs that touch are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > top[:-1]))
    return np.stack((spans[new, 0], np.maximum.reduceat(spans[:, 1], np.flatnonzero(new))), axis=1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in C.slices(batch):
            n, removed, runs, shas, kept = [], [], [], [], []
            lo, hi = rows.column("lo").to_pylist(), rows.column("hi").to_pylist()
            for i in range(rows.num_rows):
                body = data[at[i] : at[i + 1]]
                spans = merged(np.array([lo[i] or [], hi[i] or []], np.int64).T)
                keep = np.ones(len(body), bool)
                for a, b in spans.tolist():
                    keep[a:b] = False
                rest = body[keep].tobytes()
                n.append(len(body))
                removed.append(len(body) - len(rest))
                runs.append(len(spans))
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(spans.ravel().tolist())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(v, pa.int64()) for v in (n, removed, runs)), pa.array(shas, pa.string()), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """_k, _h, lo, hi: byte spans of rows (doc_id, text and their key) that repeated strings cover; they may overlap."""
    positions = docs.select(*C.ROW, "text").mapInArrow(_positions(length), "_k long, _h long, a int, near int, far int, r0 long, r1 long, context long")
    # round 1: the first quarter of the length; round 2: pairs of ranks at that offset
    # (ranks are written before they are joined, so that Spark can split a join on a rank that very many positions have)
    again = C.written(positions.groupBy("r0").count().where("count > 1").select("r0"))
    left = C.written(positions.join(again, "r0", "left_semi"), release=True)
    again = C.written(left.groupBy("r0", "r1").count().where("count > 1").select("r0", "r1"))
    named = left.join(again, ["r0", "r1"], "left_semi").select(*C.ROW, "a", "near", "far", F.xxhash64("r0", "r1").alias("class"), F.xxhash64("r0", "r1", "near", "far", "context").alias("name"))
    left2 = C.written(named, release=True)
    C.forget(left)
    # full length: contexts that occur twice, then the windows of those that don't
    contexts = C.written(left2.groupBy("class", "name", "near", "far").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*C.ROW, "a")).alias("at")))
    whole = contexts.where("n > 1").select("class", "name")
    settled = C.written(left2.join(whole, ["class", "name"], "left_semi").select(*C.ROW, (F.col("a") - F.col("far")).alias("lo"), (F.col("a") - F.col("near") + length).alias("hi")), release=True)
    C.forget(left2)
    mixed = contexts.groupBy("class").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("class")
    want = contexts.join(mixed, "class", "left_semi").select("at._k", "at._h", F.struct(F.col("at.a").alias("a"), "near", "far", "class", (F.col("n") > 1).alias("settled")).alias("want"))
    want = want.groupBy(*C.ROW).agg(F.collect_list("want").alias("want"))  # of one document: as many as it has positions at most
    ranked = C.written(docs.select(*C.ROW, "text").join(want, C.ROW).mapInArrow(_windows(length), "_k long, _h long, class long, settled boolean, last int, ranks array<long>"), release=True)
    C.forget(contexts)
    found = settled
    for part in range(PARTS):  # a part of the classes at a time: shuffle files of one are gone before the next
        each = ranked.where(F.pmod("class", F.lit(PARTS)) == part).select(*C.ROW, "class", "settled", "last", F.posexplode("ranks").alias("i", "rank"))
        twice = C.written(each.groupBy("class", "rank").agg(F.count(F.lit(1)).alias("n"), F.max("settled").alias("some")).where("n > 1 OR some").select("class", "rank"), release=True)
        more = each.where("NOT settled").select("class", "rank", *C.ROW, (F.col("last") - F.col("i")).alias("lo")).join(twice, ["class", "rank"], "left_semi").select(*C.ROW, "lo", (F.col("lo") + length).alias("hi"))
        found = found.unionByName(C.written(more, release=True))
    C.forget(ranked)
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (from, to, from, to, ... in bytes) of every row."""
    own = C.keyed(docs)
    with C.scratch(docs.sparkSession):
        spans = C.written(repeated_spans(own, length).groupBy(*C.ROW).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), release=True, out=True)
    return own.join(spans, C.ROW, "left").select("doc_id", "text", "lo", "hi").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def query(spark, sf_dir):
    return remove_repeats(C.table(spark, sf_dir, "documents")).drop("spans")
