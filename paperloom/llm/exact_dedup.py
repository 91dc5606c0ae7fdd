"""Exact dedup by content-defined chunk recipes.

One pass over the text cuts every normalised document where a rolling hash of its last 32 bytes
says so, and emits the document's recipe: the ordered identifiers of its chunks. An identifier is
64 bits of the chunk's SHA-256; all identifiers are verified against the whole digests, and
documents holding one that stands for two digests carry the digests themselves. From there on only
recipes move: documents are equal when their ordered lists are. Long documents are never shuffled.

Defined results: null text is the empty text; empty texts are equal to each other; of equal texts
the one with most code points stays, then the smallest doc_id (null is the last), then (rows that
repeat a doc_id) all of that doc_id are marked as kept, of which drop_copies leaves one; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A cut about every 2^CUT_BITS bytes; no chunk is longer than MOST_CHUNK.
CUT_BITS, MOST_CHUNK, SALTS = 10, 1 << 14, 1024
_GEAR = C.mix64(np.arange(256, dtype=np.uint64)).astype(np.uint32)
_SCHEMA = "doc_id long, _h long, code_points long, text_sha256 string, recipe array<long>, digests array<binary>"


def cuts(data: np.ndarray) -> np.ndarray:
    """Where chunks end: after a byte whose last 32 bytes hash to zeros, at MOST_CHUNK at the latest, and at the end."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        g = h.copy()
        g[k:] += h[:-k] << np.uint32(k)
        h = g
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    bounds = np.concatenate(([0], at[at < len(data)], [len(data)]))
    gaps = np.diff(bounds)
    if gaps.size and gaps.max() > MOST_CHUNK:
        bounds = np.unique(np.concatenate([bounds, *(np.arange(b, b + g, MOST_CHUNK) for b, g in zip(bounds[:-1], gaps, strict=True) if g > MOST_CHUNK)]))
    return bounds[1:] if len(data) else bounds[:0]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in C.slices(batch):
            ink, points = ~C.is_space(data), C.code_points(data)
            lean, where = data[ink], np.concatenate(([0], np.cumsum(ink)))[at]
            shas, ids, digests, counts = [], [], [], []
            for i in range(rows.num_rows):
                own = lean[where[i] : where[i + 1]]
                body, lo, n = memoryview(np.ascontiguousarray(own)), 0, 0
                for hi in cuts(own).tolist():
                    digests.append(d := hashlib.sha256(body[lo:hi]).digest())
                    ids.append(int.from_bytes(d[:8], "little", signed=True))
                    lo, n = hi, n + 1
                counts.append(n)
                shas.append(hashlib.sha256(body).hexdigest())
            ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("_h"), pa.array(points[at[1:]] - points[at[:-1]]), pa.array(shas), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(digests, pa.binary()))], names=["doc_id", "_h", "code_points", "text_sha256", "recipe", "digests"])


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, _h, code_points, text_sha256, recipe, digests of each row."""
    return C.keyed(docs).select("doc_id", "_h", "text").mapInArrow(_recipes, _SCHEMA)


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with its recipe, and one row for each group of equal texts and salt: group_size and best, the row that stays."""
    made = C.written(recipes(docs))
    chunks = made.select(F.explode(F.arrays_zip("recipe", "digests")).alias("c")).select("c.recipe", "c.digests").distinct()
    clash = chunks.groupBy(F.col("recipe").alias("id")).count().where("count > 1").select("id")
    near = F.coalesce("doc_id", F.lit(0)).alias("_near")
    unsure = made.select(near, "text_sha256", F.explode("recipe").alias("id")).join(clash, "id", "left_semi").select("_near", "text_sha256").distinct().withColumn("unsure", F.lit(True))
    own = made.select("*", near).join(unsure, ["_near", "text_sha256"], "left").select("doc_id", "_h", "code_points", "text_sha256", "recipe", F.when(F.col("unsure"), F.col("digests")).otherwise(F.array().cast("array<binary>")).alias("verified"), C.salt("doc_id", SALTS).alias("salt"))
    return own, own.groupBy("recipe", "verified", "salt").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("code_points", C.turned(F.col("doc_id")).alias("neg"), "_h")).alias("best"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    own, parts = _groups(docs)
    key = ["recipe", "verified"]
    whole = parts.groupBy(*key).agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    spread = parts.select(*key, "salt").join(whole, key).select(*key, "salt", "group_size", C.turned(F.col("best.neg")).alias("keep_id"))
    return own.join(spread, [*key, "salt"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs: the one that exact_dedup keeps; of several of its doc_id, one of them."""
    _, parts = _groups(docs)
    best = parts.groupBy("recipe", "verified").agg(F.max("best").alias("best"))
    return C.keep_rows(docs, best.select(F.coalesce(C.turned(F.col("best.neg")), F.lit(-(1 << 63))).alias("_k"), F.col("best._h").alias("_h")))


def query(spark, sf_dir):
    return exact_dedup(C.table(spark, sf_dir, "documents")).select(*COLUMNS)


#: What the query returns, and the same in SQL, which knows no chunks.
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
