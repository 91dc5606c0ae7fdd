"""Shared pieces of the corpus operators: byte-level text views, hashing, written tables, components.

Python stages see one Arrow batch at a time and cut it into slices of a few MB, so their memory
does not grow with the batch; a single document larger than a slice is a slice of its own.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import delete, own_folder, small_batches

SLICE_BYTES = 1 << 20
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_PAIR = np.uint64(0x9FB21C651E98DF25)
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Byte ranges of more than that are hashed one by one by a digest.
LONG_RANGE = 64


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in this order."""
    return mix64(a * _PAIR + b)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))


def hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 0, most: int = LONG_RANGE) -> np.ndarray:
    """A hash of each byte range: eight bytes after eight are mixed in, so texts have no structure that makes ranges collide."""
    n, at8 = hi - lo, eights(data)
    out = mix64(n.astype(np.uint64) + (np.uint64(seed) << np.uint64(40)))
    left, k = np.flatnonzero((n > 0) & (n <= most)), 0
    while len(left):
        rest = n[left] - k
        out[left] = pair(out[left], at8[lo[left] + k] & _FIRST[np.minimum(rest, 8)])
        left, k = left[rest > 8], k + 8
    long = np.flatnonzero(n > most)
    if len(long):
        body, key = memoryview(np.ascontiguousarray(data)), seed.to_bytes(8, "little")
        for i in long.tolist():
            out[i] = int.from_bytes(hashlib.blake2b(body[lo[i] : hi[i]], digest_size=8, key=key).digest(), "little")
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n values from every place on, by prefix doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        h = pair(h[: max(0, len(h) - step)], h[step:])
        have += step
    return h


def run_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each run of values h[lo:hi], of any length from 1 on: the sum of what each value and its place in the run hash to."""
    n = hi - lo
    if not len(n):
        return np.zeros(0, np.uint64)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    each = mix64(h[place + np.repeat(lo, n)] + mix64(place.astype(np.uint64) + (np.uint64(seed) << np.uint64(40))))
    return mix64(np.add.reduceat(each, first) + n.astype(np.uint64))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and where each row begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of whole rows of about `most` bytes of text: (rows, bytes, row offsets)."""
    data, at = raw(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    tidy()


def tidy() -> None:
    """Give freed memory back to the system: workers are kept, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def is_space(data: np.ndarray) -> np.ndarray:
    """The bytes of [\\x20\\x09-\\x0D]."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every maximal run of bytes that aren't white space; no word crosses rows."""
    ink = ~is_space(data)
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    full = at[:-1] < at[1:]
    heads, tails = at[:-1][full], at[1:][full] - 1
    first[heads], last[tails] = ink[heads], ink[tails]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    return lo, hi, np.searchsorted(at, lo, "right") - 1


def word_array(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The words as a binary column."""
    ends = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(hi - lo, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[~is_space(data)]))])


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: bytes that don't continue a character."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column out of flat values and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


#: Tables written in each open scratch().
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, when what was made of them has been written elsewhere."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)


@contextmanager
def kept_tables() -> Iterator[list[str]]:
    """The paths of the tables written inside, which stay: a result is still read from them."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        del _SCRATCH[next(i for i, own in enumerate(_SCRATCH) if own is made)]


def written(df: DataFrame, release: bool = False, out: bool = False) -> DataFrame:
    """The rows, written once to the shared folder and read from there: later steps don't run what made them again, and a lost executor loses nothing.

    release: have the driver collect its garbage, so that Spark deletes the shuffle files of steps that are over.
    out: the table outlives the innermost scratch()."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    if len(_SCRATCH) > out:
        _SCRATCH[-1 - out].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._paperloom_path = path
    if release:
        gc.collect()
        spark._jvm.System.gc()
    return out


def forget(df: DataFrame | None) -> None:
    """Delete what written() made for a table that no later step reads."""
    path = getattr(df, "_paperloom_path", None)
    if path:
        delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turned(number: Column) -> Column:
    """A long whose order is the opposite, for all longs; twice gives the number back, null stays null."""
    return F.bitwise_not(number)


#: What tells rows apart: doc_id (the least number stands for null, and the hash then has another seed) and a hash of the text. Rows that share both have equal texts, but for one chance in 2^64 among the rows of one doc_id.
ROW = ["_k", "_h"]


def row_key(doc_id: Column, text: Column) -> list[Column]:
    said = F.coalesce(text.cast("string"), F.lit(""))
    return [F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("_k"), F.when(doc_id.isNull(), F.xxhash64(said, F.lit(0))).otherwise(F.xxhash64(said)).alias("_h")]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null is empty) and the key of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *row_key(F.col("doc_id"), F.col("text")))


def keep_rows(docs: DataFrame, kept: DataFrame, often: str | None = None) -> DataFrame:
    """The rows of docs whose key is in kept (one row a key), with the columns of docs. Of rows with the same key one stays;
    with `often`, a column of kept, each comes as many times as that says."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = lambda name: F.col(names[docs.columns.index(name)])
    rows = docs.toDF(*names).select("*", *row_key(own("doc_id"), own("text")))
    if often is None:
        rows = rows.join(kept.select(*ROW), ROW, "left_semi").dropDuplicates(ROW)
    else:
        rows = rows.join(kept.select(*ROW, often), ROW).where(F.col(often) > 0).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(often))))
    return rows.select(*names).toDF(*docs.columns)


#: Bits that among() keeps, and those of one bitmap of Spark's bitmap_construct_agg.
BITS, BITMAP = 1 << 25, 1 << 15


def among(rows: DataFrame, need: DataFrame) -> DataFrame:
    """The rows whose key (ROW) is in need, and few others: those whose key hashes to a bit of one that is. The bits, 4 MB whatever the rows, go to
    every task, so texts are filtered where they are read; a join by key, where one is needed, follows with what is left."""
    place = F.pmod(F.xxhash64(*ROW), F.lit(BITS))
    bucket, bit = F.floor(place / BITMAP).cast("int"), place % BITMAP
    bits = need.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(bits), "_bucket")
    return found.where(byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) != 0).select(*rows.columns)


#: Parts of the hash range of which at_most counts the rows.
PARTS = 1 << 16


def at_most(rows: DataFrame, most: int, column: str = "doc_id") -> DataFrame:
    """The rows whose `column` hashes least, `most` at most: all of them where there are no more. The cutoff comes out of a histogram of
    PARTS counts; only the rows of the part that it falls into are sorted, a PARTS-th of all (more by as many as share one value)."""
    rows = written(rows)
    if rows.count() <= most:
        return rows
    part = F.shiftrightunsigned(F.xxhash64(column), 48).cast("int")
    left, cut = most, 0
    for p, n in sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect()):  # PARTS numbers
        cut = p
        if n > left:
            break
        left -= n
    rest = rows.where(part == cut).orderBy(F.shiftrightunsigned(F.xxhash64(column), 0), column).limit(left)
    return written(rows.where(part < cut).unionByName(rest))


def salt(column: str, of: int = 256) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(of)).cast("int")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): one row (node, component) for each node with a link; component is its smallest node.

    Every round points each node at its smallest smaller neighbour, shortens the chains of pointers
    by doubling until they end at a root, and goes on with the links between different roots alone.
    Rows never exceed the links; a node with many links is combined before the shuffle.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = None
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        up = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        up = written(up)
        for _ in range(most_rounds):
            over = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            longer = written(up.join(over, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
            moved = longer.where("moved").isEmpty()
            forget(up)
            up = longer
            if moved:
                break
        up = up.select("node", "root")
        step = lambda rows, name: rows.join(up.select(F.col("node").alias(name), F.col("root").alias("to")), name, "left").withColumn(name, F.coalesce("to", name)).drop("to")  # noqa: E731, B023
        smaller = written(step(step(edges, "a"), "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        nodes = up if found is None else step(found.withColumnRenamed("root", "r"), "r").withColumnRenamed("r", "root").unionByName(up.join(found.select("node"), "node", "left_anti"))
        kept = written(nodes.select("node", "root"))
        forget(edges)
        forget(found)
        edges, found = smaller, kept
    else:
        raise RuntimeError("links between components remain")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    roots = found.select(F.col("root").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("root", F.col("node"))
    return found.unionByName(roots).select("node", F.col("root").alias("component"))


def attach(rows: DataFrame, values: DataFrame, key: str, by: str = "doc_id", of: int = 1024, how: str = "inner") -> DataFrame:
    """rows joined with values (one row a key) by `key`, where any key may hold a large share of the rows.

    The different (key, salt) of rows, combined before their shuffle, take the values first; rows
    then join by key and salt, so that no task gets more than a salt's share of a key.
    """
    salted = rows.withColumn("_salt", salt(by, of))
    spread = salted.select(key, "_salt").distinct().join(values, key)
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
