"""Overlaps of sets in blocks: the rows of one component or column against the rows that may link to it.

Rows that share a column are candidates. Of short columns, a candidate is a row and a component;
long columns, in which single rows may be many, are multiplied as a whole. Both sides are dealt to
blocks of about BLOCK_ITEMS entries, and every pair of blocks is one product of two small incidence
matrices, of which the links that join what was apart are the result: fewer than the rows of the
block. Records grow with rows, and a block's size has a bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK_ITEMS = 1 << 17
#: Components up to this size are compared pair by pair: their candidates are few each.
SMALL = 16
#: Columns of more rows are multiplied as a whole; shorter ones make no more candidates of a row than that.
LONG = 32
#: Likely pairs that a block tells for each of its rows; where there are more, it tells the rows.
PAIRS = 16
#: Rows of a column that are put in order together.
RUN = 4096


def in_runs(entries: DataFrame) -> DataFrame:
    """entries (key, sid, n, ...) with run: the rows of a long column are dealt to runs of about RUN, each of which can be put in order by one task."""
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > RUN)
    some = entries.join(C.written(sizes), "key", "left")
    return some.withColumn("run", F.coalesce(F.pmod(F.xxhash64("sid"), F.ceil(F.col("_rows") / RUN)), F.lit(0)).cast("int")).drop("_rows")


def shared(entries: DataFrame, source) -> DataFrame:
    """The entries of keys that several rows have; source() makes the same entries for a count, which is combined before its shuffle."""
    several = C.written(source().groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("key"), release=True)
    return entries.join(several, "key", "left_semi")


def grouped(entries: DataFrame, found: DataFrame) -> DataFrame:
    """entries (key, sid, n, at, run, rank, pivot) with the row's component and its size. found: sid, component."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    own = found.join(sizes, "component").select("sid", F.col("component").alias("group"), "size")
    return entries.join(own, "sid", "left").withColumn("group", F.coalesce("group", "sid")).withColumn("size", F.coalesce("size", F.lit(1)))


def by_length(now: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of columns with several components, with long (whether their column has more than LONG rows), and (sid, to), twice, for the rows in long columns whose component has up
    to SMALL rows: those to compare, and those to compare them with.

    A column of more than LONG rows is first divided by size. Rows that link have sizes of num to den or closer, which lie in one band or in two that
    follow each other; so a row is in the column of its own band, and a guest in that of the next. Bands are a little wider than den to num, so rounding loses nothing.
    Small components that are still many in one column may be many that don't link with each other; they are multiplied with
    one another in blocks, where candidates would be their pairs. Guests needn't be compared with guests."""
    now = C.written(now, release=True)  # each table is read twice below
    size = now.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("key", "_rows")
    rows = sized = C.written(now.join(size, "key"), release=True)
    C.forget(now)
    band = F.floor(F.log("n") / math.log(1.01 * den / num)).cast("int")
    few = rows.where(F.col("_rows") <= LONG).drop("_rows").withColumns({"long": F.lit(False), "own": F.lit(True)})
    many = rows.where(F.col("_rows") > LONG).drop("_rows").withColumn("_band", band).withColumn("_at", F.explode(F.array(F.col("_band"), F.col("_band") + 1)))
    many = many.withColumns({"key": F.xxhash64("key", "_at"), "own": F.col("_at") == F.col("_band")}).drop("_at", "_band")
    size = many.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.min("group").alias("x"), F.max("group").alias("y"), F.max("own").alias("z")).where("x <> y AND z").select("key", "_rows")
    many = many.join(size, "key").withColumn("long", F.col("_rows") > LONG).drop("_rows")
    rows = C.written(few.unionByName(many), release=True)
    C.forget(sized)
    alone = rows.where(F.col("long") & (F.col("size") <= SMALL))
    one = lambda some: some.select("sid", F.col("key").alias("to"))
    return rows, one(alone.where("own")), one(alone)


def candidates(now: DataFrame, may: Column) -> DataFrame:
    """Different (sid, to, to_size): rows and the components that they share a column with, in long columns those of more than SMALL rows; of two components, the rows of the smaller one.

    run, rank in it, and pivot (whether the row is the column's pivot) say what has been compared: two single rows of
    which one is the pivot, or which are neighbours, are no candidates again.
    may: whether row (n, at) may link with rows of the component that have n from n_min to n_max and at from at_min on in that column."""
    ends = now.where(~F.col("long") | (F.col("size") > SMALL)).groupBy("key", F.col("group").alias("to")).agg(F.first("size").alias("to_size"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("at").alias("at_min"), F.max("pivot").alias("to_pivot"), F.min("rank").alias("to_rank"), F.min("run").alias("to_run"))
    smaller = (F.col("size") < F.col("to_size")) | ((F.col("size") == F.col("to_size")) & (F.col("group") < F.col("to")))
    beside = (F.col("run") == F.col("to_run")) & (F.abs(F.col("rank") - F.col("to_rank")) <= 1)
    done = (F.col("to_size") == 1) & (F.col("pivot") | F.col("to_pivot") | beside)
    return now.join(ends, "key").where((F.col("group") != F.col("to")) & smaller & ~done & may).groupBy("sid", "to").agg(F.first("to_size").alias("to_size"))


def members(near: DataFrame, found: DataFrame) -> DataFrame:
    """sid, to: all rows of the components in near (sid, to)."""
    to = near.select("to").distinct()
    inside = found.select("sid", F.col("component").alias("to")).join(to, "to", "left_semi")
    alone = to.join(found.select(F.col("component").alias("to")).distinct(), "to", "left_anti").select(F.col("to").alias("sid"), "to")
    return inside.select("sid", "to").unionByName(alone)


def small(near: DataFrame, found: DataFrame, sizes: DataFrame, most: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, na, b, nb) for candidates of components of up to `most` rows, the smaller row first, and the candidates of larger ones. sizes: sid, n."""
    few = near.where(F.col("to_size") <= most).select("sid", "to")
    n = lambda s: sizes.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"))
    pairs = few.join(members(few, found).withColumnRenamed("sid", "y"), "to").select(F.col("sid").alias("x"), "y").join(n("x"), "x").join(n("y"), "y")
    swap = F.struct("nx", "x") > F.struct("ny", "y")
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return pairs.select(pick("x", "y", "a"), pick("nx", "ny", "na"), pick("y", "x", "b"), pick("ny", "nx", "nb")), near.where(F.col("to_size") > most).select("sid", "to")


def _product(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        left = t.column("left").to_numpy(zero_copy_only=False).astype(bool)
        sid = t.column("sid").to_numpy(zero_copy_only=False)
        sets = t.column("keys").combine_chunks() if isinstance(t.column("keys"), pa.ChunkedArray) else t.column("keys")
        counts = np.diff(np.asarray(sets.offsets))
        _, ids = np.unique(np.asarray(sets.flatten()), return_inverse=True)
        begin = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(counts)), counts)
        right = np.flatnonzero(~left)
        flat, owner = ids[~left[row]], np.repeat(np.arange(len(right)), counts[right])
        seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        a, b = [], []
        part = np.arange(len(sid))  # which rows are linked so far
        _, same = np.unique(sid, return_inverse=True)
        for i in np.flatnonzero(left).tolist():
            own = ids[begin[i] : begin[i] + counts[i]]
            seen[own] = True
            both = np.bincount(owner[seen[flat]], minlength=len(right))
            seen[own] = False
            hit = right[(both > 0) & (den * both >= num * (counts[i] + counts[right] - both)) & (same[right] != same[i])]
            parts, first = np.unique(part[hit], return_index=True)
            new = parts != part[i]
            if new.any():
                b.append(sid[hit[first[new]]])
                a.append(np.full(int(new.sum()), sid[i]))
                part[np.isin(part, parts)] = part[i]
        none = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([*a, none]), pa.int64()), "b": pa.array(np.concatenate([*b, none]), pa.int64())})

    return run


def _likely(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        left, sid, n, end, group = (t.column(c).to_numpy(zero_copy_only=False) for c in ("left", "sid", "n", "end", "group"))
        left = left.astype(bool)
        sets = t.column("keys").combine_chunks() if isinstance(t.column("keys"), pa.ChunkedArray) else t.column("keys")
        counts = np.diff(np.asarray(sets.offsets))
        _, ids = np.unique(np.asarray(sets.flatten()), return_inverse=True)
        begin = np.cumsum(counts) - counts
        right, row = np.flatnonzero(~left), np.repeat(np.arange(len(counts)), counts)
        flat, owner = ids[~left[row]], np.repeat(np.arange(len(right)), counts[right])
        seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        rest = -(-num * n // den) - 1  # entries behind the leading ones
        m, until, of, after = n[right], end[right], group[right], rest[right]
        stays, a, b, pairs = np.zeros(len(left), bool), [], [], 0
        for i in np.flatnonzero(left).tolist():
            own = ids[begin[i] : begin[i] + counts[i]]
            seen[own] = True
            both = np.bincount(owner[seen[flat]], minlength=len(right))
            seen[own] = False
            more = np.where(until < end[i], after, np.where(until > end[i], rest[i], np.minimum(after, rest[i])))
            fits = (both > 0) & (of != group[i]) & (den * np.minimum(m, n[i]) >= num * np.maximum(m, n[i]))
            hit = right[fits & ((both + more) * (num + den) >= num * (m + n[i]))]
            stays[hit] = True
            stays[i] = len(hit) > 0
            pairs += len(hit)
            if pairs <= PAIRS * len(left):
                a.append(np.full(len(hit), sid[i]))
                b.append(sid[hit])
        none = np.zeros(0, np.int64)
        if pairs <= PAIRS * len(left):
            a, b = np.concatenate([*a, none]), np.concatenate([*b, none])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "to": pa.array(np.full(len(a), t.column("to")[0].as_py()), pa.int64()), "left": pa.nulls(len(a), pa.bool_())})
        rows = t.filter(pa.array(stays))
        return pa.table({"a": rows.column("sid"), "b": pa.nulls(rows.num_rows, pa.int64()), "to": rows.column("to"), "left": rows.column("left")})

    return run


def _dealt(near: DataFrame, inside: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """The rows of near (left) and of inside for each pair of blocks (to, x, y); sizes: sid, n."""

    def weighed(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(sizes.select("sid", "n"), "sid").groupBy("to").agg(F.ceil(F.sum("n") / block).cast("int").alias(f"n_{name}"))

    # a row for each `to`; near and inside are joined with it once each
    blocks = C.written(weighed(near, "x").join(weighed(inside, "y"), "to"), release=True)
    spot = lambda name: F.pmod(F.xxhash64("sid"), F.col(f"n_{name}")).cast("int").alias(name)
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"n_{name}") - 1)).alias(name)
    x = near.join(blocks, "to").select("sid", "to", spot("x"), every("y"), F.lit(True).alias("left"))
    y = inside.join(blocks, "to").select("sid", "to", every("x"), spot("y"), F.lit(False).alias("left"))
    return x.unionByName(y)


def likely(near: DataFrame, inside: DataFrame, held: DataFrame, found: DataFrame, num: int, den: int, block: int = BLOCK_ITEMS // 2) -> tuple[DataFrame, DataFrame]:
    """The rows (sid, to) of near and of inside that may link to a row of the other with the same `to` and of another component: by their leading keys alone, a small part of their sets.

    held: sid, n, keys (the leading ones that several rows have), end (the last leading key). What two rows share up to the lesser `end` is among these keys;
    behind it, the row that ends there has no more than its entries that aren't leading.
    Two rows that are likely in many columns are left in one of them, the least `to`, so that whole sets aren't sent for each."""
    group = held.join(found.select("sid", F.col("component").alias("group")), "sid", "left")
    group = group.select("sid", "n", "keys", "end", F.coalesce("group", "sid").alias("group"))
    rows = _dealt(near, inside, held.select("sid", F.size("keys").alias("n")), block).join(group, "sid")
    stay = C.written(rows.groupBy("to", "x", "y").applyInArrow(_likely(num, den), "a long, b long, to long, left boolean"), release=True)
    pairs = stay.where("b IS NOT NULL").groupBy("a", "b").agg(F.min("to").alias("to"))
    some = lambda own, left: C.written(pairs.select(F.col(own).alias("sid"), "to").union(stay.where(left).select("a", "to")).distinct(), release=True)
    out = some("a", "left"), some("b", "NOT left")
    C.forget(stay)
    return out


def links(near: DataFrame, inside: DataFrame, sets: DataFrame, sizes: DataFrame, num: int, den: int, block: int = BLOCK_ITEMS) -> DataFrame:
    """Pairs (a, b), a of near and b of inside with the same `to`, with overlap / union >= num / den, as many as it takes to link all rows of a block that such pairs link; sets: sid, keys; sizes: sid, n."""
    rows = _dealt(near, inside, sizes, block).join(sets, "sid")
    return rows.groupBy("to", "x", "y").applyInArrow(_product(num, den), "a long, b long")
