"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents of equal n-gram sets are one row of the matrix. Columns are put in one global order, the
rarer first, and the product is taken in two blocks. The first holds each row's leading columns, as
many as a pair above the threshold can't all miss: two rows without a common entry there are below
the bound, and those with one are paired. Their overlap in the first block is counted, and pairs
whose count plus all that may follow stays below the size-derived bound are discarded. The rest of
the product is accumulated for the remaining pairs alone, exactly.

How rare a column is comes from a count sketch of fixed size; any global order gives the same
result. A column that many rows share is not expanded to all its pairs: its rows are first compared
with a pivot and a neighbour by size, and links so found are merged to components. A column of two
rows is over with that. In the others rows are multiplied, in blocks, with the other components that
they share a leading column with; links within a component are not needed. A block is first
multiplied by leading columns alone, and whole sets are sent only of rows that may link by those.

Rows are known by their sets, never by doc_id: the pass that reads a text names its set.

Defined results: null and empty texts have no n-grams, link with nothing and are their own
component; a text of fewer words than an n-gram has all its words as one; rows that repeat a doc_id
are one document if their texts are equal, and each takes the component of its own text otherwise;
rows of a null doc_id link as others do, and a component's number is its smallest doc_id that isn't
null (null if there is none); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocked
from . import common as C

N, NUM, DEN = 5, 4, 5  # words of an n-gram; the threshold as a fraction
#: Places of the sketch, and the parts it is summed in.
PLACES, PARTS = 1 << 20, 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ngrams(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of every row: (row, hash), by row."""
    clean = _LOWER[data]
    lo, hi, row = C.word_bounds(clean, at)
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = C.hashes(clean, lo, hi)
    words = np.bincount(row, minlength=len(at) - 1)
    full = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
    rows, g = row[full], C.windows(h, n)[full]
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        first = np.searchsorted(row, short)
        rows, g = np.concatenate((rows, short)), np.concatenate((g, C.run_hashes(h, first, first + words[short])))
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (g[1:] != g[:-1])
    return rows[new], g[new]


def _per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums by row, modulo 2^64."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.searchsorted(rows, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def _names(r: np.ndarray, g: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The size and the identifier of every row's set."""
    n = np.bincount(r, minlength=k)
    return n, C.mix64(_per_row(C.mix64(g ^ np.uint64(seed + 1)), r, k) + n.astype(np.uint64)).view(np.int64)


def _profiles(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(PLACES, np.int64), False
        names = ["doc_id", "_h", "n", "sid", "check", "part", "counts"]
        none = lambda k, t: pa.nulls(k, t)
        for batch in batches:
            for rows, data, at in C.slices(batch):
                r, g = ngrams(data, at)
                k, some = rows.num_rows, True
                counts += np.bincount((g >> np.uint64(44)).astype(np.int64), minlength=PLACES)
                n, sid = _names(r, g, k, seed)
                check = _per_row(C.mix64(g + np.uint64(77)), r, k)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("_h"), pa.array(n.astype(np.int64)), pa.array(sid), pa.array(check.view(np.int64)), none(k, pa.int32()), none(k, pa.binary())], names=names)
        if some:
            kind = np.uint16 if counts.max() < 1 << 16 else np.int64
            parts = [p.astype(kind).tobytes() for p in np.split(counts, PARTS)]
            yield pa.RecordBatch.from_arrays([*(none(PARTS, pa.int64()) for _ in range(5)), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _levels(mean: float):
    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(PLACES // PARTS, np.int64), None
        for batch in groups:
            for p, b in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = p
                total += np.frombuffer(b, np.uint16 if len(b) == 2 * len(total) else np.int64)
        unit = 4 * mean**0.5 + 8
        over = np.maximum(total - mean, 0) / unit
        level = np.where(over > 1, np.minimum(1 + np.floor(np.log2(np.maximum(over, 1))), 31), 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "levels"])

    return add


def keys(g: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Numbers that sort n-grams in the global order: by level, then by hash."""
    return ((levels[(g >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (g >> np.uint64(6))).astype(np.int64)


def _leading(levels_sent, seed: int, whole: bool):
    """sid, n and the leading keys, or all, of every set; rows of equal sets in a slice are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(levels_sent.value, np.uint8)
        for batch in batches:
            for rows, data, at in C.slices(batch):
                r, g = ngrams(data, at)
                n, sid = _names(r, g, rows.num_rows, seed)
                once = np.zeros(len(n), bool)
                once[np.unique(sid, return_index=True)[1]] = True
                once &= n > 0
                r, g = r[once[r]], g[once[r]]
                key = keys(g, levels)
                order = np.lexsort((key, r))
                key = key[order]
                take = n if whole else n - (-(-NUM * n // DEN)) + 1
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                yield pa.RecordBatch.from_arrays([pa.array(sid[once]), pa.array(n[once].astype(np.int64)), C.lists(key[rank < take[r]], take[once], pa.int64())], names=["sid", "n", "keys"])

    return run


_SET = "sid long, n long, keys array<long>"


def _least(a: str, b: str) -> Column:
    """Overlap that a pair of these sizes needs: ceil(NUM (a + b) / (NUM + DEN))."""
    return F.floor((NUM * (F.col(a) + F.col(b)) + (NUM + DEN - 1)) / (NUM + DEN)).cast("long")


def _fits(na: str, ia: str, nb: str, ib: str) -> Column:
    """Whether rows of these sizes may link if the first key that they share is at these places."""
    sizes = DEN * F.least(na, nb) >= NUM * F.greatest(na, nb)
    return sizes & (F.col(ia) + F.col(ib) <= F.col(na) + F.col(nb) - 2 * _least(na, nb))


def _sets(nodes: DataFrame, rows: DataFrame, reps: DataFrame, read) -> DataFrame:
    """sid, keys: the whole sets of these rows, and few others. A text is found by its row key where it is read, and names its set itself; only sets are shuffled."""
    texts = C.among(rows, reps.join(nodes, "sid", "left_semi").select(*C.ROW)).select("text")
    return C.written(texts.mapInArrow(read(True), _SET).select("sid", "keys").dropDuplicates(["sid"]), release=True)


def _nodes(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.col(a).alias("sid")).union(pairs.select(F.col(b).alias("sid"))).distinct()


def _held(led: DataFrame, entry: DataFrame) -> DataFrame:
    """sid, n, keys and ats (the leading keys that several rows have, and their places), end (the last leading key, shared or not) of every row with such keys."""
    own = entry.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("key", "at"))).alias("held"))
    return own.join(led.select("sid", "n", F.element_at("keys", -1).alias("end")), "sid").select("sid", "n", F.col("held.key").alias("keys"), F.col("held.at").alias("ats"), "end")


def _verified(pairs: DataFrame, held: DataFrame, rows: DataFrame, reps: DataFrame, read) -> DataFrame:
    """The links among pairs (a, na, b, nb): first block, bound, rest of the product. Keys of a single row are in no overlap; of the first block, only shared keys are sent."""
    pairs = C.written(pairs.distinct())
    side = lambda rows, s: rows.select(F.col("sid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "sid"))
    leading = held.drop("n")
    both = pairs.join(side(leading, "a"), "a").join(side(leading, "b"), "b").withColumn("last", F.least("end_a", "end_b"))

    def after(s: str) -> Column:  # entries behind `last`, at most: all but the leading ones, or all but those up to the last shared key before it
        n = F.col(f"n{s}")
        before = F.size(F.filter(f"keys_{s}", lambda v: v <= F.col("last")))
        return F.when(F.col(f"end_{s}") == F.col("last"), F.floor((NUM * n + DEN - 1) / DEN).cast("long") - 1).when(before > 0, n - F.element_at(f"ats_{s}", before) - 1).otherwise(n)

    both = both.where(F.size(F.array_intersect("keys_a", "keys_b")) + F.least(after("a"), after("b")) >= _least("na", "nb"))
    left = C.written(both.select("a", "na", "b", "nb"), release=True)
    whole = _sets(_nodes(left, "a", "b"), rows, reps, read)
    both = left.join(side(whole, "a"), "a").join(side(whole, "b"), "b")
    out = C.written(both.where(F.size(F.array_intersect("keys_a", "keys_b")) >= _least("na", "nb")).select("a", "b"), release=True)
    for x in (pairs, left, whole):
        C.forget(x)
    return out


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    with C.scratch(docs.sparkSession):
        return _joined(docs)


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, _h, n, sid), and for every set sid, n, row (the key of its first row, those of a null doc_id last), first_id (its smallest doc_id) and component."""
    spark = docs.sparkSession
    rows = C.keyed(docs)
    for seed in range(1, 9):
        made = C.written(rows.select("doc_id", "_h", "text").mapInArrow(_profiles(seed), "doc_id long, _h long, n long, sid long, check long, part int, counts binary"), out=True)
        own = made.where("part IS NULL").select("doc_id", "_h", "n", "sid", "check")
        if own.groupBy("sid").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").isEmpty():
            break
        C.forget(made)
    else:
        raise RuntimeError("different sets share their identifiers")
    total = own.agg(F.sum("n")).first()[0] or 0
    summed = made.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(lambda t: pa.Table.from_batches(_levels(total / PLACES)(iter(t.to_batches()))), "part int, levels binary")
    parts = {r[0]: bytes(r[1]) for r in summed.collect()}  # PLACES bytes in all
    sent = spark.sparkContext.broadcast(b"".join(parts.get(i, bytes(PLACES // PARTS)) for i in range(PARTS)))
    read = lambda whole: _leading(sent, seed, whole)

    place = F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_k"), "_h")
    reps = own.where("n > 0").groupBy("sid").agg(F.min(place).alias("row"), F.max("n").alias("n"), F.min("doc_id").alias("first_id"))
    reps = C.written(reps.select("sid", "n", "first_id", "row", "row._k", "row._h"))
    led = C.written(rows.select("text").mapInArrow(read(False), _SET).groupBy("sid").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), release=True)
    entries = lambda: led.select("sid", F.posexplode("keys").alias("at", "key"))
    entry = C.written(blocked.shared(entries(), entries).select("key", "sid", "at"), release=True)
    held = C.written(_held(led, entry), release=True)
    C.forget(led)
    C.forget(entry)
    # how much of a row other rows share: the source of a group of edited copies has nothing of its own
    entry = held.select("sid", "n", (F.size("keys") / F.col("n")).alias("shared"), F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("ats").alias("at"))).alias("e")).select("e.key", "sid", "n", "e.at", "shared")
    # the pivot of a column: the row that shares most; a row's neighbour: one before it by size
    pivot = entry.groupBy("key").agg(F.min(F.struct((-F.col("shared")).alias("less"), "sid", "n", "at")).alias("p"), F.count(F.lit(1)).alias("rows"))
    pivot = C.written(pivot.select("key", F.struct("p.sid", "p.n", "p.at").alias("p"), "rows"))
    # the pair of a column of two rows is all that it has to say: such columns are over with it
    met = entry.drop("shared").join(pivot, "key").where((F.col("rows") > 2) | (F.col("sid") != F.col("p.sid")) & _fits("p.n", "p.at", "n", "at"))
    met = C.written(met.select("key", "sid", "n", "at", "p", (F.col("sid") == F.col("p.sid")).alias("pivot"), (F.col("rows") == 2).alias("two")), release=True)
    C.forget(pivot)
    two, ordered = met.where("two"), Window.partitionBy("key", "run").orderBy("n", "sid")
    entry = blocked.in_runs(met.where("NOT two").drop("two"))
    entry = C.written(entry.withColumns({"before": F.lag(F.struct("sid", "n", "at")).over(ordered), "rank": F.row_number().over(ordered)}), release=True)
    side = lambda p, rows: rows.where(f"{p} IS NOT NULL").select(F.col(p).alias("p"), "sid", "n", "at")
    pairs = side("p", two).unionByName(side("p", entry)).unionByName(side("before", entry))
    pairs = pairs.select(F.col("p.sid").alias("a"), F.col("p.n").alias("na"), F.col("p.at").alias("ia"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    swap = F.struct("na", "a") > F.struct("nb", "b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    pairs = pairs.where("a <> b").select(pick("a", "b"), pick("na", "nb"), pick("ia", "ib"), pick("b", "a"), pick("nb", "na"), pick("ib", "ia"))
    links = _verified(pairs.where(_fits("na", "ia", "nb", "ib")).select("a", "na", "b", "nb"), held, rows, reps, read)
    named = lambda links: C.written(C.components(links).select(F.col("node").alias("sid"), "component"))
    found = named(links)
    C.forget(met)
    may = (DEN * F.col("n") >= NUM * F.col("n_min")) & (NUM * F.col("n") <= DEN * F.col("n_max")) & ((NUM + DEN) * (F.col("at") + F.col("at_min")) <= (DEN - NUM) * (F.col("n") + F.col("n_max")))
    now, base, alone = blocked.by_length(blocked.grouped(entry.drop("p", "before"), found), NUM, DEN)
    near = C.written(blocked.candidates(now, may), release=True)
    C.forget(entry)
    pairs, wide = blocked.small(near, found, reps)
    links = links.unionByName(_verified(pairs.where(DEN * F.col("na") >= NUM * F.col("nb")), held, rows, reps, read))
    wide, inside = C.written(wide.unionByName(base)), C.written(blocked.members(wide, found).unionByName(alone))
    wide, inside = blocked.likely(wide, inside, held, found, NUM, DEN)
    sets = _sets(wide.select("sid").union(inside.select("sid")).distinct(), rows, reps, read)
    found = named(links.unionByName(C.written(blocked.links(wide, inside, sets, reps, NUM, DEN), release=True)))
    for x in (now, near, wide, inside, sets, held):
        C.forget(x)
    return own, C.written(reps.join(found, "sid", "left").select("sid", "n", "row", "first_id", F.coalesce("component", "sid").alias("component")), release=True, out=True)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    own, of = _components(docs)
    smallest = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = of.join(smallest, "component").select("sid", "component_id")
    out = C.attach(own.select("doc_id", "sid", F.col("n").alias("n_shingles")), named, "sid", how="left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of docs: that of the smallest doc_id; texts without n-grams stay, repeated rows of them once."""
    own, of = _components(docs)
    stay = of.groupBy("component").agg(F.min("row").alias("row")).select("row._k", "row._h")
    empty = own.where("n = 0").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_k"), "_h").distinct()
    return C.keep_rows(docs, stay.unionByName(empty))


def query(spark, sf_dir):
    return jaccard_components(C.table(spark, sf_dir, "documents"))
