"""Substring dedup by paragraph MinHash banding.

Paragraphs are lines of LEAST_WORDS words or more. Equal ones are one, whatever their number, before
anything is compared. Minima of hashed five-word shingles are combined to bands, tuned so that a
pair at the threshold collides with probability RECALL or more; colliding paragraphs are compared by
the exact Jaccard of their shingles, first with a pivot and a neighbour in each band, then, in blocks,
with the others that they share a band with. In every component the first paragraph (by doc_id, then
place) stays and the others are removed.

Passages are runs of LEAST_PASSAGE equal words or more, across line ends, in what the removed
paragraphs leave. Texts are cut at the least hashed shingle (of SEED words) of every WINDOW shingles
in a row, so that equal runs of 2 * WINDOW + SEED - 1 = LEAST_PASSAGE words are cut alike at two
places at least; a piece goes from a cut to the end of the shingle at the next. Of equal pieces the
first stays. Others that touch are one run, and its ends are moved outwards over all words that are
equal beside the first occurrence too. Runs that stay below LEAST_PASSAGE words are left alone.

Defined results: null and empty texts have no paragraphs; words are compared with A-Z lower-cased;
lines of fewer than LEAST_WORDS words go only as part of a passage; a very long text is one row like
others; a paragraph
that repeats within its own document is removed there too; a removed unit goes from its first word's
first byte to its last word's last; rows that repeat a doc_id are documents of their own if their
texts differ, and share one result otherwise; a null doc_id is before all others; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocked
from . import common as C
from .suffix_dedup import least, merged

N, NUM, DEN, RECALL = 5, 4, 5, 0.999
#: Shingles of which the least is a cut, and words of such a shingle.
WINDOW, SEED = 18, 10
#: Words of a paragraph and of a passage, at least.
LEAST_WORDS, LEAST_PASSAGE = 12, 2 * WINDOW + SEED - 1
#: Words that are compared beside a run: of 2 * WINDOW more equal ones, some would be a piece.
BESIDE = 2 * WINDOW
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UNIT = "struct<lo:int,hi:int,n:int,key:long,bands:array<long>>"
_PIECE = "struct<lo:int,hi:int,key:long>"
_KEY = "_k long, _h long"


def tune(threshold: float = NUM / DEN, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """Bands and rows: the most rows for which at most 48 hashes reach the recall at the threshold, with the fewest bands."""
    for rows in (4, 3, 2, 1):
        for bands in range(1, most):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                if rows * bands <= 48 or rows == 1:
                    return bands, rows
                break
    raise ValueError("no bands reach this recall")


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, row and hash of all words, and the number of the first word of every row."""
    low = _LOWER[data]
    lo, hi, row = C.word_bounds(low, at)
    return lo, hi, row, C.hashes(low, lo, hi), np.searchsorted(row, np.arange(len(at)))


def _cuts(g: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where the least of every WINDOW hashes in a row is; g has one for each word that begins a shingle, row those of all words."""
    n = len(g) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = row[:n] == row[WINDOW + SEED - 2 : WINDOW + SEED - 2 + n]  # the last shingle of the window ends in the row
    return np.unique(least(g, WINDOW)[whole])


def _keys(rows: pa.RecordBatch, of: np.ndarray) -> list[pa.Array]:
    return [rows.column(c).take(pa.array(of, pa.int64())) for c in C.ROW]


def _units(bands: int, rows_: int):
    rng = C.mix64(np.arange(bands * rows_, dtype=np.uint64) + np.uint64(1 << 50))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in C.slices(batch):
                k = rows.num_rows
                lo, _, row, h, begins = words(data, at)
                g = C.windows(h, N)
                # lines: words between line ends and row bounds
                line = np.concatenate(([0], np.cumsum(data == 10)))[lo] if len(lo) else np.zeros(0, np.int64)
                new = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])))) if len(lo) else np.zeros(0, np.int64)
                ends = np.append(new[1:], len(lo))
                keep = ends - new >= LEAST_WORDS
                a, b = new[keep], ends[keep]
                # how many different shingles a paragraph has: repeats of one in it count once
                span = b - N + 1 - a
                which = np.repeat(np.arange(len(a)), span)
                grams = g[np.arange(int(span.sum())) + np.repeat(a - (np.cumsum(span) - span), span)] if len(a) else np.zeros(0, np.uint64)
                by = np.lexsort((grams, which))
                once = np.ones(len(by), bool)
                once[1:] = (grams[by][1:] != grams[by][:-1]) | (which[by][1:] != which[by][:-1])
                different = np.bincount(which[by][once], minlength=len(a))
                made = np.zeros((len(a), bands), np.uint64)
                if len(a):
                    starts = np.cumsum(span) - span
                    for i in range(bands):
                        made[:, i] = i
                        for s in rng[i * rows_ : (i + 1) * rows_]:
                            made[:, i] = C.pair(made[:, i], np.minimum.reduceat((grams ^ s) * (s | np.uint64(1)), starts))
                of = row[a]
                unit = pa.StructArray.from_arrays([pa.array((x - begins[of]).astype(np.int32)) for x in (a, b)] + [pa.array(different.astype(np.int32)), pa.array(C.run_hashes(h, a, b).view(np.int64)), C.lists(made.ravel().view(np.int64), np.full(len(a), bands), pa.int64())], names=["lo", "hi", "n", "key", "bands"])
                cut = _cuts(C.windows(h, SEED), row)
                p, q = cut[:-1], cut[1:] + SEED
                same = row[p] == row[q - 1]
                p, q = p[same], q[same]
                piece = pa.StructArray.from_arrays([pa.array((x - begins[row[p]]).astype(np.int32)) for x in (p, q)] + [pa.array(C.run_hashes(h, p, q, 1).view(np.int64))], names=["lo", "hi", "key"])
                by_row = lambda own, value: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(own, minlength=k)))).astype(np.int32)), value)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in C.ROW), by_row(of, unit), by_row(row[p], piece)], names=[*C.ROW, "units", "pieces"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of wanted paragraphs, which name themselves."""
    for batch in batches:
        for rows, data, at in C.slices(batch):
            _, _, _, h, begins = words(data, at)
            g, n = C.windows(h, N), begins[1:] - begins[:-1]
            wants = rows.column("want").to_pylist()
            a = np.array([begins[i] + w["lo"] for i, want in enumerate(wants) for w in want if w["hi"] <= n[i]], np.int64)
            b = np.array([begins[i] + w["hi"] for i, want in enumerate(wants) for w in want if w["hi"] <= n[i]], np.int64)
            sets = [np.unique(g[x : y - N + 1]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(C.run_hashes(h, a, b).view(np.int64)), C.lists(flat, np.array([len(x) for x in sets], np.int64), pa.int64())], names=["sid", "keys"])


def _whole(nodes: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """sid, keys: the shingles of these paragraphs."""
    want = first.join(nodes, "sid", "left_semi").groupBy(*C.ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("want"))  # of one document
    want = C.written(want)
    made = C.among(docs.select(*C.ROW, "text"), want).join(want, C.ROW).select("text", "want").mapInArrow(_sets, "sid long, keys array<long>")
    return C.written(made.dropDuplicates(["sid"]), release=True)


def _verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    pairs = C.written(pairs.distinct())
    sets = _whole(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct(), docs, first)
    side = lambda s: sets.select(F.col("sid").alias(s), F.col("keys").alias(f"g{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("i", F.size(F.array_intersect("ga", "gb")))
    out = C.written(both.where(den * F.col("i") >= num * (F.size("ga") + F.size("gb") - F.col("i"))).select("a", "b"), release=True)
    C.forget(pairs)
    C.forget(sets)
    return out


def _free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces that no removed paragraph touches."""
    for batch in batches:
        keep, out = [], []
        for i, r in enumerate(batch.select(["pieces", "gone"]).to_pylist()):
            p = np.array([(x["lo"], x["hi"], x["key"]) for x in r["pieces"]], np.int64).reshape(-1, 3)
            gone = np.array([(x["lo"], x["hi"]) for x in r["gone"] or []], np.int64).reshape(-1, 2)
            out.append(p[np.searchsorted(gone[:, 1], p[:, 0], "right") == np.searchsorted(gone[:, 0], p[:, 1], "left")])
            keep.append(np.full(len(out[-1]), i))
        p, of = np.concatenate([np.zeros((0, 3), np.int64), *out]), np.concatenate([np.zeros(0, np.int64), *keep])
        yield pa.RecordBatch.from_arrays([*_keys(batch, of), *(pa.array(p[:, i].astype(t)) for i, t in ((2, np.int64), (0, np.int32), (1, np.int32)))], names=[*C.ROW, "key", "lo", "hi"])


_RUN = f"{_KEY}, lo int, hi int, lk long, lh long, ll int, le int, rk long, rh long, re int"
_RUN_NAMES = [x.split(" ")[0] for x in _RUN.split(", ")]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that touch as runs: their words, and where the first occurrence of their first piece begins and ends and that of their last one ends. A run never overlaps its own first occurrence."""
    for batch in batches:
        out: list[list] = []
        for r in batch.to_pylist():
            now = None
            for x in sorted(r["hits"], key=lambda x: (x["lo"], x["hi"])):
                h = x["head"]
                lo = max(x["lo"], h["hi"]) if (h["_k"], h["_h"]) == (r["_k"], r["_h"]) else x["lo"]
                if now and lo <= now[3]:
                    if x["hi"] > now[3]:
                        now[3], now[8:] = x["hi"], [h["_k"], h["_h"], h["hi"]]
                elif lo < x["hi"]:
                    left = [h["_k"], h["_h"], h["lo"]] if lo == x["lo"] else [None, None, None]
                    now = [r["_k"], r["_h"], lo, x["hi"], *left, h["hi"], h["_k"], h["_h"], h["hi"]]
                    out.append(now)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if n in ("_k", "_h", "lk", "lh", "rk", "rh") else pa.int32()) for i, n in enumerate(_RUN_NAMES)], names=_RUN_NAMES)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the words beside wanted places, outwards up to BESIDE words or a removed paragraph."""
    for batch in batches:
        for rows, data, at in C.slices(batch):
            _, _, row, h, begins = words(data, at)
            keep = np.ones(len(row), bool)
            places, lefts, values, of = [], [], [], []
            for i, (want, gone) in enumerate(zip(rows.column("want").to_pylist(), rows.column("gone").to_pylist(), strict=True)):
                for x in gone or []:
                    keep[begins[i] + x["lo"] : begins[i] + x["hi"]] = False
                for w in want:
                    k = int(begins[i]) + w["at"]
                    own = np.arange(k - 1, max(begins[i], k - BESIDE) - 1, -1) if w["left"] else np.arange(k, min(begins[i + 1], k + BESIDE))
                    places.append(w["at"])
                    lefts.append(w["left"])
                    values.append(h[own[np.logical_and.accumulate(keep[own])]])
                    of.append(i)
            flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*_keys(rows, np.array(of, np.int64)), pa.array(places, pa.int32()), pa.array(lefts, pa.bool_()), C.lists(flat, np.array([len(x) for x in values], np.int64), pa.int64())], names=[*C.ROW, "at", "left", "words"])


def _passages(docs: DataFrame, made: DataFrame, lines: DataFrame) -> DataFrame:
    """_k, _h, lo, hi of the passages that repeat an earlier one; made has pieces, and lines the removed paragraphs."""
    gone = C.written(lines.groupBy(*C.ROW).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("gone")))
    piece = made.select(*C.ROW, F.explode("pieces").alias("p")).select(*C.ROW, "p.*")
    place = F.struct(*C.ROW, "lo", "hi")
    several = C.written(piece.groupBy("key").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("key"), release=True)
    repeats = C.written(piece.join(several, "key", "left_semi"), release=True)
    C.forget(several)
    some = repeats.groupBy(*C.ROW).agg(F.collect_set(F.struct("lo", "hi", "key")).alias("pieces")).join(gone, C.ROW, "left")
    free = C.written(some.select(*C.ROW, "pieces", "gone").mapInArrow(_free, f"{_KEY}, key long, lo int, hi int"), release=True)
    C.forget(repeats)
    heads = C.written(free.groupBy("key").agg(F.min(place).alias("head"), F.max(place).alias("last")).where("head <> last").select("key", "head"))
    hits = free.join(heads, "key").where(~place.eqNullSafe(F.col("head")))
    runs = C.written(hits.groupBy(*C.ROW).agg(F.collect_list(F.struct("lo", "hi", "head")).alias("hits")).mapInArrow(_runs, _RUN), release=True)
    for x in (free, heads):
        C.forget(x)
    edge = lambda k, h, at, left: runs.where(f"{k} IS NOT NULL").select(F.col(k).alias("_k"), F.col(h).alias("_h"), F.col(at).alias("at"), F.lit(left).alias("left"))
    want = edge("_k", "_h", "lo", True).union(edge("lk", "lh", "ll", True)).union(edge("_k", "_h", "hi", False)).union(edge("rk", "rh", "re", False)).distinct()
    want = want.groupBy(*C.ROW).agg(F.collect_list(F.struct("at", "left")).alias("want")).join(gone, C.ROW, "left")
    beside = docs.select(*C.ROW, "text").join(want, C.ROW).select(*C.ROW, "text", "want", "gone").mapInArrow(_beside, f"{_KEY}, at int, left boolean, words array<long>")
    beside = C.written(beside.dropDuplicates([*C.ROW, "at", "left"]), release=True)
    for left, k, h, at, own in ((True, "lk", "lh", "ll", "lo"), (False, "rk", "rh", "re", "hi")):
        sides = beside.where(F.col("left") == left)
        mine = sides.select(*C.ROW, F.col("at").alias(own), F.col("words").alias("mine"))
        theirs = C.written(sides.select(F.col("_k").alias(k), F.col("_h").alias(h), F.col("at").alias(at), F.col("words").alias("theirs")))
        rows = C.written(runs.join(mine, [*C.ROW, own], "left"))  # written, so that Spark can split the join on a first occurrence that very many runs have
        rows = rows.join(theirs, [k, h, at], "left")
        unlike = F.array_position(F.zip_with("mine", "theirs", lambda x, y: x.eqNullSafe(y)), False)
        n = F.when(F.col(k).isNull() | F.col("theirs").isNull(), 0).when(unlike > 0, unlike - 1).otherwise(F.size("mine")).cast("int")
        more = F.col(own) - n if left else F.col(own) + n
        if left:  # never into the first occurrence itself
            more = F.when((F.col("lk") == F.col("_k")) & (F.col("lh") == F.col("_h")), F.least(F.greatest(more, F.col("le")), F.col("lo"))).otherwise(more)
        runs = C.written(rows.withColumn(own, F.coalesce(more, F.col(own)).cast("int")).select(*_RUN_NAMES))
    w = Window.partitionBy(*C.ROW).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*C.ROW, "lo", "hi").distinct().withColumn("new", (F.col("lo") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(*C.ROW, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("hi") - F.col("lo") >= LEAST_PASSAGE).drop("run")


def _copies(made: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """_k, _h, lo, hi of the paragraphs that are copies of an earlier one; made has units. The table outlives the scratch() around."""
    unit = made.select(*C.ROW, F.explode("units").alias("u")).select(*C.ROW, "u.*").withColumnRenamed("key", "sid")
    first = C.written(unit.groupBy("sid").agg(F.min(F.struct(*C.ROW, "lo", "hi", "n", "bands")).alias("f"), F.count(F.lit(1)).alias("count")).select("sid", "count", "f.*"), release=True)
    entries = lambda: first.select("sid", F.col("n").cast("long").alias("n"), F.explode("bands").alias("key"))
    entry = C.written(blocked.shared(entries(), entries).select("key", "sid", "n", F.lit(0).alias("at")), release=True)
    many = entry.groupBy("sid").agg(F.count(F.lit(1)).alias("shared"))  # the source of a group of edited copies shares most bands
    pivot = C.written(entry.join(many, "sid").groupBy("key").agg(F.min_by("sid", F.struct(-F.col("shared"), "sid")).alias("p")))
    w = Window.partitionBy("key", "run").orderBy("n", "sid")
    entry = blocked.in_runs(C.written(entry.join(pivot, "key").select("*", (F.col("sid") == F.col("p")).alias("pivot"))))
    entry = C.written(entry.withColumns({"before": F.lag("sid").over(w), "rank": F.row_number().over(w)}), release=True)
    side = lambda p: entry.where(f"{p} IS NOT NULL").select(F.col(p).alias("p"), "sid")
    pairs = side("p").unionByName(side("before"))
    links = _verified(pairs.where("p <> sid").select(F.least("p", "sid").alias("a"), F.greatest("p", "sid").alias("b")), docs, first, num, den)
    named = lambda links: C.written(C.components(links).select(F.col("node").alias("sid"), "component"))
    found = named(links)
    may = (den * F.col("n") >= num * F.col("n_min")) & (num * F.col("n") <= den * F.col("n_max"))
    now, base, alone = blocked.by_length(blocked.grouped(entry.drop("before", "p"), found), num, den)
    near = C.written(blocked.candidates(now, may), release=True)
    pairs, wide = blocked.small(near, found, first)
    links = links.unionByName(_verified(pairs.where(den * F.col("na") >= num * F.col("nb")).select("a", "b"), docs, first, num, den))
    wide, inside = C.written(wide.unionByName(base)), C.written(blocked.members(wide, found).unionByName(alone))
    sets = _whole(wide.select("sid").union(inside.select("sid")).distinct(), docs, first)
    found = named(links.unionByName(C.written(blocked.links(wide, inside, sets, first, num, den).where("a <> b"), release=True)))
    place = F.struct(*C.ROW, "lo")
    group = first.select("sid", "count", *C.ROW, "lo").join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    heads = group.groupBy("component").agg(F.min(place).alias("head"), F.sum("count").alias("all")).where("all > 1")
    keyed = C.written(group.join(heads, "component").select("sid", "head"))
    hit = unit.drop("bands", "n").join(keyed, "sid")
    return C.written(hit.where(~place.eqNullSafe(F.col("head"))).select(*C.ROW, "lo", "hi").distinct(), release=True, out=True)


def repeated(docs: DataFrame, num: int = NUM, den: int = DEN, recall: float = RECALL) -> DataFrame:
    """Removed units (_k, _h, lo, hi in words, passage) of docs, which has text and its key."""
    bands, rows = tune(num / den, recall)
    made = C.written(docs.select(*C.ROW, "text").mapInArrow(_units(bands, rows), f"{_KEY}, units array<{_UNIT}>, pieces array<{_PIECE}>"))
    with C.scratch(docs.sparkSession):
        lines = _copies(made, docs, num, den)
    return lines.withColumn("passage", F.lit(False)).unionByName(_passages(docs, made, lines).withColumn("passage", F.lit(True)))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in C.slices(batch):
            lo, hi, _, _, begins = words(data, at)
            out: list[list] = [[], [], [], [], [], [], []]
            for i, gone in enumerate(rows.column("gone").to_pylist()):
                body, gone = data[at[i] : at[i + 1]], gone or []
                spans = merged(np.array([(x["lo"], x["hi"]) for x in gone], np.int64).reshape(-1, 2)) + begins[i]
                spans = np.stack((lo[spans[:, 0]], hi[spans[:, 1] - 1]), 1) - at[i] if len(spans) else spans
                keep = np.ones(len(body), bool)
                for a, b in spans.tolist():
                    keep[a:b] = False
                rest = body[keep].tobytes()
                passages = sum(x["passage"] for x in gone)
                for column, v in zip(out, (len(body), len(body) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), len(gone) - passages, passages, spans.ravel().tolist()), strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_paragraphs", "n_passages", "spans"])


def paragraph_dedup(docs: DataFrame, num: int = NUM, den: int = DEN, recall: float = RECALL) -> DataFrame:
    """doc_id, n_bytes, n_removed (bytes), n_spans, kept_sha256, n_paragraphs and n_passages (removed), spans (from, to, from, to, ... in bytes) of every row."""
    own = C.keyed(docs)
    with C.scratch(docs.sparkSession):
        gone = repeated(own, num, den, recall).groupBy(*C.ROW).agg(F.array_sort(F.collect_set(F.struct("lo", "hi", "passage"))).alias("gone"))
        gone = C.written(gone, release=True, out=True)
    return own.join(gone, C.ROW, "left").select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_paragraphs long, n_passages long, spans array<long>")


def query(spark, sf_dir):
    return paragraph_dedup(C.table(spark, sf_dir, "documents")).drop("spans")
