"""Quality rules with risk-controlled thresholds.

Every metric of a document's form (share of symbols, of upper case, of repeated lines, ...) could be
cut at any of a fixed grid of values. On labelled documents of a stratum (a language), a cutoff's
false rejections are good documents beyond it; the exact binomial tail says how likely so few of
them would be if the true rate were the limit. Cutoffs are tested from the most lenient on, each only
while all before it passed (a fixed sequence needs no correction within), and the error is shared
between all strata and metrics by Bonferroni, as is the limit between the metrics of a stratum. So,
with probability 1 - error, no stratum's rules reject more than `limit` of its good documents. Of
the cutoffs that passed, the one rejecting the most bad labelled documents is used; ties go to the
most lenient; one that rejects no bad document isn't used at all.

Every labelled document counts, and any number of strata is judged. A cutoff can pass only where so many good documents are labelled that
none of them beyond it is evidence enough (least_good), so of the strata with cutoffs, which go to all tasks, there is one for some
hundreds of labels at most; cutoffs are chosen in tasks, by stratum.

Defined results: null text has no words and fails the base rules; a null language is a stratum of
its own; strata with few labels get no cutoffs (their documents are kept unless the base rules fail
them); labels that are null or contradict each other are left out; documents that occur in no label
are judged all the same; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 8
#: Share of good documents that a stratum may lose, and the chance that any stratum loses more.
LIMIT, ERROR = 0.05, 0.05
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
CARRIED = "_measures"


def repeats(code: np.ndarray, row: np.ndarray, n_rows: int, window: int = WINDOW) -> np.ndarray:
    """For each row, how many of its words lie in windows that occur twice or more in the row."""
    n = len(code) - window + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    whole = np.flatnonzero(row[:n] == row[window - 1 :])
    h = C.mix64(row[whole].astype(np.uint64) + np.uint64(1 << 40))
    for k in range(window):
        h = C.mix64(h ^ code[whole + k].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(s), bool)
    again[1:] |= same
    again[:-1] |= same
    at = whole[order[again]]
    cover = np.zeros(len(code) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n_rows)


def _measures(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows with a struct of counts in place of nothing else; `text` names the column to measure."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    names = [x.split(" ")[0] for x in _COUNTS.split(", ")]
    for batch in batches:
        for rows, data, at in C.slices(batch, text):
            n = rows.num_rows
            lo, hi, row = C.word_bounds(data, at)
            code = C.word_array(data, lo, hi).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            points = C.code_points(data)
            count = lambda hit, at=at: np.diff(np.concatenate(([0], np.cumsum(hit)))[at])
            # lines: pieces between \n and row bounds that hold a word
            bounds = np.union1d(at[:-1], np.flatnonzero(data == 10) + 1) if len(data) else np.zeros(0, np.int64)
            bounds = bounds[bounds < len(data)]
            ends = np.append(bounds[1:], len(data))
            ends = ends - (data[ends - 1] == 10) if len(bounds) else ends
            has = np.searchsorted(lo, ends) > np.searchsorted(lo, bounds)
            ls, le = bounds[has], ends[has]
            line_row = np.searchsorted(at, ls, "right") - 1
            dup, body = np.zeros(n, np.int64), data.tobytes()
            seen: set[tuple[int, bytes]] = set()
            for r, a, b in zip(line_row.tolist(), ls.tolist(), le.tolist(), strict=True):
                key = (r, body[a:b])
                if key in seen:
                    dup[r] += 1
                seen.add(key)
            values = [np.bincount(row, minlength=n), np.bincount(row, weights=points[hi] - points[lo], minlength=n), count(symbol[data]), dup, repeats(code, row, n), np.bincount(line_row, minlength=n), count((data >= 65) & (data <= 90))]
            counts = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], names=names)
            yield pa.RecordBatch.from_arrays([*rows.columns, counts], names=[*rows.schema.names, CARRIED])


def _stratum(docs: DataFrame, stratum: str) -> Column:
    return F.col(stratum).cast("string") if stratum in docs.columns else F.lit(None).cast("string")


def _failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, and counts of each document's words, symbols, lines and repetitions."""
    rows = docs.select(F.col("doc_id").cast("long"), _stratum(docs, stratum).alias("stratum"), F.col("text").cast("string"))
    made = rows.mapInArrow(_measures, f"doc_id long, stratum string, text string, {CARRIED} struct<{_COUNTS.replace(' long', ': long')}>")
    return made.select("doc_id", "stratum", f"{CARRIED}.*").withColumn("base_failed", _failed())


#: Metric: its value out of the counts, and the cutoffs to test, the most lenient first; a document beyond a cutoff is rejected.
def metrics() -> dict[str, tuple[Column, list[float]]]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    down = [round(x / 100, 2) for x in (*range(90, 20, -10), *range(20, 4, -2), 4, 3, 2, 1)]
    return {
        "symbols": (share("n_symbols", "word_chars"), down),
        "upper": (share("n_upper", "word_chars"), down),
        "dup_lines": (share("n_dup_lines", "n_lines"), down),
        "repeats": (share("n_repeat_words", "n_words"), down),
        "long_words": (share("word_chars", "n_words"), [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0]),
    }


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction, which converges fast for x below the mean."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 100_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            return front * f
    raise ArithmeticError("the incomplete beta function did not converge")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial (n, p), exactly: the incomplete beta function is this sum in closed form."""
    return 1.0 if k >= n else _beta(n - k, k + 1, 1 - p)


def least_good(strata: int, metrics: int, limit: float = LIMIT, error: float = ERROR) -> int:
    """Labelled good documents below which no cutoff of a stratum can pass, not even one that rejects none of them: (1 - p)^n > share."""
    return math.ceil(math.log(error / max(1, strata * metrics)) / math.log1p(-limit / metrics))


def choose(counts: list[dict], names: dict[str, list[float]], limit: float = LIMIT, error: float = ERROR, strata: int | None = None) -> dict[tuple[str | None, str], float]:
    """Cutoffs by (stratum, metric), out of rows with stratum, good, and bad_<m>_<i>, good_<m>_<i>: labelled documents beyond cutoff i of metric m. strata: how many there are in all, these and others."""
    out: dict[tuple[str | None, str], float] = {}
    share = error / max(1, (len(counts) if strata is None else strata) * len(names))
    for r in counts:
        for m, grid in names.items():
            best = 0
            for i, cutoff in enumerate(grid):
                if binomial_tail(r[f"good_{m}_{i}"], r["good"], limit / len(names)) > share:
                    break
                if r[f"bad_{m}_{i}"] > best:
                    best, out[r["stratum"], m] = r[f"bad_{m}_{i}"], cutoff
    return out


def learn(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """The cutoffs, a row for each stratum that has any: _s, and _m_<metric>, null where a metric isn't used."""
    with C.scratch(measured.sparkSession):
        return _learned(measured, labels, limit, error)


def _learned(measured: DataFrame, labels: DataFrame, limit: float, error: float) -> DataFrame:
    made = metrics()
    clear = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    rows = measured.where("NOT base_failed").join(clear.select("doc_id", "quality"), "doc_id")
    sums = [F.sum(F.when((v > c) & (F.col("quality") == q), 1).otherwise(0)).alias(f"{name}_{m}_{i}") for m, (v, grid) in made.items() for i, c in enumerate(grid) for name, q in (("good", 1), ("bad", 0))]
    counts = C.written(rows.groupBy("stratum").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), *sums))
    strata, names = counts.count(), {m: grid for m, (_, grid) in made.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [(r["stratum"], choose([r], names, limit, error, strata)) for r in batch.to_pylist()]
            of = [(s, found) for s, found in of if found]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in of], pa.string()), *(pa.array([found.get((s, m)) for s, found in of], pa.float64()) for m in names)], names=["_s", *(f"_m_{m}" for m in names)])

    enough = counts.where(F.col("good") >= least_good(strata, len(made), limit, error))
    return C.written(enough.mapInArrow(cut, f"_s string, {', '.join(f'_m_{m} double' for m in names)}"), out=True)


def rejected(rows: DataFrame, stratum: str, cutoffs: DataFrame) -> DataFrame:
    """rows with _rejected: whether a metric is beyond the cutoff of the row's stratum."""
    made = metrics()
    found = rows.join(F.broadcast(cutoffs), F.col(stratum).eqNullSafe(F.col("_s")), "left")  # a row for each stratum with least_good labelled documents
    bad = F.lit(False)
    for m, (value, _) in made.items():
        bad = bad | F.coalesce(value > F.col(f"_m_{m}"), F.lit(False))
    return found.withColumn("_rejected", bad).drop("_s", *(f"_m_{m}" for m in made))


def judge(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """The measured rows with kept: false where the base rules or a stratum's cutoffs reject."""
    found = rejected(measured, "stratum", learn(measured, labels, limit, error))
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("_rejected")).drop("_rejected")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """The rows that the rules keep, with the columns of docs. Texts are measured once and written with their counts; they aren't shuffled."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = lambda name: F.col(names[docs.columns.index(name)])
    rows = docs.toDF(*names)
    rows = rows.select(*names, (own(stratum) if stratum in docs.columns else F.lit(None)).cast("string").alias("stratum"), own("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    made = rows.mapInArrow(lambda b: _measures(b, "_text"), f"{kinds}, {CARRIED} struct<{_COUNTS.replace(' long', ': long')}>")
    made = C.written(made.select(*names, own("doc_id").cast("long").alias("doc_id"), "stratum", f"{CARRIED}.*").withColumn("base_failed", _failed()))
    return judge(made, labels, limit, error).where("kept").select(*names).toDF(*docs.columns)


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row."""
    return judge(C.written(measures(docs, stratum)), labels, limit, error)


def query(spark, sf_dir):
    return quality_rules(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept")
