"""Benchmark decontamination: windows of benchmark items that occur in documents, by a prefix-filtered join.

An item's windows are its runs of WINDOW consecutive words (a shorter item is one window). A window is a
set of aligned shingles of SHINGLE words, and a document holds it at a place where at least the share
`share` of them stands (all of them at share 1, which is equality of words). If so, one of any
m - ceil(share * m) + 1 of its m shingles stands there: the window's necessary prefix. The shingles of
all items are counted over all documents first, and a prefix takes the rarest of its window, so few
places of a document are candidates. A candidate says where the window would have to begin; it
must lie inside the document (position and length bounds), and then its words are compared.

Texts are read twice and never shuffled: words, shingles, the join with the prefixes and the comparison
are one stage of generated code, out of which only matches come. Prefixes are sent to all tasks in blocks
of MOST_ROWS at most, a pass over the documents for each block; so memory is bounded by the block, however
large the benchmark is, and no match is lost. Only DataFrame expressions are used.

Defined results: null and empty texts have no words and no hits; an item without words is in no document;
a null item_id is an item whose name is the empty string; rows that share an item_id are one item with
the windows of all; rows that repeat a doc_id are documents of their own, and equal rows get equal
results; a very long text is one row like others, and what is kept of it is in proportion to its words;
empty tables give empty results, an empty benchmark no hits; other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words of a window, and words of a shingle.
WINDOW, SHINGLE = 10, 3
#: Prefix rows (a shingle of a window of an item) that are sent to all tasks at once: about 40 MB.
MOST_ROWS = 100_000
#: What is between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def lower(text: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN), "")


def shingle(words: Column, at: Column, size: int) -> Column:
    """The hash of `size` words from place `at` (from 0) on. Words that are equal with A-Z lower-cased have equal hashes."""
    return F.xxhash64(*(F.lower(F.get(words, at + i)) for i in range(size)))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (string), words: the different windows of every item."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), split(lower(F.col("text"))).alias("_all"))
    starts = F.when(F.size("_all") > 0, F.sequence(F.lit(0), F.greatest(F.size("_all") - window, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return rows.select("item_id", "_all", F.explode(starts).alias("_at")).select("item_id", F.slice("_all", F.col("_at") + 1, F.lit(window)).alias("words")).distinct()


def places(docs: DataFrame, size: int, *keep: str) -> DataFrame:
    """A row for every place of every document at which `size` words begin: at, shingle, the columns to keep and the document's words."""
    rows = docs.select(*keep, split(F.col("text")).alias("words"))
    starts = F.when(F.size("words") >= size, F.sequence(F.lit(0), F.size("words") - size)).otherwise(F.array().cast("array<int>"))
    return rows.select(*keep, "words", F.explode(starts).alias("at")).select(*keep, "words", "at", shingle(F.col("words"), F.col("at"), size).alias("shingle"))


def prefixes(windows: DataFrame, docs: DataFrame, size: int, share: float) -> DataFrame:
    """item_id, words, off, shingle: the rarest shingles of every window, as many as are necessary. All windows have `size` words or more."""
    m = F.size("words") - size + 1
    offs = windows.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("off"))
    offs = C.written(offs.withColumn("shingle", shingle(F.col("words"), F.col("off"), size)))
    own = C.written(offs.select("shingle").distinct())
    counts = None
    blocks = max(1, math.ceil(own.count() / (8 * MOST_ROWS)))  # rows of one number
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == b)
        found = places(docs, size).join(F.broadcast(part), "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
        counts = found if counts is None else counts.unionByName(found)
    # the necessary prefix of a window, rarest first; at most its few shingles are sorted
    ranked = offs.join(C.written(counts), "shingle", "left").groupBy("item_id", "words").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "off"))).alias("s"))
    need = (m - F.ceil(m * share) + 1).cast("int")
    return ranked.select("item_id", "words", F.explode(F.slice("s", F.lit(1), need)).alias("s")).where("s.n > 0").select("item_id", "words", "s.off", "s.shingle")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 1.0) -> DataFrame:
    """The row key of a document (C.ROW), item_id, begin, end: the places of all windows of items, in words, the end exclusive."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    windows = C.written(item_windows(items, window))
    texts = docs.select(F.col("text").cast("string").alias("text"), *C.row_key(F.col("doc_id"), F.col("text")))
    sizes = [r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()]  # SHINGLE numbers at most
    out = []
    for size in sorted(sizes):
        own = windows.where(F.least(F.size("words"), F.lit(SHINGLE)) == size)
        first = C.written(prefixes(own, texts, size, share))
        blocks = math.ceil(first.count() / MOST_ROWS)
        for b in range(blocks):
            part = first.where(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == b)
            wanted = part.select("item_id", "off", "shingle", F.size("words").alias("n"), F.array_join("words", " ").alias("window"))
            near = places(texts, size, *C.ROW).join(F.broadcast(wanted), "shingle")
            begin = F.col("at") - F.col("off")
            near = near.where((begin >= 0) & (begin + F.col("n") <= F.size("words")))
            there = lower(F.array_join(F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.col("n")), " "))
            if share == 1:
                near = near.where(there == F.col("window"))
            else:
                a, w = F.split("there", " "), F.split("window", " ")
                alike = F.size(F.filter(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.slice(a, i, size) == F.slice(w, i, size)))  # noqa: B023
                near = near.withColumn("there", there).drop("words").where(alike >= F.ceil((F.col("n") - size + 1) * share))
            found = near.select(*C.ROW, "item_id", begin.alias("begin"), (begin + F.col("n")).alias("end"))
            out.append(C.written(found if share == 1 else found.distinct()))
    made = texts.select(*C.ROW, F.lit("").alias("item_id"), F.lit(0).alias("begin"), F.lit(0).alias("end")).limit(0)
    for rows in out:
        made = made.unionByName(rows)
    return made


def covered(spans: Column) -> Column:
    """How many places the (begin, end) of an array cover."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(x["begin"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"].cast("long")


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 1.0) -> DataFrame:
    """doc_id, n_words, spans (begin, end) and items (sorted item_ids) of every document."""
    found = matches(docs, items, window, share)
    hits = found.groupBy(*C.ROW).agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), *C.row_key(F.col("doc_id"), F.col("text")))
    rows = base.join(hits, C.ROW, "left")
    return rows.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 1.0) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with their columns."""
    found = matches(docs, items, window, share).select(*C.ROW).distinct()
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = lambda name: F.col(names[docs.columns.index(name)])
    rows = docs.toDF(*names).select("*", *C.row_key(own("doc_id"), own("text")))
    return rows.join(found, C.ROW, "left_anti").select(*names).toDF(*docs.columns)


def query(spark, sf_dir):
    made = judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    n_hit = covered(F.col("spans"))
    return made.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS win, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item_id FROM pos JOIN win USING (win, n)),
cover AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""
