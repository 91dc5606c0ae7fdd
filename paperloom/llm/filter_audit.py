"""Filter interaction audit: what each filter removes in every order that filters could be applied in.

Every document gets a number whose bits are the filters it fails (32 numbers for five filters). Which
step of an order removes a document depends on that number alone: FIRST, a table of 32 numbers by
120 orders, is made once. A task looks its rows up in it and counts part, order and step with
np.bincount, for all documents, good ones and toxic ones; it gives its counts as one row for each
part, order and step. These partial counts are summed by Spark. A task holds at most MOST_PARTS parts
at a time.

Filters A to D are expressions over the text. E needs the whole table: texts are told apart by SHA-256,
the least doc_id of a text is a partial aggregate before any shuffle, and rows take it, like their
labels, through salted joins, so copies of one text may be any share of all rows. Rows are numbers and
a digest by then; texts are read once and never shuffled.

Defined results: null text counts as empty (no words: it fails A); a null part is the part ''; a null
doc_id is neither smaller nor greater than another, so its row never fails E, has no labels, and is no
reason for another row to fail E; rows that repeat a doc_id are documents of their own, and of equal
texts only those beyond the least doc_id fail E; a document is good (toxic) if any of its label rows
says so; a very long text is one row like others; an empty table gives an empty result; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
#: The step (from 0) at which an order removes a document that fails the filters of a number; 5: none does.
FIRST = np.array([[next((k for k, f in enumerate(order) if fails >> f & 1), len(FILTERS)) for order in ORDERS] for fails in range(1 << len(FILTERS))])
#: Parts that a task counts at a time, 17 KB each.
MOST_PARTS = 512
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def own_failures(text: Column, words: Column) -> Column:
    """The bits of the filters that look at a document alone."""
    n, different = F.size(words), F.size(F.array_distinct(words))
    tests = [n < 200, 100 * different < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def facts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, fails, good, toxic of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col(part).cast("string"), F.lit("")) if part in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = C.written(rows.select("doc_id", "part", own_failures(F.col("text"), F.col("words")).alias("fails"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("digest", "first")
    said = lambda c: F.coalesce(F.max(F.col(c).cast("int") == 1), F.lit(False)).alias(c)
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    rows = C.attach(rows, first, "digest", how="left")
    rows = C.attach(rows, said, "doc_id", by="digest", how="left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int").alias(c)
    return rows.select("part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("fails"), yes("good"), yes("toxic"))


def _rows(names: list[str], cells: np.ndarray, failed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts as rows. cells: label, part, order, step (the last: kept by all); failed: of a filter, and of it alone, by part."""
    orders, n = np.array(ORDERS), len(FILTERS)
    everything = cells[0].sum(2)[:, 0]
    for i, name in enumerate(names):
        removed = cells[0, i, :, :n]
        by_filter = np.bincount(orders.ravel(), removed.ravel(), n).astype(np.int64)
        columns = {"kept": everything[i] - np.cumsum(removed, 1), "removed": removed, "redundant": failed[0, i][orders] - removed, "unique_fails": failed[1, i][orders], "good_lost": cells[1, i, :, :n], "toxic_lost": cells[2, i, :, :n], "shapley": by_filter[orders]}
        said = ["".join(FILTERS[f] for f in order) for order in ORDERS]
        head = [pa.array([name] * orders.size, pa.string()), pa.array(np.repeat(said, n), pa.string()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(ORDERS)))]
        yield pa.RecordBatch.from_arrays([*head, *(pa.array(columns[c].ravel().astype(np.int64)) for c in COUNTS)], names=["part", "filter_order", "step", *COUNTS])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, of = len(FILTERS), len(ORDERS)
    place: dict[str, int] = {}
    cells, failed = np.zeros((3, 0, of, n + 1), np.int64), np.zeros((2, 0, n), np.int64)
    for batch in batches:
        coded = batch.column("part").dictionary_encode()
        code = np.array([place.setdefault(x, len(place)) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        if len(place) > cells.shape[1]:
            more = len(place) - cells.shape[1]
            cells = np.concatenate((cells, np.zeros((3, more, of, n + 1), np.int64)), 1)
            failed = np.concatenate((failed, np.zeros((2, more, n), np.int64)), 1)
        fails, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fails", "good", "toxic"))
        at = (code[:, None] * of + np.arange(of)) * (n + 1) + FIRST[fails]
        for k, rows in enumerate((slice(None), good == 1, toxic == 1)):
            cells[k] += np.bincount(at[rows].ravel(), minlength=cells[k].size).reshape(cells[k].shape)
        for f in range(n):
            for k, rows in enumerate((fails >> f & 1 == 1, fails == 1 << f)):
                failed[k, :, f] += np.bincount(code[rows], minlength=len(place))
        if len(place) > MOST_PARTS:
            yield from _rows(list(place), cells, failed)
            place, cells, failed = {}, cells[:, :0], failed[:, :0]
    yield from _rows(list(place), cells, failed)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step and COUNTS, for every part, order and step."""
    kinds = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    partial = facts(docs, labels, part).mapInArrow(_count, kinds)
    return partial.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in COUNTS))


def query(spark, sf_dir):
    return audit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT x, min(doc_id) AS first FROM t GROUP BY x),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CAST(len(w) < 200 AS INT) + CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) * 2 + CAST(100 * len(regexp_extract_all(x, '[A-Z]')) > 3 * length(x) AS INT) * 4
  + CAST(regexp_matches(x, '[#$%&*|]') AS INT) * 8 + CAST(coalesce(t.doc_id > m.first, false) AS INT) * 16 AS fails
  FROM t JOIN m USING (x) LEFT JOIN l ON t.doc_id = l.doc_id),
h AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM e a, e b, e c, e d, e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, list_sum(list_slice(bits, 1, k - 1)) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT part, filter_order, step, bit,
  CAST(sum(CASE WHEN fails & (bit | coalesce(before, 0)::INT) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN fails & bit > 0 AND fails & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fails & bit > 0 AND fails & coalesce(before, 0)::INT > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN fails & bit > 0 AND fails & coalesce(before, 0)::INT = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN fails & bit > 0 AND fails & coalesce(before, 0)::INT = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM h, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
