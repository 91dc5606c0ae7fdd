"""Source divergence audit: how far the words of each source of a language are from those of its other sources.

Two passes over the texts. The first counts exact document frequencies: a task counts the different
terms of each document by language and gives partial counts whenever it holds MOST_HELD; Spark
sums them, and a language keeps the terms of LEAST_DOCUMENTS documents or more. The second recounts kept
terms by automaton: every term goes into an Aho-Corasick automaton of its language between two
delimiters, texts have one delimiter at least between their terms, and the automaton says which kept terms
occur, once for each occurrence, as neighbours may share a delimiter. Counts are bounded per task like
before. Automata are made of at most MOST_BYTES of terms; a larger vocabulary is recounted in as many
passes, each with a block of the terms. Of a block the driver holds the terms, of documents nothing.

What follows works on sparse postings (language, source, term, count), of which no text is part. A
pair of sources is the sum of f over all kept terms; f is symmetric, so one direction is computed.
Postings are dealt by language, block of terms and pair of blocks of sources; a task makes a small
dense matrix of such a block and gives partial sums by pair, with the number of terms that it has seen.
Kept terms that no task saw for a pair occur in neither source, and all have the same f. All arithmetic is
in whole numbers: products in decimals, f below 2^63 because p is at most 1,000,000,001.

Defined results: null text, language and source count as empty, '' being a language and a source
like others; a document without terms makes its group occur; a language with no kept term has pairs of
value 0 and no terms; rows that repeat a doc_id are documents of their own, equal ones too; null doc_ids
aren't looked at; ties go to the smaller item in UTF-8; a very long text is one row like others, of which a task
holds the terms; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEAST_DOCUMENTS, TOP = 10, 10
#: Counts that a task holds at a time: different terms in the first pass, cells (group by term) in the second.
MOST_HELD, MOST_CELLS = 400_000, 16_000_000
#: Terms that a task counts before it gives its counts, so that a cell of four bytes is wide enough.
MOST_COUNTED = 1 << 30
#: Bytes of terms, delimiters included, that automata are made of at a time: about 400 MB in a Python worker at worst.
MOST_BYTES = 8_000_000
#: Sources and terms of a block of the products, at about that number.
SOURCES, TERMS = 32, 2000
#: Bytes as terms see them: A-Z lower-cased, other ASCII between terms.
TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _texts(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple[str, ...], bytes]]:
    """What identifies the group of each row, and its text as terms and spaces."""
    for batch in batches:
        for rows, data, at in C.slices(batch):
            body = data.tobytes().translate(TABLE)
            names = [rows.column(c).to_pylist() for c in by]
            for i, key in enumerate(zip(*names, strict=True)):
                yield key, body[at[i] : at[i + 1]]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "term", "n"])
        held.clear()
        C.tidy()

    for (lang,), text in _texts(batches, "lang"):
        held.setdefault(lang, Counter()).update(set(text.split()))
        if sum(map(len, held.values())) > MOST_HELD:
            yield from flush()
    yield from flush()


#: The last block in this worker, and its automata: tasks that follow find them made.
_MADE: list = [None, {}]


def _automata(block: Broadcast) -> dict[str, tuple[ahocorasick.Automaton, pa.Array]]:
    if _MADE[0] is not block:
        _MADE[:] = [None, {}]
        made = {}
        for lang, terms in block.value.items():
            auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(terms):
                auto.add_word(f" {term.decode('latin-1')} ", i)
            auto.make_automaton()
            made[lang] = (auto, pa.array(terms, pa.binary()).cast(pa.string()))
        _MADE[:] = [block, made]
    return _MADE[1]


def _recount(block: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences of the block's terms by language and source. Bytes are read as one character each, so any text can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, second = _automata(block), itemgetter(1)
        held: dict[tuple[str, str], np.ndarray] = {}
        counted = cells = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                some = np.flatnonzero(counts)
                same = lambda x, some=some: pa.array([x] * len(some), pa.string())
                yield pa.RecordBatch.from_arrays([same(lang), same(source), automata[lang][1].take(pa.array(some)), pa.array(counts[some].astype(np.int64))], names=["lang", "source", "term", "n"])
            held.clear()
            C.tidy()

        for (lang, source), text in _texts(batches, "lang", "source"):
            if lang not in automata:
                continue
            auto, terms = automata[lang]
            found = np.fromiter(map(second, auto.iter(f" {text.decode('latin-1')} ")), np.int64)
            if len(found):
                if (lang, source) not in held:
                    held[lang, source] = np.zeros(len(terms), np.int32)
                    cells += len(terms)
                np.add.at(held[lang, source], found, np.int32(1))
                counted += len(found)
            if cells > MOST_CELLS or counted > MOST_COUNTED:
                yield from flush()
                counted = cells = 0
        yield from flush()

    return run


def read(docs: DataFrame) -> DataFrame:
    """lang, source and text of every row; null is empty."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def vocabulary(rows: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, documents: the terms that at least so many documents of a language hold."""
    found = rows.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("documents")).where(F.col("documents") >= least)


def postings(rows: DataFrame, kept: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """lang, source, term, n: how often kept terms occur, where they do."""
    spark = rows.sparkSession
    blocks = max(1, math.ceil(1.1 * (kept.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0) / most))
    out = []
    for b in range(blocks):
        terms: dict[str, list[bytes]] = {}
        for lang, term in kept.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).select("lang", "term").toLocalIterator():  # MOST_BYTES, by hash
            terms.setdefault(lang, []).append(term.encode())
        found = rows.mapInArrow(_recount(spark.sparkContext.broadcast(terms)), "lang string, source string, term string, n long")
        out.append(C.written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))))
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return made


def share(n: Column, whole: Column, terms: Column) -> Column:
    """p of a term that occurs n times among `whole` occurrences of `terms` kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    up = F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(n) + F.lit(2).cast("decimal(1,0)"))
    return (F.lit(1).cast("long") + F.call_function("div", up, wide(whole) + wide(2 * terms))).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _products(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of f by pair of sources over the terms of a block. Rows without a term give each source's p of terms that it lacks."""
    lang, _, i, j = (x.as_py() for x in key)
    base = table.filter(pc.is_null(table["term"]))
    sources = base["source"].to_pylist()
    place, block = {s: k for k, s in enumerate(sources)}, base["block"].to_numpy()
    zero = base["p"].to_numpy().astype(np.int64)
    full = table.filter(pc.is_valid(table["term"]))
    coded = full["term"].combine_chunks().dictionary_encode()
    n = len(coded.dictionary)
    p = np.repeat(zero[:, None], n, 1)
    p[[place[s] for s in full["source"].to_pylist()], coded.indices.to_numpy(zero_copy_only=False)] = full["p"].to_numpy()
    out: dict[str, list] = {"source": [], "item": [], "value": [], "p": [], "q": []}
    order = sorted(range(len(sources)), key=lambda k: (block[k], sources[k]))
    for at, g in enumerate(order):
        if block[g] != i:
            break
        others = np.array([h for h in order[at + 1 :] if block[h] == j], np.int64)
        if len(others):
            far = p[others] - p[g]
            out["value"] += (far * far // (p[others] + p[g])).sum(1).tolist()
            out["source"] += [sources[g]] * len(others)
            out["item"] += [sources[h] for h in others]
            out["p"] += [int(zero[g])] * len(others)
            out["q"] += zero[others].tolist()
    size = len(out["value"])
    kinds = {"source": pa.string(), "item": pa.string(), "value": pa.int64(), "p": pa.int64(), "q": pa.int64()}
    return pa.table({"lang": pa.array([lang] * size, pa.string()), **{k: pa.array(v, kinds[k]) for k, v in out.items()}, "seen": pa.array([n] * size, pa.int64())})


def pairs(made: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value for all pairs of sources, both ways. made: lang, source, term, p; groups: lang, source, zero (its p of a term that it lacks); langs: lang, terms, sources."""
    spread = langs.select("lang", F.greatest(F.lit(1), F.ceil(F.col("sources") / SOURCES)).alias("across"), F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).alias("deep"))
    block = F.pmod(F.xxhash64("source"), F.col("across"))
    every = F.sequence(F.lit(0).cast("long"), F.col("across") - 1)
    # a source's own block meets each block, itself once
    dealt = lambda rows: rows.withColumn("o", F.explode(every)).select("lang", "source", "term", "p", "block", "bucket", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    full = made.join(spread, "lang").select("lang", "source", "term", "p", block.alias("block"), F.pmod(F.xxhash64("term"), F.col("deep")).alias("bucket"), "across")
    bare = groups.join(spread, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("deep") - 1)).alias("bucket"), "across")
    kinds = "lang string, source string, item string, value long, p long, q long, seen long"
    sums = dealt(full.unionByName(bare)).groupBy("lang", "bucket", "i", "j").applyInArrow(_products, kinds)
    whole = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("p").alias("p"), F.max("q").alias("q"))
    whole = whole.join(langs.select("lang", "terms"), "lang").select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("seen")) * apart(F.col("p"), F.col("q"))).alias("value"))
    way = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    return whole.select("lang", F.explode(F.array(way("source", "item"), way("item", "source"))).alias("w"), "value").select("lang", "w.source", "w.item", "value")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources of a language, and the terms that a source has most beyond its language."""
    rows = read(docs)
    kept = C.written(vocabulary(rows, least))
    found = postings(rows, kept)
    there = C.written(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents")))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = there.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(size, "lang", "left").select("lang", "sources", F.coalesce("terms", F.lit(0)).alias("terms"))
    langs = C.written(langs.join(found.groupBy("lang").agg(F.sum("n").alias("whole")), "lang", "left").fillna(0, "whole"))
    groups = there.select("lang", "source").join(found.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").fillna(0, "own").join(langs, "lang")
    # a language without kept terms has no p; 1 stands for it
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("own"), F.greatest("terms", F.lit(1)))).otherwise(F.lit(1))
    groups = C.written(groups.select("lang", "source", "own", "terms", "whole", zero.cast("long").alias("zero")))
    own = found.join(groups.drop("zero"), ["lang", "source"]).select("lang", "source", "term", "whole", "terms", "n", share(F.col("n"), F.col("own"), F.col("terms")).alias("p"))
    # terms: the language's count of a term is summed before it meets the sources that have it
    all_of = found.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    beyond = own.join(all_of, ["lang", "term"]).withColumn("q", share(F.col("all"), F.col("whole"), F.col("terms"))).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = beyond.select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    both = pairs(own.select("lang", "source", "term", "p"), groups, langs).withColumn("rank", F.row_number().over(best))
    out = both.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def query(spark, sf_dir):
    return audit(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM t),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM t),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + CAST((1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p FROM f JOIN v USING (lang)),
a AS (SELECT lang, term, sum(n) AS n FROM p GROUP BY ALL),
q AS (SELECT lang, term, 1 + CAST((1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q FROM a JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM y
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM z) WHERE rank <= 10
"""
