"""Postings against comparison of all pairs, the field index against a scan, kept totals against recomputation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.operators import ingest, postings, vision
from paperloom.sources import overview
from paperloom.sources.overview import KeptOverview
from paperloom.sources.search import FieldIndex

SOUGHT, TEXTS = "p int, q string, sought string", "p int, q string, text string"


def pairs(sought, texts):
    return sorted({(p, q, s, t) for p, q, s in sought for a, b, t in texts if s and t and None not in (p, q) and (p, q) == (a, b) and s in t})


def test_holding(spark):
    """Strings of all lengths in texts, with ties, repeats, nulls, line ends, code points beyond the basic plane, a very long text, and clashing columns."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab\n😀é") for _ in range(n))
    scope = lambda: (rng.choice([1, 2, None]), rng.choice(["x", "y", None]))
    sought = [(*scope(), word(rng.randrange(7))) for _ in range(300)] + [(1, "x", None), (1, "x", ""), (1, "x", "?"), (1, "x", "😀é"), (1, "x", "needle in"), (1, "x", "(?s)")]
    texts = [(*scope(), word(rng.randrange(12))) for _ in range(200)] + [(1, "x", None), (1, "x", "ab" * 100000 + "a needle in hay" + "b" * 1000), (1, "x", "😀"), (1, "x", "is (?s) a pattern")]
    clash = lambda rows, kind: spark.createDataFrame(rows, kind).withColumns({"gram": F.lit(1), "_id": F.lit(2), "bucket": F.lit(3)})
    got = postings.holding(clash(sought * 2, SOUGHT), clash(texts * 2, TEXTS), ["p", "q"])
    assert sorted(map(tuple, got.collect())) == pairs(sought, texts)
    one = lambda rows: [(0, "", r[2]) for r in rows]
    bare = postings.holding(spark.createDataFrame(sought, SOUGHT), spark.createDataFrame(texts, TEXTS), [])
    assert sorted((0, "", *r) for r in bare.collect()) == pairs(one(sought), one(texts))
    empty = spark.createDataFrame([], TEXTS)
    assert postings.holding(spark.createDataFrame(sought, SOUGHT), empty, ["p", "q"]).count() == 0
    assert postings.holding(empty.withColumnRenamed("text", "sought"), spark.createDataFrame(texts, TEXTS), ["p"]).count() == 0


def test_only_runs_that_are_sought_are_posted(spark):
    texts = spark.createDataFrame([(1, "abcd"), (2, "xy")], "_id long, text string")
    of = lambda *n: {r.gram for r in postings.postings(texts.withColumn("_lengths", F.array(*map(F.lit, n))), []).collect()}
    assert of(3) == {"abc", "bcd"} and of(1, 3) == {"abc", "bcd", *"abcdxy"}
    assert {r.gram for r in postings.postings(texts, []).collect()} == {"abc", "bcd", *"abcdxy", "ab", "bc", "cd", "xy"}
    blocks = spark.createDataFrame([("d", 1, 0, "Total due", 90.0, (0, 0, 5, 1))], schemas.BLOCKS)
    fields = spark.createDataFrame([("d", 1, 1, "s", "total due now", "due")], "document_id string, page_number int, field_ord int, section_name string, source_text string, field_value string")
    located = vision.locate(fields, blocks, spark.createDataFrame([], schemas.SECTIONS), 0)
    assert [r.crop.width for r in located.collect()] == [5]


def test_blocks_are_dealt_once(spark):
    """What looks for boxes shuffles by page alone, and the texts of blocks once, by whatever they are read; constant page numbers change nothing."""
    blocks = spark.createDataFrame([("d", i, "Total due", 90.0, (0, i, 5, 1)) for i in range(40)], "document_id string, block_index int, text string, confidence double, bbox struct<x int, y int, width int, height int>").withColumn("page_number", F.lit(1))
    fields = spark.createDataFrame([("d", k, "s", "total due now", "due") for k in range(3)], "document_id string, field_ord int, section_name string, source_text string, field_value string").withColumn("page_number", F.lit(1))
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        located = vision.locate(fields, blocks, spark.createDataFrame([], schemas.SECTIONS), 0)
        plan = located._jdf.queryExecution().executedPlan().toString().split("\n")
        assert [r.crop.height for r in located.collect()] == [40] * 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    made = [(line, below) for line, below in zip(plan, plan[1:]) if re.search(r"(?<!Reused)Exchange hashpartitioning", line) and "ReusedExchange" not in line]
    keys = {c for line, _ in made for c in re.findall(r"(\w+)#\d+", line.split("hashpartitioning")[1])}
    assert "_page" in keys and keys <= {"_page", "document_id", "field_ord", "page_number", "section_name", "section_ord", "block_index"}  # the last four: sections
    assert sum("_b#" in below for _, below in made) == 1


def test_runs_are_whole_code_points(spark):
    rows = spark.createDataFrame([("a😀b\n😀c",)], "t string").select(postings.grams(F.col("t")), postings.key_grams(F.col("t"))).first()
    assert set(rows[0]) == {"a😀b\n😀c"[i : i + n] for n in (1, 2, 3) for i in range(7 - n)} and set(rows[1]) == {r for r in rows[0] if len(r) == 3}


def test_many_strings_and_few_are_found_alike(spark):
    """Scopes that seek more runs than FEW and fewer, repeated rows with what goes along, and a scope that is null."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgé😀") for _ in range(n))
    sought = [(s, word(rng.randrange(6)), i) for s, n in ((1, 5), (2, 300), (None, 9)) for i in range(n)]
    texts = [(s, word(rng.randrange(30)), i) for s in (1, 2, None) for i in range(60)]
    few, more = (len({w[i : i + 3] for s, w, _ in sought if s == k for i in range(max(1, len(w) - 2)) if w}) for k in (1, 2))
    assert few <= postings.FEW < more
    a, b = spark.createDataFrame(sought + sought[:50], "p int, sought string, a int"), spark.createDataFrame(texts + texts[:70], "p int, text string, b int")
    got = postings.holding(a, b, ["p"], (["a"], ["b"])).select("p", "sought", "text", "a", "b").collect()
    want = [(p, s, t, i, j) for p, s, i in sought + sought[:50] for q, t, j in texts + texts[:70] if p is not None and p == q and s and s in t]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_boxes_on_a_large_page(spark):
    """10,000 blocks and 400 fields on one page: the boxes of comparison, from about as many candidates as hits."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    lines = [(1 + (i > 9999), i, " ".join(rng.choices(words, k=5)), (i % 40, i, 5, 1)) for i in range(10050)] + [(1, 20000, "", (0, 0, 9, 9)), (1, 20001, None, (0, 0, 9, 9)), (1, 20002, "z", (7, 7, 1, 1))]
    blocks = spark.createDataFrame([("d", p, i, t, 90.0, b) for p, i, t, b in lines], schemas.BLOCKS)
    pieces = [(1 + k % 2, k, lines[rng.randrange(10000)][2][3:20] if k % 3 else rng.choice([None, "", "lost and gone", "all z of it"]), rng.choice(words)[: k % 6] if k % 5 else None) for k in range(400)]
    fields = spark.createDataFrame([("d", p, k, "s", a, b) for p, k, a, b in pieces], "document_id string, page_number int, field_ord int, section_name string, source_text string, field_value string")
    sections = spark.createDataFrame([("d", 1, "s", "s", 1, "", 1.0, [20002], (1, 2, 3, 4))], schemas.SECTIONS)
    shown = lambda many: sorted(map(str, vision.locate(fields, blocks, sections, many).select("field_ord", "crop").collect()))
    want = shown(10**9)
    assert shown(0) == want == shown(1000) and len(want) == 400
    texts = postings.named(blocks.where("page_number = 1"), [])
    sought = fields.where("page_number = 1 AND length(source_text) > 9").selectExpr("source_text AS sought").distinct()
    found = postings.candidates(sought, postings.postings(texts, []), []).count()
    assert found < 60 * sought.count()  # comparison looks at 10,000 each


KINDS = "k int, field_name string, field_value string, normalized_value string, validation_status string"


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abAB é") for _ in range(n)) if n else rng.choice([None, ""])
    rows = [(k, word(rng.randrange(5)), word(rng.randrange(9)), word(rng.randrange(9)), rng.choice(["valid", "needs_review", "conflict", None])) for k in range(150)]
    fields = spark.createDataFrame([*rows, rows[5], (900, None, None, None, "valid")], KINDS)
    index = FieldIndex(spark, f"{tmp_path}/index", 4)
    texts = sorted({word(n) for n in (1, 1, 2, 2, 3, 3, 4, 5) for _ in range(3)} | {"nowhere", "É"})
    queries = spark.createDataFrame([*((t, t) for t in texts), (texts[0], texts[0]), (None, "a"), ("empty", ""), ("null", None)], "query_id string, text string")
    assert index.search(fields, queries).count() == 0  # nothing is indexed
    index.add(fields.where("k % 2 = 0"))
    postings.postings(postings.named(fields.selectExpr("lower(field_value) AS text"), []), []).withColumn("bucket", postings.bucket(F.col("gram"), 4)).write.partitionBy("bucket").mode("append").parquet(f"{tmp_path}/index/postings")  # a run that died before it wrote strings
    index.add(fields)
    size = index.strings().count()
    index.add(fields)
    assert index.strings().count() == size == index.strings().distinct().count()
    for status in ("all", "valid", "review"):
        got = sorted(str((r.query_id, r.k)) for r in index.search(fields, queries, status).collect())
        want = [str((t, r.k)) for t in texts for r in ingest.search(fields, t, status).collect()] + [str((None, r.k)) for r in ingest.search(fields, "a", status).collect()]
        assert got == sorted(want)
    left = fields.where("k % 3 = 0")  # others were deleted since
    assert {r.k % 3 for r in index.search(left, queries).collect()} == {0}
    assert index.search(left, queries).columns == ["query_id", *fields.columns]


def test_index_prunes(spark, tmp_path):
    index = FieldIndex(spark, f"{tmp_path}/index", 8)
    index.add(spark.createDataFrame([(1, "vendor name", "Acme", "acme", "valid")], KINDS))
    plan = index.find(spark.createDataFrame([("acm",)], "sought string"))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def shown(df):
    return sorted(map(str, df.collect()))


def test_totals_equal_recomputation(spark, tmp_path):
    """Random replacements and removals; every batch is cut off at one of its two writes and repeated."""
    rng = random.Random(11)
    names = [c.split()[0] for c in overview.ROWS.split(", ")]
    kept, state = KeptOverview(spark, f"{tmp_path}/kept"), {}
    assert kept.totals().count() == 0 and kept.rows().count() == 0
    for batch in range(1, 5):
        rows = {f"d{rng.randrange(30)}": (rng.choice(["completed", "needs review", None]), rng.choice([None, 1, 4]), rng.choice([None, 0.1, 88.25]), rng.randrange(3), 1, None) for _ in range(12)}
        gone = {f"d{rng.randrange(40)}" for _ in range(6)} - rows.keys()
        new = spark.createDataFrame([(k, *v) for k, v in rows.items()] + [(None, "completed", 1, 1.0, 1, 1, 1)], overview.ROWS.replace("decimal(18,6)", "double"))
        left = spark.createDataFrame([(g,) for g in [*gone, None, *rows]], "document_id string")  # what is both there and gone is there
        kept.apply(batch, new, left)
        lost = "deltas" if batch % 2 else "rows"
        spark.createDataFrame([], "x int").write.mode("overwrite").parquet(f"{tmp_path}/kept/{lost}/batch={batch}")
        kept.apply(batch, new, left)
        state = {k: v for k, v in (state | rows).items() if k not in gone}
        want = spark.createDataFrame([(k, *v) for k, v in state.items()], overview.ROWS.replace("decimal(18,6)", "double"))
        assert shown(kept.totals()) == shown(overview.totals(want))
        assert shown(kept.rows().select("document_id", "status_text", "valid")) == shown(want.select("document_id", "status_text", "valid"))
    assert kept.rows().columns == names
    with pytest.raises(ValueError, match="after batch"):
        kept.apply(2, new)


def test_a_document_twice_in_a_batch(spark, tmp_path):
    kept = KeptOverview(spark, f"{tmp_path}/kept")
    kept.apply(1, spark.createDataFrame([("a", "completed", 1, None, 1, 0, 0), ("a", "failed", 2, None, 1, 0, 0)], overview.ROWS).withColumn("batch", F.lit("clash")).withColumn("gone", F.lit("clash")))
    assert [(r.status_text, r.documents, r.pages) for r in kept.totals().collect()] == [("failed", 1, 2)]
    kept.apply(2, spark.createDataFrame([], overview.ROWS), spark.createDataFrame([("a",)], "document_id string"))
    assert kept.totals().count() == 0 == kept.rows().count()
