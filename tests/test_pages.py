"""Files to pages, the path from an upload to its pages, and engines that read pages in batches."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.operators import layout
from paperloom.sources import pages, providers
from paperloom.sources.providers import BatchedOcr, ReplayOcr, engine
from paperloom.sources.store import Store


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\x00\x00\x00"


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03a\xff\xc2\x00\x11\x08" + struct.pack(">HH", h, w) + b"rest"


def pdf(*boxes, above=None):
    tree = b"<< /Type /Pages " + (b"/MediaBox [0 0 %d %d]" % above if above else b"") + b">> endobj\n"
    return b"%PDF-1.4\n" + tree + b"".join(b"1 0 obj << /MediaBox [0 0 %d %d] /Type /Page >> endobj\n" % b if b else b"<< /Type /Page >> endobj\n" for b in boxes)


FILES = {
    "a/one.png": png(4800, 1000), "a/two.JPG": jpeg(30, 20), "three.pdf": pdf((72, 144), None, (7200, 72), above=(36, 36)), "no.png": b"nothing", "none.pdf": pdf(), "sizeless.pdf": pdf((72, 72), None),
    "empty.pdf": b"", "large.png": png(1, 1) + bytes(2000), "notes.txt": b"x", "flat.png": png(0, 5),
}
WANT = {
    ("one.png", 1, 2400, 500, None), ("two.JPG", 1, 30, 20, None), ("three.pdf", 1, 200, 400, None), ("three.pdf", 2, 100, 100, None), ("three.pdf", 3, 2400, 24, None), ("no.png", None, None, None, "no image"),
    ("none.pdf", None, None, None, "no readable pages"), ("sizeless.pdf", 1, 200, 200, None), ("sizeless.pdf", None, None, None, "page without a size"), ("flat.png", None, None, None, "page 1 has no area"),
}
S = pages.Settings(max_upload_bytes=1500)


@pytest.fixture
def folder(tmp_path):
    for name, content in FILES.items():
        at = tmp_path / "in" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
    return str(tmp_path / "in")


def shown(rendered, files):
    rows = rendered.join(files.select("document_id", "filename"), "document_id").select("filename", "page_number", "width", "height", "error").collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return set(map(tuple, rows))


def test_batch_and_stream(spark, folder, tmp_path):
    files = pages.uploads(spark, folder, s=S)
    assert {(r.filename, r.reject_reason) for r in files.where("reject_reason IS NOT NULL").collect()} == {("notes.txt", "unsupported extension"), ("large.png", "file too large")}
    sent = spark.createDataFrame([(n.split("/")[-1],) for n in FILES] + [("lost.pdf",)], "filename string")
    assert {tuple(r) for r in pages.unseen(sent, files).collect()} == {("empty.pdf", "empty file"), ("lost.pdf", "empty file")}
    assert shown(pages.render(pages.accepted(files), s=S), files) == WANT
    made = pages.render(pages.accepted(pages.uploads(spark, folder, stream=True, s=S)), s=S)
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    made.writeStream.option("checkpointLocation", at).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    assert shown(spark.read.parquet(out), files) == WANT
    (tmp_path / "in" / "late.png").write_bytes(png(3, 4))
    made.writeStream.option("checkpointLocation", at).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    assert shown(spark.read.parquet(out), pages.uploads(spark, folder, s=S)) == WANT | {("late.png", 1, 3, 4, None)}


def test_rejected_files_are_not_opened(spark, folder):
    plan = pages.accepted(pages.uploads(spark, folder, s=S)).select("content")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,0)" in plan


def test_many_large_pages_and_late_errors(spark):
    class Drawn(pages.PageProvider):
        """Five pages of a MB each; a file that says so fails after the third."""

        def pages(self, renderer, content):
            for i in range(5):
                if i == 3 and b"bad" in content:
                    raise OSError("torn page")
                yield 10, 20, bytes([i]) * 1_000_000

    rows = [(str(i), "x.pdf", "application/pdf", b"bad" if i == 7 else b"good") for i in range(12)] + [("null", "x.pdf", None, None)]
    files = spark.createDataFrame(rows, "document_id string, filename string, mime_type string, content binary").withColumn("page_number", F.lit("clash"))
    made = pages.render(files, Drawn())
    got = pages.whole(made)
    assert got.groupBy("document_id").count().where("count = 5").count() == 11 and got.count() == 55
    first = got.where("document_id = '3' AND page_number = 2").first()
    assert (first.image_path, first.file_size_bytes, bytes(first.image[:2])) == ("3/page_002.png", 1_000_000, b"\x01\x01")
    ends = {r.document_id: (r.page_count, r.error) for r in pages.outcomes(made).collect()}
    assert ends["7"] == (0, "torn page") and ends["null"] == (0, "empty file") and ends["0"] == (5, None) and len(ends) == 13
    assert pages.render(files.limit(0)).count() == 0


def test_from_upload_to_tokens(spark, folder, tmp_path):
    store, files = Store(spark, str(tmp_path / "store"), 4), pages.uploads(spark, folder, s=S)
    assert pages.receive(store, files).count() == 2
    assert {r.status for r in store.read("documents").collect()} == {"uploaded"} and store.read("documents").count() == 7
    for _ in range(2):  # a second run gives the same documents and pages
        got = pages.preprocess(store, files, s=S)
        assert {(r.filename, r.status) for r in store.read("documents").collect()} == {(n, "preprocessed") for n in ("one.png", "two.JPG", "three.pdf")} | {(n, "failed") for n in ("no.png", "none.pdf", "sizeless.pdf", "flat.png")}
        assert got.count() == 5
    logs = store.read("logs").join(store.read("documents").select("document_id", "filename"), "document_id").where("stage = 'preprocessing'")
    assert logs.count() == 2 * 14
    done = logs.where("filename = 'three.pdf' AND status = 'completed'").first()
    assert json.loads(done.metadata) == {"page_count": 3, "mime_type": "application/pdf", "is_pdf": True}
    assert logs.where("filename = 'sizeless.pdf' AND status = 'failed'").first().message == "Preprocessing failed: page without a size"
    told = BatchedOcr(lambda asked: [[{"text": f"p{n}", "left": 1, "top": 2, "width": 3, "height": 4, "block_num": 1, "par_num": 1, "line_num": 1, "conf": "90"}] for _, n, _ in asked])
    assert sorted(r.text for r in layout.lines(told.tokens(got)).collect()) == ["p1", "p1", "p1", "p2", "p3"]


def test_a_page_that_cannot_be_read(spark):
    seen = spark.sparkContext.accumulator(0)

    def call(asked):
        seen.add(1)
        if any(n == 500 for _, n, _ in asked):
            raise OSError("smudged")
        return [[{"text": "a", "top": 1}, {"text": "b"}] if n % 2 else [] for _, n, _ in asked]

    rows = spark.range(1, 1001, numPartitions=1).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("page_number"), F.lit(None).cast("binary").alias("image"))
    own = BatchedOcr(call)
    assert [tuple(r) for r in own.errors(rows).collect()] == [("d", 500, "smudged")] and seen.value < 30
    got = own.tokens(rows)
    assert got.count() == 1000 and got.schema == spark.createDataFrame([], schemas.TOKENS).schema
    assert [(r.token_ord, r.text, r.top, r.left) for r in got.where("page_number = 7").orderBy("token_ord").collect()] == [(0, "a", 1, None), (1, "b", None, None)]
    assert own.read(rows.limit(0)).count() == 0


def test_engines_by_name(spark):
    class Off(ReplayOcr):
        def available(self):
            return False, "not installed"

    none = spark.createDataFrame([], schemas.TOKENS)
    made = {"replay": lambda: ReplayOcr(none), "off": lambda: Off(none)}
    assert engine(made, "replay").name == "replay"
    with pytest.raises(ValueError, match="unknown engine 'x': one of off, replay"):
        engine(made, "x")
    with pytest.raises(RuntimeError, match="not available: not installed"):
        engine(made, "off")


def test_a_task_holds_a_portion_of_pages_and_of_tokens(spark, monkeypatch):
    """However many pages a batch has, an engine gets few at once; a page of very many tokens is sent in parts."""
    monkeypatch.setattr(providers, "PAGE_BYTES", 1000)
    pages = [(str(i), 1, b"x" * (10 if i % 50 else 3000)) for i in range(400)]
    parts = list(providers.portions(pages))
    assert [p for part in parts for p in part] == pages
    assert max(len(p) for p in parts) <= 100 and all(sum(len(x[2]) for x in p) <= 1000 or len(p) <= 8 for p in parts)
    call = lambda asked: [[{"text": "w"}] * 25_000 if len(asked) <= 100 else 1 / 0 for _ in asked]
    rows = spark.createDataFrame([("d", k, b"y" * 100) for k in range(3)], "document_id string, page_number int, image binary")
    told = BatchedOcr(call).read(rows)
    got = told.groupBy("page_number").agg(F.count("text").alias("n"), F.max("token_ord").alias("last"), F.count("error").alias("bad")).collect()
    assert sorted(map(tuple, got)) == [(k, 25_000, 24_999, 0) for k in range(3)]
