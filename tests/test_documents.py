"""Layout, classification, sections, extraction, vision, insights, audit and the chain."""

import datetime
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.operators import audit, classify, extract, ingest, insights, layout, pipeline, sections, vision
from paperloom.settings import Settings
from paperloom.sources.providers import Batched, Replay, ReplayOcr
from paperloom.sources.store import Store
from paperloom.streaming import logs as stream

S = Settings(as_of=datetime.date(2026, 10, 10))
WORDS = [("b", 100, 50, "96"), ("a", 10, 52, "-1"), ("", 0, 0, "5"), ("c", 10, 100, "80")]


def tokens(spark, doc="d"):
    rows = [(doc, 1, 0, 1, 1, 2, 10, 150, 40, 20, "90", "last"), (doc, 1, 1, 1, 1, 1, 80, 100, 30, 20, "80", "Total"), (doc, 1, 2, 1, 1, 1, 120, 98, 30, 20, "-1", "due"), (doc, 1, 3, 1, 1, 1, 0, 0, 1, 1, "50", "  "), (doc, 2, 0, 1, 1, 1, 5, 5, 50, 10, "x", "second page")]
    return spark.createDataFrame(rows, schemas.TOKENS)


def test_layout(spark):
    b = layout.lines(tokens(spark))
    got = [(r.page_number, r.block_index, r.text, r.confidence, tuple(r.bbox)) for r in b.orderBy("page_number", "block_index").collect()]
    assert got == [(1, 0, "Total due", 80.0, (80, 98, 70, 22)), (1, 1, "last", 90.0, (10, 150, 40, 20)), (2, 0, "second page", None, (5, 5, 50, 10))]
    assert layout.document_texts(layout.page_texts(b)).first().full_text == "--- PAGE 1 ---\nTotal due\nlast\n\n--- PAGE 2 ---\nsecond page"
    m = layout.metrics(b).first()
    assert (m.block_count, m.page_count, m.average_confidence) == (3, 2, 85.0)


def test_tokens_are_shuffled_once(spark):
    """Also where all pages have one number, which Spark folds out of its keys."""
    made = layout.lines(tokens(spark).withColumn("page_number", F.lit(1)))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_boxes(spark):
    rows = spark.createDataFrame([(80, 100, 100, 30), (100, 150, 320, 40), (90, 200, 10, 20)], "x int, y int, width int, height int")
    assert tuple(rows.agg(layout.union_box().alias("b")).first().b) == (80, 100, 340, 120)
    box = F.struct(F.lit(5).alias("x"), F.lit(5).alias("y"), F.lit(40).alias("width"), F.lit(30).alias("height"))
    got = spark.range(1).select(layout.crop_box(box, F.lit(800), F.lit(1000)), layout.crop_box(box, F.lit(0), F.lit(0)), layout.shrunk(F.lit(4800), F.lit(1000))).first()
    assert tuple(got[0]) == (0, 0, 70, 60) and got[1] is None and tuple(got[2]) == (2400, 500)


def answers(spark, rows):
    return spark.createDataFrame([(d, s, k, json.dumps(r) if r is not None else None, e) for d, s, k, r, e in rows], schemas.RESPONSES)


def test_classification(spark):
    told = answers(spark, [("a", "classification", "", {"document_type": "Invoice", "confidence": 0.94, "evidence": "total"}, None), ("b", "classification", "", {"document_type": "invoice", "confidence": 0.62, "evidence": ["x", " "]}, None), ("c", "classification", "", {"document_type": "menu", "confidence": "high"}, None)])
    got = {r.document_id: r for r in classify.classify(told).collect()}
    assert (got["a"].document_type, got["a"].evidence, got["a"].below_threshold) == ("invoice", ["total"], False)
    assert (got["b"].document_type, got["b"].below_threshold) == ("unknown", True)
    assert got["b"].evidence == ["x", "Confidence (0.62) was below threshold (0.70); marked as unknown."]
    assert (got["c"].document_type, got["c"].confidence, got["c"].evidence) == ("unknown", 0.0, [])


def test_pages_shown(spark):
    rows = spark.createDataFrame([("a", i) for i in range(1, 7)] + [("b", i) for i in (1, 2, 3)], "document_id string, page_number int")
    assert sorted((r[0], r[1]) for r in classify.select_pages(rows).collect()) == [("a", 1), ("a", 2), ("a", 6), ("b", 1), ("b", 2), ("b", 3)]


def test_sections_and_fields(spark):
    blocks = layout.lines(tokens(spark))
    classes = spark.createDataFrame([("d", "invoice"), ("u", "unknown")], "document_id string, document_type string")
    one = {"sections": [{"section_name": " Line_Items ", "text": "two items here", "page_number": "1", "block_ids": [0, 1, 7]}, {"section_name": "random", "text": "text"}, {"section_name": "notes", "text": " "}, {"section_name": "tax_information", "text": "totals", "confidence": 7}]}
    found = sections.detect(answers(spark, [("d", "section_detection", "", one, None), ("u", "section_detection", "", one, None)]), classes, blocks).orderBy("section_ord").collect()
    assert [(r.document_id, r.section_name, r.confidence) for r in found] == [("d", "line_items", 0.9), ("d", "unknown", 0.9), ("d", "tax_information", 1.0)]
    assert found[0].block_ids == [0, 1] and tuple(found[0].bbox) == (10, 98, 140, 72) and found[1].bbox is None
    secs = spark.createDataFrame(found)
    told = [("d", "extraction", found[0].section_id, {"items": [{"description": "Cloud Server Hosting", "line_total": 1000.0, "confidence": 0.9}, {"quantity": 2}]}, None), ("d", "extraction", found[2].section_id, {"total": {"value": 1107.0, "confidence": 0.8, "source_text": "Total 1107"}, "subtotal": {"value": None}}, None)]
    got = extract.fields(secs, answers(spark, told)).orderBy("field_ord").collect()
    assert [r.field_name for r in got[:6]] == ["line_item_1_description", "line_item_1_quantity", "line_item_1_unit_price", "line_item_1_tax_rate", "line_item_1_line_total", "line_item_2_description"]
    by = {r.field_name: r for r in got}
    assert by["line_item_1_line_total"].field_value == "1000.0" and by["line_item_2_quantity"].field_value == "2" and by["subtotal"].field_value is None and by["discount"].field_value is None
    assert (by["total"].field_value, by["total"].confidence, by["total"].source_text, by["total"].value_kind) == ("1107.0", 0.8, "Total 1107", "number")
    failed = extract.counters(secs, answers(spark, [told[0], (*told[1][:3], None, "boom")]), extract.fields(secs, answers(spark, told[:1]))).first()
    assert (failed.sections_processed, failed.failed_sections, failed.total_fields) == (1, ["tax_information"], 10)


FIELD = {"document_id": "d", "document_type": "invoice", "field_ord": 1, "field_name": "total", "field_value": "10", "confidence": 0.95, "source": "model", "source_text": None, "section_name": "tax_information", "page_number": 1, "validation_status": "valid", "validation_message": None, "fallback_attempted": False, "ocr_value": None, "ocr_confidence": None}
KIND = "document_id string, document_type string, field_ord int, field_name string, field_value string, confidence double, source string, source_text string, section_name string, page_number int, validation_status string, validation_message string, fallback_attempted boolean, ocr_value string, ocr_confidence double"


def some(spark, *changes):
    return spark.createDataFrame([tuple((FIELD | {"field_ord": i} | c).values()) for i, c in enumerate(changes)], KIND)


def test_vision_candidates(spark):
    rows = some(spark, {"confidence": 0.96}, {"confidence": 0.45}, {"field_value": None, "validation_status": "needs_review"}, {"validation_status": "needs_review", "validation_message": "Math discrepancy: does not match calculated"}, {"confidence": 0.1, "fallback_attempted": True}, {"field_name": "agreement_1_date", "confidence": 0.1}, {"validation_status": "needs_review", "validation_message": "Email format is invalid."})
    got = {r.field_ord: r.candidate_reason for r in vision.candidates(rows).collect()}
    assert got == {1: "Low OCR confidence (0.45 < 0.70)", 2: "Missing value flagged during validation: Required field empty", 6: "OCR format/corruption issue: Email format is invalid."}


def test_vision_outcomes(spark):
    rows = some(spark, {"confidence": 0.55}, {"confidence": 0.92}, {}, {"field_value": None}, {"confidence": 0.3}, {})
    asked = rows.withColumn("candidate_reason", F.lit("why")).withColumn("crop", F.when(F.col("field_ord") != 5, F.struct(F.lit(1).alias("x"))))
    told = spark.createDataFrame([("d", 0, "10.00", 0.98, None, None, None), ("d", 1, "999", 0.95, None, None, None), ("d", 2, None, None, None, "smudge", None), ("d", 3, "7", None, None, None, None), ("d", 4, "12", 0.9, None, None, None), ("d", 5, "1", 0.9, None, None, None)], schemas.VISION)
    got = {r.field_ord: r for r in vision.evaluate(asked, told).collect()}
    assert [got[i].action_taken for i in range(6)] == ["agreed", "conflict", "unreadable", "recovered", "recovered", "skipped"]
    assert (got[0].source, got[0].confidence, got[1].validation_status) == ("ocr+vision", 0.98, "conflict")
    assert (got[3].field_value, got[3].confidence, got[4].field_value, got[4].ocr_value) == ("7", 0.85, "12", "10")
    assert got[2].validation_message == "Handwriting or character unreadable in visual crop (smudge)." and all(r.fallback_attempted for r in got.values())


def test_locate(spark):
    blocks = layout.lines(tokens(spark))
    secs = spark.createDataFrame([("d", 0, "s", "tax_information", 1, "t", 0.9, [1], Row(x=1, y=2, width=3, height=4))], schemas.SECTIONS)
    rows = some(spark, {"source_text": "total DUE"}, {"field_value": "zz", "source_text": "nowhere"}, {"field_value": "zz", "section_name": "other"})
    got = {r.field_ord: r.crop and tuple(r.crop) for r in vision.locate(rows, blocks, secs).collect()}
    assert got == {0: (80, 98, 70, 22), 1: (1, 2, 3, 4), 2: None}


def test_masking_and_summary(spark):
    rows = some(spark, {"field_name": "ssn", "field_value": "123-45"}, {"field_name": "bank_account_number", "field_value": " "}, {"field_name": "vendor_name", "field_value": "Acme"}, {"field_name": "id_doc_1_document_number", "field_value": "X9"}).withColumn("normalized_value", F.lit(None).cast("string"))
    none = spark.createDataFrame([], schemas.ISSUES)
    text = insights.context(rows, none).first().context
    assert "123-45" not in text and "X9" not in text and text.count("PROTECTED") == 2 and "Acme" in text
    docs = spark.createDataFrame([("d", "invoice"), ("u", "unknown"), ("e", "invoice")], "document_id string, document_type string")
    told = answers(spark, [("d", "summary", "", {"summary": " ok ", "key_points": ["a", " ", "b", "c", "d", "e", "f"], "review_items": "no list"}, None)])
    got = {r.document_id: r for r in insights.summaries(docs, rows, told).collect()}
    assert (got["d"].status, got["d"].summary, got["d"].key_points, got["d"].review_items) == ("completed", "ok", list("abcde"), ["no list"])
    assert (got["u"].status, got["e"].status, len(got["e"].review_items)) == ("skipped", "skipped", 1)


def issue(field, message, status="needs_review", code=None, i=1):
    return ("d", i, field, status, message, code, None, None)


@pytest.mark.parametrize(
    ("row", "action", "priority"),
    [
        (issue("invoice_date", "m", "conflict"), "Review conflicting values for 'invoice_date'", "high"), (issue("total", "x", code="ARITHMETIC_MISMATCH"), "Resolve calculation discrepancy on 'total'", "high"), (issue("due_date", "Due date is earlier than invoice date."), "Clarify invalid invoice due date with vendor", "high"),
        (issue("po", "x", code="REQUIRED_FIELD_MISSING"), "Obtain missing required information for 'po'", "high"), (issue("email", "Email format is invalid."), "Verify and correct invalid format for 'email'", "medium"), (issue("d", "Ambiguous or unrecognized date format: 'x'"), None, None),
    ],
)
def test_issue_actions(spark, row, action, priority):
    got = spark.createDataFrame([row], schemas.ISSUES).select(insights.issue_action(F.col("field_name"), F.col("status"), F.col("message"), F.col("code")).alias("a")).first().a
    assert (got and got.action, got and got.priority) == (action, priority)


def test_actions(spark):
    rows = some(spark, {"field_name": "total_amount", "field_value": "1450.0"}, {"field_name": "due_date", "field_value": "2026-10-15"}, {"field_name": "vendor_name", "field_value": "Acme Corp"}).withColumn("normalized_value", F.col("field_value"))
    none, told = spark.createDataFrame([issue("po", "missing")], schemas.ISSUES), answers(spark, [("d", "action_extraction", "", {"actions": [{"action": "Call vendor", "priority": "urgent", "due_date": "n/a"}, {"action": "call VENDOR!"}, {"action": " "}]}, None)])
    new = insights.actions(rows, none, told, s=S).orderBy("action_ord").collect()
    assert [(r.action, r.priority, r.source) for r in new] == [("Pay invoice totaling USD 1,450.00 to Acme Corp", "high", "rule_based"), ("Obtain missing required information for 'po'", "high", "rule_based"), ("Call vendor", "medium", "ai")]
    assert new[0].reason == "Payment due date (2026-10-15) is approaching within 7 days." and str(new[0].due_date) == "2026-10-15"
    old = spark.createDataFrame([("d", 1, "id1", new[0].action, "high", None, "completed", "rule_based", None, None, None), ("d", 2, "id2", "Own", "low", None, "pending", "user", None, None, None), ("d", 3, "id3", "gone", "low", None, "dismissed", "ai", None, None, None)], schemas.ACTIONS)
    again = insights.actions(rows, none, told, old, S).collect()
    assert {(r.action_id, r.status) for r in again if r.action_id.startswith("id")} == {("id1", "completed"), ("id2", "pending")} and len(again) == 4
    c = insights.counters(insights.actions(rows, none, told, old, S)).first()
    assert (c.total_actions, c.high_priority, c.ai_count, c.completed) == (4, 2, 1, 1)
    with pytest.raises(ValueError):
        insights.set_status(old, "id1", "unknown_status")


def test_uploads(spark):
    rows = spark.createDataFrame([("1", "a b.PDF", "application/pdf", 5), ("2", "x.exe", "image/png", 5), ("3", "x.png", "text/plain", 5), ("4", "x.png", "image/png", 0), ("5", "x.png", "image/png", 10 * 1024 * 1024 + 1), ("6", "dir/ü.jpg", "image/jpg", 10 * 1024 * 1024)], "document_id string, filename string, mime_type string, file_size long")
    got = {r.document_id: (r.reject_reason, r.storage_path, r.mime_type) for r in ingest.check_uploads(rows).collect()}
    assert got["1"] == (None, "documents/1/a_b.PDF", "application/pdf") and got["6"] == (None, "documents/6/_.jpg", "image/jpeg")
    assert [got[k][0] for k in "2345"] == ["unsupported extension", "unsupported type", "empty file", "file too large"]


def log_rows(spark):
    t = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    return spark.createDataFrame([("a", "ocr", "started", None, None, t(1)), ("a", "ocr", "completed", None, None, t(3)), ("b", "ocr", "started", None, None, t(2)), ("b", "ocr", "failed", None, None, t(9)), ("a", "validation", "started", None, None, t(4))], schemas.LOGS)


def test_audit_batch_and_stream_agree(spark, tmp_path):
    path = str(tmp_path / "logs")
    log_rows(spark).repartition(3).write.parquet(path)
    key = lambda rows: sorted((r.document_id, r.stage, r.status, str(r.created_at), r.log_rows) for r in rows)
    want = key(audit.latest_status(log_rows(spark)).collect())
    seen = {}
    stream.run_available(stream.latest_status(stream.read_logs(spark, path, files_per_batch=1)), str(tmp_path / "c"), lambda df, n: seen.update({r.document_id: r for r in df.collect()})).awaitTermination()
    assert key(seen.values()) == want and [w[1:3] for w in want] == [("validation", "started"), ("ocr", "failed")]
    d = {(r.document_id, r.stage): r.seconds for r in audit.stage_durations(log_rows(spark)).collect()}
    assert d == {("a", "ocr"): 120, ("b", "ocr"): 420, ("a", "validation"): None}
    docs = spark.createDataFrame([("a", "invoice"), ("b", "unknown")], "document_id string, document_type string")
    steps = {(r.document_id, r.stage): r.state for r in audit.stepper(docs, log_rows(spark)).collect()}
    assert (steps["a", "ocr"], steps["a", "validation"], steps["a", "summary"], steps["b", "ocr"], steps["b", "summary"]) == ("completed", "active", "pending", "failed", "skipped")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    doc = lambda i, st="uploaded": (i, f"{i}.pdf", "invoice", st, None, 1, None, None, None, None)
    store.append("documents", spark.createDataFrame([doc("a"), doc("b"), doc("c")], schemas.DOCUMENTS))
    rows = some(spark, {"source": "odd"}, {"document_id": "b", "confidence": 0.123456})
    store.save_fields(rows)
    store.save_fields(rows)
    assert {(r.document_id, r.source, r.confidence) for r in store.read("fields").collect()} == {("d", "model", 0.95), ("b", "model", 0.1235)} and store.read("fields").count() == 2
    store.update_documents(spark.createDataFrame([("b", "completed")], "document_id string, status string"))
    assert {r.document_id: r.status for r in store.read("documents").collect()} == {"a": "uploaded", "b": "completed", "c": "uploaded"}
    store.delete_documents(spark.createDataFrame([("b",)], "document_id string"))
    assert sorted(r.document_id for r in store.read("documents").collect()) == ["a", "c"] and store.get("fields", "b").count() == 0 and store.get("documents", "a").count() == 1
    store.write_artifact("summary", spark.createDataFrame([("a", "fine")], "document_id string, summary string"))
    assert store.read_artifact("summary", "document_id string, summary string").first().a.summary == "fine"


def test_chain(spark):
    pages = spark.createDataFrame([("d", 1, "p", 800, 1000, "png", 1), ("d", 2, "p", 800, 1000, "png", 1), ("u", 1, "p", 1, 1, "png", 1)], schemas.PAGES)
    ocr = ReplayOcr(tokens(spark).unionByName(tokens(spark, "u")))
    first = answers(spark, [("d", "classification", "", {"document_type": "invoice", "confidence": 0.9}, None), ("u", "classification", "", {"document_type": "menu"}, None), ("d", "section_detection", "", {"sections": [{"section_name": "tax_information", "text": "Total due", "block_ids": [0]}]}, None)])
    sec = pipeline.process(pages, ocr, Replay(first), s=S).sections.first().section_id
    every = first.unionByName(answers(spark, [("d", "extraction", sec, {"total": {"value": "1107.0", "confidence": 0.3, "source_text": "Total due"}}, None), ("d", "vision_fallback", "5", {"value": "1,107.00", "confidence": 0.96}, None)]))
    out = pipeline.process(pages, ocr, Replay(every), s=S)
    got = {r.field_name: r for r in out.fields.collect()}
    assert (got["total"].normalized_value, got["total"].source, got["total"].action_taken) == ("1107", "ocr+vision", "agreed")
    assert out.status.first().status == "needs_review" and {r.document_id for r in out.status.collect()} == {"d"}
    assert "Pay invoice totaling USD 1,107.00" in {r.action for r in out.actions.collect()}
    asked = spark.createDataFrame([("x", "hello")], "document_id string, prompt string")
    assert json.loads(Batched(lambda prompts: ['{"confidence": 0.9}' for _ in prompts]).answer("classification", asked).first().response_json)["confidence"] == 0.9
