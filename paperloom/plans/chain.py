"""Queries over the chain from uploads to actions, each with the same in SQL.

An order stands for a document. Answers of models are made of its columns, so that every branch of
an operator has rows: values of other types, blanks, errors, names outside of the whitelist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, classify, extract, ingest, insights, layout, sections, validate, vision
from ..schemas import SECTION_FIELDS
from .catalog import _BLOCKS, S, lines, long_fields, query, read, tokens

_ID = "CAST(o_orderkey AS VARCHAR) AS document_id"


def key() -> Column:
    return F.col("o_orderkey")


def null() -> Column:
    return F.lit(None).cast("string")


def orders(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read(spark, d, "orders", "o_orderkey", *columns).withColumn("document_id", key().cast("string"))


def pick(n: Column, *values) -> Column:
    """One of the values, by number from 0 on."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (n + 1).cast("int"))


def answers(rows: DataFrame, stage: str, item: Column, body: Column, error: Column | None = None) -> DataFrame:
    return rows.select("document_id", F.lit(stage).alias("stage"), item.alias("item_key"), body.alias("response_json"), (null() if error is None else error).alias("error"))


# Uploads and pages


@query(
    """SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'text/plain' WHEN page_id % 2 = 0 THEN 'image/jpeg' ELSE 'application/pdf' END AS mime_type, CASE WHEN page_id % 9 <> 0 AND page_id % 10 <> 0 THEN 'documents/' || page_id || '/scan_' || page_id || '_.pdf' END AS storage_path,
CASE WHEN page_id % 9 = 0 THEN 'unsupported type' WHEN page_id % 10 = 0 THEN 'empty file' END AS reject_reason FROM pages"""
)
def upload_paths(spark, d):
    k = F.col("page_id")
    mime = F.when(k % 9 == 0, "text/plain").when(k % 2 == 0, "IMAGE/JPG").otherwise("application/pdf")
    rows = read(spark, d, "pages", "page_id").select("page_id", k.cast("string").alias("document_id"), F.concat(F.lit("in/scan "), k.cast("string"), F.lit("é.pdf")).alias("filename"), mime.alias("mime_type"), F.when(k % 10 == 0, 0).otherwise(700).alias("file_size"))
    return ingest.check_uploads(rows, S).select("page_id", "mime_type", "storage_path", "reject_reason")


@query("SELECT page_id, CASE WHEN page_id % 4 IN (0, 3) THEN 'pdf' ELSE 'image' END AS renderer, CASE CAST(page_id % 4 AS INTEGER) WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' ELSE 'pdf' END AS badge FROM pages")
def file_routing(spark, d):
    n = F.col("page_id") % 4
    rows = read(spark, d, "pages", "page_id").select("page_id", pick(n, "A.PDF", "b.Png", "c.jpeg", "no extension").alias("filename"), pick(n, "image/png", "x", "image/jpeg", "application/pdf").alias("mime_type"))
    return ingest.route(rows).select("page_id", "renderer", "badge")


@query("SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS page_number FROM conversations WHERE turn % 5 <> 4")
def page_scan(spark, d):
    """Pages by their file names; others in the folder are no pages."""
    rows = read(spark, d, "conversations", "conv_id", "turn")
    name = F.when(F.col("turn") % 5 == 4, "thumbnail.png").otherwise(ingest.page_name(F.col("turn")))
    own = F.col("conv_id").cast("string")
    return ingest.scan_pages(rows.select(own.alias("document_id"), F.concat_ws("/", F.lit("pages"), own, name).alias("image_path"))).select("document_id", "page_number")


@query(
    """SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) & 1 = 0 THEN 'ocr needs pages' END AS ocr, CASE WHEN CAST(event_id AS BIGINT) & 2 = 0 THEN 'classification needs ocr' END AS classification,
CASE WHEN CAST(event_id AS BIGINT) & 2 = 0 THEN 'section_detection needs ocr' WHEN CAST(event_id AS BIGINT) & 4 = 0 THEN 'section_detection needs classification' END AS section_detection,
CASE WHEN CAST(event_id AS BIGINT) & 2 = 0 THEN 'extraction needs ocr' WHEN CAST(event_id AS BIGINT) & 4 = 0 THEN 'extraction needs classification' WHEN CAST(event_id AS BIGINT) & 8 = 0 THEN 'extraction needs sections' END AS extraction,
CASE WHEN CAST(event_id AS BIGINT) & 8 = 0 THEN 'validation needs sections' END AS validation FROM events"""
)
def stage_preconditions(spark, d):
    has = [F.col("event_id").cast("long").bitwiseAND(1 << i) != 0 for i in range(4)]
    stages = ["ocr", "classification", "section_detection", "extraction", "validation"]
    return read(spark, d, "events", "event_id").select("event_id", *(ingest.precondition(x, *has).alias(x) for x in stages))


_SIZES = "SELECT p_partkey, CAST(p_size * 100 AS DOUBLE) AS w, CAST((p_partkey % 60) * 100 + 100 AS DOUBLE) AS h FROM part"


@query(f"SELECT p_partkey, CAST(floor(w * s) AS INTEGER) AS width, CAST(floor(h * s) AS INTEGER) AS height FROM (SELECT *, least(1.0::DOUBLE, 2400.0::DOUBLE / greatest(w, h)) AS s FROM ({_SIZES}))")
def image_sizes(spark, d):
    rows = read(spark, d, "part", "p_partkey", "p_size").select("p_partkey", (F.col("p_size") * 100).alias("w"), (F.col("p_partkey") % 60 * 100 + 100).alias("h"))
    return rows.select("p_partkey", layout.shrunk(F.col("w"), F.col("h"), S).alias("s")).select("p_partkey", "s.*")


@query(f"SELECT document_id, block_index, confidence >= 80 AS good FROM ({_BLOCKS}) WHERE block_index < 50")
def first_blocks(spark, d):
    """The first fifty blocks of a document: what its page shows."""
    return ingest.first_blocks(layout.lines(tokens(spark, d))).select("document_id", "block_index", "good")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Line Total' || p_partkey ELSE 'Vendor Name' || p_partkey END AS field, 'Tax Information' || p_partkey AS section FROM part")
def shown_titles(spark, d):
    part = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("line_item_3_line_total"), part)).otherwise(F.concat(F.lit("vendor_name"), part))
    return read(spark, d, "part", "p_partkey").select("p_partkey", T.field_title(name).alias("field"), T.section_title(F.concat(F.lit("tax_information"), part)).alias("section"))


# Classification and sections

_ASK = "Name the type of this document (invoice, onboarding_form or unknown), your confidence from 0 to 1, and the evidence.\n\n"


@query(
    f"""SELECT document_id, CASE WHEN length(t) > 7500 THEN substring(t, 1, 7500) || chr(10) || '[cut]' ELSE t END AS prompt FROM (
SELECT document_id, '{_ASK}Page 1:' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY block_index) AS t FROM ({_BLOCKS}) WHERE block_index < 20 GROUP BY document_id)"""
)
def classification_prompts(spark, d):
    """Twenty blocks of a page and so many characters: what the classifier is shown."""
    blocks = layout.lines(tokens(spark, d))
    pages = blocks.select("document_id", "page_number").distinct().withColumn("text", null())
    return classify.prompts(blocks, pages, S)


@query(
    f"""SELECT {_ID}, CASE WHEN o_orderkey % 5 = 4 THEN 'unknown' ELSE 'invoice' END AS raw_document_type, CASE WHEN o_orderkey % 5 = 0 THEN 'invoice' ELSE 'unknown' END AS document_type, [1.0, 0.0, 0.0, 0.5, 0.9][CAST(o_orderkey % 5 AS INTEGER) + 1]::DOUBLE AS confidence,
CASE WHEN o_orderkey % 2 = 0 THEN 'a|b' ELSE 'one text' END || CASE WHEN o_orderkey % 5 IN (1, 2) THEN '|Confidence (0.00) was below threshold (0.70); marked as unknown.' WHEN o_orderkey % 5 = 3 THEN '|Confidence (0.50) was below threshold (0.70); marked as unknown.' ELSE '' END AS evidence, o_orderkey % 5 IN (1, 2, 3) AS below_threshold FROM orders"""
)
def classification_answers(spark, d):
    """Types in any case, confidences that are no numbers or outside of 0 to 1, evidence as a list or one text."""
    n = key() % 5
    evidence = F.when(key() % 2 == 0, '["a", " ", "b "]').otherwise('" one text "')
    body = F.concat(F.lit('{"document_type": "'), pick(n, " INVOICE ", "invoice", "invoice", "Invoice", "receipt"), F.lit('"'), pick(n, ', "confidence": 1.7', ', "confidence": "high"', "", ', "confidence": 0.5', ', "confidence": "0.9"'), F.lit(', "evidence": '), evidence, F.lit("}"))
    rows = classify.classify(answers(orders(spark, d), "classification", null(), body), S)
    return rows.withColumn("evidence", F.array_join("evidence", "|"))


def boxed_blocks(rows: DataFrame) -> DataFrame:
    """Four blocks on the one page of each document."""
    i = F.col("block_index")
    int_ = lambda c: c.cast("int")
    box = F.struct(int_(key() % 7 + 10 * i).alias("x"), int_(20 * i).alias("y"), int_(30 + i).alias("width"), F.lit(10).alias("height"))
    text = F.concat(pick(i, "Vendor no. ", "Total due ", "Paid by v", "Thanks "), key().cast("string"))
    return rows.withColumn("block_index", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("document_id", F.lit(1).alias("page_number"), "block_index", text.alias("text"), F.lit(90.0).alias("confidence"), box.alias("bbox"))


@query(
    f"""WITH o AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0)
SELECT {_ID}, 0 AS section_ord, CASE WHEN o_orderkey % 2 = 0 THEN 'notes' WHEN o_orderkey % 3 = 1 THEN 'line_items' ELSE 'unknown' END AS section_name, 1 AS page_number, o_orderpriority AS text, 1.0::DOUBLE AS confidence, '0,2' AS block_ids, CAST(o_orderkey % 7 AS INTEGER) AS x, 0 AS y, 52 AS width, 50 AS height FROM o
UNION ALL SELECT {_ID}, 2, 'unknown', 1, 'second', 0.9, '', NULL, NULL, NULL, NULL FROM o UNION ALL SELECT {_ID}, 3, 'notes', 2, 'third', 0.8, '', NULL, NULL, NULL, NULL FROM o"""
)
def section_detection(spark, d):
    """Answers to sections: blank texts go, names are held to the list of the type, boxes come from the blocks of the page."""
    rows = orders(spark, d, "o_orderpriority")
    name = F.when(key() % 2 == 0, " Notes ").otherwise("LINE_ITEMS")
    body = F.concat(
        F.lit('{"sections": [{"section_name": "'), name, F.lit('", "text": "'), F.col("o_orderpriority"), F.lit('", "page_number": 1, "confidence": 1.7, "block_ids": ["0", "x", "9", "2"]}, {"section_name": "notes", "text": "  "}, '),
        F.lit('{"section_name": "odd", "text": "second"}, {"section_name": "notes", "text": "third", "page_number": "2", "confidence": "low", "block_ids": ["1"]}]}'),
    )
    types = rows.select("document_id", pick(key() % 3, "unknown", "invoice", "onboarding_form").alias("document_type"))
    found = sections.detect(answers(rows, "section_detection", null(), body), types, boxed_blocks(rows))
    return found.select("document_id", "section_ord", "section_name", "page_number", "text", "confidence", F.array_join("block_ids", ",").alias("block_ids"), "bbox.*")


# Extraction


def vendor_answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sections of each order and the answers about them: one with fields, one too short, one without a schema; some answers fail."""
    rows = orders(spark, d, "o_orderpriority")
    part = lambda id_, i, name, text: F.struct(F.lit(id_).alias("section_id"), F.lit(i).alias("section_ord"), F.lit(name).alias("section_name"), F.lit(1).alias("page_number"), F.lit(text).alias("text"))
    found = rows.withColumn("s", F.explode(F.array(part("a", 1, "vendor_information", "long enough"), part("b", 2, "notes", " abc "), part("c", 3, "footer", "long enough"), part("d", 4, "notes", "five5")))).select("document_id", F.lit("invoice").alias("document_type"), "s.*")
    vendor = F.concat(F.lit('{"vendor_name": {"value": "'), F.col("o_orderpriority"), F.lit('", "confidence": 0.5, "source_text": "by rank"}, "vendor_phone": {"value": "555", "confidence": 0.25}, "odd": {"value": "x"}}'))
    notes = F.lit('{"notes": {"value": "paid", "confidence": 0.75}}')
    failed = F.when(key() % 7 == 0, "timeout")
    told = answers(rows, "extraction", F.lit("a"), F.when(failed.isNull(), vendor), failed)
    return found, told.unionByName(answers(rows, "extraction", F.lit("b"), notes)).unionByName(answers(rows, "extraction", F.lit("c"), notes)).unionByName(answers(rows, "extraction", F.lit("d"), notes))


_VENDOR = SECTION_FIELDS["invoice", "vendor_information"]


@query(
    f"""SELECT {_ID}, i AS field_ord, {_VENDOR}[i] AS field_name, CASE i WHEN 1 THEN o_orderpriority WHEN 4 THEN '555' END AS field_value, CASE WHEN i IN (1, 4) THEN 'string' ELSE 'null' END AS value_kind, CASE i WHEN 1 THEN 0.5::DOUBLE WHEN 4 THEN 0.25 END AS confidence, CASE i WHEN 1 THEN 'by rank' END AS source_text, 'vendor_information' AS section_name
FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM orders WHERE o_orderkey % 7 <> 0) UNION ALL SELECT {_ID}, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 6 END, 'notes', 'paid', 'string', 0.75, NULL, 'notes' FROM orders"""
)
def section_fields(spark, d):
    """Answers about single sections as long rows; short sections and those without fields are never asked about."""
    return extract.fields(*vendor_answers(spark, d)).select("document_id", "field_ord", "field_name", "field_value", "value_kind", "confidence", "source_text", "section_name")


@query(f"SELECT {_ID}, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END::BIGINT AS sections_processed, CASE WHEN o_orderkey % 7 = 0 THEN 'vendor_information' ELSE '' END AS failed_sections, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 6 END::BIGINT AS total_fields FROM orders")
def extraction_counters(spark, d):
    """A section that fails takes no other with it."""
    found, told = vendor_answers(spark, d)
    return extract.counters(found, told, extract.fields(found, told)).withColumn("failed_sections", F.array_join("failed_sections", ","))


# Validation


def form_fields(spark: SparkSession, d: str) -> DataFrame:
    """Onboarding forms: names and contacts given, blank or absent."""
    k, text = key() % 6, lambda c: c.cast("string")
    item = lambda i, name, value: F.struct(F.lit(i).alias("field_ord"), F.lit(name).alias("field_name"), text(value).alias("field_value"))
    parts = F.array_compact(F.array(
        F.when(k != 0, item(1, "full_name", F.when(k == 1, " ").otherwise(F.col("o_orderpriority")))), F.when(k.isin(1, 2, 3), item(2, "email", F.when(k == 1, "a@b.co").when(k == 2, "").otherwise("no mail"))),
        F.when(k.isin(2, 4), item(3, "phone", F.when(k == 2, " ").otherwise("555"))), item(4, "joining_date", F.date_format("o_orderdate", "yyyy-MM-dd")),
    ))
    rows = orders(spark, d, "o_orderpriority", "o_orderdate").select("document_id", F.explode(parts).alias("f")).select("document_id", "f.*")
    return long_fields(rows, "onboarding_form")


@query(
    f"""WITH o AS (SELECT {_ID}, o_orderkey % 6 AS k FROM orders)
SELECT document_id, 'full_name' AS field_name, 'needs_review' AS status, 'Required full name is missing.' AS message, k = 0 AS placeholder FROM o WHERE k IN (0, 1)
UNION ALL SELECT document_id, 'email', 'needs_review', '{validate._NO_CONTACT}', k <> 2 FROM o WHERE k IN (0, 2, 5) UNION ALL SELECT document_id, 'email', 'needs_review', 'Email format is invalid.', false FROM o WHERE k = 3
UNION ALL SELECT document_id, 'phone', 'needs_review', 'Phone number must contain between 7 and 15 digits.', false FROM o WHERE k = 4"""
)
def onboarding_rules(spark, d):
    found = validate.validate(form_fields(spark, d), S).where("validation_status <> 'valid'")
    return found.select("document_id", "field_name", F.col("validation_status").alias("status"), F.col("validation_message").alias("message"), (F.col("source") == "validation").alias("placeholder"))


# Second readings


@query(
    f"""SELECT {_ID}, CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN o_orderkey % 7 + 10 WHEN 1 THEN o_orderkey % 7 + 20 WHEN 2 THEN 300 WHEN 3 THEN o_orderkey % 7 END::INTEGER AS x, [20, 40, 310, 0, NULL][CAST(o_orderkey % 5 AS INTEGER) + 1] AS y, [31, 32, 50, 63, NULL][CAST(o_orderkey % 5 AS INTEGER) + 1] AS width, [10, 10, 60, 70, NULL][CAST(o_orderkey % 5 AS INTEGER) + 1] AS height FROM orders"""
)
def vision_boxes(spark, d):
    """Where to look: a block that holds the source text, one that holds the value, the section's box, its blocks, or nowhere."""
    rows, n, k = orders(spark, d), key() % 5, key().cast("string")
    fields = rows.select("document_id", F.lit(1).alias("page_number"), F.lit(1).alias("field_ord"), pick(n, "s", "s", "boxed", "listed", "s").alias("section_name"), F.when(n == 0, "TOTAL due").otherwise("").alias("source_text"), F.when(n == 1, F.concat(F.lit("by V"), k)).otherwise("zz").alias("field_value"))
    box = lambda *v: F.struct(*(F.lit(x).cast("int").alias(c) for c, x in zip(("x", "y", "width", "height"), v, strict=True)))
    part = lambda i, name, b, *ids: F.struct(F.lit(i).alias("section_ord"), F.lit(name).alias("section_name"), b.alias("bbox"), F.array(*map(F.lit, ids)).cast("array<int>").alias("block_ids"))
    found = rows.select("document_id", F.lit(1).alias("page_number"), F.explode(F.array(part(1, "boxed", box(300, 310, 50, 60), 0), part(2, "boxed", box(1, 1, 1, 1)), part(3, "listed", box(5, 5, 0, 9), 0, 3))).alias("s")).select("document_id", "page_number", "s.*")
    return vision.locate(fields, boxed_blocks(rows), found).select("document_id", "crop.*")


@query(f"SELECT {_ID}, CAST(o_orderkey % 4 AS INTEGER) AS field_ord, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority END AS value, CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN 1.0 WHEN 2 THEN 0.25 END::DOUBLE AS confidence, 'seen' AS source_text FROM orders")
def vision_answers(spark, d):
    """Answers cleaned: words for nothing are nothing, confidences are numbers from 0 to 1 or absent."""
    body = F.concat(F.lit('{"value": "'), pick(key() % 4, F.concat(F.lit(" "), F.col("o_orderpriority")), "N/A", " null", ""), F.lit('", "source_text": "seen"'), pick(key() % 3, ', "confidence": 3', ', "confidence": "high"', ', "confidence": 0.25'), F.lit("}"))
    return vision.clean(answers(orders(spark, d, "o_orderpriority"), "vision_fallback", (key() % 4).cast("string"), body)).select("document_id", "field_ord", "value", "confidence", "source_text")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS document_id, count(*) FILTER (l_linenumber <> 5) AS candidates, count(*) FILTER (l_linenumber IN (1, 2)) AS recovered, count(*) FILTER (l_linenumber = 3) AS conflicts FROM lineitem GROUP BY l_orderkey")
def vision_counters(spark, d):
    taken = F.when(F.col("l_linenumber") == 1, "agreed").when(F.col("l_linenumber") == 2, "recovered").when(F.col("l_linenumber") == 3, "conflict").when(F.col("l_linenumber") != 5, "unreadable")
    return vision.counters(read(spark, d, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").cast("string").alias("document_id"), taken.alias("action_taken")))


# Summaries and actions


@query(
    f"""SELECT {_ID}, CASE WHEN k = 0 OR n = 0 THEN 'skipped' WHEN k IN (1, 2) THEN 'failed' ELSE 'completed' END AS status, CASE WHEN k = 0 THEN 'No summary: the document''s type is unknown.' WHEN n = 0 THEN 'No summary: the document has no fields.' WHEN k > 2 THEN o_orderpriority END AS summary,
CASE WHEN k > 2 AND n > 0 THEN 'a,b,c,d,e' ELSE '' END AS key_points, CASE WHEN k = 0 THEN '' WHEN n = 0 THEN 'Extract fields before summarizing.' WHEN k > 2 THEN 'look' ELSE '' END AS review_items, n AS total_fields, r AS needs_review_fields, c AS conflict_fields
FROM (SELECT o_orderkey, o_orderpriority, o_orderkey % 5 AS k, count(l_orderkey) AS n, count(*) FILTER (l_linenumber % 3 = 1) AS r, count(*) FILTER (l_linenumber % 3 = 2) AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""
)
def summary_results(spark, d):
    """Summaries with capped lists, or why there is none: unknown type, no fields, an error, a blank answer."""
    rows, k = orders(spark, d, "o_orderpriority"), key() % 5
    body = F.concat(F.lit('{"summary": "'), F.when(k == 2, " ").otherwise(F.concat(F.col("o_orderpriority"), F.lit(" "))), F.lit('", "key_points": ["a", "b", " ", "c", "d", "e", "f"], "review_items": "look"}'))
    told = answers(rows, "summary", null(), F.when(k != 2, body), F.when(k == 1, "timeout"))
    types = rows.select("document_id", F.when(k == 0, "unknown").otherwise("invoice").alias("document_type"))
    state = F.element_at(F.array(*map(F.lit, ["valid", "needs_review", "conflict"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    fields = read(spark, d, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").cast("string").alias("document_id"), state.alias("validation_status"))
    out = insights.summaries(types, fields, told, S)
    return out.withColumns({c: F.array_join(c, ",") for c in ("key_points", "review_items")})


@query(
    f"""SELECT {_ID}, CASE WHEN o_orderkey % 4 = 0 THEN '{{"fields":[{{"field_name":"account_number","value":"{insights.MASK}","status":"valid"}},{{"field_name":"vendor_name","value":"' || o_orderpriority || '","status":"conflict"}}],"issues":[{{"field_name":"vendor_name","status":"conflict","message":"two"}}],"conflicts_detected":["vendor_name"]}}'
ELSE '{{"fields":[{{"field_name":"account_number","value":"{insights.MASK}","status":"valid"}},{{"field_name":"vendor_name","value":"' || o_orderpriority || '","status":"valid"}}],"conflicts_detected":[]}}' END AS context FROM orders"""
)
def summary_context(spark, d):
    """What a model is told about a document: no sensitive value, all issues, names in conflict."""
    rows = orders(spark, d, "o_orderpriority")
    item = lambda i, name, value, normal, st: F.struct(F.lit(i).alias("field_ord"), F.lit(name).alias("field_name"), value.alias("field_value"), normal.alias("normalized_value"), st.alias("validation_status"))
    clash = F.when(key() % 4 == 0, "conflict").otherwise("valid")
    fields = rows.select("document_id", F.explode(F.array(item(2, "vendor_name", F.lit("raw"), F.col("o_orderpriority"), clash), item(1, "account_number", key().cast("string"), null(), F.lit("valid")))).alias("f")).select("document_id", "f.*")
    issues = rows.where(key() % 4 == 0).select("document_id", F.lit(1).alias("issue_ord"), F.lit("vendor_name").alias("field_name"), F.lit("conflict").alias("status"), F.lit("two").alias("message"))
    return insights.context(fields, issues, S)


@query(
    f"""SELECT {_ID}, 2000000 AS ord, 'Call ' || o_orderpriority AS action, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'medium' END AS priority, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS due_date, 'ai' AS source, CASE WHEN o_orderkey % 4 = 0 THEN 'asked' END AS reason FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT {_ID}, 2000002, 'File it', 'medium', NULL, 'ai', NULL FROM orders WHERE o_orderkey % 5 <> 0"""
)
def suggested_actions(spark, d):
    """Actions that a model suggests: blank ones go, priorities and dates are checked, errors suggest nothing."""
    rows = orders(spark, d, "o_orderpriority", "o_orderdate")
    due = F.when(key() % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key() % 3 == 1, " None").otherwise("soon")
    first = F.concat(F.lit('{"actions": [{"action": " Call '), F.col("o_orderpriority"), F.lit('", "priority": "'), F.when(key() % 2 == 0, " HIGH").otherwise("urgent"), F.lit('", "due_date": "'), due, F.lit('", "reason": "'), F.when(key() % 4 == 0, "asked ").otherwise(" "), F.lit('"}, {"action": " "}, {"action": "File it"}]}'))
    return insights.suggested(answers(rows, "action_extraction", null(), first, F.when(key() % 5 == 0, "timeout")))


@query(
    f"""SELECT {_ID}, 'Prepare onboarding provisioning for ' || CASE CAST(o_orderkey % 6 AS INTEGER) WHEN 0 THEN 'new employee' WHEN 1 THEN ' ' ELSE o_orderpriority END AS action, 'medium' AS priority, CAST(o_orderdate AS DATE) AS due_date, 'deterministic' AS source, 'Candidate joining date is scheduled for ' || strftime(o_orderdate, '%Y-%m-%d') || '.' AS reason FROM orders"""
)
def provisioning_actions(spark, d):
    fields = validate.validate(form_fields(spark, d), S)
    made = insights.deterministic(fields, validate.issues(fields), S)
    return made.where("due_date IS NOT NULL").select("document_id", "action", "priority", "due_date", "source", "reason")


_ACTED = "SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_partkey % 3 AS p, l_linenumber % 4 AS s, l_linenumber FROM lineitem"


@query(
    f"SELECT document_id, count(*) AS total_actions, count(*) FILTER (p = 0) AS high_priority, count(*) FILTER (l_linenumber % 3 <> 2) AS deterministic_count, count(*) FILTER (l_linenumber % 3 = 2) AS ai_count, count(*) FILTER (s = 1) AS completed, count(*) FILTER (s = 0) AS pending FROM ({_ACTED}) GROUP BY document_id"
)
def action_counters(spark, d):
    n = F.col("l_linenumber")
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return insights.counters(rows.select(F.col("l_orderkey").cast("string").alias("document_id"), pick(F.col("l_partkey") % 3, "high", "medium", "low").alias("priority"), pick(n % 3, "rule_based", "deterministic", "ai").alias("source"), pick(n % 4, "pending", "completed", "dismissed", "in_progress").alias("status")))


@query(
    """SELECT l_orderkey AS k, CAST(sum(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(sum(CASE WHEN l_linenumber % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicts, CAST(sum(CASE WHEN l_linenumber % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS needs_review,
CASE WHEN l_orderkey % 2 = 0 THEN 'needs review' ELSE 'completed' END AS status_text, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 4 END::BIGINT AS pages FROM lineitem GROUP BY l_orderkey"""
)
def overview_metrics(spark, d):
    rows = lines(spark, d)
    k = F.col("l_orderkey")
    fields = rows.select(k.cast("string").alias("document_id"), pick(F.col("l_linenumber") % 3, "valid", "conflict", "needs_review").alias("validation_status"))
    documents = rows.select(k.cast("string").alias("document_id"), F.when(k % 2 == 0, "needs_review").otherwise("completed").alias("status")).distinct()
    ocr = documents.where(F.col("document_id").cast("long") % 3 != 0).select("document_id", F.lit(4).cast("long").alias("page_count"), F.lit(90.0).alias("average_confidence"))
    out = audit.overview(documents, fields, ocr)
    return out.select(F.col("document_id").cast("long").alias("k"), "valid", "conflicts", "needs_review", "status_text", "pages")


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN ['ocr', 'ocr_completed', 'extracting', NULL][CAST(event_id % 4 AS INTEGER) + 1] ELSE ['ocr_completed', 'classified', 'extracted', NULL][CAST(event_id % 4 AS INTEGER) + 1] END AS status FROM events"""
)
def document_status_of_stage(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started").otherwise("completed")
    rows = read(spark, d, "events", "event_id", "event_type")
    return rows.select("event_id", audit.status_of(pick(F.col("event_id") % 4, "ocr", "classification", "extraction", "summary"), status).alias("status"))
