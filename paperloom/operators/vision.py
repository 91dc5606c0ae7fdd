"""Second readings of doubtful fields: which to ask for, where to look, and what an answer changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import values_agree
from ..functions.text import blank, strip
from ..settings import DEFAULT, Settings
from .classify import clamped
from .layout import crop_box, union_box
from .postings import holding
from .validate import validate

_ANSWER = "struct<value:string,confidence:string,source_text:string,reason:string>"


def candidate_reason(s: Settings = DEFAULT) -> Column:
    """Why a field is worth a second reading, or null."""
    name, message = F.lower("field_name"), F.coalesce("validation_message", F.lit(""))
    low = F.lower(message)
    has = lambda *parts: F.greatest(*(low.contains(p) for p in parts))
    review = F.coalesce(F.col("validation_status") == "needs_review", F.lit(False))
    reason = F.when(F.col("confidence") < s.vision_threshold, F.format_string(f"Low OCR confidence (%.2f < {s.vision_threshold:.2f})", "confidence"))
    reason = reason.when(blank(F.col("field_value")) & review, F.concat(F.lit("Missing value flagged during validation: "), F.when(message == "", "Required field empty").otherwise(message)))
    reason = reason.when(review & has("discrepancy", "does not match calculated", "earlier than invoice date"), F.lit(None))
    reason = reason.when(review & has("format is invalid", "must contain between", "could not parse", "invalid"), F.concat(F.lit("OCR format/corruption issue: "), message))
    return F.when(~F.coalesce("fallback_attempted", F.lit(False)) & ~name.startswith("agreement_") & (name != "notes"), reason)


def candidates(fields: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return fields.withColumn("candidate_reason", candidate_reason(s)).where("candidate_reason IS NOT NULL")


#: Pages of more blocks look for texts by postings; on smaller ones each field is compared with each block, which costs less there.
MANY_BLOCKS = 1000


def _posted(own: DataFrame, blocks: DataFrame, box: list[str]) -> DataFrame:
    """_page, field_ord and the boxes of the blocks that hit a field, by postings: _t or _v in a block, or a block in _t; a box may come twice. Only blocks as short as the page's longest _t are sought in one."""
    words = own.select("_page", "field_ord", F.explode(F.array("_t", F.when(F.length("_v") >= 3, F.col("_v")))).alias("sought"))
    short = blocks.join(own.groupBy("_page").agg(F.max(F.length("_t")).alias("_most")), "_page").where(F.length("_b") <= F.col("_most"))
    down = holding(words, blocks.withColumnRenamed("_b", "text"), ["_page"], (["field_ord"], box))
    up = holding(short.withColumnRenamed("_b", "sought"), own.withColumnRenamed("_t", "text"), ["_page"], (box, ["field_ord"]))
    return down.select("_page", "field_ord", *box).unionByName(up.select("_page", "field_ord", *box))


def locate(fields: DataFrame, blocks: DataFrame, sections: DataFrame, many: int = MANY_BLOCKS) -> DataFrame:
    """fields with crop: around the blocks whose text holds the source text (or is held by it, or holds the value), else the section's box, else the box of its blocks. Pages of more than `many` blocks go by postings, with the same result."""
    text, value = F.lower(strip(F.coalesce("source_text", F.lit("")))), F.lower(strip(F.coalesce("field_value", F.lit(""))))
    page, box = ["document_id", "page_number"], ["x", "y", "width", "height"]
    b = blocks.select(*page, "block_index", F.lower(strip(F.col("text"))).alias("_b"), "bbox.*")
    # Fields and blocks are dealt once, by one column for their page: page numbers may be constant, and then Spark does not know them again behind a shuffle. All that reads
    # blocks needs their boxes, by a condition that always holds: with the same columns it is the same shuffle, else texts would be sent again for each set of them.
    dealt = lambda rows, *c: rows.where("document_id IS NOT NULL AND page_number IS NOT NULL").select(F.struct("document_id", F.col("page_number").cast("long").alias("page_number")).alias("_page"), *c).repartition("_page")
    own = dealt(fields, "field_ord", text.alias("_t"), value.alias("_v"))
    counted = dealt(b, "_b", *box).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_page"))).where(F.length(F.concat_ws(" ", *box)) >= 0)
    hit = ((F.col("_t") != "") & (F.col("_b") != "") & (F.col("_b").contains(F.col("_t")) | F.col("_t").contains(F.col("_b")))) | ((F.length("_v") >= 3) & F.col("_b").contains(F.col("_v")))
    hits = own.join(counted.where(F.col("_n") <= many), "_page").where(hit).select("_page", "field_ord", *box).unionByName(_posted(own, counted.where(F.col("_n") > many).drop("_n"), box)).select("_page.document_id", "field_ord", *box)
    first = hits.groupBy("document_id", "field_ord").agg(union_box(None).alias("_one"))
    around = sections.select("document_id", "section_ord", "page_number", F.explode("block_ids").alias("block_index")).join(b.drop("_b"), [*page, "block_index"]).groupBy("document_id", "section_ord").agg(union_box(None).alias("_blocks"))
    boxed = sections.join(around, ["document_id", "section_ord"], "left")
    box = F.when((F.col("bbox.width") > 0) & (F.col("bbox.height") > 0), F.col("bbox"))
    boxed = boxed.select(*page, "section_name", "section_ord", F.coalesce(box, "_blocks").alias("_box")).where("_box IS NOT NULL")
    boxed = boxed.groupBy(*page, "section_name").agg(F.min_by("_box", "section_ord").alias("_two"))
    rows = fields.join(first, ["document_id", "field_ord"], "left").join(boxed, [*page, "section_name"], "left")
    return rows.withColumn("crop", F.coalesce("_one", "_two")).drop("_one", "_two")


def crops(located: DataFrame, pages: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The padded crop on its page; a field whose page is missing takes the document's first page."""
    size = pages.select("document_id", "page_number", "width", "height")
    any_ = size.groupBy("document_id").agg(F.min_by(F.struct("width", "height"), "page_number").alias("_any"))
    rows = located.join(size, ["document_id", "page_number"], "left").join(any_, "document_id", "left")
    return rows.withColumn("crop", crop_box(F.col("crop"), F.coalesce("width", "_any.width"), F.coalesce("height", "_any.height"), s)).drop("width", "height", "_any")


def clean(responses: DataFrame) -> DataFrame:
    """Answers of stage vision_fallback by field_ord (item_key)."""
    a = F.from_json("response_json", _ANSWER)
    value = strip(a["value"])
    return responses.where("stage = 'vision_fallback'").select(
        "document_id", F.col("item_key").try_cast("int").alias("field_ord"), F.when(~F.lower(value).isin("null", "none", "n/a", "unknown", ""), value).alias("value"), clamped(a["confidence"], None, None).alias("confidence"), a["source_text"].alias("source_text"), a["reason"].alias("reason"), "error"
    )


def evaluate(asked: DataFrame, answers: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Candidates (with crop) and answers to updated fields with action_taken: skipped, unreadable, agreed, recovered or conflict."""
    a = answers.select("document_id", "field_ord", F.col("value").alias("_v"), F.col("confidence").alias("_c"), F.col("source_text").alias("_s"), F.col("reason").alias("_r"), F.col("error").alias("_e"), F.lit(True).alias("_answered"))
    return outcome(asked.join(a, ["document_id", "field_ord"], "left"), s)


def outcome(rows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The decision table, on rows of candidates with their answer (_v, _c; _s, _r, _e and _answered if there are)."""
    for c, kind in (("_s", "string"), ("_r", "string"), ("_e", "string"), ("_answered", "boolean")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(True) if c == "_answered" else F.lit(None).cast(kind))
    old, conf = F.col("field_value"), F.col("confidence")
    none = F.col("crop").isNull() | F.col("_answered").isNull() | F.col("_e").isNotNull()
    fix = (conf.isNull() | (conf < s.vision_threshold)) & (F.col("_c") >= s.vision_threshold)
    action = F.when(none, "skipped").when(blank(F.col("_v")), "unreadable").when(values_agree(old, F.col("_v"), float(s.rounding_tolerance)), "agreed").when(blank(old) | fix, "recovered").otherwise("conflict")
    rows = rows.withColumn("action_taken", action)
    is_ = lambda *x: F.col("action_taken").isin(*x)
    sure = F.coalesce("_c", F.lit(0.85))
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(c, F.lit("None")), F.lit("'"))
    return rows.withColumns(
        {
            "ocr_value": F.when(is_("skipped"), F.col("ocr_value")).otherwise(F.coalesce("ocr_value", old)), "ocr_confidence": F.when(is_("skipped"), F.col("ocr_confidence")).otherwise(F.coalesce("ocr_confidence", conf)),
            "vision_value": F.when(is_("skipped"), F.lit(None)).otherwise(F.col("_v")), "vision_confidence": F.when(is_("skipped"), F.lit(None)).otherwise(F.col("_c")), "vision_source_text": F.when(is_("skipped"), F.lit(None)).otherwise(F.col("_s")),
            "fallback_attempted": F.lit(True), "fallback_reason": F.col("candidate_reason"), "field_value": F.when(is_("recovered"), F.col("_v")).otherwise(old),
            "confidence": F.when(is_("agreed"), F.greatest(F.coalesce(conf, F.lit(0.0)), sure)).when(is_("recovered"), sure).otherwise(conf),
            "source": F.when(is_("agreed"), "ocr+vision").when(is_("recovered"), "vision_fallback").otherwise(F.col("source")),
            "validation_status": F.when(is_("unreadable"), "needs_review").when(is_("conflict"), "conflict").otherwise(F.col("validation_status")),
            "validation_message": F.when(is_("unreadable"), F.concat(F.lit("Handwriting or character unreadable in visual crop ("), F.coalesce("_r", F.lit("Illegible")), F.lit(").")))
            .when(is_("conflict"), F.concat(F.lit("Conflict between OCR ("), quoted(old), F.lit(") and Vision ("), quoted(F.col("_v")), F.lit(")."))).otherwise(F.col("validation_message")),
        }
    ).drop("_v", "_c", "_s", "_r", "_e", "_answered")


def cropped(fields: DataFrame, blocks: DataFrame, sections: DataFrame, pages: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The candidates with the crop to read; null where there is nothing to look at, which is never asked for."""
    return crops(locate(candidates(fields, s), blocks, sections), pages, s)


def run(fields: DataFrame, answers: DataFrame, asked: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The answers to `asked` (cropped()) evaluated, then everything validated again. What vision found unreadable or in conflict stays so, unless s.legacy."""
    done = evaluate(asked, answers, s).drop("candidate_reason", "crop")
    rest = fields.join(asked.select("document_id", "field_ord"), ["document_id", "field_ord"], "left_anti").withColumn("action_taken", F.lit(None).cast("string"))
    every = done.unionByName(rest, allowMissingColumns=True).where("source IS NULL OR source <> 'validation'")
    checked = validate(every, s)
    if s.legacy:
        return checked
    keep = F.col("action_taken").isin("unreadable", "conflict")
    marks = every.where(keep).select("document_id", "field_ord", F.col("validation_status").alias("_st"), F.col("validation_message").alias("_m"))
    out = checked.join(marks, ["document_id", "field_ord"], "left")
    return out.withColumns({"validation_status": F.coalesce("_st", "validation_status"), "validation_message": F.when(F.col("_st").isNotNull(), F.col("_m")).otherwise(F.col("validation_message"))}).drop("_st", "_m")


def counters(done: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(F.col("action_taken") == x)
    return done.groupBy("document_id").agg(F.count("action_taken").alias("candidates"), (n("recovered") + n("agreed")).alias("recovered"), n("conflict").alias("conflicts"))


def prompts(asked: DataFrame) -> DataFrame:
    """One prompt a candidate that has a crop, with that crop."""
    said = F.format_string("Read the field %s in this crop. OCR read: %s. Answer with value, confidence, source_text and reason.", "field_name", F.coalesce("field_value", F.lit("nothing")))
    return asked.where("crop IS NOT NULL").select("document_id", F.col("field_ord").cast("string").alias("item_key"), "page_number", "crop", said.alias("prompt"))


def latest(fields: DataFrame) -> DataFrame:
    """The last field of each name."""
    w = Window.partitionBy("document_id", F.lower("field_name")).orderBy(F.desc("field_ord"))
    return fields.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
