"""Uploads and pages: names, checks, routing; and what a search over fields finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings

# Accepted extensions and types.
EXTENSIONS = [".pdf", ".jpg", ".jpeg", ".png"]
TYPES = ["application/pdf", "image/jpeg", "image/jpg", "image/png"]
KEY_FIELDS = ["vendor_name", "customer_name", "invoice_number", "invoice_date", "due_date", "total", "subtotal", "tax_amount", "currency", "full_name", "email", "phone", "joining_date", "designation"]


def safe_name(name: Column, document_id: Column) -> Column:
    """The last part of a path with nothing but letters, digits, dot, dash and underscore."""
    last = F.regexp_replace(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1), "[^a-zA-Z0-9._-]", "_")
    return F.when(F.coalesce(last, F.lit("")) == "", F.concat(F.lit("document_"), F.substring(F.sha2(document_id, 256), 1, 8))).otherwise(last)


def check_uploads(files: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """files (document_id, filename, mime_type, file_size) with reject_reason (the first check that fails, or null), mime_type as stored, and storage_path."""
    ext = F.lower(F.regexp_extract("filename", r"(\.[^./\\]*)$", 1))
    mime = F.lower("mime_type")
    reason = (
        F.when(~ext.isin(EXTENSIONS), "unsupported extension").when(F.coalesce(~mime.isin(TYPES), F.lit(True)), "unsupported type").when(F.coalesce("file_size", F.lit(0)) <= 0, "empty file").when(F.col("file_size") > s.max_upload_bytes, "file too large")
    )
    safe = safe_name(F.col("filename"), F.col("document_id"))
    return files.withColumns({"reject_reason": reason, "safe_name": safe, "mime_type": F.when(mime == "image/jpg", "image/jpeg").otherwise(mime)}).withColumn("storage_path", F.when(F.col("reject_reason").isNull(), F.concat_ws("/", F.lit("documents"), "document_id", "safe_name")))


def route(documents: DataFrame) -> DataFrame:
    """Which renderer a document needs, and its badge."""
    pdf = (F.col("mime_type") == "application/pdf") | F.lower("filename").endswith(".pdf")
    png = F.lower("filename").endswith(".png") | (F.col("mime_type") == "image/png")
    return documents.withColumns({"renderer": F.when(pdf, "pdf").otherwise("image"), "badge": F.when(pdf, "pdf").when(png, "png").otherwise("jpg")})


def page_name(n: Column) -> Column:
    return F.format_string("page_%03d.png", n)


def scan_pages(paths: DataFrame) -> DataFrame:
    """document_id, image_path, page_number of pages by name (…/<document>/page_<n>.png), in order."""
    number = F.regexp_extract("image_path", r"page_(\d+)\.png$", 1).try_cast("int")
    return paths.withColumn("page_number", number).where("page_number IS NOT NULL").orderBy("document_id", "image_path")


def precondition(stage: str, pages: Column, ocr: Column, classified: Column, sectioned: Column) -> Column:
    """Why a document can't enter a stage yet, or null; arguments say what it has."""
    need = {"ocr": [("pages", pages)], "classification": [("ocr", ocr)], "section_detection": [("ocr", ocr), ("classification", classified)], "extraction": [("ocr", ocr), ("classification", classified), ("sections", sectioned)], "validation": [("sections", sectioned)]}
    out = F.lit(None).cast("string")
    for name, has in reversed(need.get(stage, [])):
        out = F.when(~F.coalesce(has, F.lit(False)), f"{stage} needs {name}").otherwise(out)
    return out


def search(fields: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Fields whose name, value or normal form holds the text, of one status (all, valid, review or conflict)."""
    q = F.lit(text.lower())
    hit = F.lit(not text)
    for c in ("field_name", "field_value", "normalized_value"):
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    of = {"all": F.lit(True), "valid": F.col("validation_status") == "valid", "review": F.col("validation_status") == "needs_review", "conflict": F.col("validation_status") == "conflict"}[status]
    return fields.where(hit & of).withColumns({"key_field": F.lower("field_name").isin(KEY_FIELDS), "shown": F.coalesce("normalized_value", "field_value")})


def first_blocks(blocks: DataFrame, most: int = 50) -> DataFrame:
    """The first blocks of each document, with the badge of good confidence."""
    w = Window.partitionBy("document_id").orderBy("page_number", "block_index")
    return blocks.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r").withColumn("good", F.coalesce(F.col("confidence") >= 80, F.lit(False)))
