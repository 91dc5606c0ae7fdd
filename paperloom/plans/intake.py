"""Queries over files and pages, each with the same in SQL. A document stands for an uploaded file, whose bytes Spark makes of its columns, or for a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import pages
from ..sources.providers import BatchedOcr
from .catalog import S, query, read
from .chain import pick

_SIZE = "CAST(floor(w * least(1.0::DOUBLE, 2400.0::DOUBLE / greatest(w, h))) AS INTEGER) AS width, CAST(floor(h * least(1.0::DOUBLE, 2400.0::DOUBLE / greatest(w, h))) AS INTEGER) AS height"


@query(
    f"""WITH d AS (SELECT doc_id, CAST(doc_id % 6 AS INTEGER) AS k, coalesce(n_chars, 0) AS n FROM documents),
p AS (SELECT doc_id, 1 AS page_number, n % 60000 + 1 AS w, doc_id % 3000 + 1000 AS h FROM d WHERE k IN (0, 1) UNION ALL
SELECT doc_id, CAST(unnest(range(1, n // 1000 + 2)) AS INTEGER), 1700, 2200 FROM d WHERE k = 2)
SELECT doc_id, page_number, {_SIZE}, NULL AS error FROM p UNION ALL
SELECT doc_id, NULL, NULL, NULL, ['no image', 'no readable pages', 'empty file'][k - 2] FROM d WHERE k > 2"""
)
def page_rendering(spark, d):
    """A page a row of images and of files with many pages, and an error for corrupt, empty and page-less ones."""
    n, id_ = F.coalesce("n_chars", F.lit(0)), F.col("doc_id")
    side = lambda value, digits: F.unhex(F.lpad(F.hex(value.cast("long")), digits, "0"))
    w, h = n % 60000 + 1, id_ % 3000 + 1000
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), side(w, 8), side(h, 8))
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE000040000FFC0001108")), side(h, 4), side(w, 4))
    pdf = F.concat(F.lit("%PDF-1.4\n"), F.repeat(F.lit("<< /Type /Page /MediaBox [0 0 612 792] >> endobj\n"), F.floor(n / 1000).cast("int") + 1)).cast("binary")
    k = id_ % 6
    content = pick(k, png, jpeg, pdf, F.lit("an image").cast("binary"), F.lit("%PDF-1.4\n<< /Type /Catalog >> endobj").cast("binary"), F.lit(None).cast("binary"))
    files = read(spark, d, "documents", "doc_id", "n_chars").select(
        id_.cast("string").alias("document_id"), pick(k, *(F.lit(x) for x in ("a.png", "a.jpg", "a.pdf", "b.png", "b.pdf", "c.pdf"))).alias("filename"), F.lit("").alias("mime_type"), content.alias("content")
    )
    return pages.render(files, s=S).select(F.col("document_id").cast("long").alias("doc_id"), "page_number", "width", "height", "error")


def _words(asked: list) -> list:
    """Stands for an engine: the words of a page as tokens; it can't take one with an @, or a batch that holds one."""
    if any(b"@" in image for _, _, image in asked):
        raise ValueError("unreadable page")
    return [[{"line_num": i, "text": w.decode()} for i, line in enumerate(image.split(b"\n")) for w in line.split()] for _, _, image in asked]


@query(
    r"""SELECT doc_id, CASE WHEN bad THEN 0 ELSE len(words) END::BIGINT AS n_tokens, CASE WHEN bad THEN 0 ELSE coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) END::BIGINT AS n_letters, CASE WHEN bad THEN 'unreadable page' END AS error
FROM (SELECT doc_id, contains(text, '@') AS bad, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents WHERE text IS NOT NULL) WHERE bad OR len(words) > 0"""
)
def page_reading(spark, d):
    """Whole texts as pages through an engine that takes batches: tokens of those it can read, an error for each it can't and for no other."""
    rows = read(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.col("text").cast("binary").alias("image"))
    told = BatchedOcr(_words).read(rows)
    counted = told.groupBy("document_id").agg(F.count("text").alias("n_tokens"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_letters"), F.max("error").alias("error"))
    return counted.select(F.col("document_id").cast("long").alias("doc_id"), "n_tokens", "n_letters", "error")
