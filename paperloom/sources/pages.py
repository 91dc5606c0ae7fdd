"""Pages out of uploaded files: Spark's binaryFile source lists, prunes and packs the files (as a batch or as a stream), a renderer turns each
file into pages on the executors.

`uploads` has the checks of an upload without the bytes: a file that is rejected by name, type or size is never opened. `render` gives a row a page, or
for a file that can't be read, or has no pages, one row with an error in place of it. A renderer gives its pages one after
the other, so a task holds one file, one page and what is waiting to be sent (at most SEND_BYTES and a page), however many pages there are.
Defined results: null or empty content is an error of its file; a file that fails after some pages keeps none of them (`whole`); a document_id that
comes twice gives its pages twice; no files give no rows.
"""

from __future__ import annotations

import re
import struct
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, layout
from ..session import materialized
from ..settings import DEFAULT, Settings
from .store import Store

RENDERED = "document_id string, page_number int, width int, height int, image binary, error string"
FILES = "path string, modificationTime timestamp, length long, content binary"
DPI = 200
SEND_BYTES = 16 * 1024 * 1024


class PageProvider(ABC):
    """Turns the bytes of a file into its pages: (width, height, PNG or None) each, in order. What it raises is the file's error."""

    name = "pages"

    def available(self) -> tuple[bool, str | None]:
        return True, None

    @abstractmethod
    def pages(self, renderer: str, content: bytes) -> Iterator[tuple[int, int, bytes | None]]: ...


class Headers(PageProvider):
    """Sizes of pages out of what files declare, without pixels: the headers of PNG and JPEG, and page objects of PDF that aren't compressed, at DPI; a page without
    a size of its own has that of the page tree before it."""

    name = "headers"

    def pages(self, renderer: str, content: bytes) -> Iterator[tuple[int, int, bytes | None]]:
        if renderer == "pdf":
            if not content.startswith(b"%PDF-"):
                raise ValueError("no PDF")
            above = None
            for part in content.split(b"endobj"):
                box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s*\]", part)
                if re.search(rb"/Type\s*/Pages\b", part):
                    above = box or above
                elif re.search(rb"/Type\s*/Page\b", part):
                    if not (box or above):
                        raise ValueError("page without a size")
                    left, bottom, right, top = map(float, (box or above).groups())
                    yield round((right - left) * DPI / 72), round((top - bottom) * DPI / 72), None
        elif content.startswith(b"\x89PNG\r\n\x1a\n") and content[12:16] == b"IHDR" and len(content) >= 24:
            yield (*struct.unpack(">II", content[16:24]), None)
        elif content.startswith(b"\xff\xd8"):
            at = 2
            while at + 9 <= len(content):
                mark, size = struct.unpack(">HH", content[at : at + 4])
                if 0xFFC0 <= mark <= 0xFFCF and mark not in (0xFFC4, 0xFFC8, 0xFFCC):  # the frames; these three are tables
                    height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                    yield width, height, None
                    return
                at += 2 + size
            raise ValueError("no size in the image")
        else:
            raise ValueError("no image")


def uploads(spark: SparkSession, path: str, stream: bool = False, s: Settings = DEFAULT) -> DataFrame:
    """The files below a folder, on any file system that Spark reads, as ingest.check_uploads gives them, with `content` as the last column: it is read
    only where it is used, and never for files whose length rejects them (the scan's filter on length). Spark's file sources pass over files
    without a byte, in a batch and in a stream alike: `unseen` tells them from a list of what was sent."""
    reader = spark.readStream.schema(FILES) if stream else spark.read
    files = reader.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    mime = F.when(ext == "pdf", "application/pdf").when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg")
    rows = files.select(F.sha2("path", 256).alias("document_id"), name.alias("filename"), mime.alias("mime_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("created_at"), "content")
    return ingest.check_uploads(rows, s)


def unseen(sent: DataFrame, files: DataFrame) -> DataFrame:
    """Of a table of what was sent (filename and other columns) the rows that no file was read for: they are empty or missing. Names alone are joined."""
    return sent.join(files.select("filename").distinct(), "filename", "left_anti").withColumn("reject_reason", F.lit("empty file"))


def accepted(files: DataFrame) -> DataFrame:
    """Files without a reason to reject them; the conditions on size are given again, plainly, so that the scan has them."""
    return files.where("file_size > 0 AND reject_reason IS NULL")


def render(files: DataFrame, provider: PageProvider | None = None, s: Settings = DEFAULT) -> DataFrame:
    """files (document_id, filename, mime_type, content) to RENDERED: pages from 1 on with their sizes after shrinking to the largest side, or an error."""
    own = provider or Headers()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, waiting = [], 0
            for document, kind, content in zip(batch["document_id"], batch["renderer"], batch["content"], strict=True):
                number = 0
                try:
                    if not content:
                        raise ValueError("empty file")
                    for number, (width, height, image) in enumerate(own.pages(kind, bytes(content)), 1):
                        if width < 1 or height < 1:
                            raise ValueError(f"page {number} has no area")
                        rows.append((document, number, width, height, image, None))
                        waiting += 100 + len(image or b"")
                        if waiting > SEND_BYTES:
                            yield pd.DataFrame(rows, columns=names)
                            rows, waiting = [], 0
                    if not number:
                        raise ValueError("no readable pages")
                except Exception as e:  # whatever a renderer raises is an error of its file
                    rows.append((document, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=names)

    names = [part.split()[0] for part in RENDERED.split(", ")]
    made = ingest.route(files).select("document_id", "renderer", "content").mapInPandas(run, RENDERED)
    size = layout.shrunk(F.col("width"), F.col("height"), s)
    return made.withColumn("_s", size).withColumns({"width": F.col("_s.width"), "height": F.col("_s.height")}).drop("_s")


def whole(rendered: DataFrame) -> DataFrame:
    """schemas.PAGES with `image`, of documents that were rendered without an error."""
    bad = rendered.where("error IS NOT NULL").select("document_id").distinct()
    pages = rendered.where("error IS NULL").join(bad, "document_id", "left_anti")
    path = F.concat_ws("/", "document_id", ingest.page_name(F.col("page_number")))
    return pages.select("document_id", "page_number", path.alias("image_path"), "width", "height", F.lit("png").alias("format"), F.length("image").cast("long").alias("file_size_bytes"), "image")


def outcomes(rendered: DataFrame) -> DataFrame:
    """One row a document: page_count and error (the least, where there are several), 0 pages where there is one."""
    return rendered.groupBy("document_id").agg(F.count("page_number").alias("_n"), F.min("error").alias("error")).select("document_id", F.when(F.col("error").isNull(), F.col("_n")).otherwise(0).alias("page_count"), "error")


def _log(rows: DataFrame, stage: str, status: Column, message: Column, metadata: Column, at: Column) -> DataFrame:
    return rows.select("document_id", F.lit(stage).alias("stage"), status.alias("status"), message.alias("message"), metadata.alias("metadata"), at.alias("created_at"))


def receive(store: Store, files: DataFrame) -> DataFrame:
    """Uploads into the store: accepted files become documents of status 'uploaded', with a log row each; gives the rejected ones with their reason."""
    good = accepted(files).drop("content")
    rows = good.select("document_id", "filename", F.lit("unknown").alias("document_type"), F.lit("uploaded").alias("status"), "mime_type", "file_size", "storage_path", "created_at", F.current_timestamp().alias("updated_at"))
    store.replace("documents", rows)
    told = F.to_json(F.struct(F.col("filename").alias("original_filename"), "mime_type", "file_size", "storage_path"))
    store.log(_log(good, "upload", F.lit("completed"), F.lit("Document uploaded successfully"), told, F.current_timestamp()))
    return files.where("reject_reason IS NOT NULL").drop("content")


def preprocess(store: Store, files: DataFrame, provider: PageProvider | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Accepted files through the renderer: rendered once (the table of pages and errors is written and read again), then the status of each document and its
    log. Gives the pages (schemas.PAGES, with `image`). Documents that fail have the status 'failed' and no pages; others aren't touched by them."""
    good = accepted(files)
    starts = _log(good, "preprocessing", F.lit("started"), F.lit("Document preprocessing started"), F.lit(None).cast("string"), F.current_timestamp())
    store.log(starts)
    rendered = materialized(render(good, provider, s))
    ended = outcomes(rendered).join(ingest.route(good.drop("content")).select("document_id", "mime_type", (F.col("renderer") == "pdf").alias("is_pdf")), "document_id")
    failed = F.col("error").isNotNull()
    store.update_documents(ended.select("document_id", F.when(failed, "failed").otherwise("preprocessed").alias("status")))
    message = F.when(failed, F.concat(F.lit("Preprocessing failed: "), "error")).otherwise("Document preprocessing completed successfully")
    store.log(_log(ended, "preprocessing", F.when(failed, "failed").otherwise("completed"), message, F.when(~failed, F.to_json(F.struct("page_count", "mime_type", "is_pdf"))), F.current_timestamp()))
    return whole(rendered)
