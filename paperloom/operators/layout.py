"""OCR tokens to lines, pages and documents; boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from ..settings import DEFAULT, Settings


def clean_tokens(tokens: DataFrame) -> DataFrame:
    """Without blank words; confidence as a number, null where it is negative or none."""
    conf = F.col("conf").cast("string").try_cast("double")
    return tokens.where(~blank(F.col("text"))).withColumns({"text": strip(F.col("text")), "conf": F.when(conf >= 0, conf)})


def union_box(least: int | None = 1, x: str = "x", y: str = "y", width: str = "width", height: str = "height") -> Column:
    """The box around all boxes of a group, no side under `least`."""
    side = lambda a, n: F.max(F.col(a) + F.col(n)) - F.min(a)
    size = lambda a, n: F.greatest(F.lit(least), side(a, n)) if least is not None else side(a, n)
    box = F.struct(F.min(x).cast("int").alias("x"), F.min(y).cast("int").alias("y"), size(x, width).cast("int").alias("width"), size(y, height).cast("int").alias("height"))
    return F.when(F.count(x) > 0, box)


def lines(tokens: DataFrame) -> DataFrame:
    """One block a line (block, paragraph, line number), in reading order: by y, x, then first token; block_index from 0 on a page. Tokens are shuffled once, by page: lists of words don't shrink before a shuffle, and both the lines and their order need a page together. The shuffle goes by a hash of the page, which Spark knows again behind it even where page numbers are constant. What a line's tokens share is put side by side, which compresses better."""
    key = ["document_id", "page_number", "block_num", "par_num", "line_num"]
    tokens = clean_tokens(tokens).select(F.xxhash64("document_id", "page_number").alias("_page"), *key, "top", "height", "width", "left", "token_ord", "conf", "text")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_ord", "text"))), lambda t: t["text"]), " ")
    made = tokens.repartition("_page").groupBy("_page", *key).agg(words.alias("text"), F.round(F.avg("conf"), 2).alias("confidence"), union_box(1, "left", "top").alias("bbox"), F.min("token_ord").alias("_first"))
    order = Window.partitionBy("_page", "document_id", "page_number").orderBy("bbox.y", "bbox.x", "_first")
    return made.select("document_id", "page_number", (F.row_number().over(order) - 1).alias("block_index"), "text", "confidence", "bbox")


def page_texts(blocks: DataFrame) -> DataFrame:
    """The lines of each page, joined."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"]), "\n")
    return blocks.groupBy("document_id", "page_number").agg(text.alias("text"), F.count(F.lit(1)).alias("block_count"))


def document_texts(pages: DataFrame) -> DataFrame:
    """The pages of each document under their headings."""
    page = F.concat(F.lit("--- PAGE "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", page.alias("t")))), lambda p: p["t"]), "\n\n")
    return pages.groupBy("document_id").agg(strip(text).alias("full_text"), F.count(F.lit(1)).alias("page_count"))


def metrics(blocks: DataFrame) -> DataFrame:
    """Blocks, pages and the mean confidence of blocks, by document."""
    return blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("block_count"), F.countDistinct("page_number").alias("page_count"), F.round(F.avg(F.col("confidence").cast("decimal(10,2)")), 2).cast("double").alias("average_confidence"))


def crop_box(box: Column, width: Column, height: Column, s: Settings = DEFAULT) -> Column:
    """The box with padding, inside the page; null when nothing is left."""
    x0, y0 = F.greatest(F.lit(0), box["x"] - s.crop_padding), F.greatest(F.lit(0), box["y"] - s.crop_padding)
    x1, y1 = F.least(width, box["x"] + box["width"] + s.crop_padding), F.least(height, box["y"] + box["height"] + s.crop_padding)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), (x1 - x0).cast("int").alias("width"), (y1 - y0).cast("int").alias("height")))


def shrunk(width: Column, height: Column, s: Settings = DEFAULT) -> Column:
    """Size of a page image after shrinking to the largest side."""
    scale = F.least(F.lit(1.0), s.max_image_side / F.greatest(width, height))
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))
