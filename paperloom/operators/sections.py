"""Sections: answers cleaned, names held to the whitelist, boxes from the blocks they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, shortened, strip
from ..schemas import section_whitelist
from ..settings import DEFAULT, Settings
from .classify import clamped
from .layout import union_box

_ANSWER = "struct<sections:array<struct<section_name:string,text:string,page_number:string,confidence:string,block_ids:array<string>>>>"
TYPES = ["invoice", "onboarding_form"]


def prompts(blocks: DataFrame, classifications: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """document_id, prompt: the allowed names and all blocks with their numbers; only documents of a known type."""
    known = classifications.where(F.col("document_type").isin(TYPES)).select("document_id", "document_type")
    names = section_whitelist(blocks.sparkSession).groupBy("document_type").agg(F.array_join(F.array_sort(F.collect_list("section_name")), ", ").alias("names"))
    line = F.format_string("[%d:%d] %s", "page_number", "block_index", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "block_index", line.alias("t")))), lambda b: b["t"]), "\n")
    rows = blocks.join(known.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(joined.alias("t")).join(known, "document_id").join(F.broadcast(names), "document_type")
    return rows.select("document_id", shortened(F.concat(F.lit("Find these sections: "), "names", F.lit("\n\n"), "t"), s.section_chars, "\n[cut]").alias("prompt"))


def clean(responses: DataFrame) -> DataFrame:
    """One row a section in the order of the answer; without text there is no section."""
    rows = responses.where("stage = 'section_detection'").select("document_id", F.posexplode(F.from_json("response_json", _ANSWER)["sections"]).alias("section_ord", "s"))
    ids = F.filter(F.transform("s.block_ids", lambda b: b.try_cast("int")), lambda b: b.isNotNull())
    return rows.where(F.col("s").isNotNull() & ~blank(F.col("s.text"))).select(
        "document_id", "section_ord", F.lower(strip(F.col("s.section_name"))).alias("section_name"), F.coalesce(F.col("s.page_number").try_cast("int"), F.lit(1)).alias("page_number"), F.col("s.text").alias("text"),
        clamped(F.col("s.confidence"), 0.9, 0.8).alias("confidence"), F.coalesce(ids, F.array().cast("array<int>")).alias("block_ids"),
    )


def hold_to_whitelist(sections: DataFrame, classifications: DataFrame) -> DataFrame:
    """Sections of documents of a known type, names outside of its list as unknown."""
    known = classifications.where(F.col("document_type").isin(TYPES)).select("document_id", "document_type")
    listed = section_whitelist(sections.sparkSession).withColumn("_ok", F.lit(True))
    rows = sections.join(known, "document_id").join(F.broadcast(listed), ["document_type", "section_name"], "left")
    return rows.withColumn("section_name", F.when(F.col("_ok"), F.col("section_name")).otherwise("unknown")).drop("_ok")


def with_boxes(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections with the box around their blocks; blocks that a page doesn't have are dropped from block_ids."""
    own = sections.withColumn("section_id", F.sha2(F.concat_ws("|", "document_id", "section_ord", "section_name"), 256))
    named = own.select("document_id", "section_ord", "page_number", F.posexplode("block_ids").alias("_i", "block_index"))
    hit = named.join(blocks.select("document_id", "page_number", "block_index", "bbox.*"), ["document_id", "page_number", "block_index"])
    boxes = hit.groupBy("document_id", "section_ord").agg(union_box(1).alias("bbox"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "block_index"))), lambda b: b["block_index"]).alias("_ids"))
    return own.join(boxes, ["document_id", "section_ord"], "left").withColumn("block_ids", F.coalesce("_ids", F.array().cast("array<int>"))).drop("_ids")


def detect(responses: DataFrame, classifications: DataFrame, blocks: DataFrame) -> DataFrame:
    return with_boxes(hold_to_whitelist(clean(responses), classifications), blocks)
