"""Queries that find: boxes by postings, fields for many texts, and totals kept by deltas; each with the same in SQL.

A turn of a conversation stands for a page and its lines for blocks; a part stands for a field.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import vision
from ..session import own_folder
from ..sources.overview import KeptOverview
from ..sources.search import FieldIndex
from .catalog import query, read

_BLOCKS = "SELECT conv_id, turn, i - 1 AS block_index, lower(l[i]) AS b FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(l) + 1)) AS i FROM conversations)"
_SOUGHT = "SELECT conv_id, turn, lower(replace(replace(substr(coalesce(text, ''), 5, 9), ' ', '-'), chr(10), '-')) AS t, lower(replace(replace(substr(coalesce(text, ''), 40, 4), ' ', ''), chr(10), '')) AS v FROM conversations"


@query(
    f"""WITH b AS (SELECT conv_id, turn, block_index, replace(b, ' ', '-') AS b FROM ({_BLOCKS})), f AS ({_SOUGHT})
SELECT f.conv_id || '-' || f.turn AS document_id, min(block_index)::INTEGER AS first_block, (max(block_index) - min(block_index) + 1)::INTEGER AS height
FROM f JOIN b ON f.conv_id = b.conv_id AND f.turn = b.turn AND ((t <> '' AND b <> '' AND (contains(b, t) OR contains(t, b))) OR (length(v) >= 3 AND contains(b, v))) GROUP BY ALL"""
)
def boxes_by_postings(spark, d):
    """The lines of a turn that hold a piece of it, each turn by postings however few lines it has; blanks are dashes, so that nothing is trimmed."""
    said = F.coalesce("text", F.lit(""))
    rows = read(spark, d, "conversations", "conv_id", "turn", "text").select(F.concat_ws("-", "conv_id", "turn").alias("document_id"), F.lit(1).alias("page_number"), said.alias("said"))
    lines = rows.select("document_id", "page_number", F.posexplode(F.split("said", "\n")).alias("block_index", "text"))
    box = F.struct(F.lit(0).alias("x"), F.col("block_index").alias("y"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    blocks = lines.select("document_id", "page_number", "block_index", F.translate("text", " ", "-").alias("text"), box.alias("bbox"))
    source, value = F.translate(F.substring("said", 5, 9), " \n", "--"), F.regexp_replace(F.substring("said", 40, 4), "[ \n]", "")
    fields = rows.select("document_id", "page_number", F.lit(1).alias("field_ord"), F.lit("none").alias("section_name"), source.alias("source_text"), value.alias("field_value"))
    sections = spark.createDataFrame([], "document_id string, page_number int, section_ord int, section_name string, block_ids array<int>, bbox struct<x:int,y:int,width:int,height:int>")
    return vision.locate(fields, blocks, sections, many=0).where("crop IS NOT NULL").select("document_id", F.col("crop.y").alias("first_block"), F.col("crop.height").alias("height"))


_TEXTS = "SELECT DISTINCT s FROM (SELECT lower(substr(c_mktsegment, 1, k)) AS s FROM customer, (SELECT unnest([2, 3, 5]) AS k) UNION ALL SELECT lower(r_name) FROM region UNION ALL SELECT lower(substr(p_type, 2, 4)) FROM part UNION ALL SELECT lower(right(p_name, 3)) FROM part) WHERE s <> ''"


@query(f"SELECT s AS query_id, p_partkey FROM part, ({_TEXTS}) WHERE p_partkey % 4 <> 0 AND (contains(lower(p_name), s) OR contains(lower(p_type), s) OR contains(CAST(p_size AS VARCHAR), s))")
def field_search_many(spark, d):
    """All texts of a table sought in all fields at once, by an index that is made in two steps."""
    rows = read(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size")
    status = F.when(F.col("p_partkey") % 4 == 0, "conflict").otherwise("valid")
    fields = rows.select("p_partkey", F.col("p_name").alias("field_name"), F.col("p_type").alias("field_value"), F.col("p_size").cast("string").alias("normalized_value"), status.alias("validation_status"))
    parts = [read(spark, d, "customer", "c_mktsegment").select(F.substring("c_mktsegment", 1, k).alias("text")) for k in (2, 3, 5)]
    parts += [read(spark, d, "region", "r_name").toDF("text"), rows.select(F.substring("p_type", 2, 4).alias("text")), rows.select(F.expr("right(p_name, 3)").alias("text"))]
    texts = parts[0]
    for part in parts[1:]:
        texts = texts.unionByName(part)
    index = FieldIndex(spark, f"{own_folder(spark)}/index-{uuid.uuid4().hex}", 8)
    for step in (fields.where("p_partkey % 2 = 0"), fields):
        index.add(step)
    asked = texts.select(F.lower("text").alias("query_id"), "text").distinct()
    return index.search(fields, asked, "valid").select("query_id", "p_partkey")


_KEPT = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'completed' ELSE lower(o_orderstatus) END AS status_text, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_orderkey % 4 END AS pages, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 100 AS DECIMAL(18,6)) END AS c, o_orderkey % 11 AS valid FROM orders WHERE o_orderkey % 5 <> 0"


@query(f"SELECT status_text, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(valid) AS BIGINT) AS valid, CAST(coalesce(sum(c), 0) AS DOUBLE) AS confidence, count(c) AS with_confidence FROM ({_KEPT}) GROUP BY status_text")
def overview_totals(spark, d):
    """Totals after three batches: all documents, a third of them replaced (twice, as after a failure), a fifth removed."""
    k = F.col("o_orderkey")
    zero = F.lit(0).alias
    rows = read(spark, d, "orders", "o_orderkey", "o_orderstatus").select(k.cast("string").alias("document_id"), F.lower("o_orderstatus").alias("status_text"), (k % 4).alias("pages"), F.when(k % 7 != 0, k % 100).alias("average_confidence"), (k % 11).alias("valid"), zero("conflicts"), zero("needs_review"))
    number = F.col("document_id").cast("long")
    changed = rows.where(number % 3 == 0).withColumns({"status_text": F.lit("completed"), "pages": F.lit(5)})
    kept = KeptOverview(spark, f"{own_folder(spark)}/overview-{uuid.uuid4().hex}")
    kept.apply(1, rows)
    for _ in range(2):
        kept.apply(2, changed)
    kept.apply(3, rows.limit(0), rows.where(number % 5 == 0).select("document_id"))
    return kept.totals().select("status_text", "documents", "pages", "valid", F.col("confidence").cast("double").alias("confidence"), "with_confidence")
