"""Answers about sections to long rows of fields, each with its confidence and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import LIST_SECTIONS, NUMBER_FIELDS, SECTION_FIELDS
from . import answers as checks

_ONE = "map<string,struct<value:string,confidence:double,source_text:string>>"
_MANY = "array<map<string,string>>"


def gate(sections: DataFrame) -> DataFrame:
    """Sections with fields to look for and at least five characters of text."""
    known = sections.sparkSession.createDataFrame([(*k, v) for k, v in SECTION_FIELDS.items()], "document_type string, section_name string, names array<string>")
    return sections.join(F.broadcast(known), ["document_type", "section_name"]).where(F.length(strip(F.col("text"))) >= 5)


def prompts(sections: DataFrame) -> DataFrame:
    """One prompt a section, with that section's text and fields alone."""
    said = F.format_string("From this %s section (%s, page %d) give the value, confidence and source text of: %s\n\n%s", "section_name", "document_type", "page_number", F.array_join("names", ", "), "text")
    return gate(sections).select("document_id", F.col("section_id").alias("item_key"), said.alias("prompt"))


def checked(sections: DataFrame, responses: DataFrame) -> DataFrame:
    """The answers about sections, held against their schemas, unless that is done; see answers.check."""
    return responses if "error_path" in responses.columns else checks.check(gate(sections), responses)


def _passed(sections: DataFrame, responses: DataFrame) -> DataFrame:
    """The sections whose answers hold, with response_json."""
    if "error_path" not in responses.columns:
        return checks.passed(gate(sections), responses)
    return gate(sections).join(responses.where("error IS NULL").select("document_id", F.col("item_key").alias("section_id"), "response_json"), ["document_id", "section_id"])


def fields(sections: DataFrame, responses: DataFrame) -> DataFrame:
    """Unpivoted fields in the order of sections, items and the registry; fields without a value are kept as null. Sections whose answer fails its schema give none."""
    spark = sections.sparkSession
    rows = _passed(sections, responses)
    lists = spark.createDataFrame([(k, *v) for k, v in LIST_SECTIONS.items()], "section_name string, list_key string, prefix string")
    rows = rows.join(F.broadcast(lists), "section_name", "left")
    keep, one = ["document_id", "document_type", "section_id", "section_ord", "section_name", "page_number", "prefix"], F.col("prefix").isNull()
    # sections of one item and of many go one way, so that an answer is held against its schema once
    many = F.from_json(F.expr("get_json_object(response_json, concat('$.', list_key))"), _MANY)
    items = F.when(one, F.array(F.lit(None).cast("map<string,string>"))).otherwise(many)
    rows = rows.select(*keep, "names", F.when(one, F.from_json("response_json", _ONE)).alias("s"), F.posexplode(items).alias("item", "m"))
    rows = rows.select(*keep, "item", "s", "m", F.posexplode("names").alias("at", "name"))
    value, of = F.try_element_at("s", F.col("name")), lambda k: F.try_element_at("m", F.lit(k))
    told = F.when(one, value["value"]).otherwise(F.try_element_at("m", F.col("name")))
    sure = F.when(one, value["confidence"]).otherwise(of("confidence").try_cast("double"))
    rows = rows.select(*keep, "item", "at", F.when(one, F.col("name")).otherwise(F.concat_ws("_", "prefix", (F.col("item") + 1).cast("string"), "name")).alias("field_name"), told.alias("field_value"), sure.alias("confidence"), F.when(one, value["source_text"]).otherwise(of("source_text")).alias("source_text"))
    order = Window.partitionBy("document_id").orderBy("section_ord", "item", "at")
    name = F.regexp_replace("field_name", r"^(line_item|id_doc|agreement)_\d+_", "")
    kind = F.when(F.col("field_value").isNull(), "null").when(name.isin(NUMBER_FIELDS), "number").when(name == "accepted", "bool").otherwise("string")
    out = rows.withColumn("field_ord", F.row_number().over(order))
    return out.select("document_id", "document_type", "field_ord", F.sha2(F.concat_ws("|", "document_id", "field_ord", "field_name"), 256).alias("field_id"), "section_id", "field_name", "field_value", kind.alias("value_kind"), "confidence", F.lit("model").alias("source"), "source_text", "section_name", "page_number")


def counters(sections: DataFrame, responses: DataFrame, made: DataFrame) -> DataFrame:
    """Sections processed, those that failed, and fields, by document."""
    asked = gate(sections).select("document_id", F.col("section_id").alias("item_key"), "section_name", "section_ord")
    state = asked.join(checked(sections, responses).select("document_id", "item_key", "response_json", "error"), ["document_id", "item_key"], "left")
    ok = F.col("error").isNull() & F.col("response_json").isNotNull()
    out = state.groupBy("document_id").agg(F.count_if(ok).alias("sections_processed"), F.transform(F.array_sort(F.collect_list(F.when(~ok, F.struct("section_ord", "section_name")))), lambda x: x["section_name"]).alias("failed_sections"))
    return out.join(made.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_fields")), "document_id", "left").fillna(0, ["total_fields"])


def section_data(sections: DataFrame, responses: DataFrame) -> DataFrame:
    """The answers of each document by section name: of sections that share one, the last in order stays. Sections that fail are left out."""
    return _passed(sections, responses).groupBy("document_id", "section_name").agg(F.max_by("response_json", "section_ord").alias("section_data"))
