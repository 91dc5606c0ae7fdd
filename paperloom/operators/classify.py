"""What a classifier is shown, and what its answer comes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shortened, strip
from ..schemas import DOCUMENT_TYPES
from ..settings import DEFAULT, Settings

_ANSWER = "struct<document_type:string,confidence:string,evidence:string>"


def select_pages(pages: DataFrame) -> DataFrame:
    """All of up to three pages; of more, the first, the second and the last."""
    w = Window.partitionBy("document_id")
    rank = F.row_number().over(w.orderBy("page_number"))
    return pages.withColumns({"_r": rank, "_n": F.count(F.lit(1)).over(w)}).where("_n <= 3 OR _r <= 2 OR _r = _n").drop("_r", "_n")


def prompts(blocks: DataFrame, pages: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """document_id, prompt: up to 20 blocks (or 1200 characters) of each selected page, cut to the limit."""
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda b: F.concat(F.lit("- "), b["text"])), "\n")
    tops = blocks.where("block_index < 20").groupBy("document_id", "page_number").agg(head.alias("blocks"))
    shown = select_pages(pages).join(tops, ["document_id", "page_number"], "left")
    body = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(":\n"), F.coalesce("blocks", F.substring(F.coalesce("text", F.lit("")), 1, 1200)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", body.alias("t")))), lambda p: p["t"]), "\n\n")
    ask = "Name the type of this document (invoice, onboarding_form or unknown), your confidence from 0 to 1, and the evidence.\n\n"
    return shown.groupBy("document_id").agg(joined.alias("t")).select("document_id", shortened(F.concat(F.lit(ask), "t"), s.classify_chars, "\n[cut]").alias("prompt"))


def clamped(c: Column, default: float | None, bad: float | None) -> Column:
    """A confidence inside 0..1; `default` if absent, `bad` if no number."""
    n = c.try_cast("double")
    fit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), n))
    return F.when(c.isNull(), F.lit(default).cast("double")).when(n.isNull() | F.isnan(n), F.lit(bad).cast("double")).otherwise(fit)


def texts(raw: Column) -> Column:
    """A JSON list of texts without blanks; one text is a list of one, anything else is none."""
    listed = F.from_json(raw, "array<string>")
    many = F.filter(F.transform(listed, strip), lambda x: x.isNotNull() & (x != ""))
    one = F.when(~strip(raw).rlike(r"^[\[{]") & (strip(raw) != ""), F.array(strip(raw)))
    return F.coalesce(F.when(strip(raw).startswith("["), many), one, F.array().cast("array<string>"))


def clean(responses: DataFrame) -> DataFrame:
    """Answers of stage classification: type in the domain, confidence in 0..1, evidence a list."""
    a = F.from_json("response_json", _ANSWER)
    kind = F.lower(strip(a["document_type"]))
    rows = responses.where("stage = 'classification'")
    return rows.select("document_id", F.when(kind.isin(DOCUMENT_TYPES), kind).otherwise("unknown").alias("raw_document_type"), clamped(a["confidence"], 0.0, 0.0).alias("confidence"), texts(a["evidence"]).alias("evidence"))


def apply_threshold(answers: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """document_type is unknown below the threshold, with a line of evidence that says so."""
    low = (F.col("raw_document_type") != "unknown") & (F.col("confidence") < s.classification_threshold)
    said = F.format_string(f"Confidence (%.2f) was below threshold ({s.classification_threshold:.2f}); marked as unknown.", "confidence")
    return answers.select(
        "document_id", "raw_document_type", F.when(low, "unknown").otherwise(F.col("raw_document_type")).alias("document_type"), "confidence",
        F.when(low, F.concat("evidence", F.array(said))).otherwise(F.col("evidence")).alias("evidence"), low.alias("below_threshold"),
    )


def classify(responses: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return apply_threshold(clean(responses), s)
