"""The audit log: latest status, stage durations, counts, and the stepper of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import STAGES
from .machine import order


def last_row() -> Column:
    """The last row of a group of log rows: by time, then by stage number, then ends after starts."""
    at, number, stage, ended, status = order(F.col("stage"), F.col("status"), F.col("created_at"))
    return F.max(F.struct(at.alias("created_at"), number.alias("_n"), stage.alias("stage"), ended.alias("_e"), status.alias("status")))


def latest_status(logs: DataFrame) -> DataFrame:
    """Stage, status and time of the last log row of each document; of rows of the same instant the later stage counts, and its end before its start."""
    return logs.groupBy("document_id").agg(last_row().alias("l"), F.count(F.lit(1)).alias("log_rows")).select("document_id", "l.stage", "l.status", "l.created_at", "log_rows")


def attempts(logs: DataFrame) -> DataFrame:
    """Every attempt of a stage: document_id, stage, attempt, started_at, ended_at, outcome, repeats, seconds.

    A start opens an attempt, and the first end after it closes it (outcome completed or failed); further ends are counted as repeats.
    An attempt without an end is open if it is the last, else abandoned. Ends before any start are attempt 0, an orphan. Equal rows
    count once; at equal times a start comes first. One shuffle, by document and stage; windows run along the sorted rows and hold none of them."""
    ended = F.col("status").isin("completed", "failed")
    rows = logs.where("status IN ('started', 'completed', 'failed')").select("document_id", "stage", "status", "created_at", ended.alias("_e"))
    by = Window.partitionBy("document_id", "stage").orderBy("created_at", "_e", "status")
    again = F.coalesce((F.lag("status").over(by) == F.col("status")) & (F.lag("created_at").over(by) == F.col("created_at")), F.lit(False))
    rows = rows.withColumn("_again", again).where("NOT _again")
    rows = rows.withColumn("attempt", F.count_if(~F.col("_e")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    first_end = F.min(F.when(F.col("_e"), F.struct("created_at", "status"))).alias("e")
    out = rows.groupBy("document_id", "stage", "attempt").agg(F.min(F.when(~F.col("_e"), F.col("created_at"))).alias("started_at"), first_end, F.greatest(F.count_if("_e") - 1, F.lit(0)).alias("repeats"))
    last = F.max("attempt").over(Window.partitionBy("document_id", "stage"))
    outcome = F.when(F.col("attempt") == 0, "orphan").otherwise(F.coalesce("e.status", F.when(F.col("attempt") == last, "open").otherwise("abandoned")))
    seconds = (F.unix_micros("e.created_at") - F.unix_micros("started_at")) / 1e6
    return out.select("document_id", "stage", "attempt", "started_at", F.col("e.created_at").alias("ended_at"), outcome.alias("outcome"), "repeats", seconds.alias("seconds"))


def stage_durations(logs: DataFrame) -> DataFrame:
    """First start, last end, attempts, failures, and the seconds that all attempts took, of each document's stages."""
    end = F.max(F.when(F.col("status").isin("completed", "failed"), F.col("created_at")))
    ends = logs.groupBy("document_id", "stage").agg(end.alias("ended_at"))
    tried = attempts(logs).groupBy("document_id", "stage").agg(F.min("started_at").alias("started_at"), F.count_if(F.col("attempt") > 0).alias("attempts"), F.count_if(F.col("outcome") == "failed").alias("failures"), F.sum("seconds").alias("seconds"))
    return ends.join(tried, ["document_id", "stage"], "left").fillna(0, ["attempts", "failures"]).select("document_id", "stage", "started_at", "ended_at", "attempts", "failures", "seconds")


def stage_totals(logs: DataFrame) -> DataFrame:
    """Attempts by outcome, and their seconds, of each stage."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(f"n_{o}")
    return attempts(logs).groupBy("stage").agg(*map(n, ("completed", "failed", "open", "abandoned", "orphan")), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))


def counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("documents"))


def status_of(stage: Column, status: Column) -> Column:
    """The document status that a stage's log row puts it in."""
    doing = {"upload": "uploaded", "preprocessing": "preprocessing", "ocr": "ocr", "classification": "ocr_completed", "section_detection": "classified", "extraction": "extracting", "normalization": "validating", "validation": "validating"}
    done = {"upload": "uploaded", "preprocessing": "preprocessed", "ocr": "ocr_completed", "classification": "classified", "section_detection": "sectioned", "extraction": "extracted", "normalization": "validating"}
    at = lambda m: F.try_element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), stage)
    return F.when(status == "failed", "failed").when(status == "started", at(doing)).when(status == "completed", at(done))


def stepper(documents: DataFrame, logs: DataFrame) -> DataFrame:
    """One row a document and stage: pending, active, completed, failed or skipped (stages after classification of unknown documents)."""
    state = logs.groupBy("document_id", "stage").agg(F.max_by("status", F.struct("created_at", F.col("status").isin("completed", "failed"), "status")).alias("_s"))
    rows = documents.select("document_id", "document_type", F.posexplode(F.array(*map(F.lit, STAGES))).alias("step", "stage")).join(state, ["document_id", "stage"], "left")
    late = (F.col("document_type") == "unknown") & (F.col("step") > STAGES.index("classification"))
    shown = F.when(late, "skipped").when(F.col("_s") == "started", "active").when(F.col("_s").isin("completed", "failed", "skipped"), F.col("_s")).otherwise("pending")
    return rows.select("document_id", "step", "stage", shown.alias("state"))


def overview(documents: DataFrame, validated: DataFrame, ocr: DataFrame) -> DataFrame:
    """One row a document: status text, pages, OCR confidence and counts of fields by status."""
    n = lambda st: F.count_if(F.col("validation_status") == st)
    by = validated.groupBy("document_id").agg(n("valid").alias("valid"), n("conflict").alias("conflicts"), n("needs_review").alias("needs_review"))
    rows = documents.join(ocr.select("document_id", "page_count", "average_confidence"), "document_id", "left").join(by, "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("document_id", F.regexp_replace("status", "^([^_]*)_", "$1 ").alias("status_text"), F.coalesce("page_count", F.lit(1)).alias("pages"), "average_confidence", zero("valid"), zero("conflicts"), zero("needs_review"))
