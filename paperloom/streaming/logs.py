"""Structured Streaming over the audit log and events: windowed counts, latest status, replacement by document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit
from ..schemas import LOGS


def read_logs(spark: SparkSession, path: str, schema: str = LOGS, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def windowed_counts(logs: DataFrame, every: str = "1 hour", late: str = "1 hour", time: str = "created_at", *by: str) -> DataFrame:
    """Rows in tumbling windows by these columns; rows later than the watermark are dropped in a stream."""
    rows = logs.withWatermark(time, late) if logs.isStreaming else logs
    out = rows.groupBy(F.window(time, every), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n")


def latest_status(logs: DataFrame) -> DataFrame:
    """The last status of each document, kept as state: one small row a document."""
    return audit.latest_status(logs)


def _sides(logs: DataFrame, late: str) -> tuple[DataFrame, DataFrame]:
    """Starts and ends. The watermark stands before they part: any row of the log moves it for both."""
    rows = logs.withWatermark("created_at", late) if logs.isStreaming else logs
    rows = rows.select("document_id", "stage", "created_at", "status")
    return rows.where("status = 'started'").drop("status"), rows.where("status IN ('completed', 'failed')")


def _unmatched(rows: DataFrame, others: DataFrame, near: Column) -> DataFrame:
    """Rows r without a row o of the same document and stage that is near. In a stream they come out once the watermark says that none can follow."""
    same = (F.col("r.document_id") == F.col("o.document_id")) & (F.col("r.stage") == F.col("o.stage")) & near
    if not rows.isStreaming:
        return rows.alias("r").join(others.alias("o"), same, "left_anti").select("r.*")
    both = rows.alias("r").join(others.alias("o"), same, "left_outer")
    return both.where("o.document_id IS NULL").select("r.*")


def stalled(logs: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Starts of stages that no end follows within this time: document_id, stage, created_at."""
    starts, ends = _sides(logs, late)
    after = F.col("o.created_at").between(F.col("r.created_at"), F.col("r.created_at") + F.expr(f"INTERVAL {within}"))
    return _unmatched(starts, ends, after)


def orphans(logs: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Ends of stages that no start precedes within this time: document_id, stage, created_at, status."""
    starts, ends = _sides(logs, late)
    before = F.col("o.created_at").between(F.col("r.created_at") - F.expr(f"INTERVAL {within}"), F.col("r.created_at"))
    return _unmatched(ends, starts, before)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Everything that is there now, batch by batch; each(rows, batch number) must give the same when repeated."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
