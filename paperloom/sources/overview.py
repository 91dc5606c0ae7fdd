"""Totals over the overview of all documents, kept by deltas: what a batch replaces is subtracted, what it brings is added.

Two Parquet folders hold a part for each batch: `rows` the batch's rows of the overview (or that a document is
gone), `deltas` the change of the totals. A batch's delta depends on it and on earlier batches alone, so a batch
that is repeated after a failure at any point writes the same parts again and changes nothing. Batches are
numbered and applied in order; one earlier than the last is refused, as later deltas rest on it.

A batch reads the ids of the history and the rows of its own documents; totals read the deltas, which have a
row for each status and batch. Confidences are summed as decimals, so that adding and subtracting is exact.

Defined results: a document that a batch has twice counts once, by its greatest row, and one that is both
there and gone is there; a null id is ignored, as is a removal of what isn't there; null counts are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ["pages", "valid", "conflicts", "needs_review"]
ROWS = "document_id string, status_text string, pages long, average_confidence decimal(18,6), valid long, conflicts long, needs_review long"
SUMS = ["documents", *COUNTS, "confidence", "with_confidence"]
DELTAS = "status_text string, documents long, pages long, valid long, conflicts long, needs_review long, confidence decimal(38,6), with_confidence long"


def totals(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Sums by status_text of rows of the overview, times sign."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)) * sign).cast("long")
    conf = F.col("average_confidence").cast("decimal(18,6)")
    confidence = F.sum(F.coalesce(conf, F.lit(0).cast("decimal(18,6)")) * sign).cast("decimal(38,6)")
    return rows.groupBy("status_text").agg(total(F.lit(1)).alias("documents"), *(total(F.col(c)).alias(c) for c in COUNTS), confidence.alias("confidence"), total(conf.isNotNull().cast("int")).alias("with_confidence"))


def summed(deltas: DataFrame) -> DataFrame:
    """Deltas added up; what comes to no documents is left out."""
    rows = deltas.groupBy("status_text").agg(*(F.sum(c).cast("decimal(38,6)" if c == "confidence" else "long").alias(c) for c in SUMS))
    return rows.where("documents <> 0")


class KeptOverview:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        schema += ", batch long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def _history(self) -> DataFrame:
        return self._read("rows", f"{ROWS}, gone boolean")

    def _latest(self, history: DataFrame) -> DataFrame:
        names = [c for c in history.columns if c not in ("document_id", "batch")]
        last = history.groupBy("document_id").agg(F.max_by(F.struct(*names), "batch").alias("_l"))
        return last.select("document_id", "_l.*").where("NOT gone").drop("gone")

    def apply(self, batch: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Replace the documents of rows (columns of the overview) and remove those of gone (document_id)."""
        last = self._history().agg(F.max("batch")).first()[0]
        if last is not None and batch < last:
            raise ValueError(f"batch {batch} comes after batch {last}")
        schema = self.spark.createDataFrame([], ROWS).schema
        new = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema), F.lit(False).alias("gone"))
        if gone is not None:
            new = new.unionByName(gone.select("document_id", F.lit(True).alias("gone")), allowMissingColumns=True)
        names = [c for c in new.columns if c not in ("document_id", "gone")]
        one = new.where("document_id IS NOT NULL").groupBy("document_id").agg(F.max(F.struct((~F.col("gone")).alias("here"), *names)).alias("_m"))
        one.select("document_id", *(F.col("_m")[c].alias(c) for c in names), (~F.col("_m.here")).alias("gone")).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        history = self._history()
        mine = history.where(F.col("batch") == batch)
        before = self._latest(history.where(F.col("batch") < batch).join(mine.select("document_id"), "document_id", "left_semi"))
        change = totals(mine.where("NOT gone")).unionByName(totals(before, -1))
        summed_ = change.groupBy("status_text").agg(*(F.sum(c).cast("decimal(38,6)" if c == "confidence" else "long").alias(c) for c in SUMS))
        summed_.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

    def rows(self) -> DataFrame:
        """The overview as it is after all batches."""
        return self._latest(self._history())

    def totals(self) -> DataFrame:
        return summed(self._read("deltas", DELTAS).drop("batch"))
