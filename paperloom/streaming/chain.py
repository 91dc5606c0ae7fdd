"""The chain by micro-batch: documents with new rows are computed anew and replaced, each batch once.

A batch names the documents it has rows of. Only those are computed, from the tables as they are, and their rows
replace the old ones, so a batch that is repeated gives the same. After the last table a marker (query, batch) is
written; a batch with a marker is passed over, so one that a restart delivers again, after its writes and before its
commit, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import materialized
from ..sources.store import Store

MARKS = "query string, batch long"


class Upserts:
    """compute(documents) gives, for the documents of a batch (document_id), the new rows by table of the store."""

    def __init__(self, store: Store, name: str, compute: Callable[[DataFrame], dict[str, DataFrame]], keep: Callable[[DataFrame], None] | None = None):
        self.store, self.name, self.compute, self.keep = store, name, compute, keep

    @property
    def _marks(self) -> str:
        return f"{self.store.root}/_marks/{self.name}"

    def done(self, batch: int) -> bool:
        """Whether the batch has a marker: one small folder a batch is looked up, not all of them."""
        return self.store._there(f"_marks/{self.name}/batch={batch}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if self.done(batch):
            return
        documents = materialized(rows.select("document_id").where("document_id IS NOT NULL").distinct())
        if not documents.isEmpty():
            if self.keep:
                self.keep(rows)
            for table, made in self.compute(documents).items():
                self.store.replace(table, made, documents)
        self.mark(batch)

    def mark(self, batch: int) -> None:
        spark = self.store.spark
        spark.createDataFrame([(self.name, batch)], MARKS).select("query", F.col("batch").alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{self._marks}/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Everything that is there now, batch by batch."""
        return stream.writeStream.queryName(self.name).option("checkpointLocation", checkpoint).foreachBatch(self).trigger(availableNow=True).start()
