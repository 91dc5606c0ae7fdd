"""Tables of documents in folders of Parquet, partitioned by a bucket of document_id.

Replacing the rows of some documents rewrites only the buckets they fall in, by Spark's dynamic partition
overwrite: the job's output takes the place of those buckets when it is committed, and reads of the rest go on. Only
touched buckets are read for it (the plan's partition filter names them). A bucket that was replaced holds one row
without a document, so that it is written, and so emptied, when nothing is left in it; reads leave such rows out.
Every write can be repeated with the same result. One writer at a time is assumed. The number of buckets
is the store's own, kept when it is first written: choose it so that a bucket is about a GB, as that is what the
change of one document rewrites. Works on any file system that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.normalize import action_key
from ..operators import changes

BUCKETS = 64
SOURCES = ["model", "ocr", "vision_fallback", "ocr+vision", "validation", "manual", "database"]
_ORDER = {"sections": "page_number", "actions": "created_at", "fields": "field_ord", "logs": "created_at"}


class Store:
    """documents, sections, fields, actions, logs, the changes of actions, and stage artifacts under one root."""

    TABLES = {"documents": schemas.DOCUMENTS, "sections": schemas.SECTIONS, "fields": schemas.FIELDS, "actions": schemas.ACTIONS, "logs": schemas.LOGS, "action_changes": changes.CHANGES}

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), dict(self.TABLES)
        self.buckets = self.spark.read.parquet(f"{self.root}/_buckets").first()[0] if self._there("_buckets") else buckets

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _there(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)

    def exists(self, table: str) -> bool:
        return self._there(table)

    def bucket(self, document_id: Column | str = "document_id") -> Column:
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def _rows(self, table: str) -> DataFrame:
        """All rows with their bucket, which is a partition of the files."""
        kinds = f"{self.tables[table]}, bucket int"
        if not self.exists(table):
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(self._path(table)).where("document_id IS NOT NULL")

    def read(self, table: str) -> DataFrame:
        return self._rows(table).drop("bucket")

    def get(self, table: str, document_id: str) -> DataFrame:
        """One document's rows: only its bucket is read."""
        own = self._rows(table).where((F.col("bucket") == self.bucket(F.lit(document_id))) & (F.col("document_id") == document_id)).drop("bucket")
        return own.orderBy(_ORDER[table]) if table in _ORDER else own

    def _write(self, table: str, rows: DataFrame, mode: str) -> None:
        if not self._there("_buckets"):
            self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(self._path("_buckets"))
        # one file a bucket where buckets are small, more where they are large
        rows.hint("rebalance", "bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        self._write(table, rows.where("document_id IS NOT NULL").withColumn("bucket", self.bucket()), "append")

    def replace(self, table: str, rows: DataFrame, documents: DataFrame | None = None) -> None:
        """Rows in place of all rows of their documents, or of `documents` (document_id)."""
        names = [c.name for c in self.spark.createDataFrame([], self.tables[table]).schema]
        ids = (documents if documents is not None else rows).select("document_id").where("document_id IS NOT NULL").distinct().withColumn("bucket", self.bucket())
        touched = sorted(r[0] for r in ids.select("bucket").distinct().collect())  # at most self.buckets
        if not touched:
            return
        own = rows.where("document_id IS NOT NULL").withColumn("bucket", self.bucket())
        old = self.touched(table, touched).join(ids.select("document_id"), "document_id", "left_anti")
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(*(F.lit(None).alias(c) for c in names), "bucket")
        new = own.select(*(F.col(c) if c in own.columns else F.lit(None).alias(c) for c in names), "bucket")
        kinds = self.spark.createDataFrame([], f"{self.tables[table]}, bucket int").schema
        self._write(table, old.select(*names, "bucket").unionByName(new.to(kinds)).unionByName(marks.to(kinds)), "overwrite")

    def touched(self, table: str, buckets: list[int]) -> DataFrame:
        """The rows of these buckets, whose files alone are read."""
        rows = self._rows(table)
        return rows if len(buckets) == self.buckets else rows.where(F.col("bucket").isin(buckets))

    def save_sections(self, sections: DataFrame) -> None:
        self.replace("sections", sections.withColumn("confidence", F.round("confidence", 4)))

    def save_fields(self, fields: DataFrame) -> None:
        known = F.when(F.col("source").isin(SOURCES), F.col("source")).otherwise("model")
        self.replace("fields", fields.withColumns({"confidence": F.round("confidence", 4), "source": known}))

    def save_actions(self, actions: DataFrame) -> None:
        """Of actions with one key the last; empty ones are left out, unknown priorities become medium, and statuses that users have set before stay, as does the id."""
        rows = actions.where(F.trim(F.coalesce("action", F.lit(""))) != "").withColumn("priority", F.when(F.col("priority").isin(schemas.ACTION_PRIORITIES), F.col("priority")).otherwise("medium"))
        one = rows.groupBy("document_id", action_key(F.col("action")).alias("_k")).agg(F.max_by(F.struct(*rows.columns), "action_ord").alias("r")).select("_k", "r.*")
        ids = actions.select("document_id").distinct()
        old = self.read("actions").join(ids, "document_id", "left_semi").groupBy("document_id", action_key(F.col("action")).alias("_k")).agg(F.max_by(F.struct("action_id", "status", "created_at"), "action_ord").alias("o"))
        rows = one.join(old, ["document_id", "_k"], "left")
        status = F.when(F.col("o.status").isin(changes.KEPT), F.col("o.status")).otherwise(F.coalesce("status", F.lit("pending")))
        made = rows.withColumns({"status": status, "action_id": F.coalesce("o.action_id", "action_id"), "created_at": F.coalesce("o.created_at", "created_at")}).drop("_k", "o")
        self.replace("actions", made, ids)

    def record(self, rows: DataFrame) -> None:
        """Append to the log of changes of actions (changes.CHANGES)."""
        self.append("action_changes", rows)

    def update_action_status(self, rows: DataFrame) -> DataFrame:
        """Edits of users (document_id, action, status, at): they go to the log, the actions of their documents are made anew from it, and edits that match nothing are given back, with the reason."""
        self.record(changes.edits(rows))
        return self.settle(rows.select("document_id").distinct())

    def settle(self, documents: DataFrame) -> DataFrame:
        """The actions of these documents, from the log of their changes; gives the edits that had no effect (changes.errors)."""
        ids = documents.select("document_id").distinct().withColumn("bucket", self.bucket())
        touched = sorted(r[0] for r in ids.select("bucket").distinct().collect())
        log = self.touched("action_changes", touched).drop("bucket").join(ids.select("document_id"), "document_id", "left_semi")
        folded = changes.fold(log)
        self.replace("actions", changes.actions(folded), ids)
        return changes.errors(changes.fold(log))

    def update_documents(self, updates: DataFrame, nulls: bool = False) -> None:
        """updates (document_id and some columns): new values where they aren't null, or with `nulls` all of them. A status outside of the domain is an error."""
        if "status" in updates.columns and not updates.where(~F.col("status").isin(schemas.STATUSES)).isEmpty():
            raise ValueError("a status outside of the domain")
        names = [c for c in updates.columns if c != "document_id"]
        new = updates.select("document_id", *(F.col(c).alias(f"_{c}") for c in names))
        touched = sorted(r[0] for r in updates.select(self.bucket().alias("b")).distinct().collect())
        rows = self.touched("documents", touched).drop("bucket").join(new, "document_id")
        self.replace("documents", rows.withColumns({c: F.col(f"_{c}") if nulls else F.coalesce(f"_{c}", c) for c in names} | {"updated_at": F.current_timestamp()}).drop(*(f"_{c}" for c in names)))

    def delete_documents(self, ids: DataFrame) -> None:
        """Documents with their sections, fields, actions and logs."""
        for t in self.tables:
            if self.exists(t):
                self.replace(t, self.spark.createDataFrame([], self.tables[t]), ids)

    def log(self, rows: DataFrame) -> None:
        self.append("logs", rows)

    def _artifacts(self, stage: str) -> str:
        self.tables[f"artifacts_{stage}"] = "document_id string, stage string, body string"
        return f"artifacts_{stage}"

    def write_artifact(self, stage: str, rows: DataFrame) -> None:
        """One JSON text a document and stage, in place of the one before."""
        self.replace(self._artifacts(stage), rows.select("document_id", F.lit(stage).alias("stage"), F.to_json(F.struct(*rows.columns)).alias("body")))

    def artifacts(self, stage: str) -> DataFrame:
        """document_id and the text that a stage has left, as precedence.merge takes it."""
        return self.read(self._artifacts(stage)).select("document_id", "body")

    def read_artifact(self, stage: str, schema: str) -> DataFrame:
        """document_id and the parsed body; error where the text is corrupt."""
        bad = F.when(F.expr("try_parse_json(body)").isNull(), "corrupt")
        return self.artifacts(stage).select("document_id", F.from_json("body", schema).alias("a"), bad.alias("error"))

    def fields_or_table(self, artifact: DataFrame, documents: DataFrame) -> DataFrame:
        """The artifact's fields; for documents without any, rows of the table with section 'database' and page 1."""
        table = self.read("fields").join(documents.select("document_id"), "document_id", "left_semi").join(artifact.select("document_id").distinct(), "document_id", "left_anti")
        none = {c: F.lit(None).cast("string") for c in ("normalized_value", "validation_status", "validation_message")}
        return artifact.unionByName(table.withColumns({"section_name": F.lit("database"), "page_number": F.lit(1), **none}), allowMissingColumns=True)
