"""A search index over fields: postings of names, values and normal forms, kept in a folder.

Strings are kept lower-cased and once each, named by their hash; a string's postings never change, so fields
that are replaced or deleted leave the index right: strings that no field has any more cost room and find
nothing. Postings lie in buckets by run of characters, and a search reads the buckets of its own runs.

Defined results: null and empty strings are not indexed and an empty text finds nothing (list the fields
instead); repeated texts of one query_id find once (fields must have no column of that name); a null query_id is one like others; a field of several
strings that hold a text is found once; repeated rows of fields are found each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.postings import bucket, candidates, named, postings

COLUMNS = ["field_name", "field_value", "normalized_value"]
BUCKETS = 64


class FieldIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """The number of buckets is part of what is stored: use the one that the folder was made with."""
        self.spark, self.path, self.buckets = spark, path, buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def strings(self) -> DataFrame:
        return self._read("strings", "text string, _id long")

    def posted(self) -> DataFrame:
        return self._read("postings", "gram string, _id long, bucket int")

    def add(self, fields: DataFrame) -> None:
        """Index the strings of fields that the index lacks. Postings are written first: a run that dies before the strings are leaves them to be
        written once more, and postings that are there twice change no result."""
        said = fields.select(F.explode(F.array(*(F.lower(c) for c in COLUMNS))).alias("text"))
        unseen = named(said, []).join(self.strings(), ["text", "_id"], "left_anti")
        made = postings(unseen, []).withColumn("bucket", bucket(F.col("gram"), self.buckets))
        made.repartition("bucket", F.pmod("_id", F.lit(8))).select("gram", "_id", "bucket").write.partitionBy("bucket").mode("append").parquet(f"{self.path}/postings")
        unseen.select("text", "_id").write.mode("append").parquet(f"{self.path}/strings")

    def find(self, texts: DataFrame) -> DataFrame:
        """sought, text: the strings of the index that hold each text (column sought), lower-cased."""
        own = texts.select(F.lower("sought").alias("sought")).where("sought <> ''").distinct()
        found = candidates(own, self.posted(), [], self.buckets).distinct()
        return found.join(self.strings().distinct(), "_id").where(F.col("text").contains(F.col("sought"))).select("sought", "text")

    def search(self, fields: DataFrame, queries: DataFrame, status: str = "all") -> DataFrame:
        """query_id and the fields found by queries (query_id, text): those whose name, value or normal form holds the text, of one status."""
        asked = queries.select("query_id", F.lower("text").alias("sought")).where("sought <> ''").distinct()
        hits = asked.join(self.find(asked), "sought").withColumnRenamed("text", "_said")
        of = {"all": F.lit(True), "valid": F.col("validation_status") == "valid", "review": F.col("validation_status") == "needs_review", "conflict": F.col("validation_status") == "conflict"}[status]
        rows = fields.where(of).select(F.struct(*fields.columns).alias("_row"), F.array(*(F.lower(c) for c in COLUMNS)).alias("_all"))
        found = rows.select("*", F.posexplode("_all").alias("_i", "_said")).join(hits, "_said")
        earlier = F.exists(F.slice("_all", F.lit(1), F.col("_i")), lambda x: F.coalesce(x.contains(F.col("sought")), F.lit(False)))
        return found.where(~earlier).select("query_id", "_row.*")
