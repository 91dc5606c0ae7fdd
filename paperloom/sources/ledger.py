"""A ledger of answers: equal prompts are asked once, and later runs ask only what is unseen.

The ledger is a Parquet folder with a row for each (model, prompt hash) that was asked. A hash covers the
stage, the prompt and, where a stage has crops, the page and box that are shown with it: page ids differ by
document, so pictures are never mixed up. A run writes what it learns before it uses it; one that is ended
in between asks anew only what it hadn't written. Rows may repeat (concurrent runs append both): an
answer goes before an error, and then the least answer, so every reader sees the same.

Prompts are moved once, one of each kind: `min` of the hash's rows is a partial aggregate. The join back is
by hash; where a prompt is that of a large share of all rows, its side is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import materialized
from .providers import ModelProvider

LEDGER = "model string, prompt_hash string, response_json string, error string"


def prompt_hash(stage: str, prompts: DataFrame) -> Column:
    """What an answer depends on. Parts are separated by their lengths, so that no two prompts read alike."""
    parts = [F.lit(stage), F.col("prompt")]
    if "crop" in prompts.columns:
        parts += [F.col("document_id"), F.col("page_number").cast("string"), F.to_json(F.struct("crop"))]
    said = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("", *(x for p in said for x in (F.length(p).cast("string"), F.lit(":"), p))), 256)


class Ledgered(ModelProvider):
    """A provider that looks answers up first. again: ask what had an error once more."""

    def __init__(self, provider: ModelProvider, path: str, model: str | None = None, again: bool = False):
        self.provider, self.path, self.model, self.again = provider, path, model or provider.name, again
        self.name = f"ledgered {self.model}"

    def available(self) -> tuple[bool, str | None]:
        return self.provider.available()

    def known(self, spark) -> DataFrame:
        """prompt_hash, response_json, error: one row of each prompt that this model was asked."""
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            return spark.createDataFrame([], LEDGER).drop("model")
        rows = spark.read.schema(LEDGER).parquet(self.path).where(F.col("model") == self.model)
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "response_json", "error")).alias("b")
        return rows.groupBy("prompt_hash").agg(best).select("prompt_hash", "b.response_json", "b.error")

    def answer(self, stage: str, prompts: DataFrame) -> DataFrame:
        spark = prompts.sparkSession
        rows = prompts if "item_key" in prompts.columns else prompts.withColumn("item_key", F.lit(""))
        rows = materialized(rows.withColumn("prompt_hash", prompt_hash(stage, rows)))
        seen = self.known(spark)
        unseen = rows.join(seen.where("error IS NULL") if self.again else seen, "prompt_hash", "left_anti")
        show = [c for c in ("page_number", "crop") if "crop" in prompts.columns]
        one = F.min_by(F.struct("document_id", "prompt", *show), F.struct("document_id", "item_key")).alias("p")
        asked = unseen.groupBy("prompt_hash").agg(one).select(F.col("p.document_id").alias("document_id"), F.col("prompt_hash").alias("item_key"), "p.prompt", *(f"p.{c}" for c in show))
        told = self.provider.answer(stage, asked).select(F.lit(self.model).alias("model"), F.col("item_key").alias("prompt_hash"), "response_json", "error")
        told.write.mode("append").parquet(self.path)
        out = rows.select("document_id", "item_key", "prompt_hash").join(self.known(spark), "prompt_hash", "left")
        error = F.coalesce("error", F.when(F.col("response_json").isNull(), "no response"))
        return out.select("document_id", F.lit(stage).alias("stage"), "item_key", "response_json", error.alias("error")).to(spark.createDataFrame([], schemas.RESPONSES).schema)
