"""Sessions, and what Python workers need in order to import this package."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_workers(spark: SparkSession) -> SparkSession:
    """Put this checkout on the path of Python workers that share the driver's file system; on a cluster, ship the package with --py-files."""
    environment = spark.sparkContext.environment
    parts = [p for p in (environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in parts:
        environment["PYTHONPATH"] = ":".join([ROOT, *parts])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where that is unset, one of our own if there is one machine only; on a cluster an error, as executors don't see each other's disks."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps tables in between."""
    return f"{shared_folder(spark)}/paperloom/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables in between of this application; results that were not written yet are lost with them."""
    delete(spark, own_folder(spark))


def materialized(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a Python worker gets at once. Texts are long: Spark's default of 10,000 rows is tens of MB or more, held several times.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch for this session, unless it has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    made = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("paperloom").config(map=made | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_workers(spark)
