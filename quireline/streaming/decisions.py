"""Streams over the reviewers' log and over arriving documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def logged_time(text="logged_at"):
    """Time of a record in either of its two forms, else null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(t, F.lit("dd/MM/yyyy HH:mm")), F.try_to_timestamp(t))


def read_log(spark: SparkSession, path: str, like: DataFrame, files: int = 16, pattern: str | None = None) -> DataFrame:
    """Stream of a folder of parquet files with the schema of ``like``, or of those of
    its files that fit ``pattern``."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def counts(stream: DataFrame, column: str = "human_decision") -> DataFrame:
    """Running number of each decision, in capitals; null stays null."""
    return stream.groupBy(F.upper(column).alias("decision")).agg(F.count("*").alias("n"))


def latest(stream: DataFrame, key: str = "sgml_file") -> DataFrame:
    """Latest decision of each document by its logged time, then its id."""
    s = stream.withColumn("at", logged_time())
    return s.groupBy(key).agg(F.max_by(F.upper("validator_decision"), F.struct("at", "decision_id")).alias("decision"), F.max("at").alias("at"))


def override_rate(stream: DataFrame, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Decisions and overrides in each window; records later than ``delay`` are left out."""
    s = stream.withColumn("at", logged_time()).where("at IS NOT NULL").withWatermark("at", delay)
    over = F.col("human_decision").isNotNull() & (F.upper("human_decision") != F.upper("validator_decision"))
    return s.groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.count_if(over).alias("overridden")).select(F.col("window.start").alias("start"), "n", "overridden")


def run_once(frame: DataFrame, mode: str = "complete") -> DataFrame:
    """The stream's result over what is there now, as a table in the shared folder.

    Each batch replaces (``complete``) or adds to the table, so a batch that is
    repeated after a lost executor changes nothing.
    """
    spark = frame.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quireline-")
    where = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        name = f"{where}/out" if mode == "complete" else f"{where}/out/batch={number}"
        batch.write.mode("overwrite").parquet(name)

    frame.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{where}/out")


def on_arrival(spark: SparkSession, path: str, schema: str, check: Callable[[DataFrame], DataFrame], out: str, state: str):
    """Run ``check`` on every batch of arriving documents; one folder a batch, so a
    repeated batch replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(path).writeStream.option("checkpointLocation", state).foreachBatch(keep)
