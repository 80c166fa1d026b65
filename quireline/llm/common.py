"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch. Texts may be megabytes long, so batches stay small.
ARROW_ROWS = 1000


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` under ``root``. Arrow batches are bounded for the session
    unless its caller has chosen their size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` with at least as many partitions as the session has cores.

    A scan of a large table has them already and stays as it is, so its texts aren't
    shuffled. Only what comes in fewer pieces (small compressed files) is dealt round
    robin, since its texts may need minutes of Python.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(parts_of(df.sparkSession))


def parts_of(session: SparkSession) -> int:
    """Partitions of a shuffle that adaptive execution mustn't narrow, since few bytes
    are much work there."""
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)


def need(df: DataFrame, *names: str) -> None:
    """Clear error if a column is missing, before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def latest(df: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """One row per ``key``: resent rows are equal but for their arrival time."""
    return df.select(key, *[c for c in keep if c != key]).dropDuplicates([key])


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the cluster's shared folder and read again, so
    that what follows starts from there and reads only the columns it needs.

    The folder is that of ``spark.checkpoint.dir``. Only a local session may leave it
    unset, as tests do; a cluster's executors couldn't read each other's folders. The
    table is deleted when the session's JVM ends.
    """
    session = df.sparkSession
    context = session.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or session.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quireline-")
        session.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/quireline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return session.read.schema(df.schema).parquet(path)
