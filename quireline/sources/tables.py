"""Tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def whole_texts(spark: SparkSession, path: str, pattern: str = "*.sgm") -> DataFrame:
    """``(path, filename, raw)`` of every file below ``path`` that fits the pattern,
    decoded as UTF-8 with the replacement sign for what isn't."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    # Bytes that aren't UTF-8 are replaced, not an error.
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), raw.alias("raw"))


def stem(path: str = "path"):
    """File name without folder and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def without_suffix(files: DataFrame, suffix: str = "_TR") -> DataFrame:
    """Files whose stem doesn't end with ``suffix``."""
    return files.where(~F.endswith(stem(), F.lit(suffix)))


def pair_by_stem(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Targets with the ``source_path`` of the same folder and stem, null if none."""
    base = F.regexp_replace("path", r"\.[^.]+$", "")
    s = sources.select(base.alias("__base"), F.col("path").alias("source_path")).groupBy("__base").agg(F.min("source_path").alias("source_path"))
    return targets.withColumn("__base", base).join(s, "__base", "left").drop("__base")


def find_by_stem(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Targets with the ``source_path`` of the best fitting stem anywhere: equal,
    else equal in capitals, else in small letters; of equal ones the first path."""
    t = targets.withColumn("__s", stem())
    s = sources.select(stem().alias("__x"), F.col("path").alias("source_path"))
    met = t.select("path", "__s").join(s, F.lower("__s") == F.lower("__x"))
    prio = F.when(F.col("__s") == F.col("__x"), 0).when(F.upper("__s") == F.col("__x"), 1).when(F.lower("__s") == F.col("__x"), 2).otherwise(3)
    best = met.withColumn("__k", F.row_number().over(Window.partitionBy("path").orderBy(prio, "source_path"))).where("__k = 1")
    return t.join(best.select("path", "source_path"), "path", "left").drop("__s")


def decision_log(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Records of a folder of JSON lines; lines that aren't JSON are skipped."""
    schema = (
        "timestamp string, source string, sgml_file string, pdf_file string, validator_decision string, human_decision string, "
        "normalised_score double, reviewer_note string, fixes_found int, auto_fixes_available int, scores string"
    )
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("source") == source) if source else rows


def stored_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored baseline table, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
