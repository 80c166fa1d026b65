"""From documents to scores: one plan put together from operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.functions import text as T
from quireline.operators import compare as J
from quireline.operators import rules as R

# Points for the share of source paragraphs found in the target.
COVERAGE_STEPS = [(0.9, 20.0), (0.75, 18.0), (0.6, 15.0), (0.45, 12.0), (0.3, 8.0)]
# Points for the share of headings found.
HEADING_STEPS = [(0.95, 8.0), (0.85, 6.0), (0.7, 4.0), (0.5, 2.0)]


def structure_scores(docs: DataFrame, rules: list[R.Rule], base: dict[str, float] = R.FILING_POINTS, key: str = "doc_id") -> DataFrame:
    """``(key, structure, issues, critical)`` of marked-up documents. An empty text
    scores 0."""
    found = R.issues(docs, rules, key)
    scores = R.category_scores(docs, found, base, key).groupBy(key).agg(F.sum("score").alias("structure"))
    counts = found.groupBy(key).agg(F.count("*").alias("issues"), F.bool_or(F.col("severity") == "critical").alias("critical"))
    empty = docs.select(key, (F.coalesce(F.trim("raw"), F.lit("")) == "").alias("empty"))
    out = scores.join(counts, key, "left").join(empty, key)
    return out.select(
        key, F.when(F.col("empty"), 0.0).otherwise(F.col("structure")).alias("structure"), F.coalesce("issues", F.lit(0)).alias("issues"),
        (F.coalesce("critical", F.lit(False)) | F.col("empty")).alias("critical"),
    )


def text_scores(source: DataFrame, target: DataFrame, words: Column, least: float = 0.6, least_words: int = 10, doc: str = "doc_id", key: str = "para_id") -> DataFrame:
    """``(doc, paragraphs, found, ratio, text)``: source paragraphs of enough words
    whose 5-grams the target holds by ``least``, and the points for their share."""
    long_ = source.where(F.size(words) >= least_words)
    c = J.gram_coverage(long_, target, words, 5, doc, key)
    r = c.groupBy(doc).agg(F.count("*").alias("paragraphs"), F.count_if(F.col("coverage") >= least).alias("found"))
    r = r.withColumn("ratio", F.col("found") / F.col("paragraphs"))
    return r.withColumn("text", T.tier(F.col("ratio"), COVERAGE_STEPS))


def heading_scores(source: DataFrame, target: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, ratio, headings)``: headings found either way and their points."""
    return J.heading_match(source, target, doc=doc).select(doc, "ratio", T.tier(F.col("ratio"), HEADING_STEPS).alias("headings"))


def tabular_scores(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, score)``: what a workbook document's issues leave of the points of its
    structure (35), kind (20) and cells (10), none below 0."""
    lost = lambda *c: F.coalesce(F.sum(F.when(F.col("category").isin(*c), F.col("points"))), F.lit(0.0))
    left = lambda base, *c: F.greatest(F.lit(0.0), base - lost(*c))
    rows = docs.select(key).join(found, key, "left").groupBy(key)
    return rows.agg(F.round(left(35.0, "content", "tables") + left(20.0, "kind") + left(10.0, "cells"), 1).alias("score"))


def overall(levels: DataFrame, most: dict[str, float], key: str = "doc_id") -> DataFrame:
    """``(key, total, reachable, normalised)``: the sum of a document's levels (columns
    named as in ``most``), what could be reached in those it has, and the share in
    hundredths, at most 100; null if it has none. A level that is null wasn't judged and
    counts on neither side."""
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in most), F.lit(0.0))
    reach = sum((F.when(F.col(n).isNotNull(), float(m)).otherwise(0.0) for n, m in most.items()), F.lit(0.0))
    rows = levels.select(key, total.alias("total"), reach.alias("reachable"))
    return rows.withColumn("normalised", F.when(F.col("reachable") > 0, F.least(F.lit(100.0), F.col("total") / F.col("reachable") * 100)))
