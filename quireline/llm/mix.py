"""Problem 7: a mix of sources with target shares.

Method: systematic sampling. Every page of a source has the same expected number
of copies, the source's target size over its size, at most the source's cap. The
expected copies are summed up over the source's pages in a fixed order; with one
random offset a page comes out once for each whole number that the sum crosses in
it. The sums are taken in two steps, within slices of a source and over the
slices, so that no source has to pass through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireline.llm.common import cut, need

#: Pages that one slice of a source holds on average, if all were of one source.
SLICE_PAGES = 20_000


def mix(pages: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 7, slice_pages: int = SLICE_PAGES) -> tuple[DataFrame, DataFrame]:
    """Pages with their copies, and the report of the sources.

    ``pages(doc_id, source, tokens)`` and ``weights(source, target_share,
    max_repeats)``; ``total`` is the size of the mix in tokens, by default that of
    all pages with a source. First result: ``(doc_id, source, tokens, copies)`` of
    all pages used, ``copies`` at most ``max_repeats``. Second: ``(source,
    target_share, available, expected_copies, tokens, actual_share)``.

    Pages with null source, without weight or tokens stay out; pages resent with
    one id count once; a weight that comes several times for a source counts once
    (the greatest); a source without pages is reported with 0. The slices follow the
    number of pages, so none grows. Other columns are ignored.
    """
    need(pages, "doc_id", "source", "tokens")
    need(weights, "source", "target_share", "max_repeats")
    rows = pages.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.col("tokens") > 0)).groupBy("doc_id").agg(
        F.min("source").alias("source"), F.max("tokens").alias("tokens")
    )
    w = weights.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = cut(rows)
    slices = -(-rows.count() // slice_pages) or 1
    rows = rows.withColumn("slice", F.abs(F.xxhash64("doc_id", F.lit(seed))) % slices)
    sums = cut(rows.groupBy("source", "slice").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")))
    size = sums.groupBy("source").agg(F.sum("t").alias("available"))
    all_tokens = sums.join(w, "source").agg(F.sum("t")).first()[0] or 0
    want = F.lit(float(total if total is not None else all_tokens))
    plan = w.join(size, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    copies = F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_share") * want / F.col("available"))).otherwise(0.0)
    plan = plan.withColumn("expected_copies", F.greatest(copies, F.lit(0.0)))
    # The order of a source: its slices, in each the pages by size and hash.
    offset = (F.abs(F.xxhash64("source", F.lit(seed))) % 1_000_003) / 1_000_003.0
    starts = sums.join(plan.select("source", "expected_copies"), "source").withColumn(
        "start", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("source", "slice", "start", "expected_copies", offset.alias("u"))
    inner = Window.partitionBy("source", "slice").orderBy("tokens", F.xxhash64("doc_id"), "doc_id")
    numbered = rows.join(starts, ["source", "slice"]).withColumn("k", F.col("start") + F.row_number().over(inner))
    # A millionth takes the rounding of the product away from whole numbers.
    crossed = lambda k: F.floor(k * F.col("expected_copies") + F.col("u") + 1e-9)
    used = numbered.withColumn("copies", (crossed(F.col("k")) - crossed(F.col("k") - 1)).cast("int")).where("copies > 0")
    used = cut(used.select("doc_id", "source", "tokens", "copies"))
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    whole = got.agg(F.sum("tokens")).first()[0] or 0
    report = plan.join(got, "source", "left").select(
        "source", "target_share", "available", "expected_copies", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.coalesce("tokens", F.lit(0)) / F.lit(float(whole or 1))).alias("actual_share"),
    )
    return used, report
