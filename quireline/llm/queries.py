"""Queries of this subpackage: ``pN_...`` for problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.llm import language, mix, pack, scan_repair, sentences, spam, split, tokens, unify
from quireline.llm.common import cut, read, spread


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of a marked-up and a printed paragraph that differ but look the same."""
    return unify.same_looking_pairs(spread(read(spark, root, "paragraphs").where("side IN ('sgml', 'pdf_l4')")))


def p1_texts(spark: SparkSession, root: str) -> DataFrame:
    """Both sides' paragraphs in their one form for reading."""
    rows = read(spark, root, "paragraphs").where("side IN ('sgml', 'pdf_l4')").select("para_id", "text").dropDuplicates(["para_id"])
    return unify.unify(rows, out="text")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Damage of scanned filings, with the right words."""
    rows = read(spark, root, "paragraphs")
    return scan_repair.repair(rows).findings.select("para_id", "noise", "repaired").distinct()


def p2_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs of both printed sides of all filings without furniture, whole and
    rightly spelled: the merged ones, and those that the printed lines make."""
    done = scan_repair.repair(read(spark, root, "paragraphs"))
    merged = scan_repair.repaired_paragraphs(done).withColumn("side", F.lit("pdf_l4"))
    return merged.unionByName(scan_repair.line_paragraphs(done).withColumn("side", F.lit("pdf_l1")))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Oversized items, and whether a natural cut exists everywhere."""
    return p3_pieces(spark, root).where("piece = 0").select("item", "item_id", "hard")


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Oversized items in pieces of at most 1,200 code points."""
    paras = read(spark, root, "paragraphs").where("side = 'pdf_l4'").select(F.lit("paragraph").alias("item"), F.col("para_id").alias("item_id"), "text")
    heads = read(spark, root, "headings").where("side = 'pdf_l4'").select(F.lit("heading").alias("item"), F.col("heading_id").alias("item_id"), "text")
    return split.split_items(paras.unionByName(heads), only_long=True)


def p3_rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """What the pieces of each oversized item give when put together again."""
    return split.rebuilt(p3_pieces(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """End of every sentence; abbreviations are those of the sentence's language, told
    by the model of problem 5."""
    rows = read(spark, root, "paragraphs").where("side IN ('sgml', 'pdf_l4') AND text IS NOT NULL").select("para_id", "text")
    ends = sentences.sentence_bounds(spread(rows), judge=p5_model(spark, root).tell).select("para_id", "sent_ends").dropDuplicates(["para_id"])
    return ends.select("para_id", F.explode("sent_ends").alias("sent_end"))


def p5_model(spark: SparkSession, root: str) -> language.Model:
    """Language model from the filings' own labels."""
    labels = read(spark, root, "sgml_content").select("doc_id", "lang").dropDuplicates(["doc_id"])
    rows = read(spark, root, "paragraphs").where("side = 'sgml'").select("doc_id", "text")
    return language.train(rows.join(labels, "doc_id"), "text", "lang")


def p5_languages(spark: SparkSession, root: str) -> DataFrame:
    """Main language of every filing (und with confidence 0 if its marked-up side has no
    letter) and language of every foreign segment, with confidence, however small;
    offsets are code points of the paragraph."""
    segments = cut(language.filing_segments(read(spark, root, "paragraphs"), p5_model(spark, root)))
    mains = cut(language.main_language(segments))
    filings = read(spark, root, "sgml_content").select("doc_id").where("doc_id IS NOT NULL").distinct()
    mains = filings.join(mains, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    whole = mains.select("doc_id", F.lit(None).cast("bigint").alias("para_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "lang", "confidence")
    return whole.unionByName(language.foreign_segments(segments, mains).select("doc_id", "para_id", "start", "end", "lang", "confidence"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Wrong language labels and paragraphs with foreign sentences."""
    segments = cut(language.filing_segments(read(spark, root, "paragraphs"), p5_model(spark, root)))
    mains = cut(language.main_language(segments))
    wrong = language.wrong_labels(
        {
            "sgml_content": (read(spark, root, "sgml_content"), "lang"),
            "pdf_data": (read(spark, root, "pdf_data"), "language_hint"),
            "document_class": (read(spark, root, "document_class"), "lang"),
        },
        mains,
    )
    foreign = language.certain(language.foreign_segments(segments, mains)).select(F.lit("paragraph").alias("unit"), F.col("para_id").alias("unit_id"), "lang").distinct()
    return wrong.unionByName(foreign)


def page_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Pages with their size in tokens."""
    rows = read(spark, root, "documents").where("text IS NOT NULL").select("doc_id", "source", "text")
    return spread(rows).select("doc_id", "source", tokens.token_count(F.col("text")).alias("tokens"))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """Every page in containers of 2,048 tokens."""
    return pack.pack(page_tokens(spark, root).select("doc_id", "tokens"))


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    """Number of containers and how full they are under each capacity."""
    return pack.fill_report(p6_containers(spark, root))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    """Pages of the mix with their copies."""
    return mix.mix(page_tokens(spark, root), read(spark, root, "mix_weights"))[0]


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Share that each source reaches in the mix."""
    return mix.mix(page_tokens(spark, root), read(spark, root, "mix_weights"))[1]


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages of repeated keywords, links or product tags."""
    return spam.spam_pages(read(spark, root, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return {f.__name__: f for f in (p1_found, p1_texts, p2_found, p2_paragraphs, p3_found, p3_pieces, p3_rebuilt, p4_found, p5_found, p5_languages, p6_containers, p6_fill, p7_mix, p7_shares, p8_found)}


def _sql_class(signs: str) -> str:
    """Signs as the body of a regular-expression class in SQL."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(signs))


#: Blanks as Python knows them.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    run = f"[^{_sql_class(BLANKS + split.SENTENCE_MARKS + split.CLAUSE_MARKS)}]+"
    long_ = "SELECT DISTINCT '{item}' AS item, {key} AS item_id, text FROM {table} WHERE side = 'pdf_l4' AND length(text) > {limit}"
    rows = " UNION ALL ".join(long_.format(item=i, key=f"{k}_id", table=t, limit=split.LIMIT) for i, k, t in (("paragraph", "para", "paragraphs"), ("heading", "heading", "headings")))
    hard = f"coalesce(list_max(list_transform(regexp_extract_all(text, '{run}'), lambda x: length(x))), 0) > {split.LIMIT}"
    return {
        "p3_found": f"SELECT item, item_id, CAST({hard} AS INT) AS hard FROM ({rows})",
        "p3_rebuilt": f"SELECT item, item_id, md5(text) AS digest, 0 AS too_long, 0 AS wrong_overlaps FROM ({rows})",
    }
