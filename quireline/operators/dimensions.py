"""Points that a document loses against its source: counts, order, metadata, contacts,
tagging, and the tiers of content and corpus checks.

A check is a condition and its points over one row of facts for each document, so all
checks of a dimension are one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.functions import text as T
from quireline.functions.udf import seq_ratio
from quireline.operators import compare as J
from quireline.operators import layout as L

# How phone numbers, addresses of mail and links look.
PHONE = r"(?:^|[^0-9])((?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s][0-9]{3}[-.\s][0-9]{4})(?:[^0-9]|$)"
MAIL = r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
LINK = r"(https?://[^\s<>\"&]{8,}|www\.[^\s<>\"&]{5,})"
# Languages that a document may state, and tags that say nothing of its kind.
LANGUAGES = ("EN", "FR", "BI")
PLAIN_TAGS = ("polidoc", "polident", "freeform", "n", "ti", "date")


@dataclass(frozen=True)
class Check:
    """Dimension, name and severity of a check, when it hits and what it costs."""

    dimension: str
    name: str
    severity: str
    hit: Column
    points: Column | float


def apply_checks(facts: DataFrame, checks: list[Check], key: str = "doc_id") -> DataFrame:
    """``(key, dimension, name, severity, points)`` of the checks that hit; a condition
    that is null doesn't."""
    one = lambda c: F.struct(
        F.lit(c.dimension).alias("dimension"), F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"),
        (c.points if isinstance(c.points, Column) else F.lit(float(c.points))).cast("double").alias("points"), F.coalesce(c.hit, F.lit(False)).alias("hit"),
    )
    rows = facts.select(key, F.explode(F.filter(F.array(*[one(c) for c in checks]), lambda x: x["hit"])).alias("x"))
    return rows.select(key, "x.dimension", "x.name", "x.severity", "x.points")


def completeness() -> list[Check]:
    """Counts of source (``s_``) and target (``t_``): tables, images, footnotes,
    headings; ``first_page`` of the source, ``t_appendix`` whether the target has one."""
    c = F.col
    some = lambda n: c(f"s_{n}") > 0
    ratio = c("t_headings") / c("s_headings")
    many = (c("s_headings") > 3) & (c("t_headings") > 0) & ~((c("t_headings") < 4) & (c("s_headings") > c("t_headings") * 4))
    lost = some("tables") & (c("t_tables") == 0)
    appendix = F.regexp_like("first_page", F.lit(r"(?i)\b(schedule|appendix|annex|exhibit)\s+[a-z0-9]"))
    return [
        Check("completeness", "tables lost", "critical", lost, F.least(F.lit(2.0), c("s_tables") * 0.5)),
        Check("completeness", "tables differ", "major", some("tables") & ~lost & (F.abs(c("t_tables") - c("s_tables")) > F.greatest(F.lit(1.0), c("s_tables") * 0.25)), 1.0),
        Check("completeness", "images lost", "major", some("images") & (c("t_images") == 0), F.least(F.lit(1.5), c("s_images") * 0.3)),
        Check("completeness", "images fewer", "minor", some("images") & (c("t_images") > 0) & (c("t_images") < c("s_images") - 2), 0.5),
        Check("completeness", "footnotes lost", "major", (c("s_footnotes") > 4) & (c("t_footnotes") == 0), 1.0),
        Check("completeness", "footnotes fewer", "minor", (c("t_footnotes") > 0) & (c("s_footnotes") > c("t_footnotes") + 3), 0.5),
        Check("completeness", "sections lost", "major", many & (ratio < 0.5), 1.0),
        Check("completeness", "sections fewer", "minor", many & (ratio >= 0.5) & (ratio < 0.7), 0.5),
        Check("completeness", "appendix lost", "minor", appendix & ~c("t_appendix"), 0.5),
    ]


def metadata() -> list[Check]:
    """What a document states of itself (``label, lang, adddate, moddate, number``)
    against what its source shows (``s_lang, s_date, first_page``)."""
    c = F.col
    said = lambda n: F.coalesce(c(n), F.lit("")) != ""
    day = lambda n: F.try_to_date(c(n), "yyyyMMdd")
    page = F.coalesce(c("first_page"), F.lit(""))
    number = T.squeeze(F.coalesce(c("number"), F.lit("")))
    bare = F.regexp_extract(number, r"[0-9]{2}-[0-9]{3,4}", 0)
    packed = lambda x: F.translate(x, "- ", "")
    there = F.contains(page, number) | ((bare != "") & F.array_contains(F.regexp_extract_all(page, F.lit(r"([0-9]{2}-[0-9]{3,4})"), F.lit(1)), bare)) | F.contains(packed(page), packed(number))
    apart = F.abs(F.datediff(day("s_date"), day("adddate")))
    wrong_day = lambda n: said(n) & day(n).isNull()
    return [
        Check("metadata", "language", "major", said("lang") & said("s_lang") & (c("lang") != c("s_lang")), 1.0),
        Check("metadata", "number", "major", c("number").isNotNull() & ~there & (bare != "") & ~number.rlike("^[0-9]{4}-[0-9]{3}$"), 1.0),
        Check("metadata", "date", "major", apart > 1825, 1.0),
        Check("metadata", "date of keying", "warning", (apart > 30) & (apart <= 1825), 0.0),
        *[Check("metadata", f"{n} missing", "warning", F.trim(F.coalesce(c(n), F.lit(""))) == "", 0.0) for n in ("label", "lang", "adddate")],
        Check("metadata", "language unknown", "warning", said("lang") & ~F.upper(F.trim("lang")).isin(*LANGUAGES), 0.0),
        Check("metadata", "adddate form", "warning", wrong_day("adddate"), 0.0),
        Check("metadata", "moddate form", "warning", wrong_day("moddate"), 0.0),
        Check("metadata", "dates turned", "warning", day("moddate") < day("adddate"), 0.0),
        Check("metadata", "label form", "warning", said("label") & ~c("label").rlike("[A-Za-z]{3}"), 0.0),
    ]


def ordering() -> list[Check]:
    """Order of matched headings: ``matched``, ``ratio`` of inverted pairs, numbers of
    headings, and whether the source has two columns, whose order proves nothing."""
    c = F.col
    able = ~F.coalesce(c("two_column"), F.lit(False)) & (c("s_headings") >= 3) & (c("t_headings") >= 3) & (c("matched") >= 3)
    return [
        Check("ordering", "order", "major", able & (c("ratio") >= 0.3) & (c("ratio") > 0.3), F.least(F.lit(2.0), c("ratio") * 4.0)),
        Check("ordering", "order in part", "minor", able & (c("ratio") > 0.1) & (c("ratio") <= 0.3), 0.5),
    ]


def contacts(source: DataFrame, target: DataFrame, unit: float = 0.3, cap: float = 1.5, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(doc, kind, item)``: phone numbers, mail addresses and links that the source
    has and the target lacks, by their normal form; and ``(doc, items, points)``."""
    found = None
    for kind, pattern in (("phone", PHONE), ("mail", MAIL), ("link", LINK)):
        one = J.missing_items(source, target, F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), doc=doc).withColumn("kind", F.lit(kind))
        found = one if found is None else found.unionByName(one)
    found = found.select(doc, "kind", F.trim("item").alias("item"))
    points = found.groupBy(doc).agg(F.count("*").alias("items")).withColumn("points", F.least(F.lit(cap), F.col("items") * unit))
    return found, points


def untagged(items: DataFrame, stages: list[tuple], doc: str = "doc_id", least_words: int = 2) -> DataFrame:
    """Items of enough words that no stage finds and that may not be left out;
    ``stages`` as in ``fuzzy_cascade``."""
    rows = items.where((T.word_count(F.col("text")) >= least_words) & ~L.is_omitted(F.col("text")))
    return fuzzy_cascade(rows, stages, doc).where("found_by IS NULL").drop("found_by")


def fuzzy_cascade(items: DataFrame, stages: list[tuple], doc: str = "doc_id") -> DataFrame:
    """``compare.cascade`` with two more ways: ``("name", texts, least)`` with a number
    finds items whose sequence ratio with a text is at least that, and ``holds`` those
    that hold a text of eight and more signs. Similar texts have a common word, so they
    meet over words; only what earlier stages left is compared."""
    left, out = items, None
    for name, texts, how in stages:
        if isinstance(how, str) and how != "holds":
            both = J.cascade(left, [(name, texts, how)], doc)
        else:
            k = left.select(doc, F.lower("text").alias("x")).distinct()
            t = texts.select(doc, F.lower("text").alias("y")).where("y IS NOT NULL").distinct()
            if how == "holds":
                hit = J.holding(k.withColumnRenamed("x", "y"), t.where(F.length("y") >= 8).withColumnRenamed("y", "x"), doc).select(doc, F.col("y").alias("x"))
            else:
                words = lambda c: F.explode(F.array_distinct(T.words(T.squeeze(F.col(c))))).alias("w")
                met = k.select(doc, "x", words("x")).join(t.select(doc, "y", words("y")), [doc, "w"]).select(doc, "x", "y").distinct()
                hit = met.where(seq_ratio("x", "y") >= float(how)).select(doc, "x")
            hit = hit.distinct().withColumn("__hit", F.lit(name))
            both = left.withColumn("x", F.lower("text")).join(hit, [doc, "x"], "left").drop("x").withColumnRenamed("__hit", "found_by")
        part = both.where("found_by IS NOT NULL")
        out = part if out is None else out.unionByName(part)
        left = both.where("found_by IS NULL").drop("found_by")
    rest = left.withColumn("found_by", F.lit(None).cast("string"))
    return rest if out is None else out.unionByName(rest)


def tagging() -> list[Check]:
    """Shares of untagged spans (``bold_share, italic_share, heading_share``) and the
    numbers of images on both sides."""
    c = F.col
    points = lambda n, unit, cap: F.least(F.lit(cap), c(f"{n}_share") * unit)
    return [
        Check("tagging", "bold", "minor", c("bold_share") > 0, points("bold", 3.0, 1.5)),
        Check("tagging", "italic", "minor", c("italic_share") > 0, points("italic", 2.0, 1.0)),
        Check("tagging", "headings", "minor", c("heading_share") > 0, points("heading", 2.0, 1.5)),
        Check("tagging", "images lost", "major", (c("s_images") > 0) & (c("t_images") == 0), 1.0),
        Check("tagging", "images differ", "minor", (c("s_images") > 0) & (c("t_images") > 0) & (F.abs(c("t_images") - c("s_images")) > 2), 0.5),
    ]


def dimension_scores(docs: DataFrame, found: DataFrame, base: dict[str, float], key: str = "doc_id") -> DataFrame:
    """``(key, dimension, score)``: what the checks leave of each dimension's points,
    not below 0; a document without facts keeps all."""
    lost = found.groupBy(key, "dimension").agg(F.sum("points").alias("lost"))
    every = docs.select(key, F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in base]), F.array(*[F.lit(float(v)) for v in base.values()]))).alias("dimension", "base"))
    return every.join(lost, [key, "dimension"], "left").select(key, "dimension", F.greatest(F.lit(0.0), F.col("base") - F.coalesce("lost", F.lit(0.0))).alias("score"))


# Points of the dimensions.
DIMENSION_POINTS = {"tagging": 5.0, "completeness": 7.0, "ordering": 4.0, "metadata": 3.0}


# --- tiers of content and corpus ---------------------------------------------


def catastrophic_loss(source_words: Column, target_words: Column, excepted: Column) -> Column:
    """Whether a target of some length has less than 0.3 of its source's words, though
    the source isn't more than five times as long (then it holds appendices that are
    keyed apart) and its kind isn't ``excepted``."""
    appendix = (source_words / F.greatest(F.lit(1), target_words) > 5) & (target_words > 300)
    return ~F.coalesce(excepted, F.lit(False)) & ~appendix & (target_words > 300) & (source_words > 200) & (target_words / source_words < 0.3)


def table_points(source: Column, target: Column) -> Column:
    """Points for the tables found: all if the source has none, half for one or two
    lost, else by the share."""
    share = F.least(source, target) / source
    tiers = T.tier(share, [(0.9, 4.0), (0.6, 2.0), (0.3, 1.0)])
    return F.when(source == 0, 4.0).when(target == 0, F.when(source <= 2, 2.0).otherwise(0.0)).otherwise(tiers)


def footnote_points(source: Column, target: Column) -> Column:
    """The same for footnotes."""
    share = F.least(source, target) / F.greatest(F.lit(1), source)
    return F.when(source == 0, 3.0).when(target == 0, F.when(source >= 3, 0.0).otherwise(1.5)).otherwise(T.tier(share, [(0.8, 3.0), (0.5, 1.5)]))


def section_points(ratio: Column, text_points: Column, structured: Column, source: Column, target: Column) -> Column:
    """Points for the headings found: stricter steps for plain documents than for
    ``structured`` ones, and a floor where the text is known to be there."""
    plain = T.tier(ratio, [(0.95, 8.0), (0.85, 6.0), (0.7, 4.0), (0.5, 2.0)])
    parts = T.tier(ratio, [(0.95, 8.0), (0.7, 6.0), (0.5, 4.0), (0.3, 2.0)])
    by_ratio = F.when(source == 0, 8.0).when(target == 0, 0.0).when(structured, parts).otherwise(plain)
    return F.greatest(by_ratio, F.when(text_points >= 20, 4.0).when(text_points >= 18, 2.0).otherwise(0.0))


def corpus_checks() -> list[Check]:
    """A document against its corpus: ``jurisdiction, label, known_label, doc_type``,
    ``z`` of its words, ``depth, corpus_depth, missing_common``, and its raw text's
    flags ``has_parts, has_free_form, n_table, n_body, has_ident, special``."""
    c = F.col
    based = c("z").isNotNull() | c("corpus_depth").isNotNull()
    return [
        Check("jurisdiction", "unknown", "minor", F.lower("jurisdiction") == "unknown", 2.0),
        Check("jurisdiction", "label unknown", "minor", c("label").isNotNull() & ~c("known_label"), 1.0),
        Check("statistics", "no baseline", "warning", ~based, 3.0),
        Check("statistics", "far too short", "major", c("z") < -4, 4.0),
        Check("statistics", "short", "minor", (c("z") >= -4) & (c("z") < -3), 2.0),
        Check("statistics", "long", "warning", c("z") > 4, 0.0),
        Check("statistics", "deep", "minor", c("depth") > c("corpus_depth") + 5, 2.0),
        Check("statistics", "common tags missing", "warning", c("missing_common") > 3, 1.0),
        Check("patterns", "notice with parts", "warning", (c("doc_type") == "notice") & c("has_parts"), 0.0),
        Check("patterns", "instrument without parts", "major", (c("doc_type") == "instrument") & ~c("has_parts"), 3.0),
        Check("patterns", "no free form", "critical", ~c("has_free_form"), 3.0),
        Check("patterns", "tables unpaired", "major", c("n_table") != c("n_body"), 2.0),
        Check("patterns", "no ident block", "critical", ~c("has_ident") & ~c("special"), 2.0),
    ]


# Points of the corpus checks, and of a document that has no corpus.
CORPUS_POINTS = {"jurisdiction": 5.0, "statistics": 10.0, "patterns": 10.0}
NO_CORPUS = 12.5


# --- summaries -------------------------------------------------------------------

# What a missing and an altered text costs by severity.
MISSING_COST = {"critical": 2.5, "major": 1.0, "minor": 0.3}
ALTERED_COST = {"critical": 2.0, "major": 0.5, "minor": 0.1}


def severity_points(docs: DataFrame, found: DataFrame, most: float = 8.0, each: float = 0.04, key: str = "doc_id") -> DataFrame:
    """``(key, text, coverage)``: points and coverage that the texts ``found(key, kind,
    severity)`` of kind ``missing`` or ``altered`` leave."""
    cost = F.lit(0.0)
    for kind, table in (("missing", MISSING_COST), ("altered", ALTERED_COST)):
        for severity, c in table.items():
            cost = F.when((F.col("kind") == kind) & (F.col("severity") == severity), c).otherwise(cost)
    lost = found.groupBy(key).agg(F.sum(cost).alias("lost"), F.count("*").alias("n"))
    rows = docs.select(key).join(lost, key, "left").withColumns({"lost": F.coalesce("lost", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})
    return rows.select(key, F.greatest(F.lit(0.0), most - F.col("lost")).alias("text"), F.greatest(F.lit(0.0), 1 - F.col("n") * each).alias("coverage"))


def union_issues(levels: dict[str, DataFrame]) -> DataFrame:
    """Issues of several levels under each other with their ``level``; columns that a
    level lacks are null."""
    out = None
    for name, rows in levels.items():
        one = rows.withColumn("level", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def fix_summary(fixes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, dimension, severity, n, auto)``: numbers of cards in each dimension and
    severity, and of those that apply by themselves."""
    return fixes.groupBy(key, "dimension", "severity").agg(F.count("*").alias("n"), F.count_if("auto").alias("auto"))


def blocks_without_heading(docs: DataFrame, key: str = "doc_id", raw: str = "raw") -> DataFrame:
    """``(key, headings, bare)``: number of headings, and of numbered blocks that end
    before one opens in them."""
    parts = F.filter(F.split(F.col(raw), r"(?i)(?=<BLOCK[123][\s>])", -1), lambda p: F.regexp_like(p, F.lit(r"(?i)^<BLOCK[123][\s>]")))
    body = lambda p: F.split(p, r"(?i)</BLOCK[123]>", -1)[0]
    bare = F.filter(parts, lambda p: ~F.regexp_like(body(p), F.lit(r"(?i)<TI[\s>]")))
    return docs.select(key, F.regexp_count(F.col(raw), F.lit(r"(?i)<TI[\s>]")).alias("headings"), F.coalesce(F.size(bare), F.lit(0)).alias("bare"))


def heading_positions(target: DataFrame, source: DataFrame, least: float = 0.6, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """``(doc, a, b)``: for each target heading (place ``a``) the place ``b`` of the most
    similar source heading, the first of equal ones, if it is at least ``least`` similar.
    Headings meet over their words."""
    words = lambda c: F.explode(T.heading_words(F.col(c))).alias("w")
    t = target.select(doc, F.col(order).alias("a"), F.lower("text").alias("x")).where("x IS NOT NULL")
    s = source.select(doc, F.col(order).alias("b"), F.lower("text").alias("y")).where("y IS NOT NULL")
    met = t.select(doc, "a", "x", words("x")).join(s.select(doc, "b", "y", words("y")), [doc, "w"]).select(doc, "a", "b", "x", "y").distinct()
    near = met.withColumn("r", seq_ratio("x", "y")).where(F.col("r") >= least)
    return near.groupBy(doc, "a").agg(F.min_by("b", F.struct(-F.col("r"), F.col("b"))).alias("b"))


def cell_points(cells: DataFrame, covered: DataFrame, key: str = "doc_id", cell: str = "cell_id") -> DataFrame:
    """``(key, cells, share, points)``: points lost for source cells that the target
    lacks; ``covered(key, cell, method)`` as ``compare.staged_coverage`` gives it."""
    rows = cells.select(key, cell).join(covered.select(key, cell, "method"), [key, cell], "left")
    one = rows.groupBy(key).agg(F.count("*").alias("cells"), (F.count("method") / F.count("*")).alias("share"))
    return one.withColumn("points", F.when(F.col("share") < 0.75, 1.5).when(F.col("share") < 0.9, 0.75).otherwise(0.0))


def local_losses(sentences: DataFrame, section: DataFrame, document: DataFrame, local: float = 0.15, everywhere: float = 0.3, n: int = 3, doc: str = "doc_id") -> DataFrame:
    """Sentences ``(doc, section, key, text)`` whose word ``n``-grams neither their own
    section of the target ``section(doc, section, text)`` holds by ``local`` nor the
    whole target ``document(doc, text)`` by ``everywhere``, so that they weren't moved."""
    w = T.content_words(F.col("text"))
    fit = sentences.where(F.size(w) >= 6)
    place = F.concat_ws("\x01", F.col(doc).cast("string"), F.col("section").cast("string"))
    near = J.gram_coverage(fit.withColumn("__p", place), section.withColumn("__p", place), w, n, "__p", "key", short_texts=False).select("key", F.col("coverage").alias("near"))
    far = J.gram_coverage(fit, document, w, n, doc, "key", short_texts=False).select("key", F.col("coverage").alias("far"))
    return fit.join(near, "key").join(far, "key").where((F.col("near") < local) & (F.col("far") < everywhere))
