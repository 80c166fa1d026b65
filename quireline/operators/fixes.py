"""Fix cards: templates, replacements, highlights, applying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.operators.rules import ENTITY_OF

SEVERITY_RANK = {"critical": 0, "major": 1, "minor": 2, "warning": 3, "info": 4}


def severity_rank(severity: Column) -> Column:
    """Rank of a severity, worst first; unknown ones last."""
    out = F.lit(len(SEVERITY_RANK))
    for name, rank in SEVERITY_RANK.items():
        out = F.when(F.lower(severity) == name, rank).otherwise(out)
    return out


#: Templates that one rule table may hold; they are read into the plan.
MOST_TEMPLATES = 2_000


def match_templates(issues: DataFrame, templates: DataFrame, most: int = MOST_TEMPLATES) -> DataFrame:
    """Issues with ``template``: of the templates whose keyword stands in the
    description, first those of the issue's category, then any, each in the order
    ``prio``; null if none. ``issues(issue_id, category, description)``,
    ``templates(prio, category, keyword, template)``, of which there may be ``most``; more
    are an error, since each description is held against all of them in one pass."""
    rules = templates.select("prio", "category", F.lower("keyword").alias("keyword"), "template").limit(most + 1).collect()
    if len(rules) > most:
        raise ValueError(f"more than {most} templates")
    if not rules:
        return issues.withColumn("template", F.lit(None).cast("string"))
    one = lambda r: F.struct(F.lit(r["prio"]).cast("int").alias("prio"), F.lit(r["category"]).cast("string").alias("c"), F.lit(r["keyword"]).cast("string").alias("w"), F.lit(r["template"]).cast("string").alias("t"))
    table = F.array(*[one(r) for r in rules])
    text = F.lower(F.col("description"))
    hits = F.transform(F.filter(table, lambda r: F.contains(text, r["w"])), lambda r: F.struct(F.coalesce((r["c"] != F.col("category")).cast("int"), F.lit(1)).alias("a"), r["prio"].alias("p"), r["t"].alias("t")))
    return issues.withColumn("template", F.array_min(hits)["t"])


def sign_cards(lines: DataFrame, signs: dict[str, str] = ENTITY_OF) -> DataFrame:
    """``(doc_id, line, sign, entity, n)``: a card for each sign on each line that
    should be an entity. Characters are exploded once for all signs."""
    table = F.create_map(*[F.lit(x) for kv in signs.items() for x in kv])
    rows = lines.select("doc_id", "line", F.explode(F.split("text", "")).alias("sign")).where(F.col("sign").isin(list(signs)))
    return rows.groupBy("doc_id", "line", "sign").agg(F.count("*").alias("n")).withColumn("entity", table[F.col("sign")])


def highlights(fixes: DataFrame) -> DataFrame:
    """``(doc_id, line, severity)``: for each line the worst severity among its fixes.
    ``fixes(doc_id, severity, lines array<int>)``."""
    rows = fixes.select("doc_id", "severity", F.explode("lines").alias("line"))
    return rows.groupBy("doc_id", "line").agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"))


def ordered_cards(cards: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Cards with ``rank``: by severity, dimension and whether they have a line; of
    the dimensions in ``caps`` only so many for each document."""
    w = Window.partitionBy("doc_id").orderBy(severity_rank(F.col("severity")), "dimension", F.col("line").isNull(), "line", "card_id")
    d = Window.partitionBy("doc_id", "dimension").orderBy(severity_rank(F.col("severity")), F.col("line").isNull(), "line", "card_id")
    limit = F.lit(None).cast("int")
    for name, n in (caps or {}).items():
        limit = F.when(F.col("dimension") == name, n).otherwise(limit)
    rows = cards.withColumn("__k", F.row_number().over(d)).where(limit.isNull() | (F.col("__k") <= limit)).drop("__k")
    return rows.withColumn("rank", F.row_number().over(w))


def apply_fixes(docs: DataFrame, fixes: DataFrame, raw: str = "raw") -> DataFrame:
    """Documents with ``fixed`` and ``applied``: the fixes ``(doc_id, ord, wrong,
    right)`` folded over the text in order, each replacing the first place of what is
    there then. A fix that finds nothing counts as not applied; documents without
    fixes stay as they are."""
    packed = fixes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "wrong", "right"))).alias("__f"))
    fold = F.expr(f"""aggregate(coalesce(__f, array()), named_struct('t', {raw}, 'n', 0), (a, x) ->
        CASE WHEN x.wrong != '' AND locate(x.wrong, a.t) > 0
          THEN named_struct('t', overlay(a.t PLACING x.right FROM locate(x.wrong, a.t) FOR length(x.wrong)), 'n', a.n + 1) ELSE a END)""")
    return docs.join(packed, "doc_id", "left").withColumn("__r", fold).withColumns({"fixed": F.col("__r.t"), "applied": F.col("__r.n")}).drop("__f", "__r")


def first_keys(rows: DataFrame, text: str, stage: str, size: int = 60, doc: str = "doc_id") -> DataFrame:
    """Rows whose first ``size`` letters weren't found by an earlier stage or row."""
    w = Window.partitionBy(doc, F.lower(F.substring(text, 1, size))).orderBy(stage, text)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def _lines(docs: DataFrame, doc: str) -> DataFrame:
    return docs.select(doc, F.posexplode(F.split("raw", "\n", -1)).alias("__k", "text")).select(doc, (F.col("__k") + 1).alias("line"), "text")


def metadata_cards(docs: DataFrame, found: DataFrame, shown: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, dimension, name, line, wrong, right, auto)``: a card for each wrong
    language, number or date of ``docs(doc, raw)``, at the line of the root or number
    tag; only a language can be put right by itself, as ``shown(doc, s_lang)`` says."""
    wrong = found.where((F.col("dimension") == "metadata") & (F.col("points") > 0)).select(doc, "name")
    l = _lines(docs.join(wrong.select(doc).distinct(), doc, "left_semi"), doc).withColumn("__n", F.regexp_like("text", F.lit(r"<N[\s>]"))).withColumn("__r", F.contains("text", F.lit("<POLIDOC")))
    first = l.where("__n OR __r").groupBy(doc).agg(F.min_by(F.struct("line", "text"), F.when(F.col("__n"), F.col("line"))).alias("n"), F.min_by(F.struct("line", "text"), F.when(F.col("__r"), F.col("line"))).alias("r"))
    place = F.when(F.col("name") == "number", F.col("n")).otherwise(F.col("r"))
    rows = wrong.join(first, doc).withColumn("p", place).where("p IS NOT NULL").join(shown, doc)
    language = F.col("name") == "language"
    attr = lambda v: F.concat(F.lit('LANG="'), v, F.lit('"'))
    right = F.replace(F.col("p.text"), attr(F.regexp_extract("p.text", 'LANG="([^"]*)"', 1)), attr(F.col("s_lang")))
    return rows.select(doc, F.lit("metadata").alias("dimension"), "name", F.col("p.line").alias("line"), F.col("p.text").alias("wrong"), F.when(language, right).alias("right"), language.alias("auto"))


def issue_cards(docs: DataFrame, issues: DataFrame, tags: dict[str, str], doc: str = "doc_id") -> DataFrame:
    """``(doc, dimension, severity, name, line)``: a card for each issue of the rules in
    ``tags`` (rule to tag), at the first line on which that tag opens."""
    of = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    i = issues.where(F.col("rule").isin(*tags)).select(doc, F.col("category").alias("dimension"), "severity", F.col("rule").alias("name"), of[F.col("rule")].alias("tag"))
    names = sorted(set(tags.values()))
    found = _lines(docs.join(i.select(doc).distinct(), doc, "left_semi"), doc).select(doc, "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"<({'|'.join(names)})[\s>/]"), F.lit(1)))).alias("tag"))
    first = found.groupBy(doc, "tag").agg(F.min("line").alias("line"))
    return i.join(first, [doc, "tag"]).select(doc, "dimension", "severity", "name", "line").distinct()


def wrapping_cards(items: DataFrame, lines: DataFrame, tag: str, doc: str = "doc_id") -> DataFrame:
    """``(doc, text, line, wrong, right, auto)``: for each item that should be wrapped in
    ``tag`` the first line that holds it, as it is and wrapped; ``auto`` where the case
    agrees too."""
    from quireline.functions.text import wrap_in_tag
    from quireline.operators.compare import holding

    i = items.select(doc, "text", F.lower("text").alias("x")).distinct()
    held = holding(lines.select(doc, "line", F.lower("text").alias("y")), i.select(doc, "x"), doc, ("line",)).groupBy(doc, "x").agg(F.min("line").alias("line"))
    rows = i.join(held, [doc, "x"]).join(lines.select(doc, "line", F.col("text").alias("wrong")), [doc, "line"])
    return rows.select(doc, "text", "line", "wrong", wrap_in_tag(F.col("wrong"), F.col("text"), tag).alias("right"), F.contains("wrong", F.col("text")).alias("auto"))


def inverted_cards(pairs: DataFrame, most: int = 5, doc: str = "doc_id") -> DataFrame:
    """``(doc, first, second)``: up to ``most`` (as many as a reviewer is shown) pairs of
    neighbouring headings of a matching ``(doc, a, b, text)`` that stand the other way
    round in the source, in the target's order."""
    w = Window.partitionBy(doc).orderBy("a")
    rows = pairs.withColumns({"__b": F.lead("b").over(w), "second": F.lead("text").over(w)}).where(F.col("b") > F.col("__b"))
    rows = rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    return rows.select(doc, F.col("text").alias("first"), "second")


def placement_cards(missing: DataFrame, source: DataFrame, target: DataFrame, doc: str = "doc_id", key: str = "para_id", order: str = "idx") -> DataFrame:
    """``(doc, key, after)``: where a missing source text belongs: behind the place in the
    target of the nearest source text before it that the target has (null if none).
    ``source(doc, key, idx, found_at)`` has the target's place of each found text."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = source.withColumn("after", F.last("found_at", ignorenulls=True).over(w))
    return missing.select(doc, key).join(placed.select(doc, key, "after"), [doc, key])
