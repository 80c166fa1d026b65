"""Markup extraction: tags, attributes, blocks, sections, depth, paths and lines.

``MarkupVocabulary`` names the tags that play a part, so the same operators read
SGML filings and HTML pages. Tags match exactly (``<P>`` isn't ``<PART>``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.functions import text as T

TAG = r"<(/?[A-Za-z][A-Za-z0-9]*)"
ATTRIBUTE = r"([A-Za-z_][A-Za-z0-9_-]*)\s*=\s*\"([^\"]*)\""


@dataclass(frozen=True)
class MarkupVocabulary:
    """Tags by the part they play."""

    root: str = "POLIDOC"
    ident: str = "POLIDENT"
    heading: str = "TI"
    number: str = "N"
    paragraphs: tuple[str, ...] = ("P", "P1", "P2", "P3", "P4", "PARAP", "SECP", "SSECP", "DEFP")
    item: str = "ITEM"
    line: str = "LINE"
    table: str = "TABLE"
    row: str = "TBLROW"
    cell: str = "TBLCELL"
    footnote: str = "FOOTNOTE"
    graphic: str = "GRAPHIC"
    emphasis: tuple[str, ...] = ("BOLD", "EM")
    blocks: tuple[str, ...] = ("BLOCK2", "BLOCK3", "BLOCK1")
    void: tuple[str, ...] = ("GRAPHIC", "TBLCDEF")


HTML = MarkupVocabulary(
    root="html", ident="head", heading="h1", number="title", paragraphs=("p",), item="li", line="a", table="table", row="tr", cell="td",
    footnote="sup", graphic="img", emphasis=("b", "i", "em"), blocks=("h2", "h1"), void=("meta", "br", "img", "link", "hr", "input"),
)


def tag_stream(raw: Column) -> Column:
    """Tags in order, closing ones with their slash."""
    return F.regexp_extract_all(raw, F.lit(TAG), F.lit(1))


def tag_events(docs: DataFrame, raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key, ord, tag, closing, offset, line, attrs)`` of every tag.

    Offsets count from 0, lines from 1; ``attrs`` is what stands between the name
    and the end of the tag. Null or empty texts have no events.
    """
    parts = F.split(F.col(raw), r"(?=</?[A-Za-z][A-Za-z0-9]*)", -1)
    cut = docs.select(key, F.posexplode(parts).alias("k", "part"))
    order = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    newlines = F.length("part") - F.length(F.replace(F.col("part"), F.lit("\n"), F.lit("")))
    placed = cut.withColumns({
        "offset": F.coalesce(F.sum(F.length("part")).over(order), F.lit(0)), "line": F.coalesce(F.sum(newlines).over(order), F.lit(0)) + 1,
        "name": F.regexp_extract("part", r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1),
    }).where("name != ''")
    return placed.select(
        key, F.row_number().over(Window.partitionBy(key).orderBy("k")).alias("ord"), F.replace("name", F.lit("/"), F.lit("")).alias("tag"),
        F.startswith("name", F.lit("/")).alias("closing"), "offset", "line",
        F.trim(F.regexp_extract("part", r"^</?[A-Za-z][A-Za-z0-9]*([^>]*)>", 1)).alias("attrs"),
    )


def tag_counts(docs: DataFrame, raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key, tag, opens, closes)``; counted from the stream without offsets."""
    names = docs.select(key, F.explode(tag_stream(F.col(raw))).alias("name"))
    closing = F.startswith("name", F.lit("/"))
    return names.groupBy(key, F.lower(F.replace("name", F.lit("/"), F.lit(""))).alias("tag")).agg(
        F.count_if(~closing).alias("opens"), F.count_if(closing).alias("closes")
    )


def tag_lines(docs: DataFrame, raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key, tag, lines)``: the lines on which each tag opens, in order."""
    rows = docs.select(key, F.posexplode(F.split(F.col(raw), "\n", -1)).alias("k", "text"))
    names = rows.select(key, (F.col("k") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    return names.groupBy(key, F.lower("tag").alias("tag")).agg(F.array_sort(F.collect_list("line")).alias("lines"))


def attribute(raw: Column, tag: str, name: str) -> Column:
    """Value of an attribute on the first ``tag`` that has it, else null."""
    return F.nullif(F.regexp_extract(raw, rf"(?is)<{tag}\s[^>]*?\b{name}\s*=\s*\"([^\"]*)\"", 1), F.lit(""))


def root_attributes(raw: Column, tag: str) -> Column:
    """All attributes of the first ``tag`` as a map; of equal names the last wins."""
    head = F.regexp_extract(raw, rf"(?is)<{tag}\b([^>]*)>", 1)
    names, values = (F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"]))
    return F.map_from_entries(last)


def elements(raw: Column, tag: str) -> Column:
    """Contents of every ``tag`` up to its next end."""
    return F.regexp_extract_all(raw, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def inner_text(html: Column) -> Column:
    """Text without tags, single spaces."""
    return T.squeeze(F.regexp_replace(html, "<[^>]*>", " "))


def element_texts(raw: Column, tag: str) -> Column:
    """Texts of every ``tag``, empty ones left out."""
    return F.filter(F.transform(elements(raw, tag), inner_text), lambda x: x != "")


def count_tag(raw: Column, tag: str) -> Column:
    """Number of opening tags."""
    return F.regexp_count(raw, F.lit(rf"(?i)<{tag}[\s>/]"))


def paragraphs(raw: Column, v: MarkupVocabulary, least_words: int = 3) -> Column:
    """Paragraph texts: the ident block left out, tables and footnotes as place
    marks, paragraphs of fewer words dropped."""
    body = F.regexp_replace(raw, rf"(?is)<{v.ident}\b.*?</{v.ident}>", " ")
    body = F.regexp_replace(body, rf"(?is)<{v.table}(?:\s[^>]*)?>.*?</{v.table}>", " [TABLE] ")
    body = F.regexp_replace(body, rf"(?is)<{v.footnote}(?:\s[^>]*)?>.*?</{v.footnote}>", " [FOOTNOTE] ")
    names = "|".join(sorted(v.paragraphs, key=lambda x: (-len(x), x)))
    found = F.regexp_extract_all(body, F.lit(rf"(?is)<({names})(?:\s[^>]*)?>(.*?)</\1>"), F.lit(2))
    return F.filter(F.transform(found, inner_text), lambda x: F.size(T.words(x)) >= least_words)


def sections(docs: DataFrame, v: MarkupVocabulary, raw: str = "raw", key: str = "doc_id", longest: int | None = None, preamble_words: int = 10) -> DataFrame:
    """``(key, ord, heading, content, raw_len)``: a text split at the first block
    level of the vocabulary that occurs at least twice; what comes before the first
    block counts if it has ``preamble_words`` words; ``content`` is the whole text or,
    if asked for, its first ``longest`` code points, ``raw_len`` its whole length."""
    level = F.coalesce(*[F.when(count_tag(F.col(raw), b) >= 2, F.lit(b)) for b in v.blocks], F.lit(v.blocks[0]))
    split = F.coalesce(*[F.when(level == b, F.split(F.col(raw), rf"(?i)(?=<{b}[\s>])", -1)) for b in v.blocks])
    rows = docs.select(key, level.alias("level"), F.posexplode(split).alias("ord", "part"))
    body = inner_text(F.col("part"))
    rows = rows.withColumns({"content": body, "heading": F.get(element_texts(F.col("part"), v.heading), F.lit(0))})
    starts = F.regexp_like("part", F.concat(F.lit("(?i)^<"), F.col("level"), F.lit(r"[\s>]")))
    kept = rows.where(starts | (F.size(T.words(F.col("content"))) >= preamble_words))
    content = F.col("content") if longest is None else F.substring("content", 1, longest)
    return kept.select(key, "ord", F.coalesce("heading", F.lit("")).alias("heading"), content.alias("content"), F.length("content").alias("raw_len"))


def nesting_depth(raw: Column, void: tuple[str, ...] = ()) -> Column:
    """Greatest depth of the tag stream; closing below zero doesn't count."""
    skip = [t.lower() for t in void]
    steps = F.transform(tag_stream(raw), lambda t: F.when(F.lower(F.replace(t, F.lit("/"), F.lit(""))).isin(skip), 0).when(F.startswith(t, F.lit("/")), -1).otherwise(1))
    state = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    return F.aggregate(
        steps, state,
        lambda s, x: F.struct(F.greatest(s["d"] + x, F.lit(0)).alias("d"), F.greatest(s["m"], s["d"] + x).alias("m")), lambda s: s["m"],
    )


def line_of(raw: Column, offset: Column) -> Column:
    """Line (from 1) of a place (from 0) in a text; only line feeds end lines."""
    head = F.substring(raw, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def nth_tag_line(events: DataFrame, tag: str, n: int, key: str = "doc_id") -> DataFrame:
    """``(key, line)`` of the n-th opening ``tag`` (from 1)."""
    opens = events.where((F.lower("tag") == tag.lower()) & ~F.col("closing"))
    return opens.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("k") == n).select(key, "line")


def tag_paths(docs: DataFrame, v: MarkupVocabulary, raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key, ord, tag, path)``: for every opening tag the open tags around it.

    A stack is folded over the stream: a closing tag takes the stack back to before
    its last opening one, and changes nothing if there is none; void tags open
    nothing.
    """
    stack = F.expr(f"""aggregate(stream, named_struct('s', cast(array() as array<string>), 'o', cast(array() as array<struct<tag:string,path:string>>)),
      (a, t) -> CASE
        WHEN t LIKE '/%' THEN named_struct('s', slice(a.s, 1, CASE WHEN array_contains(a.s, substring(t, 2)) THEN size(a.s) - array_position(reverse(a.s), substring(t, 2)) ELSE size(a.s) END), 'o', a.o)
        WHEN array_contains(void, t) THEN named_struct('s', a.s, 'o', concat(a.o, array(named_struct('tag', t, 'path', array_join(concat(a.s, array(t)), '/')))))
        ELSE named_struct('s', concat(a.s, array(t)), 'o', concat(a.o, array(named_struct('tag', t, 'path', array_join(concat(a.s, array(t)), '/'))))) END,
      a -> a.o)""")
    rows = docs.select(key, F.transform(tag_stream(F.col(raw)), lambda t: F.lower(t)).alias("stream"), F.array(*[F.lit(t.lower()) for t in v.void]).alias("void"))
    return rows.select(key, F.posexplode(stack).alias("ord", "x")).select(key, "ord", "x.tag", "x.path")


def block_order_faults(docs: DataFrame, prefix: str = "BLOCK", raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key, kind, outer, inner)``, each once: numbered blocks inside a block of
    equal or greater number (``reverse``) or more than one level below (``skip``)."""
    paths = tag_paths(docs, MarkupVocabulary(void=()), raw, key).where(F.regexp_like("tag", F.lit(rf"^{prefix.lower()}[0-9]+$")))
    levels = F.transform(F.filter(F.split("path", "/"), lambda x: F.regexp_like(x, F.lit(rf"^{prefix.lower()}[0-9]+$"))), lambda x: F.regexp_extract(x, "([0-9]+)$", 1).cast("int"))
    rows = paths.select(key, levels.alias("l")).where(F.size("l") >= 2).select(key, F.element_at("l", -1).alias("inner"), F.slice("l", 1, F.size("l") - 1).alias("outer"))
    back = rows.select(key, F.lit("reverse").alias("kind"), F.explode(F.filter("outer", lambda x: x > F.col("inner"))).alias("outer"), "inner")
    skip = rows.where(F.col("inner") > F.element_at("outer", -1) + 1).select(key, F.lit("skip").alias("kind"), F.element_at("outer", -1).alias("outer"), "inner")
    return back.unionByName(skip).distinct()


def contained(raw: Column, outer: str, inner: str) -> Column:
    """Number of ``outer`` blocks that hold an opening ``inner``."""
    return F.size(F.filter(elements(raw, outer), lambda b: F.regexp_like(b, F.lit(rf"(?i)<{inner}[\s>/]"))))


def entity_names(raw: Column) -> Column:
    """Names of the entities used, in order."""
    return F.regexp_extract_all(raw, F.lit(r"&([A-Za-z][A-Za-z0-9]*);"), F.lit(1))


def direct_children(raw: Column, tag: str, void: tuple[str, ...] = ()) -> Column:
    """Names of the tags that open right inside the first ``tag``, each once, in order;
    what opens inside another tag is none of them. ``void`` tags open nothing."""
    first = F.get(elements(raw, tag), F.lit(0))
    skip = [t.lower() for t in void]
    state = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("o"))

    def step(s: Column, t: Column) -> Column:
        name = F.replace(t, F.lit("/"), F.lit(""))
        closing, alone = F.startswith(t, F.lit("/")), F.lower(name).isin(skip)
        depth = F.when(alone, s["d"]).when(closing, F.greatest(s["d"] - 1, F.lit(0))).otherwise(s["d"] + 1)
        return F.struct(depth.alias("d"), F.when(~closing & (s["d"] == 0), F.array_append(s["o"], name)).otherwise(s["o"]).alias("o"))

    return F.array_distinct(F.aggregate(tag_stream(first), state, step, lambda s: s["o"]))


def part_counts(raw: Column, v: MarkupVocabulary) -> Column:
    """Numbers of tables, footnotes, graphics and sections."""
    return F.struct(
        count_tag(raw, v.table).alias("tables"), count_tag(raw, v.footnote).alias("footnotes"), count_tag(raw, v.graphic).alias("graphics"), count_tag(raw, v.number).alias("sections")
    )


def contents(raw: Column, v: MarkupVocabulary, paragraph_words: int = 5, cell_words: int = 2) -> Column:
    """What a comparison reads of a document: its text, paragraphs, headings and
    cells (shorter ones left out), attributes and counts."""
    long_ = lambda xs, n: F.filter(xs, lambda x: F.size(T.words(x)) >= n)
    return F.struct(
        inner_text(raw).alias("text"), long_(element_texts(raw, v.paragraphs[0]), paragraph_words).alias("paragraphs"), element_texts(raw, v.heading).alias("headings"),
        long_(element_texts(raw, v.cell), cell_words).alias("cells"), root_attributes(raw, v.root).alias("attributes"), part_counts(raw, v).alias("counts"),
        (count_tag(raw, "APPENDIX") > 0).alias("has_appendix"),
    )


def context_lines(docs: DataFrame, places: DataFrame, around: int = 2, raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key, line, snippet)``: the lines around each place ``(key, line)``, the line
    itself marked with an arrow. Lines meet places by equality."""
    lines = docs.select(key, F.posexplode(F.split(F.col(raw), "\n", -1)).alias("k", "text")).withColumn("at", F.col("k") + 1)
    wanted = places.select(key, "line").distinct().withColumn("at", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)))
    marked = F.struct("at", F.concat(F.when(F.col("at") == F.col("line"), "> ").otherwise("  "), F.col("text")).alias("t"))
    got = wanted.join(lines.select(key, "at", "text"), [key, "at"]).groupBy(key, "line").agg(F.array_sort(F.collect_list(marked)).alias("l"))
    return got.select(key, "line", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("snippet"))


def first_line(docs: DataFrame, pattern: str, raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key, line)`` of the first line that a pattern matches."""
    lines = docs.select(key, F.posexplode(F.split(F.col(raw), "\n", -1)).alias("k", "text")).where(F.regexp_like("text", F.lit(pattern)))
    return lines.groupBy(key).agg((F.min("k") + 1).alias("line"))


def table_parts(docs: DataFrame, tag: str = "SGMLTBL", raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key, ord, content, has_head, columns, rows)`` of every table."""
    t = docs.select(key, F.posexplode(elements(F.col(raw), tag)).alias("ord", "content"))
    first_defs = F.get(elements(F.col("content"), "TBLCDEFS"), F.lit(0))
    return t.select(
        key, "ord", "content", (count_tag(F.col("content"), "TBLHEAD") > 0).alias("has_head"), F.coalesce(count_tag(first_defs, "TBLCDEF"), F.lit(0)).alias("columns"),
        count_tag(F.col("content"), "TBLROW").alias("rows"),
    )


def pattern_lines(docs: DataFrame, pattern: str, n: int | None = None, raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key, k, line)`` of all lines that a pattern matches, counted from 1, or of the
    ``n``-th only."""
    lines = docs.select(key, F.posexplode(F.split(F.col(raw), "\n", -1)).alias("__k", "text")).where(F.regexp_like("text", F.lit(pattern)))
    rows = lines.select(key, F.row_number().over(Window.partitionBy(key).orderBy("__k")).alias("k"), (F.col("__k") + 1).alias("line"))
    return rows if n is None else rows.where(F.col("k") == n)


def unparsable(docs: DataFrame, known: dict[str, str], raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key)`` of the texts that no parser reads even once they are made ready for one;
    a warning, since filings needn't be well-formed."""
    from quireline.functions.entities import preprocess
    from quireline.functions.udf import xml_ok

    return docs.where(F.col(raw).isNotNull()).where(~xml_ok(preprocess(F.col(raw), known))).select(key)
