"""Layout operators over ``spans`` (page, block, line, span, text, size, flags,
font, bbox) and over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.functions import text as T

BOLD_FLAG, ITALIC_FLAG = 16, 2
# Words of a web page's frame.
CHROME = ("sign in", "français", "trading status", "home trading", "toronto stock exchange trading notices", "copyright © 20", "tmx group limited")
# Patterns of texts that a target may leave out; letter case doesn't count.
OMITTED = (
    r"^\d{1,4}$",
    r"^page\s+\d{1,4}",
    r"^table\s+of\s+contents",
    r"copyright\s+©?\s*20\d{2}",
    r"^\s*(continued|suite)\s*$",
    r"^(home|trading|français|sign in)",
    r"thomson\s+reuters",
    r"^(?:january|february|march|april|may|june|july|august|september|october|november|december|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)\s+\d{1,2},?\s+\d{4}$",
    r"^\d{7}$",
    r"\.{5,}",
    r"^\d{1,3}\s+(?:see|ibid|supra|infra|note\b)",
    r"^\d{1,3}\s+.{5,}\.(?:ca|com|gov|org|net)(?:[/\s]|$)",
    r"^\(\d{4}\),\s+\d+\s+oscb\s+\d+",
    r"^b\.\d*[:\s]",
    r"^[-–]\s+and\s+[-–]$",
    r"^\d{1,2},\s+\d{4}$",
    r"^\(as\s+of\b",
    r"^made\s+under\s+the\b",
    r"^,",
    r"^q[1-4]\s+\d{4}$",
    r"^%\s+change\b",
    r"^date:\s+\d",
    r"^(?:part|section|chapter)\s+\d+[a-z]?\s*$",
    r"^(?:annex|appendix)\s+[a-z]\s*$",
    r"^(?:i{1,3}|iv|vi{0,3}|ix|xi{0,2}|xiv|xv)\.\s+\S",
    r"(?:securities\s+commission|securities\s+authority)\s*$",
    r"^(?:canadian\s+investment\s+regulatory\s+organization|cipf)\s*$",
    r"\bstrikethrough\b",
    r"^(?:document\s+(?:type|no\.?|number|date|title)|effective\s+date|reference\s+no\.?)\s*[:\s]*$",
    r"^(?:part|section|article|division|schedule|item)\s+\d+[a-z]?\s+(?:[-–—]|definitions?|purposes?|interpretation|effective\s+date|general|application|exemption|transitional|repeal)\b",
    r"^fli[;,\s].*fofi",
    r"^(?:\S{1,2}\s+){2,}\S{1,2}$",
    r"^(?:rules\s+and\s+policies|notices\s+and\s+news\s+releases)$",
    r"^\d+\s*\|",
    r"^(?:part|section|article|division|schedule|item)\s+\d+[a-z]?\s*[–—-]",
)

#: A span's place.
SPAN_KEYS = ["doc_id", "page", "block", "line"]


def span_lines(spans: DataFrame, joint: str = " ") -> DataFrame:
    """``(doc_id, page, block, line, text, size, bold, italic, x0, y0, x1, y1)``:
    spans of a line joined in order; empty lines left out. A line's spans are few,
    so each group is bounded."""
    named = F.lower(F.coalesce("font", F.lit("")))
    rows = spans.groupBy(*SPAN_KEYS).agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), joint)).alias("text"),
        F.max("size").alias("size"),
        F.bool_or(F.col("flags").bitwiseAND(BOLD_FLAG) > 0).alias("bold"),
        F.bool_or((F.col("flags").bitwiseAND(ITALIC_FLAG) > 0) | named.rlike("italic|oblique")).alias("italic"),
        F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"),
        F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"),
    )
    return rows.where("text != ''")


def styled_spans(spans: DataFrame, flag: int, font_pattern: str, least: int = 3) -> DataFrame:
    """``(doc_id, page, text)`` of spans whose flag or font name shows a style."""
    hit = (F.col("flags").bitwiseAND(flag) > 0) | F.coalesce("font", F.lit("")).rlike(f"(?i){font_pattern}")
    return spans.where(hit & (F.length(F.trim("text")) >= least)).select("doc_id", "page", F.trim("text").alias("text"))


def is_page_number(text: Column) -> Column:
    return F.regexp_like(F.trim(text), F.lit(r"^[0-9]{1,4}$"))


def is_footnote_line(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^[0-9]{1,3}\s+\S"))


def is_omitted(text: Column) -> Column:
    return F.regexp_like(F.trim(text), F.lit("(?i)" + "|".join(OMITTED)))


def web_chrome(lines: DataFrame, order: str = "idx", least: int = 2, first: int = 10) -> DataFrame:
    """``(doc_id)`` of documents whose first lines show a web page's frame."""
    top = lines.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).where(F.col("k") <= first)
    shown = top.groupBy("doc_id").agg(*[F.max(F.contains(F.lower("text"), F.lit(s)).cast("int")).alias(f"s{i}") for i, s in enumerate(CHROME)])
    return shown.where(sum((F.col(f"s{i}") for i in range(len(CHROME))), F.lit(0)) >= least).select("doc_id")


def running_lines(lines: DataFrame, by: str = "pages", share: float = 0.4, least: int = 2) -> DataFrame:
    """``(doc_id, norm, n)`` of lines that recur as running heads: on at least
    ``share`` of the pages (``by="pages"``) or as often (``by="occurrences"``), and
    ``least`` times."""
    rows = lines.select("doc_id", "page", T.squeeze(F.lower("text")).alias("norm"))
    pages = rows.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    n = F.count_distinct("page") if by == "pages" else F.count("*")
    return rows.groupBy("doc_id", "norm").agg(n.alias("n")).join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(float(least)), F.col("pages") * share)).select("doc_id", "norm", "n")


def without_running(lines: DataFrame, **how) -> DataFrame:
    """Lines that aren't running heads."""
    run = running_lines(lines, **how).select("doc_id", F.col("norm").alias("__norm"))
    return lines.withColumn("__norm", T.squeeze(F.lower("text"))).join(run, ["doc_id", "__norm"], "left_anti").drop("__norm")


def upper_median(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """``(*key, median)``: the element at half the number of rows, counted from 0.

    Values are counted before they are ranked, so a group of many rows is as small
    as its number of different values.
    """
    w = Window.partitionBy(*key)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    run = counts.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "all": F.sum("n").over(w)})
    return run.where((F.col("upto") > F.expr("all div 2")) & (F.col("upto") - F.col("n") <= F.expr("all div 2"))).select(*key, F.col(value).alias("median"))


def modal_value(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """``(*key, mode, n)``: the most frequent value, of equal ones the smallest."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def heading_lines(lines: DataFrame, sizes: DataFrame, factor: float = 1.15, least: int = 15, most_words: int = 20) -> DataFrame:
    """Lines that look like headings: bold or larger than the median size, long
    enough, not too many words, not a number."""
    big = F.col("bold") | (F.col("size") >= F.col("median") * factor)
    fit = (F.length("text") >= least) & (T.word_count(F.col("text")) <= most_words) & ~is_page_number(F.col("text"))
    return lines.join(sizes, "doc_id").where(big & fit).drop("median")


def footnotes_by_size(lines: DataFrame, sizes: DataFrame, factor: float = 0.85) -> DataFrame:
    """Lines in small type that begin with a note mark."""
    return lines.join(sizes, "doc_id").where((F.col("size") < F.col("median") * factor) & F.regexp_like("text", F.lit(r"^[0-9*†‡§]+\s"))).drop("median")


def in_content_zone(lines: DataFrame, hard: tuple[float, float] = (0.07, 0.97), soft: tuple[float, float] = (0.10, 0.93), words: int = 10) -> DataFrame:
    """Lines outside the head and foot zones; in the zones next to them only long lines."""
    y = F.col("y0") / F.col("page_h")
    return lines.where((y >= hard[0]) & (y <= hard[1]) & ((y.between(*soft)) | (T.word_count(F.col("text")) >= words)))


def merge_lines(column: str = "__lines", short: int = 70) -> Column:
    """Array column of lines of one document or page block merged into paragraphs: a line goes on
    if the text so far has no final mark, or is short and the line begins small."""
    merged = F.expr(f"""aggregate({column}, named_struct('buf', '', 'out', cast(array() as array<string>)), (a, x) -> CASE
        WHEN a.buf = '' THEN named_struct('buf', x, 'out', a.out)
        WHEN NOT rtrim(a.buf) RLIKE '[.?!:;]$' OR (length(a.buf) < {short} AND NOT substring(x, 1, 1) RLIKE '[\\\\p{{Lu}}]')
          THEN named_struct('buf', concat(rtrim(a.buf), ' ', x), 'out', a.out)
        ELSE named_struct('buf', x, 'out', concat(a.out, array(a.buf))) END,
      a -> CASE WHEN a.buf = '' THEN a.out ELSE concat(a.out, array(a.buf)) END)""")
    return merged


def paragraphs_from_lines(lines: DataFrame, order: str = "idx", least_words: int = 4, block: int = 2000, short: int = 70) -> DataFrame:
    """``(doc_id, chunk, ord, text)``: lines merged into paragraphs. A document is
    merged run by run: where a final mark ends a line that is long or comes before a
    capital, no text so far lets the next line go on. ``chunk`` tells the ``block``
    lines in which a paragraph's run begins, ``ord`` counts in it."""
    rows = lines.where(~is_omitted(F.col("text"))).select("doc_id", order, "text")
    w = Window.partitionBy("doc_id").orderBy(order, "text")
    last = F.lag("text").over(w)
    ends = F.regexp_like(F.rtrim(last), F.lit(r"[.?!:;]$")) & ((F.length(last) >= short) | F.regexp_like(F.substring("text", 1, 1), F.lit(r"\p{Lu}")))
    rows = rows.withColumn("__ends", F.coalesce(ends, F.lit(False)))
    rows = rows.withColumn("run", F.count_if("__ends").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    packed = rows.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("l"))
    packed = packed.select("doc_id", "run", F.expr(f"l[0].{order} div {block}").alias("chunk"), F.transform("l", lambda x: x["text"]).alias("__lines"))
    out = packed.select("doc_id", "chunk", "run", F.posexplode(merge_lines("__lines", short)).alias("k", "text"))
    place = F.row_number().over(Window.partitionBy("doc_id", "chunk").orderBy("run", "k")) - 1
    return out.select("doc_id", "chunk", place.alias("ord"), "text").where(T.word_count(F.col("text")) >= least_words)


def distinct_headings(rows: DataFrame, order: str = "idx", least: float = 0.8, most: int = 2000) -> DataFrame:
    """``(doc_id, headings)``: headings in order without those whose words overlap a
    kept one by ``least``; a fold, since what is kept decides what goes. Headings
    are gathered in parts of ``most`` and folded one part after the other, each
    against what all earlier ones kept."""
    part = F.expr(f"{order} div {most}").alias("part")
    parts = rows.groupBy("doc_id", part).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))).alias("h"))
    got = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "h"))).alias("p"))
    kept = F.expr(f"""aggregate(p, cast(array() as array<struct<t:string,w:array<string>>>), (k, q) -> aggregate(q.h, k, (a, x) ->
        CASE WHEN exists(a, y -> size(array_union(y.w, __w(x.t))) > 0 AND size(array_intersect(y.w, __w(x.t))) >= {least} * size(array_union(y.w, __w(x.t))))
          THEN a ELSE concat(a, array(named_struct('t', x.t, 'w', __w(x.t)))) END))""".replace(
        "__w(x.t)", "array_distinct(filter(split(trim(regexp_replace(lower(x.t), '[^a-z0-9 ]', '')), ' '), q -> q != ''))"))
    return got.select("doc_id", kept.alias("k")).select("doc_id", F.transform("k", lambda x: x["t"]).alias("headings"))


def two_columns(lines: DataFrame, share: float = 0.55, least: int = 20, pages: int = 5) -> DataFrame:
    """``(doc_id, two_column)``: whether the median line is narrower than ``share``
    of four fifths of the page."""
    rows = lines.where((F.length("text") >= least) & (F.col("page") < pages)).withColumn("w", F.col("x1") - F.col("x0"))
    width = rows.groupBy("doc_id").agg(F.avg("page_w").alias("page_w"))
    return upper_median(rows, ["doc_id"], "w").join(width, "doc_id").select("doc_id", (F.col("median") / (0.8 * F.col("page_w")) < share).alias("two_column"))


def column_of(lines: DataFrame, gap: float = 0.08) -> DataFrame:
    """Lines with their column by gaps between left edges in the page's middle."""
    edges = lines.select("doc_id", "page", "x0", "page_w").distinct()
    w = Window.partitionBy("doc_id", "page").orderBy("x0")
    step = (F.col("x0") - F.lag("x0").over(w) >= F.col("page_w") * gap) & (F.col("x0") / F.col("page_w")).between(0.3, 0.7)
    col = F.sum(F.when(step, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.join(edges.withColumn("column", col).drop("page_w"), ["doc_id", "page", "x0"])


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with ``ord``: by page, column, height and left edge."""
    w = Window.partitionBy("doc_id", "page").orderBy("column", "y0", "x0")
    return lines.withColumn("ord", F.row_number().over(w))


def joins_next_page(blocks: DataFrame) -> DataFrame:
    """Last blocks of pages that go on in the first block of the next: no final
    mark, small first letter, same font, sizes close. ``blocks(doc_id, page, ord,
    text, font, size, heading)``."""
    w = Window.partitionBy("doc_id", "page")
    ends = blocks.withColumns({"a": F.row_number().over(w.orderBy("ord")), "z": F.row_number().over(w.orderBy(F.desc("ord")))})
    last = ends.where("z = 1").select("doc_id", "page", F.col("text").alias("text"), "font", "size", "heading")
    first = ends.where("a = 1").select("doc_id", (F.col("page") - 1).alias("page"), F.col("text").alias("next_text"), F.col("font").alias("f2"), F.col("size").alias("s2"), F.col("heading").alias("h2"))
    return last.join(first, ["doc_id", "page"]).where(
        ~F.col("text").rlike(r"[.?!:;]\s*$") & F.col("next_text").rlike(r"^\p{Ll}") & F.col("font").eqNullSafe(F.col("f2"))
        & (F.abs(F.col("size") - F.col("s2")) <= 1.5) & ~F.col("heading") & ~F.col("h2")
    ).select("doc_id", "page", F.concat_ws(" ", "text", "next_text").alias("text"))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of box ``a`` that lies in box ``b``."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, side("x0", "x1") * side("y0", "y1") / area).otherwise(0.0)


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.5, caption: float = 20.0) -> DataFrame:
    """Text blocks of which at most ``share`` lies in a table of their page, or that
    stand within ``caption`` points above one and name it."""
    t = tables.select("doc_id", "page", F.col("bbox").alias("tb"))
    near = F.regexp_like("text", F.lit(r"(?i)^(?:table|figure|exhibit)\b")) & (F.col("tb.y0") - F.col("bbox.y1")).between(-caption, caption)
    inside = blocks.join(t, ["doc_id", "page"]).where((overlap_ratio(F.col("bbox"), F.col("tb")) > share) & ~near).select("doc_id", "page", "block").distinct()
    return blocks.join(inside, ["doc_id", "page", "block"], "left_anti")


def heading_level(size: Column, body: Column, bold: Column, words: Column) -> Column:
    """Level 1 to 4 of a heading by how much larger than the body its type is, 4 too for
    short bold text of body size, 0 for what is none."""
    more = size - body
    return F.when(more > 6, 1).when(more > 3, 2).when(more > 1.5, 3).when(more > 0.5, 4).when(bold & (words <= 12), 4).otherwise(0)


def table_pages(drawings: DataFrame, least: int = 4) -> DataFrame:
    """``(doc_id, tables)``: pages with at least ``least`` long thin rules.
    ``drawings(doc_id, page, bbox)``."""
    rules = drawings.where((F.col("bbox.y1") - F.col("bbox.y0") < 3) & (F.col("bbox.x1") - F.col("bbox.x0") > 50))
    return rules.groupBy("doc_id", "page").agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy("doc_id").agg(F.count("*").alias("tables"))


def line_metadata(first_page: Column) -> dict[str, Column]:
    """Language hint, reference number and date of a first page's text."""
    return {"language_hint": T.language_hint(first_page), "doc_number": T.number_reference(first_page), "doc_date": T.text_date(first_page)}


def image_count(blocks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """``(doc_id, images)``: image blocks (``block_type`` 1) of each document; of one
    without any, the images that ``images(doc_id, name)`` lists, each once."""
    n = blocks.groupBy("doc_id").agg(F.count_if(F.col("block_type") == 1).alias("images"))
    if images is None:
        return n
    listed = images.groupBy("doc_id").agg(F.count_distinct("name").alias("listed"))
    both = n.join(listed, "doc_id", "full_outer")
    return both.select("doc_id", F.when(F.coalesce("images", F.lit(0)) > 0, F.col("images")).otherwise(F.coalesce("listed", F.lit(0))).alias("images"))


def ruled_cells(drawings: DataFrame, spans: DataFrame, thin: float = 3.0, long_: float = 20.0) -> DataFrame:
    """``(doc_id, page, row, col, text)``: the cells that a page's rules cut out, with the
    texts whose middle lies in each (empty if none). ``drawings(doc_id, page, bbox)``,
    ``spans(doc_id, page, text, bbox)``. A page's rules are few and rounded before they
    are ordered; spans meet cells of their own page only."""
    wide, tall = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")

    def steps(is_rule: Column, at: str, name: str) -> DataFrame:
        edges = drawings.where(is_rule).select("doc_id", "page", F.round(at, 0).alias("lo")).distinct()
        w = Window.partitionBy("doc_id", "page").orderBy("lo")
        return edges.withColumns({f"{name}_hi": F.lead("lo").over(w), name: F.row_number().over(w) - 1}).where(f"{name}_hi IS NOT NULL").withColumnRenamed("lo", f"{name}_lo")

    rows = steps((tall < thin) & (wide > long_), "bbox.y0", "row")
    cols = steps((wide < thin) & (tall > long_), "bbox.x0", "col")
    grid = rows.join(cols, ["doc_id", "page"])
    x, y = (F.col("bbox.x0") + F.col("bbox.x1")) / 2, (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    s = spans.select("doc_id", "page", "text", x.alias("x"), y.alias("y"))
    inside = grid.join(s, ["doc_id", "page"]).where((F.col("y") >= F.col("row_lo")) & (F.col("y") < F.col("row_hi")) & (F.col("x") >= F.col("col_lo")) & (F.col("x") < F.col("col_hi")))
    texts = inside.groupBy("doc_id", "page", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda t: t["text"]), " ").alias("text"))
    return grid.select("doc_id", "page", "row", "col").join(texts, ["doc_id", "page", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def interleaved(blocks: DataFrame, tables: DataFrame, notes: DataFrame) -> DataFrame:
    """``(doc_id, ord, kind, text)``: a document's blocks and tables as they stand on its
    pages, footnotes after all of them. All three are ``(doc_id, page, y0, text)``."""
    one = lambda df, kind, last: df.select("doc_id", F.lit(last).alias("last"), "page", "y0", F.lit(kind).alias("kind"), "text")
    rows = one(blocks, "block", 0).unionByName(one(tables, "table", 0)).unionByName(one(notes, "note", 1))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("last", "page", "y0", "kind", "text"))).select("doc_id", "ord", "kind", "text")
