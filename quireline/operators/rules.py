"""Rules as data: what a rule counts is a Column, what it costs is a row.

A catalogue is applied in one pass over the documents; no rule has a scan or a
shuffle of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.operators import markup as M


@dataclass(frozen=True)
class Rule:
    """Name, category, severity, penalty of each hit and its cap, and how to count
    hits in a document's text."""

    name: str
    category: str
    severity: str
    unit: float
    cap: float
    count: Column


def issues(docs: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """``(key, rule, category, severity, n, points)`` of the rules that hit."""
    hits = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.coalesce(r.count.cast("int"), F.lit(0)).alias("n"),
            F.lit(r.unit).alias("unit"), F.lit(r.cap).alias("cap"),
        ) for r in rules
    ])
    rows = docs.select(key, F.explode(F.filter(hits, lambda h: h["n"] > 0)).alias("h"))
    return rows.select(key, "h.rule", "h.category", "h.severity", "h.n", F.least(F.col("h.cap"), F.col("h.n") * F.col("h.unit")).alias("points"))


def category_scores(docs: DataFrame, found: DataFrame, base: dict[str, float], key: str = "doc_id") -> DataFrame:
    """``(key, category, score)``: what is left of each category's points, not below 0."""
    lost = found.groupBy(key, "category").agg(F.sum("points").alias("lost"))
    cats = docs.select(key, F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in base]), F.array(*[F.lit(float(v)) for v in base.values()]))).alias("category", "base"))
    return cats.join(lost, [key, "category"], "left").select(key, "category", F.greatest(F.lit(0.0), F.col("base") - F.coalesce("lost", F.lit(0.0))).alias("score"))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def _empty(raw: Column, tag: str) -> Column:
    return F.size(F.filter(M.elements(raw, tag), lambda x: M.inner_text(x) == ""))


# Tags that filings use.
FILING_TAGS = (
    "POLIDOC POLIDENT FREEFORM QUOTE BLOCK0 BLOCK1 BLOCK2 BLOCK3 BLOCK4 BLOCK5 BLOCK6 PART SEC SECP SSEC SSECP PARA PARAP SPARA SPARAP MDIV MDIV1 DEF DEFP TERM "
    "TI N P P1 P2 P3 P4 ITEM LINE TABLE SGMLTBL TBL TBLCDEFS TBLCDEF TBLHEAD TBLBODY TBLROWS TBLROW TBLCELL TBLNOTE TBLNOTES CL CLP SCL SCLP STATREF STATHIST "
    "REG REFN ACTUNDER APPENDIX ARTICLE CHAPTER FORM SCHEDDOC LEGIDDOC MISCLAW CONTAINR BOLD EM SUP SUB STRIKE ITALIC GRAPHIC LINKTEXT EDITNOTE DATE CITE FOOTNOTE FN DF"
).split()
# Children that a block must not hold.
FORBIDDEN = (("TBLCELL", "P"), ("TABLE", "FOOTNOTE"), ("SGMLTBL", "FOOTNOTE"), ("TBLROW", "FOOTNOTE"), ("TBLCELL", "FOOTNOTE"))
REQUIRED_ATTRIBUTES = ("LABEL", "LANG", "ADDDATE")
# Signs that must be written as entities.
ENTITY_OF = {
    "‘": "&lsquo;", "’": "&rsquo;", "“": "&ldquo;", "”": "&rdquo;", "–": "&ndash;", "—": "&mdash;", "\xa0": "&nbsp;", "é": "&eacute;", "è": "&egrave;", "ê": "&ecirc;",
    "à": "&agrave;", "ô": "&ocirc;", "É": "&Eacute;", "°": "&deg;", "·": "&middot;", "×": "&times;", "±": "&plusmn;", "©": "&copy;", "•": "&bull;", "…": "&hellip;",
    "€": "&euro;", "≥": "&ge;", "≤": "&le;", "½": "&frac12;", "¼": "&frac14;",
}


def unknown_tags(raw: Column, known: list[str]) -> Column:
    """Tags used (in capitals) that aren't known."""
    used = F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), F.upper))
    return F.array_except(used, F.array(*[F.lit(t.upper()) for t in known]))


def raw_signs(text: Column, signs: dict[str, str] = ENTITY_OF) -> Column:
    """Signs that should be entities, with their number, as an array."""
    one = lambda s: F.struct(F.lit(s).alias("sign"), (F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))).alias("n"))
    return F.filter(F.array(*[one(s) for s in signs]), lambda x: x["n"] > 0)


# Labels that a date may have.
DATE_LABELS = ("Effective", "Published", "Amended", "Revised", "Adopted", "Approved", "In Force", "Coming into Force")
#: Elements that the rules read.
READ = ("TABLE", "SGMLTBL", "TBLROW", "TBLCELL", "TBLHEAD", "TBLBODY", "TBLCDEFS", "ITEM", "P", "TI", "N", "DEF", "DATE", "POLIDENT")


def prepared(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """``docs`` with what several rules read: the names of the opening tags (``__tags``)
    and the contents of each element (``__e_``); an element is only searched for in
    texts where its tag opens."""
    text = F.col(raw)
    docs = docs.withColumn("__tags", F.transform(F.regexp_extract_all(text, F.lit(r"<([A-Za-z][A-Za-z0-9]*)[\s>/]"), F.lit(1)), F.upper))
    found = lambda t: F.when(F.array_contains("__tags", t), M.elements(text, t)).otherwise(F.array().cast("array<string>"))
    return docs.withColumns({f"__e_{t}": found(t) for t in READ})


class _Parts:
    """Tags and elements of a text: prepared columns, or expressions over the text."""

    def __init__(self, raw: Column, ready: bool) -> None:
        self.raw, self.ready = raw, ready

    def n(self, tag: str) -> Column:
        return F.size(F.filter(F.col("__tags"), lambda t: t == tag)) if self.ready else M.count_tag(self.raw, tag)

    def each(self, tag: str) -> Column:
        return F.col(f"__e_{tag}") if self.ready else M.elements(self.raw, tag)

    def first(self, tag: str) -> Column:
        return F.get(self.each(tag), F.lit(0))


def _total(values: Column) -> Column:
    """Sum of an array of whole numbers."""
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def filing_rules(raw: Column, entities: list[str], ready: bool = False) -> list[Rule]:
    """Structural rules of a marked-up filing; ``ready`` if ``prepared`` has made the
    columns they read."""
    x = _Parts(raw, ready)
    attrs = M.root_attributes(raw, "POLIDOC")
    has = lambda name: F.map_contains_key(attrs, F.lit(name))
    cells, tables, bodies, items, headings, paragraphs = (x.each(t) for t in ("TBLCELL", "TABLE", "SGMLTBL", "ITEM", "TI", "P"))
    outside = F.regexp_replace(raw, r"(?is)<TABLE(?:\s[^>]*)?>.*?</TABLE>", " ")
    rows = lambda t: M.elements(t, "TBLROW")
    n_cells = lambda t: M.count_tag(t, "TBLCELL")
    holds = lambda parent, child: F.exists(x.each(parent), lambda t: M.count_tag(t, child) > 0)
    empty = lambda texts: F.size(F.filter(texts, lambda t: M.inner_text(t) == ""))
    graphics = F.regexp_extract_all(raw, F.lit(r"(?i)<GRAPHIC(?=[\s>/])([^>]*)>"), F.lit(1))
    names = F.filter(F.transform(graphics, lambda g: F.regexp_extract(g, r"FILENAME=\"([^\"]+)\"", 1)), lambda f: f != "")
    numbers = F.array_sort(F.transform(F.filter(names, lambda f: f.rlike(r"(?i)^SB[0-9]{6}\.BMP$")), lambda f: F.substring(f, 3, 6).cast("int")))
    steps = F.zip_with(numbers, F.slice(numbers, F.lit(2), F.greatest(F.size(numbers), F.lit(1))), lambda a, b: b - a)
    no_notes = F.regexp_replace(raw, r"(?is)<FOOTNOTE(?:\s[^>]*)?>.*?</FOOTNOTE>", "")
    between = F.regexp_extract_all(no_notes, F.lit(r"(?s)</P>(.{1,600}?)</P>"), F.lit(1))
    long_words = lambda t: F.size(F.filter(F.split(F.regexp_replace(t, "<[^>]+>", ""), r"\s+"), lambda w: w.rlike("[a-zA-Z]{3}")))
    no_body = F.filter(F.transform(bodies, lambda t, i: F.when(M.count_tag(t, "TBLBODY") == 0, i)), lambda i: i.isNotNull())
    dates = F.regexp_extract_all(raw, F.lit(r"(?i)<DATE\s[^>]*?LABEL=\"([^\"]+)\""), F.lit(1))
    roots = F.regexp_extract_all(raw, F.lit(r"<POLIDOC[^>]*\sADDDATE=\"([0-9]{8})\""), F.lit(1))
    rising = F.zip_with(roots, F.slice(roots, F.lit(2), F.greatest(F.size(roots), F.lit(1))), lambda a, b: a < b)
    ident = F.coalesce(x.first("POLIDENT"), F.lit(""))
    filled = lambda tag: F.size(M.element_texts(ident, tag)) > 0
    used = F.array_distinct(M.entity_names(raw))
    body = F.regexp_replace(raw, "<[^>]*>", "")
    yes = lambda flags: F.size(F.filter(flags, lambda f: F.coalesce(f, F.lit(False))))
    return [
        Rule("unknown tag", "schema", "major", 1.0, 4.0, F.size(unknown_tags(raw, FILING_TAGS))),
        Rule("no root", "schema", "major", 3.0, 3.0, _flag(F.size(F.map_keys(attrs)) == 0)),
        Rule("attribute missing", "schema", "minor", 0.5, 8.0, F.when(F.size(F.map_keys(attrs)) > 0, F.size(F.array_except(F.array(*[F.lit(a) for a in REQUIRED_ATTRIBUTES]), F.map_keys(attrs))))),
        Rule("language", "schema", "major", 1.0, 1.0, _flag(has("LANG") & ~attrs["LANG"].isin("EN", "FR"))),
        Rule("date form", "schema", "minor", 0.5, 1.0, sum((_flag(has(a) & ~attrs[a].rlike("^[0-9]{8}$")) for a in ("ADDDATE", "MODDATE")), F.lit(0))),
        Rule("empty label", "schema", "minor", 0.5, 0.5, _flag(has("LABEL") & (F.trim(attrs["LABEL"]) == ""))),
        Rule("container without label", "schema", "minor", 0.5, 1e9, F.size(F.filter(F.regexp_extract_all(raw, F.lit(r"(?i)<CONTAINR\b([^>]*)>"), F.lit(1)), lambda a: ~F.contains(F.upper(a), F.lit("LABEL="))))),
        Rule("forbidden child", "nesting", "critical", 1.5, 1e9, sum((_flag(holds(p, c)) for p, c in FORBIDDEN), F.lit(0))),
        Rule("item in paragraph", "nesting", "minor", 1.0, 1.0, _flag(holds("P", "ITEM"))),
        Rule("table body outside table", "nesting", "critical", 2.0, 2.0, F.when(x.n("SGMLTBL") > 0, _flag(M.count_tag(outside, "SGMLTBL") > 0))),
        Rule("empty item", "nesting", "major", 1.0, 2.0, empty(items)),
        Rule("item without paragraph", "nesting", "minor", 0.5, 1.0, F.size(F.filter(items, lambda t: (M.inner_text(t) != "") & (M.count_tag(t, "P") == 0)))),
        Rule("end without paragraph", "nesting", "major", 1.0, 2.0, F.size(F.filter(between, lambda t: ~t.rlike(r"<P[\s>1-4]") & (long_words(t) >= 6)))),
        Rule("unknown entity", "characters", "major", 0.5, 3.0, F.size(F.array_except(used, F.array(*[F.lit(e) for e in entities])))),
        Rule("bare ampersand", "characters", "minor", 0.5, 2.0, F.regexp_count(raw, F.lit(r"&(?!#?[A-Za-z0-9]+;|\s)"))),
        Rule("bare less-than", "characters", "minor", 0.25, 1.0, F.regexp_count(raw, F.lit(r"<(?![/A-Za-z!?])"))),
        Rule("bare greater-than", "characters", "minor", 0.1, 0.5, F.regexp_count(body, F.lit(">"))),
        Rule("raw sign", "characters", "minor", 0.4, 2.0, F.size(raw_signs(raw))),
        Rule("table without body element", "tables", "major", 1.0, 1.0, _flag(F.exists(tables, lambda t: M.count_tag(t, "SGMLTBL") == 0))),
        Rule("paragraph in cell", "tables", "critical", 1.5, 1.5, _flag(F.exists(cells, lambda c: M.count_tag(c, "P") > 0))),
        # The third table and those after it count once together.
        Rule("no table body", "tables", "minor", 0.5, 1e9, F.size(F.filter(no_body, lambda i: i < 2)) + _flag(F.exists(no_body, lambda i: i >= 2))),
        Rule("uneven rows", "tables", "minor", 0.25, 1e9, F.size(F.filter(bodies, lambda t: F.size(F.array_distinct(F.transform(rows(t), n_cells))) > 1))),
        Rule("empty cell", "tables", "info", 0.0, 0.0, F.size(F.filter(cells, lambda c: F.trim(F.regexp_replace(c, r"\s", "")) == ""))),
        # Each table costs at most as much as four loose cells.
        Rule("cell outside row", "tables", "major", 0.5, 1e9, _total(F.transform(bodies, lambda t: F.least(F.lit(4), n_cells(t) - n_cells(F.array_join(rows(t), " ")))))),
        Rule("graphic without file", "graphics", "major", 1.0, 1e9, F.size(graphics) - F.size(names)),
        Rule("graphic name", "graphics", "minor", 0.5, 1e9, F.size(F.filter(names, lambda f: ~f.rlike(r"(?i)^SB[0-9]{6}\.BMP$")))),
        Rule("graphic twice", "graphics", "major", 1.0, 1.0, _flag(F.size(names) > F.size(F.array_distinct(F.transform(names, F.upper))))),
        Rule("graphic outside paragraph", "graphics", "minor", 0.5, 1.0, F.size(graphics) - F.regexp_count(raw, F.lit(r"(?i)<P[^>]*>\s*<GRAPHIC[\s>/]"))),
        Rule("graphic numbers apart", "graphics", "minor", 0.1, 0.5, F.size(F.filter(steps, lambda d: d > 100))),
        Rule("empty number", "text", "minor", 0.5, 1.5, empty(x.each("N"))),
        Rule("empty heading", "text", "minor", 0.5, 1.0, F.when(x.n("TI") > 0, _empty(F.regexp_replace(raw, r"(?is)<EDITNOTE(?:\s[^>]*)?>.*?</EDITNOTE>", " "), "TI"))),
        Rule("heading with stop", "text", "minor", 0.1, 0.5, F.size(F.filter(headings, lambda t: M.inner_text(t).endswith(".")))),
        Rule("heading all emphasis", "text", "minor", 0.25, 0.5, F.size(F.filter(headings, lambda t: F.trim(t).rlike(r"(?is)^<EM>.*</EM>$")))),
        Rule("item with bullet", "text", "minor", 0.1, 0.5, F.size(F.filter(items, lambda t: M.inner_text(t).rlike("^[•▪◦·*-]")))),
        Rule("address outside line", "text", "minor", 0.25, 1.0, F.size(F.filter(paragraphs, lambda p: p.rlike(r"https?://") & F.regexp_replace(p, r"(?is)<(LINE|EM)(?:\s[^>]*)?>.*?</\1>", " ").rlike(r"https?://")))),
        Rule("no ident block", "legal", "critical", 3.0, 3.0, _flag(x.n("POLIDENT") == 0)),
        Rule("ident without number", "legal", "minor", 1.0, 1.0, F.when(x.n("POLIDENT") > 0, _flag(~filled("N")))),
        Rule("ident without title", "legal", "minor", 1.0, 1.0, F.when(x.n("POLIDENT") > 0, _flag(~filled("TI")))),
        Rule("definition without text", "legal", "minor", 0.5, 2.0, F.size(F.filter(x.each("DEF"), lambda d: M.count_tag(d, "DEFP") == 0))),
        Rule("date label", "legal", "minor", 0.25, 0.5, F.size(F.filter(dates, lambda d: ~d.isin(*DATE_LABELS)))),
        Rule("no free form", "legal", "major", 2.0, 2.0, _flag(x.n("FREEFORM") == 0)),
        Rule("dates rising", "legal", "minor", 0.5, 1.0, yes(rising)),
    ]


def filing_issues(docs: DataFrame, entities: list[str], raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """What all structural rules find in filings, as ``issues`` gives it; the order of
    numbered blocks, which needs a stack of open tags, among them."""
    ready = prepared(docs.select(key, raw), raw)
    found = issues(ready, filing_rules(F.col(raw), entities, ready=True), key)
    faults = M.block_order_faults(docs, "BLOCK", raw, key).groupBy(key, "kind").agg(F.count("*").cast("int").alias("n"))
    back = F.col("kind") == "reverse"
    order = faults.select(
        key, F.when(back, "block in lower block").otherwise("block level skipped").alias("rule"), F.lit("nesting").alias("category"), F.when(back, "minor").otherwise("major").alias("severity"), "n",
        (F.col("n") * F.when(back, 0.25).otherwise(1.0)).alias("points"),
    )
    return found.unionByName(order)


# Points of each category.
FILING_POINTS = {"schema": 8.0, "nesting": 8.0, "characters": 6.0, "tables": 4.0, "graphics": 4.0, "text": 4.0, "legal": 6.0}
BALANCED = ("POLIDOC", "APPENDIX", "BLOCK1", "BLOCK2", "FREEFORM", "POLIDENT", "SGMLTBL", "TABLE", "TBLHEAD", "TBLBODY", "TBLROW")


def tag_balance(docs: DataFrame, tags: tuple[str, ...], raw: str = "raw", key: str = "doc_id") -> DataFrame:
    """``(key, tag, opens, closes)`` of the tags that don't open as often as they close."""
    return M.tag_counts(docs, raw, key).where(F.col("tag").isin([t.lower() for t in tags]) & (F.col("opens") != F.col("closes")))


def row_parity(source: DataFrame, target: DataFrame, key: str, tolerance_rows: int = 5, tolerance_share: float = 0.01) -> DataFrame:
    """``(key, n_source, n_target)`` of groups whose numbers of rows differ by more
    than the tolerance."""
    s = source.groupBy(key).agg(F.count("*").alias("n_source"))
    t = target.groupBy(key).agg(F.count("*").alias("n_target"))
    both = s.join(t, key, "full_outer").withColumns({"n_source": F.coalesce("n_source", F.lit(0)), "n_target": F.coalesce("n_target", F.lit(0))})
    allowed = F.greatest(F.lit(float(tolerance_rows)), F.floor(F.col("n_source") * tolerance_share))
    return both.where(F.abs(F.col("n_source") - F.col("n_target")) > allowed)


def not_sequential(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``(key, n)`` of groups whose numbers aren't 1 to n, each once."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(number).alias("a"), F.max(number).alias("b"), F.count_distinct(number).alias("d")).where(
        (F.col("a") != 1) | (F.col("b") != F.col("n")) | (F.col("d") != F.col("n"))
    ).select(key, "n")


def header_row(cells: DataFrame, most_row: int = 14, columns: int = 11, default: int = 6) -> DataFrame:
    """``(doc_id, sheet, header_row)``: first row that has a text in column 1 without
    colon, at least two filled cells and no date among the first columns."""
    top = cells.where((F.col("row") <= most_row) & (F.col("col") <= columns))
    filled = F.coalesce(F.col("v_str"), F.col("v_num").cast("string"), F.col("v_ts").cast("string")).isNotNull()
    rows = top.groupBy("doc_id", "sheet", "row").agg(
        F.count_if(filled).alias("n"), F.max(F.when(F.col("col") == 1, F.col("v_str"))).alias("a"), F.bool_or(F.col("v_ts").isNotNull()).alias("dated")
    )
    fit = rows.where((F.col("n") >= 2) & F.col("a").isNotNull() & ~F.contains("a", F.lit(":")) & ~F.col("dated")).groupBy("doc_id", "sheet").agg(F.min("row").alias("header_row"))
    return cells.select("doc_id", "sheet").distinct().join(fit, ["doc_id", "sheet"], "left").withColumn("header_row", F.coalesce("header_row", F.lit(default)))


def data_rows(cells: DataFrame, headers: DataFrame, first: int = 4) -> DataFrame:
    """Cells of the rows below the header that have something in the first columns."""
    below = cells.join(headers, ["doc_id", "sheet"]).where(F.col("row") > F.col("header_row"))
    filled = F.coalesce(F.col("v_str"), F.col("v_num").cast("string"), F.col("v_ts").cast("string")).isNotNull()
    keep = below.where(filled & (F.col("col") <= first)).select("doc_id", "sheet", "row").distinct()
    return below.join(keep, ["doc_id", "sheet", "row"], "left_semi")


# Months of a workbook's date.
WORKBOOK_MONTHS = "January February March April May June July August September October November December".split()


@dataclass(frozen=True)
class WorkbookKind:
    """What a kind of document made from workbooks must look like."""

    root: str = "POLIDOC"
    blocks: bool = True
    landscape: bool = False


def tabular_rules(raw: Column, kind: WorkbookKind = WorkbookKind(), today: str | None = None, ready: bool = False) -> list[Rule]:
    """Rules of documents that were made from a workbook, of one ``kind``; ``today`` is
    the day, written out, that the document's date must not be."""
    x = _Parts(raw, ready)
    tables, bodies, rows, cells = (x.each(t) for t in ("SGMLTBL", "TBLBODY", "TBLROW", "TBLCELL"))
    part = lambda t, tag: F.coalesce(F.get(M.elements(t, tag), F.lit(0)), F.lit(""))
    defs = lambda t: M.count_tag(F.split(t, "<TBLROWS", -1)[0], "TBLCDEF")
    both = lambda t: (M.count_tag(t, "TBLHEAD") > 0) & (M.count_tag(t, "TBLBODY") > 0)
    widths = lambda d: F.transform(F.regexp_extract_all(d, F.lit(r"(?i)COLWD\s*=\s*\"?([0-9]+)"), F.lit(1)), lambda w: w.cast("int"))
    starts = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"COLSTART=\"([0-9]+)\""), F.lit(1)), lambda w: w.cast("int"))
    wrong_order = lambda r: (F.size(starts(r)) > 0) & (starts(r) != F.sequence(F.lit(1), F.greatest(F.size(starts(r)), F.lit(1))))
    attr = F.regexp_extract_all(raw, F.lit(r"(?i)<TBLBODY(?=[\s>])([^>]*)>"), F.lit(1))
    stated = F.transform(F.arrays_zip(attr.alias("a"), bodies.alias("b")), lambda z: F.struct(F.regexp_extract(z["a"], r"TBLROWS=\"([0-9]+)\"", 1).alias("said"), M.count_tag(z["b"], "TBLROW").alias("n")))
    counts = lambda b: F.transform(M.elements(b, "TBLROW"), lambda r: M.count_tag(r, "TBLCELL"))
    times = lambda c: F.transform(F.array_distinct(c), lambda v: F.size(F.filter(c, lambda w: w == v)))
    uneven = lambda b: F.size(counts(b)) > F.coalesce(F.array_max(times(counts(b))), F.lit(0))
    unbalanced = sum((_flag(F.regexp_count(raw, F.lit(rf"<{t}\b")) != F.regexp_count(raw, F.lit(rf"</{t}>"))) for t in BALANCED), F.lit(0))
    filing = kind.root == "POLIDOC"
    text_of = lambda tag: F.regexp_extract(raw, rf"<{tag}>(.*?)</{tag}>", 1)
    there = lambda tag: F.regexp_like(raw, F.lit(rf"<{tag}>.*?</{tag}>"))
    number, date = F.trim(text_of("N")), F.trim(text_of("DATE"))
    title = F.trim(F.regexp_replace(F.regexp_extract(raw, r"(?s)<BLOCK2>\s*<TI>(.*?)</TI>", 1), "<[^>]+>", ""))
    body = F.regexp_replace(raw, "<[^>]+>", "")
    has = lambda t: F.contains(raw, F.lit(t))
    landscape = has('ORIENT="LANDSCAP"')
    of = lambda c: _flag(c) if filing else F.lit(0)
    return [
        Rule("root", "content", "critical", 10.0, 10.0, _flag((x.n(kind.root) == 0) | ~has(f"</{kind.root}>"))),
        Rule("forbidden attribute", "content", "major", 5.0, 5.0, _flag(has("INITID="))),
        Rule("language attribute", "content", "minor", 2.0, 2.0, _flag(~F.contains(F.substring(raw, 1, 500), F.lit('LANG="EN"')))),
        Rule("dates", "content", "minor", 2.0, 6.0, sum((_flag(~F.regexp_like(raw, F.lit(rf"{a}=\"[0-9]{{8}}\""))) for a in ("ADDDATE", "CLIPDATE", "MODDATE")), F.lit(0))),
        Rule("no date", "content", "minor", 2.0, 2.0, of(~there("DATE"))),
        Rule("date of today", "content", "major", 5.0, 5.0, of(date == F.lit(today)) if today else F.lit(0)),
        Rule("empty number", "content", "major", 5.0, 5.0, of(~there("N") | (number == ""))),
        Rule("number and first block differ", "content", "minor", 2.0, 2.0, of((number != "") & F.regexp_like(raw, F.lit(r"(?s)<BLOCK2>\s*<TI>.*?</TI>")) & (number != title))),
        Rule("block in appendix", "content", "critical", 10.0, 10.0, F.lit(0) if filing else _flag(has("<BLOCK2>"))),
        Rule("no free form", "content", "major", 5.0, 5.0, of(~has("<FREEFORM>"))),
        Rule("no block", "content", "major", 5.0, 5.0, of(~has("<BLOCK2>")) if kind.blocks else F.lit(0)),
        Rule("no table", "content", "critical", 10.0, 20.0, _flag(x.n("TBLCELL") == 0) + _flag(x.n("TBLBODY") == 0)),
        Rule("literal none", "content", "major", 5.0, 5.0, F.size(F.filter(F.split(raw, "\n", -1), lambda t: F.contains(t, F.lit("<TBLCELL")) & F.contains(t, F.lit(">None<"))))),
        Rule("bare ampersand", "content", "major", 5.0, 5.0, _flag(F.regexp_like(body, F.lit(r"&(?!#?[A-Za-z0-9]+;)")))),
        Rule("accented signs", "content", "minor", 2.0, 2.0, _flag(F.regexp_like(body, F.lit("[éèêàâôîçùûÉÈÊÀÂÔÎÇœŒ]")))),
        Rule("balance", "content", "critical", 10.0, 1e9, unbalanced),
        Rule("column numbers", "tables", "major", 5.0, 1e9, F.size(F.filter(tables, lambda t: both(t) & (defs(part(t, "TBLHEAD")) != defs(part(t, "TBLBODY")))))),
        Rule("row sizes", "tables", "major", 5.0, 1e9, F.size(F.filter(bodies, uneven))),
        Rule("column order", "tables", "minor", 2.0, 2.0, F.size(F.filter(rows, wrong_order))),
        Rule("stated rows", "tables", "minor", 2.0, 1e9, F.size(F.filter(stated, lambda z: (z["said"] != "") & (z["said"].cast("int") != z["n"])))),
        Rule("rows not stated", "tables", "minor", 1.0, 1e9, F.size(F.filter(stated, lambda z: (z["said"] == "") & (z["n"] > 0)))),
        Rule("no mark before landscape", "tables", "major", 5.0, 5.0, _flag(landscape & ~has("<?RSRVON>"))),
        Rule("no mark after landscape", "tables", "major", 5.0, 5.0, _flag(landscape & ~has("<?RSRVOFF>"))),
        Rule("mark not before table", "tables", "minor", 2.0, 2.0, _flag(landscape & ~F.regexp_like(raw, F.lit(r"<\?RSRVON>\s*<TABLE>")))),
        Rule("landscape without width", "tables", "minor", 2.0, 1e9, F.size(F.filter(F.regexp_extract_all(raw, F.lit(r"<SGMLTBL\b([^>]*)>"), F.lit(1)), lambda a: F.contains(a, F.lit("LANDSCAP")) & ~F.contains(a, F.lit("TBLWD="))))),
        Rule("root of the kind", "kind", "critical", 8.0, 8.0, _flag(x.n(kind.root) == 0)),
        Rule("column widths", "kind", "major", 4.0, 4.0, F.size(F.filter(x.each("TBLCDEFS"), lambda d: (F.size(widths(d)) > 0) & ~_total(widths(d)).between(95, 105)))),
        Rule("landscape of the kind", "kind", "major" if kind.landscape else "minor", 4.0 if kind.landscape else 2.0, 4.0, _flag(~landscape if kind.landscape else landscape)),
        Rule("blocks of the kind", "kind", "major" if kind.blocks else "minor", 4.0 if kind.blocks else 2.0, 4.0, _flag(~has("<BLOCK2>") if kind.blocks else has("<BLOCK2>"))),
        Rule("cell of none", "cells", "major", 3.0, 3.0, F.size(F.filter(cells, lambda c: F.lower(c) == "none"))),
        Rule("empty rows", "cells", "minor", 1.0, 1.0, F.size(F.filter(rows, lambda r: F.regexp_replace(r, r"\s", "") == ""))),
        Rule("long decimals", "cells", "minor", 1.0, 1.0, _flag(F.size(F.filter(cells, lambda c: F.regexp_like(M.inner_text(c), F.lit(r"^-?0?\.[0-9]+$")))) > 3)),
        Rule("number left empty", "cells", "major", 3.0, 3.0, of(there("N") & (number == ""))),
        Rule("date left empty", "cells", "major", 3.0, 3.0, of(there("DATE") & (date == ""))),
        Rule("date form", "cells", "minor", 1.0, 1.0, _flag((date != "") & ~date.rlike(rf"^(?:{'|'.join(WORKBOOK_MONTHS)})\s+[0-9]{{1,2}},\s+[0-9]{{4}}$"))),
    ]


# Points of a workbook document's categories; a third for what the
# workbook itself is compared with.
TABULAR_POINTS = {"content": 35.0, "tables": 35.0, "kind": 20.0, "cells": 10.0}
