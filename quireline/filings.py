"""Queries over whole marked-up filings: the test tables' paragraphs put into markup,
with the faults that the rules look for, and the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.functions import text as T
from quireline.operators import compare as J
from quireline.operators import corpus as A
from quireline.operators import dimensions as D
from quireline.operators import fixes as X
from quireline.operators import layout as L
from quireline.operators import markup as M
from quireline.operators import report as K
from quireline.operators import rules as R
from quireline.plans import validate as V
from quireline.queries import BL, SQUEEZE, query
from quireline.sources.tables import table

#: Parts with faults; every filing gets three of them, by its number.
FAULTS = (
    "",
    "<DIV>x</DIV>",
    "<BLOCK2><TI>Over</TI><BLOCK4><TI>Deep</TI><P>A level is skipped here.</P></BLOCK4></BLOCK2>",
    "<BLOCK3><TI>Upper</TI><BLOCK2><TI>Lower.</TI></BLOCK2></BLOCK3>",
    "<ITEM></ITEM><ITEM> </ITEM><ITEM>Text without paragraph</ITEM>",
    '<TABLE><SGMLTBL><TBLBODY TBLROWS="3"><TBLROW><TBLCELL COLSTART="1">a</TBLCELL><TBLCELL COLSTART="3"></TBLCELL></TBLROW><TBLROW><TBLCELL>b</TBLCELL></TBLROW></TBLBODY></SGMLTBL></TABLE>',
    "<SGMLTBL><TBLBODY><TBLCELL>loose</TBLCELL><TBLCELL>None</TBLCELL></TBLBODY></SGMLTBL>",
    "<TABLE><P>No table body.</P></TABLE>",
    "<TABLE><SGMLTBL><TBLROW><TBLCELL><P>x</P></TBLCELL></TBLROW></SGMLTBL></TABLE><TABLE><FOOTNOTE>n</FOOTNOTE></TABLE>",
    "<P>A&B and &foo; &bar; &foo; 3 < 4 > 2</P>",
    '<P><GRAPHIC FILENAME="SB000001.BMP"></P><P><GRAPHIC FILENAME="SB000500.BMP"></P><GRAPHIC FILENAME="sb000001.bmp">',
    '<GRAPHIC><P><GRAPHIC FILENAME="fig.jpg"></P>',
    "<BLOCK2><N></N><TI></TI><TI>Ends with a stop.</TI><TI><EM>All emphasis</EM></TI></BLOCK2><EDITNOTE><TI></TI></EDITNOTE>",
    "<ITEM>• bullet</ITEM><P>See http://a.example/x now</P><P><LINE>http://b.example/y</LINE></P>",
    "<DEF><TERM>x</TERM></DEF><DEF><DEFP>y</DEFP></DEF>",
    '<DATE LABEL="Made">May 1, 2020</DATE><DATE LABEL="Amended">x</DATE>',
    "<CONTAINR><P>One two three.</P></CONTAINR><CONTAINR LABEL=\"a\"></CONTAINR>",
    "<P>Before.</P> these are seven orphaned words without opener </P>",
    "<P1>Text — with “raw” signs ½</P1>",
    '</FREEFORM></POLIDOC><POLIDOC LANG="EN" LABEL="x" ADDDATE="20991231"><FREEFORM>',
    "<P>Held <ITEM><P>inside</P></ITEM> of it</P>",
    '<?RSRVON><TABLE><SGMLTBL ORIENT="LANDSCAP"><TBLHEAD><TBLCDEFS><TBLCDEF COLWD="50"><TBLCDEF COLWD="30"></TBLCDEFS></TBLHEAD><TBLBODY><TBLCDEFS><TBLCDEF COLWD="100"></TBLCDEFS><TBLROW>'
    "<TBLCELL>0.05</TBLCELL><TBLCELL>.25</TBLCELL><TBLCELL>0.5</TBLCELL><TBLCELL>-0.125</TBLCELL></TBLROW><TBLROW> </TBLROW></TBLBODY></SGMLTBL></TABLE>",
    "<BLOCK2><TI>Unclosed</TI><TABLE><SGMLTBL><TBLBODY><TBLROW><TBLCELL>1</TBLCELL></TBLBODY></SGMLTBL></TABLE></BLOCK2>",
)
ENTITIES = ("amp", "lt", "gt", "quot")


def filings(spark, root: str) -> DataFrame:
    """``(doc_id, raw)``: every filing with its marked-up paragraphs in order, as one
    text with faults. A text is as long as its filing, and no row holds two."""
    meta = table(spark, root, "sgml_content").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("label", "lang", "doc_number", "doc_title", "adddate")])
    body = table(spark, root, "paragraphs").where("side = 'sgml'").select("doc_id", "para_id", "idx", "text").dropDuplicates(["para_id"])
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = body.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "para_id", F.concat(F.lit("<P>"), F.coalesce(safe, F.lit("")), F.lit("</P>")).alias("p")))).alias("l"))
    d, k = F.col("doc_id"), len(FAULTS)
    faults = F.array(*[F.lit(x) for x in FAULTS])
    fault = lambda n: F.element_at(faults, (n % k + 1).cast("int"))
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), c, F.lit('"'))
    ident = F.concat(F.lit("<POLIDENT>"), F.when(d % 7 == 2, "").otherwise(F.concat(F.lit("<N>"), F.coalesce("doc_number", F.lit("")), F.lit("</N>"))),
                     F.when(d % 11 == 3, "").otherwise(F.concat(F.lit("<TI>"), F.coalesce("doc_title", F.lit("")), F.lit("</TI>"))), F.lit("</POLIDENT>"))
    open_, close = F.when(d % 17 == 5, "").otherwise("<FREEFORM>"), F.when(d % 17 == 5, "").otherwise("</FREEFORM>")
    head = F.when(d % 19 == 6, "<POLIDOC>").otherwise(F.concat(
        F.lit("<POLIDOC"), F.when(F.col("label").isNull(), "").otherwise(attr("LABEL", F.replace("label", F.lit('"'), F.lit("")))), F.when(F.col("lang").isNull(), "").otherwise(attr("LANG", F.replace("lang", F.lit('"'), F.lit("")))),
        F.when(F.col("adddate").isNull(), "").otherwise(attr("ADDDATE", F.col("adddate"))), F.lit(">"),
    ))
    text = F.array_join(F.transform("l", lambda x: x["p"]), "\n")
    raw = F.concat(
        head, F.lit("\n"), F.when(d % 13 == 4, "").otherwise(ident), open_, F.lit("<BLOCK2><TI>Body</TI>\n"), F.coalesce(text, F.lit("")), F.lit("\n</BLOCK2>\n"),
        fault(d), F.lit("\n"), fault(F.expr(f"doc_id div {k}") + 3 * d + 1), F.lit("\n"), fault(5 * d + 7), F.lit("\n"), close, F.lit("</POLIDOC>"),
    )
    return meta.join(body, "doc_id", "left").select("doc_id", raw.alias("raw"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


FAULT = lambda n: f"list_extract([{', '.join(map(_q, FAULTS))}], CAST(({n}) % {len(FAULTS)} + 1 AS BIGINT))"
FILINGS = f"""(SELECT m.doc_id, CASE WHEN m.doc_id % 19 = 6 THEN '<POLIDOC>' ELSE '<POLIDOC' || coalesce(' LABEL="' || replace(label, '"', '') || '"', '') || coalesce(' LANG="' || replace(lang, '"', '') || '"', '') || coalesce(' ADDDATE="' || adddate || '"', '') || '>' END
  || chr(10) || CASE WHEN m.doc_id % 13 = 4 THEN '' ELSE '<POLIDENT>' || CASE WHEN m.doc_id % 7 = 2 THEN '' ELSE '<N>' || coalesce(doc_number, '') || '</N>' END || CASE WHEN m.doc_id % 11 = 3 THEN '' ELSE '<TI>' || coalesce(doc_title, '') || '</TI>' END || '</POLIDENT>' END
  || CASE WHEN m.doc_id % 17 = 5 THEN '' ELSE '<FREEFORM>' END || '<BLOCK2><TI>Body</TI>' || chr(10) || coalesce(b.t, '') || chr(10) || '</BLOCK2>' || chr(10)
  || {FAULT('m.doc_id')} || chr(10) || {FAULT(f'm.doc_id // {len(FAULTS)} + 3 * m.doc_id + 1')} || chr(10) || {FAULT('5 * m.doc_id + 7')} || chr(10) || CASE WHEN m.doc_id % 17 = 5 THEN '' ELSE '</FREEFORM>' END || '</POLIDOC>' AS raw
  FROM (SELECT doc_id, max(label) AS label, max(lang) AS lang, max(doc_number) AS doc_number, max(doc_title) AS doc_title, max(adddate) AS adddate FROM sgml_content GROUP BY doc_id) m
  LEFT JOIN (SELECT doc_id, string_agg('<P>' || coalesce(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '') || '</P>', chr(10) ORDER BY idx, para_id) AS t
    FROM (SELECT DISTINCT doc_id, para_id, idx, text FROM paragraphs WHERE side = 'sgml') GROUP BY doc_id) b ON m.doc_id = b.doc_id)"""

N = lambda tag, x="raw": f"len(regexp_extract_all({x}, '(?i)<{tag}[\\s>/]'))"
EACH = lambda tag, x="raw": f"regexp_extract_all({x}, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)"
INNER = lambda x: SQUEEZE(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")
HOW_MANY = lambda values, test: f"len(list_filter({values}, lambda x: {test}))"
FLAG = lambda test: f"CAST(coalesce({test}, false) AS INT)"
HEAD = "regexp_extract(raw, '(?is)<POLIDOC\\b([^>]*)>', 1)"
ROOT = lambda name: f"regexp_extract_all({HEAD}, '\\b{name}\\s*=\\s*\"([^\"]*)\"', 1)"
PAIRS = lambda values, test: f"len(list_filter(range(1, len({values})), lambda i: ({values})[i] IS NOT NULL AND {test}))"
GRAPHICS = "regexp_extract_all(raw, '(?i)<GRAPHIC([\\s>/][^>]*>|>)', 1)"
FILES = f"list_filter(list_transform({GRAPHICS}, lambda x: regexp_extract(x, 'FILENAME=\"([^\"]+)\"', 1)), lambda x: x <> '')"
NUMBERS = f"list_sort(list_transform(list_filter({FILES}, lambda x: regexp_matches(x, '(?i)^SB[0-9]{{6}}[.]BMP$')), lambda x: CAST(substr(x, 3, 6) AS INT)))"
DATES = "regexp_extract_all(raw, '<POLIDOC[^>]*\\sADDDATE=\"([0-9]{8})\"', 1)"
LONG_WORDS = "len(regexp_extract_all(regexp_replace(x, '<[^>]+>', '', 'g'), '\\S*[a-zA-Z]{3}\\S*'))"
SIGNS = "‘’“”–—\xa0éèêàôÉ°·×±©•…€≥≤½¼"
BULLETS = "•▪◦·*-"
#: Rule, category, severity, points of each hit, most points, and the number of hits in SQL.
FILING_SQL = (
    ("unknown tag", "schema", "major", 1.0, 4.0, f"""len(list_filter(list_distinct(list_transform(regexp_extract_all(raw, '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: upper(x))), lambda x: NOT list_contains(string_split('{' '.join(R.FILING_TAGS)}', ' '), x)))"""),
    ("no root", "schema", "major", 3.0, 3.0, FLAG(f"NOT regexp_matches({HEAD}, '[A-Za-z_][A-Za-z0-9_-]*\\s*=\\s*\"[^\"]*\"')")),
    ("attribute missing", "schema", "minor", 0.5, 8.0, f"""CASE WHEN regexp_matches({HEAD}, '[A-Za-z_][A-Za-z0-9_-]*\\s*=\\s*"[^"]*"') THEN {' + '.join(FLAG(f'len({ROOT(a)}) = 0') for a in ('LABEL', 'LANG', 'ADDDATE'))} ELSE 0 END"""),
    ("language", "schema", "major", 1.0, 1.0, FLAG(f"len({ROOT('LANG')}) > 0 AND {ROOT('LANG')}[-1] NOT IN ('EN', 'FR')")),
    ("date form", "schema", "minor", 0.5, 1.0, f"""{FLAG(f"len({ROOT('ADDDATE')}) > 0 AND NOT regexp_full_match({ROOT('ADDDATE')}[-1], '[0-9]{{8}}')")}"""),
    ("empty label", "schema", "minor", 0.5, 0.5, FLAG(f"len({ROOT('LABEL')}) > 0 AND trim({ROOT('LABEL')}[-1]) = ''")),
    ("container without label", "schema", "minor", 0.5, 1e9, HOW_MANY("regexp_extract_all(raw, '(?i)<CONTAINR\\b([^>]*)>', 1)", "upper(x) NOT LIKE '%LABEL=%'")),
    ("forbidden child", "nesting", "critical", 1.5, 1e9, " + ".join(FLAG(f"{HOW_MANY(EACH(p), N(c, 'x') + ' > 0')} > 0") for p, c in (("TBLCELL", "P"), ("TABLE", "FOOTNOTE"), ("SGMLTBL", "FOOTNOTE"), ("TBLROW", "FOOTNOTE"), ("TBLCELL", "FOOTNOTE")))),
    ("item in paragraph", "nesting", "minor", 1.0, 1.0, FLAG(f"{HOW_MANY(EACH('P'), N('ITEM', 'x') + ' > 0')} > 0")),
    ("table body outside table", "nesting", "critical", 2.0, 2.0, FLAG(N("SGMLTBL", "regexp_replace(raw, '(?is)<TABLE(?:\\s[^>]*)?>.*?</TABLE>', ' ', 'g')") + " > 0")),
    ("empty item", "nesting", "major", 1.0, 2.0, HOW_MANY(EACH("ITEM"), f"{INNER('x')} = ''")),
    ("item without paragraph", "nesting", "minor", 0.5, 1.0, HOW_MANY(EACH("ITEM"), f"{INNER('x')} <> '' AND {N('P', 'x')} = 0")),
    ("end without paragraph", "nesting", "major", 1.0, 2.0, HOW_MANY("regexp_extract_all(regexp_replace(raw, '(?is)<FOOTNOTE(?:\\s[^>]*)?>.*?</FOOTNOTE>', '', 'g'), '(?s)</P>(.{1,600}?)</P>', 1)", f"NOT regexp_matches(x, '<P[\\s>1-4]') AND {LONG_WORDS} >= 6")),
    ("unknown entity", "characters", "major", 0.5, 3.0, "len(list_filter(list_distinct(regexp_extract_all(raw, '&([A-Za-z][A-Za-z0-9]*);', 1)), lambda x: x NOT IN ('amp', 'lt', 'gt', 'quot')))"),
    ("bare ampersand", "characters", "minor", 0.5, 2.0, "len(regexp_extract_all(raw, '&')) - len(regexp_extract_all(raw, '&#?[A-Za-z0-9]+;')) - len(regexp_extract_all(raw, '&\\s'))"),
    ("bare less-than", "characters", "minor", 0.25, 1.0, "len(regexp_extract_all(raw, '<')) - len(regexp_extract_all(raw, '<[/A-Za-z!?]'))"),
    ("bare greater-than", "characters", "minor", 0.1, 0.5, "len(regexp_extract_all(regexp_replace(raw, '<[^>]*>', '', 'g'), '>'))"),
    ("raw sign", "characters", "minor", 0.4, 2.0, f"len(list_filter(list_distinct(string_split('{SIGNS}', '')), lambda x: contains(raw, x)))"),
    ("table without body element", "tables", "major", 1.0, 1.0, FLAG(f"{HOW_MANY(EACH('TABLE'), N('SGMLTBL', 'x') + ' = 0')} > 0")),
    ("paragraph in cell", "tables", "critical", 1.5, 1.5, FLAG(f"{HOW_MANY(EACH('TBLCELL'), N('P', 'x') + ' > 0')} > 0")),
    ("no table body", "tables", "minor", 0.5, 1e9, f"{HOW_MANY(EACH('SGMLTBL') + '[1:2]', N('TBLBODY', 'x') + ' = 0')} + {FLAG(HOW_MANY(EACH('SGMLTBL') + '[3:]', N('TBLBODY', 'x') + ' = 0') + ' > 0')}"),
    ("uneven rows", "tables", "minor", 0.25, 1e9, HOW_MANY(EACH("SGMLTBL"), f"len(list_distinct(list_transform({EACH('TBLROW', 'x')}, lambda y: {N('TBLCELL', 'y')}))) > 1")),
    ("empty cell", "tables", "info", 0.0, 0.0, HOW_MANY(EACH("TBLCELL"), "regexp_full_match(x, '\\s*')")),
    ("cell outside row", "tables", "major", 0.5, 1e9, f"CAST(coalesce(list_sum(list_transform({EACH('SGMLTBL')}, lambda x: least(4, {N('TBLCELL', 'x')} - {N('TBLCELL', 'array_to_string(' + EACH('TBLROW', 'x') + ', chr(32))')}))), 0) AS INT)"),
    ("graphic without file", "graphics", "major", 1.0, 1e9, f"len({GRAPHICS}) - len({FILES})"),
    ("graphic name", "graphics", "minor", 0.5, 1e9, HOW_MANY(FILES, "NOT regexp_matches(x, '(?i)^SB[0-9]{6}[.]BMP$')")),
    ("graphic twice", "graphics", "major", 1.0, 1.0, FLAG(f"len({FILES}) > len(list_distinct(list_transform({FILES}, lambda x: upper(x))))")),
    ("graphic outside paragraph", "graphics", "minor", 0.5, 1.0, f"len({GRAPHICS}) - len(regexp_extract_all(raw, '(?i)<P[^>]*>\\s*<GRAPHIC[\\s>/]'))"),
    ("graphic numbers apart", "graphics", "minor", 0.1, 0.5, PAIRS(NUMBERS, f"({NUMBERS})[i + 1] - ({NUMBERS})[i] > 100")),
    ("empty number", "text", "minor", 0.5, 1.5, HOW_MANY(EACH("N"), f"{INNER('x')} = ''")),
    ("empty heading", "text", "minor", 0.5, 1.0, HOW_MANY(EACH("TI", "regexp_replace(raw, '(?is)<EDITNOTE(?:\\s[^>]*)?>.*?</EDITNOTE>', ' ', 'g')"), f"{INNER('x')} = ''")),
    ("heading with stop", "text", "minor", 0.1, 0.5, HOW_MANY(EACH("TI"), f"{INNER('x')} LIKE '%.'")),
    ("heading all emphasis", "text", "minor", 0.25, 0.5, HOW_MANY(EACH("TI"), "regexp_full_match(trim(x), '(?is)<EM>.*</EM>')")),
    ("item with bullet", "text", "minor", 0.1, 0.5, HOW_MANY(EACH("ITEM"), f"{INNER('x')} <> '' AND contains('{BULLETS}', substr({INNER('x')}, 1, 1))")),
    ("address outside line", "text", "minor", 0.25, 1.0, HOW_MANY(EACH("P"), "regexp_matches(regexp_replace(regexp_replace(x, '(?is)<LINE(?:\\s[^>]*)?>.*?</LINE>', ' ', 'g'), '(?is)<EM(?:\\s[^>]*)?>.*?</EM>', ' ', 'g'), 'https?://')")),
    ("no ident block", "legal", "critical", 3.0, 3.0, FLAG(f"{N('POLIDENT')} = 0")),
    ("ident without number", "legal", "minor", 1.0, 1.0, FLAG(f"{N('POLIDENT')} > 0 AND {HOW_MANY(EACH('N', EACH('POLIDENT') + '[1]'), INNER('x') + chr(32) + chr(60) + chr(62) + chr(32) + chr(39) * 2)} = 0")),
    ("ident without title", "legal", "minor", 1.0, 1.0, FLAG(f"{N('POLIDENT')} > 0 AND {HOW_MANY(EACH('TI', EACH('POLIDENT') + '[1]'), INNER('x') + chr(32) + chr(60) + chr(62) + chr(32) + chr(39) * 2)} = 0")),
    ("definition without text", "legal", "minor", 0.5, 2.0, HOW_MANY(EACH("DEF"), f"{N('DEFP', 'x')} = 0")),
    ("date label", "legal", "minor", 0.25, 0.5, HOW_MANY("regexp_extract_all(raw, '(?i)<DATE\\s[^>]*?LABEL=\"([^\"]+)\"', 1)", "x NOT IN ('Effective', 'Published', 'Amended', 'Revised', 'Adopted', 'Approved', 'In Force', 'Coming into Force')")),
    ("no free form", "legal", "major", 2.0, 2.0, FLAG(f"{N('FREEFORM')} = 0")),
    ("dates rising", "legal", "minor", 0.5, 1.0, PAIRS(DATES, f"({DATES})[i] < ({DATES})[i + 1]")),
)


def _rules_sql(rules) -> str:
    """Issues of these rules over ``f(doc_id, raw)``."""
    one = ", ".join(f"{{'rule': '{r}', 'category': '{c}', 'severity': '{s}', 'n': CAST(coalesce({n}, 0) AS INT), 'unit': {u}::DOUBLE, 'cap': {m}::DOUBLE}}" for r, c, s, u, m, n in rules)
    return f"SELECT doc_id, h.rule AS rule, h.category AS category, h.severity AS severity, h.n AS n, least(h.cap, h.n * h.unit) AS points FROM (SELECT doc_id, unnest([{one}]) AS h FROM f) WHERE h.n > 0"


#: Numbered blocks over a stack of open tags, tag by tag.
ORDER_SQL = """ev AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, list_transform(regexp_extract_all(raw, '<(/?[A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x)) AS t FROM f)),
  st AS (SELECT doc_id, 0 AS k, []::VARCHAR[] AS s FROM f UNION ALL
    SELECT st.doc_id, ev.k, CASE WHEN ev.t NOT LIKE '/%' THEN list_append(st.s, ev.t) WHEN list_contains(st.s, substr(ev.t, 2)) THEN st.s[1 : len(st.s) - list_position(list_reverse(st.s), substr(ev.t, 2))] ELSE st.s END FROM st JOIN ev ON ev.doc_id = st.doc_id AND ev.k = st.k + 1),
  bl AS (SELECT st.doc_id, list_transform(list_filter(st.s, lambda x: regexp_full_match(x, 'block[0-9]+')), lambda x: CAST(substr(x, 6) AS INT)) AS l FROM st JOIN ev ON ev.doc_id = st.doc_id AND ev.k = st.k WHERE regexp_full_match(ev.t, 'block[0-9]+')),
  o AS (SELECT DISTINCT * FROM (SELECT doc_id, 'reverse' AS kind, unnest(list_filter(l[1 : len(l) - 1], lambda x: x > l[len(l)])) AS "outer", l[len(l)] AS "inner" FROM bl WHERE len(l) >= 2
    UNION ALL SELECT doc_id, 'skip', l[len(l) - 1], l[len(l)] FROM bl WHERE len(l) >= 2 AND l[len(l)] > l[len(l) - 1] + 1))"""
ISSUES_SQL = f"""WITH RECURSIVE f AS {FILINGS}, {ORDER_SQL} {_rules_sql(FILING_SQL)} UNION ALL
  SELECT doc_id, CASE kind WHEN 'reverse' THEN 'block in lower block' ELSE 'block level skipped' END, 'nesting', CASE kind WHEN 'reverse' THEN 'minor' ELSE 'major' END, CAST(count(*) AS INT), count(*) * CASE kind WHEN 'reverse' THEN 0.25 ELSE 1.0 END FROM o GROUP BY doc_id, kind"""


@query(ISSUES_SQL)
def r_issues(spark, root):
    """What the structural rules find in the filings, with the points each costs."""
    return R.filing_issues(filings(spark, root), list(ENTITIES))


@query(f"""SELECT doc_id, category, round(greatest(0.0, base - coalesce(lost, 0.0)), 6) AS score FROM (SELECT doc_id, unnest(['schema', 'nesting', 'characters', 'tables', 'graphics', 'text', 'legal']) AS category, unnest([8.0, 8.0, 6.0, 4.0, 4.0, 4.0, 6.0]) AS base FROM {FILINGS})
  LEFT JOIN (SELECT doc_id, category, sum(points) AS lost FROM ({ISSUES_SQL}) GROUP BY ALL) USING (doc_id, category)""")
def r_scores(spark, root):
    """What the rules leave of each category's points."""
    d = filings(spark, root)
    return R.category_scores(d, R.filing_issues(d, list(ENTITIES)), R.FILING_POINTS).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE f AS {FILINGS}, {ORDER_SQL} SELECT doc_id, kind, "outer", "inner" FROM o""")
def w06_block_order(spark, root):
    """Numbered blocks in blocks of greater number, and levels skipped."""
    return M.block_order_faults(filings(spark, root))


HAS = lambda t: f"contains(raw, '{t}')"
VALUE = lambda tag: f"trim(regexp_extract(raw, '<{tag}>(.*?)</{tag}>', 1))"
THERE = lambda tag: f"regexp_matches(raw, '<{tag}>.*?</{tag}>')"
BODY = "regexp_replace(raw, '<[^>]+>', '', 'g')"
DEFS = lambda part, t: N("TBLCDEF", f"string_split(coalesce({EACH(part, t)}[1], ''), '<TBLROWS')[1]")
COUNTS = f"list_transform({EACH('TBLROW', 'x')}, lambda y: {N('TBLCELL', 'y')})"
WIDTHS = "list_transform(regexp_extract_all(x, '(?i)COLWD\\s*=\\s*\"?([0-9]+)', 1), lambda y: CAST(y AS INT))"
STARTS = "list_transform(regexp_extract_all(x, 'COLSTART=\"([0-9]+)\"', 1), lambda y: CAST(y AS INT))"
STATED = f"list_zip(list_transform(regexp_extract_all(raw, '(?i)<TBLBODY(?:\\s([^>]*))?>', 1), lambda y: regexp_extract(coalesce(y, ''), 'TBLROWS=\"([0-9]+)\"', 1)), list_transform({EACH('TBLBODY')}, lambda y: {N('TBLROW', 'y')}))"
TABULAR_SQL = (
    ("root", "content", "critical", 10.0, 10.0, FLAG(f"{N('POLIDOC')} = 0 OR NOT {HAS('</POLIDOC>')}")),
    ("forbidden attribute", "content", "major", 5.0, 5.0, FLAG(HAS("INITID="))),
    ("language attribute", "content", "minor", 2.0, 2.0, FLAG("NOT contains(substr(raw, 1, 500), 'LANG=\"EN\"')")),
    ("dates", "content", "minor", 2.0, 6.0, " + ".join(FLAG(f"NOT regexp_matches(raw, '{a}=\"[0-9]{{8}}\"')") for a in ("ADDDATE", "CLIPDATE", "MODDATE"))),
    ("no date", "content", "minor", 2.0, 2.0, FLAG(f"NOT {THERE('DATE')}")),
    ("date of today", "content", "major", 5.0, 5.0, FLAG(f"{VALUE('DATE')} = 'May 1, 2020'")),
    ("empty number", "content", "major", 5.0, 5.0, FLAG(f"NOT {THERE('N')} OR {VALUE('N')} = ''")),
    ("number and first block differ", "content", "minor", 2.0, 2.0, FLAG(f"{VALUE('N')} <> '' AND regexp_matches(raw, '(?s)<BLOCK2>\\s*<TI>.*?</TI>') AND {VALUE('N')} <> trim(regexp_replace(regexp_extract(raw, '(?s)<BLOCK2>\\s*<TI>(.*?)</TI>', 1), '<[^>]+>', '', 'g'))")),
    ("no free form", "content", "major", 5.0, 5.0, FLAG(f"NOT {HAS('<FREEFORM>')}")),
    ("no block", "content", "major", 5.0, 5.0, FLAG(f"NOT {HAS('<BLOCK2>')}")),
    ("no table", "content", "critical", 10.0, 20.0, f"{FLAG(N('TBLCELL') + ' = 0')} + {FLAG(N('TBLBODY') + ' = 0')}"),
    ("literal none", "content", "major", 5.0, 5.0, HOW_MANY("string_split(raw, chr(10))", "contains(x, '<TBLCELL') AND contains(x, '>None<')")),
    ("bare ampersand", "content", "major", 5.0, 5.0, FLAG(f"len(regexp_extract_all({BODY}, '&')) > len(regexp_extract_all({BODY}, '&#?[A-Za-z0-9]+;'))")),
    ("accented signs", "content", "minor", 2.0, 2.0, FLAG(f"regexp_matches({BODY}, '[éèêàâôîçùûÉÈÊÀÂÔÎÇœŒ]')")),
    ("balance", "content", "critical", 10.0, 1e9, " + ".join(FLAG(f"len(regexp_extract_all(raw, '<{t}\\b')) <> len(regexp_extract_all(raw, '</{t}>'))") for t in ("POLIDOC", "APPENDIX", "BLOCK1", "BLOCK2", "FREEFORM", "POLIDENT", "SGMLTBL", "TABLE", "TBLHEAD", "TBLBODY", "TBLROW"))),
    ("column numbers", "tables", "major", 5.0, 1e9, HOW_MANY(EACH("SGMLTBL"), f"{N('TBLHEAD', 'x')} > 0 AND {N('TBLBODY', 'x')} > 0 AND {DEFS('TBLHEAD', 'x')} <> {DEFS('TBLBODY', 'x')}")),
    ("row sizes", "tables", "major", 5.0, 1e9, HOW_MANY(EACH("TBLBODY"), f"len({COUNTS}) > 0 AND len({COUNTS}) > list_max(list_transform(list_distinct({COUNTS}), lambda v: len(list_filter({COUNTS}, lambda w: w = v))))")),
    ("column order", "tables", "minor", 2.0, 2.0, HOW_MANY(EACH("TBLROW"), f"len({STARTS}) > 0 AND {STARTS} <> list_transform(range(1, len({STARTS}) + 1), lambda y: CAST(y AS INT))")),
    ("stated rows", "tables", "minor", 2.0, 1e9, HOW_MANY(STATED, "x[1] <> '' AND TRY_CAST(x[1] AS INT) <> x[2]")),
    ("rows not stated", "tables", "minor", 1.0, 1e9, HOW_MANY(STATED, "x[1] = '' AND x[2] > 0")),
    ("no mark before landscape", "tables", "major", 5.0, 5.0, FLAG(f"{HAS('ORIENT=\"LANDSCAP\"')} AND NOT {HAS('<?RSRVON>')}")),
    ("no mark after landscape", "tables", "major", 5.0, 5.0, FLAG(f"{HAS('ORIENT=\"LANDSCAP\"')} AND NOT {HAS('<?RSRVOFF>')}")),
    ("mark not before table", "tables", "minor", 2.0, 2.0, FLAG(f"{HAS('ORIENT=\"LANDSCAP\"')} AND NOT regexp_matches(raw, '<[?]RSRVON>\\s*<TABLE>')")),
    ("landscape without width", "tables", "minor", 2.0, 1e9, HOW_MANY("regexp_extract_all(raw, '<SGMLTBL\\b([^>]*)>', 1)", "contains(x, 'LANDSCAP') AND NOT contains(x, 'TBLWD=')")),
    ("root of the kind", "kind", "critical", 8.0, 8.0, FLAG(f"{N('POLIDOC')} = 0")),
    ("column widths", "kind", "major", 4.0, 4.0, HOW_MANY(EACH("TBLCDEFS"), f"len({WIDTHS}) > 0 AND list_sum({WIDTHS}) NOT BETWEEN 95 AND 105")),
    ("landscape of the kind", "kind", "minor", 2.0, 4.0, FLAG(HAS('ORIENT="LANDSCAP"'))),
    ("blocks of the kind", "kind", "major", 4.0, 4.0, FLAG(f"NOT {HAS('<BLOCK2>')}")),
    ("cell of none", "cells", "major", 3.0, 3.0, HOW_MANY(EACH("TBLCELL"), "lower(x) = 'none'")),
    ("empty rows", "cells", "minor", 1.0, 1.0, HOW_MANY(EACH("TBLROW"), "regexp_full_match(x, '\\s*')")),
    ("long decimals", "cells", "minor", 1.0, 1.0, FLAG(HOW_MANY(EACH("TBLCELL"), f"regexp_matches({INNER('x')}, '^-?0?[.][0-9]+$')") + " > 3")),
    ("number left empty", "cells", "major", 3.0, 3.0, FLAG(f"{THERE('N')} AND {VALUE('N')} = ''")),
    ("date left empty", "cells", "major", 3.0, 3.0, FLAG(f"{THERE('DATE')} AND {VALUE('DATE')} = ''")),
    ("date form", "cells", "minor", 1.0, 1.0, FLAG(f"{VALUE('DATE')} <> '' AND NOT regexp_full_match({VALUE('DATE')}, '(?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+[0-9]{{1,2}},\\s+[0-9]{{4}}')")),
)


@query(f"WITH f AS {FILINGS} {_rules_sql(TABULAR_SQL)}")
def r_tabular_issues(spark, root):
    """Workbook rules applied to the filings."""
    return R.issues(R.prepared(filings(spark, root)), R.tabular_rules(F.col("raw"), today="May 1, 2020", ready=True))


@query(f"""WITH f AS {FILINGS}, i AS ({_rules_sql(TABULAR_SQL)}) SELECT f.doc_id, round(greatest(0.0, 35 - coalesce(sum(points) FILTER (WHERE category IN ('content', 'tables')), 0)) + greatest(0.0, 20 - coalesce(sum(points) FILTER (WHERE category = 'kind'), 0))
  + greatest(0.0, 10 - coalesce(sum(points) FILTER (WHERE category = 'cells'), 0)), 1) AS score FROM f LEFT JOIN i USING (doc_id) GROUP BY f.doc_id""")
def x_scores(spark, root):
    """What the workbook rules leave of the points of structure, kind and cells."""
    d = filings(spark, root)
    found = R.issues(R.prepared(d), R.tabular_rules(F.col("raw"), today="May 1, 2020", ready=True))
    return V.tabular_scores(d, found)


@query(rf"""WITH f AS {FILINGS} SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS ord, unnest(p) AS text FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(raw, '(?is)<POLIDENT\b.*?</POLIDENT>', ' ', 'g'),
  '(?is)<TABLE(?:\s[^>]*)?>.*?</TABLE>', ' [TABLE] ', 'g'), '(?is)<FOOTNOTE(?:\s[^>]*)?>.*?</FOOTNOTE>', ' [FOOTNOTE] ', 'g'), '(?is)(<P(?:\s[^>]*)?>.*?</P>|<P1(?:\s[^>]*)?>.*?</P1>|<DEFP(?:\s[^>]*)?>.*?</DEFP>)', 1), lambda x: {INNER('x')}),
  lambda x: len(regexp_extract_all(x, '[^{BL[1:-2]}]+')) >= 3) AS p FROM f)""")
def t12_filing_paragraphs(spark, root):
    """Paragraphs of the filings' markup, tables as place marks."""
    return filings(spark, root).select("doc_id", F.posexplode(M.paragraphs(F.col("raw"), M.MarkupVocabulary())).alias("ord", "text"))


@query(f"""WITH f AS {FILINGS} SELECT doc_id, CAST(len(regexp_extract_all(raw, '(?i)<TABLE[\\s>/]')) AS INT) AS tables, CAST(len(regexp_extract_all(raw, '(?i)<FOOTNOTE[\\s>/]')) AS INT) AS footnotes,
  CAST(len(regexp_extract_all(raw, '(?i)<GRAPHIC[\\s>/]')) AS INT) AS graphics, CAST(len(regexp_extract_all(raw, '(?i)<N[\\s>/]')) AS INT) AS sections FROM f""")
def t13_part_counts(spark, root):
    """Numbers of tables, footnotes, graphics and numbered parts."""
    return filings(spark, root).select("doc_id", M.part_counts(F.col("raw"), M.MarkupVocabulary()).alias("c")).select("doc_id", "c.*")


@query(f"""WITH f AS {FILINGS} SELECT doc_id, list_distinct(regexp_extract_all({HEAD}, '\\b([A-Za-z_][A-Za-z0-9_-]*)\\s*=\\s*"[^"]*"', 1)).list_sort() AS names, nullif({ROOT('LABEL')}[-1], '') AS label FROM f""")
def t05_root_attributes(spark, root):
    """Names of the root's attributes, and its label."""
    d = filings(spark, root).withColumn("a", M.root_attributes(F.col("raw"), "POLIDOC"))
    return d.select("doc_id", F.array_sort(F.map_keys("a")).alias("names"), F.nullif(F.try_element_at("a", F.lit("LABEL")), F.lit("")).alias("label"))


@query(f"""WITH f AS {FILINGS}, t AS (SELECT doc_id, unnest(e) AS content, generate_subscripts(e, 1) - 1 AS ord FROM (SELECT doc_id, {EACH('SGMLTBL')} AS e FROM f)) SELECT doc_id, CAST(ord AS INT) AS ord, content, {N('TBLHEAD', 'content')} > 0 AS has_head,
  CAST(coalesce({N('TBLCDEF', EACH('TBLCDEFS', 'content') + '[1]')}, 0) AS INT) AS columns, CAST({N('TBLROW', 'content')} AS INT) AS rows FROM t""")
def t23_table_parts(spark, root):
    """Tables of the filings with their head, columns and rows."""
    return M.table_parts(filings(spark, root))


@query(f"""WITH f AS {FILINGS}, l AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) AS line FROM (SELECT doc_id, string_split(raw, chr(10)) AS s FROM f)),
  t AS (SELECT doc_id, line, unnest(list_transform(regexp_extract_all(text, '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x))) AS tag FROM l) SELECT doc_id, tag, list_transform(list_sort(list(line)), lambda x: CAST(x AS INT)) AS lines FROM t WHERE tag IN ('ti', 'table', 'graphic', 'item') GROUP BY doc_id, tag""")
def t03_tag_lines(spark, root):
    """Lines on which the headings, tables, graphics and items open."""
    return M.tag_lines(filings(spark, root)).where(F.col("tag").isin("ti", "table", "graphic", "item"))


# --- dimensions ----------------------------------------------------------------


def facts(spark, root: str) -> DataFrame:
    """One row for each filing with what the dimensions compare: source counts from
    the printed side's record, target counts from the markup."""
    raw = F.col("raw")
    attrs = M.root_attributes(raw, "POLIDOC")
    attr = lambda n: F.try_element_at(attrs, F.lit(n)).alias(n.lower())
    t = filings(spark, root).select(
        "doc_id", M.count_tag(raw, "TABLE").alias("t_tables"), M.count_tag(raw, "GRAPHIC").alias("t_images"), M.count_tag(raw, "FOOTNOTE").alias("t_footnotes"), M.count_tag(raw, "TI").alias("t_headings"),
        (F.regexp_like(raw, F.lit(r"(?i)<APPENDIX[\s>/]")) | F.regexp_like(F.regexp_replace(raw, "<[^>]*>", " "), F.lit(r"Schedule\s+[A-Z0-9]"))).alias("t_appendix"),
        attr("LABEL"), attr("LANG"), attr("ADDDATE"), attr("MODDATE"), F.get(M.elements(raw, "N"), F.lit(0)).alias("number"),
    )
    p = table(spark, root, "pdf_data").groupBy("doc_id").agg(
        F.max("table_count").alias("s_tables"), F.max("image_count").alias("s_images"), F.max("footnote_count").alias("s_footnotes"), F.max("first_page_text").alias("first_page"),
        F.max("language_hint").alias("s_lang"), F.max("doc_date").alias("s_date"), F.max("two_column").alias("two_column"),
    )
    h = table(spark, root, "headings").where("side = 'pdf_l4'").groupBy("doc_id").agg(F.count_distinct("heading_id").cast("int").alias("s_headings"))
    return t.join(p, "doc_id", "left").join(h, "doc_id", "left").withColumn("s_headings", F.coalesce("s_headings", F.lit(0)))


FACTS = f"""(SELECT t.*, p.* EXCLUDE (doc_id), CAST(coalesce(h.n, 0) AS INT) AS s_headings FROM (SELECT doc_id, {N('TABLE')} AS t_tables, {N('GRAPHIC')} AS t_images, {N('FOOTNOTE')} AS t_footnotes, {N('TI')} AS t_headings,
  regexp_matches(raw, '(?i)<APPENDIX[\\s>/]') OR regexp_matches(regexp_replace(raw, '<[^>]*>', ' ', 'g'), 'Schedule\\s+[A-Z0-9]') AS t_appendix, {ROOT('LABEL')}[-1] AS label, {ROOT('LANG')}[-1] AS lang, {ROOT('ADDDATE')}[-1] AS adddate, {EACH('N')}[1] AS number FROM {FILINGS}) t
  LEFT JOIN (SELECT doc_id, max(table_count) AS s_tables, max(image_count) AS s_images, max(footnote_count) AS s_footnotes, max(first_page_text) AS first_page, max(language_hint) AS s_lang, max(doc_date) AS s_date, bool_or(two_column) AS two_column FROM pdf_data GROUP BY doc_id) p USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(DISTINCT heading_id) AS n FROM headings WHERE side = 'pdf_l4' GROUP BY doc_id) h USING (doc_id))"""


def _checks_sql(checks, source: str = FACTS) -> str:
    one = ", ".join(f"{{'dimension': '{d}', 'name': '{n}', 'severity': '{s}', 'points': CAST({p} AS DOUBLE), 'hit': coalesce({h}, false)}}" for d, n, s, h, p in checks)
    return f"SELECT doc_id, c.dimension AS dimension, c.name AS name, c.severity AS severity, c.points AS points FROM (SELECT doc_id, unnest([{one}]) AS c FROM {source}) WHERE c.hit"


_MANY = "s_headings > 3 AND t_headings > 0 AND NOT (t_headings < 4 AND s_headings > 4 * t_headings)"
COMPLETE_SQL = (
    ("completeness", "tables lost", "critical", "s_tables > 0 AND t_tables = 0", "least(2.0, s_tables / 2.0)"),
    ("completeness", "tables differ", "major", "s_tables > 0 AND t_tables > 0 AND abs(t_tables - s_tables) > greatest(1.0, s_tables / 4.0)", "1.0"),
    ("completeness", "images lost", "major", "s_images > 0 AND t_images = 0", "least(1.5, s_images * 0.3::DOUBLE)"),
    ("completeness", "images fewer", "minor", "s_images > 0 AND t_images > 0 AND s_images - t_images > 2", "0.5"),
    ("completeness", "footnotes lost", "major", "s_footnotes >= 5 AND t_footnotes = 0", "1.0"),
    ("completeness", "footnotes fewer", "minor", "t_footnotes > 0 AND s_footnotes - t_footnotes > 3", "0.5"),
    ("completeness", "sections lost", "major", f"{_MANY} AND 2 * t_headings < s_headings", "1.0"),
    ("completeness", "sections fewer", "minor", f"{_MANY} AND 2 * t_headings >= s_headings AND t_headings::DOUBLE / s_headings < 0.7::DOUBLE", "0.5"),
    ("completeness", "appendix lost", "minor", "regexp_matches(lower(first_page), '\\b(schedule|appendix|annex|exhibit)\\s+[a-z0-9]') AND NOT t_appendix", "0.5"),
)


@query(_checks_sql(COMPLETE_SQL))
def d4_completeness(spark, root):
    """What counts say the markup has lost of its source."""
    return D.apply_checks(facts(spark, root), D.completeness())


_DAY = lambda c: f"TRY_CAST(try_strptime({c}, '%Y%m%d') AS DATE)"
_NUM = SQUEEZE("coalesce(number, '')")
_APART = f"abs(date_diff('day', {_DAY('adddate')}, {_DAY('s_date')}))"
META_SQL = (
    ("metadata", "language", "major", "coalesce(lang, '') <> '' AND coalesce(s_lang, '') <> '' AND lang <> s_lang", "1.0"),
    ("metadata", "number", "major", f"number IS NOT NULL AND NOT contains(coalesce(first_page, ''), {_NUM}) AND regexp_matches({_NUM}, '[0-9]{{2}}-[0-9]{{3,4}}') AND NOT list_contains(regexp_extract_all(coalesce(first_page, ''), '[0-9]{{2}}-[0-9]{{3,4}}'), regexp_extract({_NUM}, '[0-9]{{2}}-[0-9]{{3,4}}')) AND NOT contains(translate(coalesce(first_page, ''), '- ', ''), translate({_NUM}, '- ', '')) AND NOT regexp_full_match({_NUM}, '[0-9]{{4}}-[0-9]{{3}}')", "1.0"),
    ("metadata", "date", "major", f"{_APART} > 1825", "1.0"),
    ("metadata", "date of keying", "warning", f"{_APART} BETWEEN 31 AND 1825", "0.0"),
    *[("metadata", f"{n} missing", "warning", f"trim(coalesce({n}, '')) = ''", "0.0") for n in ("label", "lang", "adddate")],
    ("metadata", "language unknown", "warning", "lang <> '' AND upper(trim(lang)) NOT IN ('EN', 'FR', 'BI')", "0.0"),
    ("metadata", "adddate form", "warning", f"adddate <> '' AND {_DAY('adddate')} IS NULL", "0.0"),
    ("metadata", "label form", "warning", "label <> '' AND NOT regexp_matches(label, '[A-Za-z]{3}')", "0.0"),
)


@query(_checks_sql(META_SQL))
def d7_metadata(spark, root):
    """What the filings state of themselves against what their source shows."""
    return D.apply_checks(facts(spark, root), D.metadata())


@query(f"""WITH c AS ({_checks_sql(COMPLETE_SQL)} UNION ALL {_checks_sql(META_SQL)}) SELECT f.doc_id, f.dimension, round(greatest(0.0, f.base - coalesce(sum(c.points), 0.0)), 6) AS score
  FROM (SELECT doc_id, unnest(['tagging', 'completeness', 'ordering', 'metadata']) AS dimension, unnest([5.0, 7.0, 4.0, 3.0]::DOUBLE[]) AS base FROM {FACTS}) f LEFT JOIN c ON c.doc_id = f.doc_id AND c.dimension = f.dimension GROUP BY f.doc_id, f.dimension, f.base""")
def d_dimension_scores(spark, root):
    """What completeness and metadata leave of the dimensions' points."""
    f = facts(spark, root)
    return D.dimension_scores(f, D.apply_checks(f, [*D.completeness(), *D.metadata()]), D.DIMENSION_POINTS).withColumn("score", F.round("score", 6))


_TEXTS = lambda side: f"(SELECT doc_id, {SQUEEZE('lower(text)')} AS t, min(idx) AS i FROM paragraphs WHERE side = '{side}' GROUP BY ALL)"


@query(f"""WITH p AS (SELECT a.doc_id, a.i AS a, b.i AS b FROM {_TEXTS('sgml')} a JOIN {_TEXTS('pdf_l4')} b ON a.doc_id = b.doc_id AND a.t = b.t), m AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
  v AS (SELECT x.doc_id, count(*) AS k FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.a < y.a AND x.b > y.b GROUP BY x.doc_id), two AS (SELECT doc_id, bool_or(two_column) AS w FROM pdf_data GROUP BY doc_id),
  r AS (SELECT m.doc_id, coalesce(v.k, 0) / (m.n * (m.n - 1) / 2.0) AS ratio FROM m LEFT JOIN v USING (doc_id) LEFT JOIN two USING (doc_id) WHERE m.n >= 3 AND NOT coalesce(w, false))
  SELECT doc_id, 'ordering' AS dimension, CASE WHEN ratio > 0.3 THEN 'order' ELSE 'order in part' END AS name, CASE WHEN ratio > 0.3 THEN 'major' ELSE 'minor' END AS severity, round(CAST(CASE WHEN ratio > 0.3 THEN least(2.0, ratio * 4.0) ELSE 0.5 END AS DOUBLE), 6) AS points FROM r WHERE ratio > 0.1""")
def d5_ordering(spark, root):
    """Points for paragraphs that stand in another order than in the source."""
    h = table(spark, root, "paragraphs").select("doc_id", "side", "idx", T.squeeze(F.lower("text")).alias("t"))
    one = lambda side, name: h.where(F.col("side") == side).groupBy("doc_id", "t").agg(F.min("idx").alias(name))
    order = J.inversions(one("sgml", "a").join(one("pdf_l4", "b"), ["doc_id", "t"])).withColumns({"s_headings": F.col("matched"), "t_headings": F.col("matched")})
    two = table(spark, root, "pdf_data").groupBy("doc_id").agg(F.max("two_column").alias("two_column"))
    return D.apply_checks(order.join(two, "doc_id", "left"), D.ordering()).withColumn("points", F.round("points", 6))


_CONTACT = lambda kind, pattern: f"""SELECT host, '{kind}' AS kind, trim(min(i)) AS item FROM (SELECT host, i, lower(regexp_replace(i, '[\\s().+-]', '', 'g')) AS k FROM (SELECT host, unnest(regexp_extract_all(text, '{pattern}', 1)) AS i FROM documents WHERE host IS NOT NULL))
  ANTI JOIN (SELECT host, lower(regexp_replace(i, '[\\s().+-]', '', 'g')) AS k FROM (SELECT host, unnest(regexp_extract_all(url, '{pattern}', 1)) AS i FROM documents)) USING (host, k) GROUP BY host, k"""  # noqa: E731


@query(" UNION ALL ".join(_CONTACT(k, p) for k, p in (("phone", "(?:^|[^0-9])((?:\\+?1[-.\\s]?)?\\(?[0-9]{3}\\)?[-.\\s][0-9]{3}[-.\\s][0-9]{4})(?:[^0-9]|$)"), ("mail", "([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,})"), ("link", "(https?://[^\\s<>\"&]{8,}|www\\.[^\\s<>\"&]{5,})"))))
def d9_contacts(spark, root):
    """Phone numbers, addresses and links in a host's pages that aren't among the
    addresses crawled from it; the filings of the tables hold none to compare."""
    d = table(spark, root, "documents").where("host IS NOT NULL")
    return D.contacts(d.select("host", "text"), d.select("host", F.col("url").alias("text")), doc="host")[0]


@query(f"""SELECT s.doc_id, CASE WHEN p.t = 0 THEN 4.0 WHEN s.t = 0 THEN CASE WHEN p.t <= 2 THEN 2.0 ELSE 0.0 END WHEN least(s.t, p.t) / p.t >= 0.9 THEN 4.0 WHEN least(s.t, p.t) / p.t >= 0.6 THEN 2.0 WHEN least(s.t, p.t) / p.t >= 0.3 THEN 1.0 ELSE 0.0 END AS tables,
  CASE WHEN p.f = 0 THEN 3.0 WHEN s.f = 0 THEN CASE WHEN p.f >= 3 THEN 0.0 ELSE 1.5 END WHEN least(s.f, p.f) / p.f >= 0.8 THEN 3.0 WHEN least(s.f, p.f) / p.f >= 0.5 THEN 1.5 ELSE 0.0 END AS footnotes,
  p.w > 200 AND s.w > 300 AND s.w < 0.3 * p.w AND NOT p.w > 5 * s.w AS lost FROM (SELECT doc_id, max(table_count) AS t, max(footnote_count) AS f, max(raw_word_count) AS w FROM sgml_content GROUP BY doc_id) s
  JOIN (SELECT doc_id, max(table_count) AS t, max(footnote_count) AS f, max(clean_word_count) AS w FROM pdf_content GROUP BY doc_id) p USING (doc_id)""")
def c4_count_tiers(spark, root):
    """Points for the tables and footnotes found, and whether most words are lost."""
    most = lambda name, words: table(spark, root, name).groupBy("doc_id").agg(*[F.max(c).alias(a) for c, a in (("table_count", "t"), ("footnote_count", "f"), (words, "w"))])
    s, p = most("sgml_content", "raw_word_count").alias("s"), most("pdf_content", "clean_word_count").alias("p")
    return s.join(p, "doc_id").select(
        "doc_id", D.table_points(F.col("p.t"), F.col("s.t")).alias("tables"), D.footnote_points(F.col("p.f"), F.col("s.f")).alias("footnotes"),
        D.catastrophic_loss(F.col("p.w"), F.col("s.w"), F.lit(False)).alias("lost"),
    )


CORPUS_FACTS = f"""(SELECT doc_id, jurisdiction, {ROOT('LABEL')}[-1] AS label, list_contains((SELECT list(label) FROM instruments), {ROOT('LABEL')}[-1]) AS known_label, regexp_matches(raw, '<(PART|SEC )') AS has_parts,
  CASE WHEN lower(doc_type) LIKE '%notice%' THEN 'notice' ELSE 'instrument' END AS doc_type, contains(raw, '<FREEFORM') AS has_free_form, {N('TABLE')} AS n_table, {N('SGMLTBL')} AS n_body, contains(raw, '<POLIDENT') AS has_ident, regexp_matches(raw, '<(MISCLAW|LEGIDDOC)[\\s>]') AS special
  FROM {FILINGS} LEFT JOIN (SELECT doc_id, max(jurisdiction) AS jurisdiction, max(doc_type) AS doc_type FROM document_class GROUP BY doc_id) USING (doc_id))"""


@query(_checks_sql((
    ("jurisdiction", "unknown", "minor", "lower(jurisdiction) = 'unknown'", "2.0"), ("jurisdiction", "label unknown", "minor", "label IS NOT NULL AND NOT known_label", "1.0"),
    ("patterns", "notice with parts", "warning", "doc_type = 'notice' AND has_parts", "0.0"), ("patterns", "instrument without parts", "major", "doc_type = 'instrument' AND NOT has_parts", "3.0"),
    ("patterns", "no free form", "critical", "NOT has_free_form", "3.0"), ("patterns", "tables unpaired", "major", "n_table <> n_body", "2.0"), ("patterns", "no ident block", "critical", "NOT has_ident AND NOT special", "2.0"),
), CORPUS_FACTS))
def c8_corpus_patterns(spark, root):
    """Jurisdiction, label and structural patterns of the filings against the corpus."""
    raw, has = F.col("raw"), lambda t: F.contains("raw", F.lit(t))
    label = F.try_element_at(M.root_attributes(raw, "POLIDOC"), F.lit("LABEL"))
    known = table(spark, root, "instruments").where("label IS NOT NULL").select(F.col("label"), F.lit(True).alias("k")).distinct()
    cls = table(spark, root, "document_class").groupBy("doc_id").agg(F.max("jurisdiction").alias("jurisdiction"), F.max("doc_type").alias("doc_type"))
    f = filings(spark, root).select(
        "doc_id", label.alias("label"), F.regexp_like(raw, F.lit("<(PART|SEC )")).alias("has_parts"), has("<FREEFORM").alias("has_free_form"), M.count_tag(raw, "TABLE").alias("n_table"),
        M.count_tag(raw, "SGMLTBL").alias("n_body"), has("<POLIDENT").alias("has_ident"), F.regexp_like(raw, F.lit(r"<(MISCLAW|LEGIDDOC)[\s>]")).alias("special"),
    ).join(cls, "doc_id", "left").join(known, "label", "left")
    none = F.lit(None).cast("double")
    f = f.withColumns({"known_label": F.coalesce("k", F.lit(False)), "doc_type": F.when(F.lower("doc_type").contains("notice"), "notice").otherwise("instrument"), "z": none, "corpus_depth": none, "depth": none, "missing_common": none})
    return D.apply_checks(f, [c for c in D.corpus_checks() if c.dimension != "statistics"])


# --- cards ---------------------------------------------------------------------


@query(f"""WITH f AS (SELECT f.doc_id, f.raw, c.name FROM {FILINGS} f JOIN ({_checks_sql(META_SQL)}) c USING (doc_id) WHERE c.points > 0), h AS (SELECT doc_id, max(language_hint) AS hint FROM pdf_data GROUP BY doc_id),
  l AS (SELECT doc_id, name, unnest(string_split(raw, chr(10))) AS t, generate_subscripts(string_split(raw, chr(10)), 1) AS line FROM f),
  a AS (SELECT doc_id, name, min(line) FILTER (WHERE contains(t, CASE name WHEN 'number' THEN '<N' ELSE '<POLIDOC' END) AND (name <> 'number' OR regexp_matches(t, '<N[\\s>]'))) AS line FROM l GROUP BY ALL)
  SELECT a.doc_id, 'metadata' AS dimension, a.name, CAST(a.line AS INT) AS line, l.t AS wrong, CASE a.name WHEN 'language' THEN replace(l.t, 'LANG="' || regexp_extract(l.t, 'LANG="([^"]*)"', 1) || '"', 'LANG="' || hint || '"') END AS "right", a.name = 'language' AS auto
  FROM a JOIN l ON l.doc_id = a.doc_id AND l.name = a.name AND l.line = a.line JOIN h ON h.doc_id = a.doc_id""")
def x02_metadata_cards(spark, root):
    """Cards for wrong languages, numbers and dates, the first with its correction."""
    f = facts(spark, root)
    return X.metadata_cards(filings(spark, root), D.apply_checks(f, D.metadata()), f.select("doc_id", "s_lang"))


@query(f"""WITH RECURSIVE i AS ({ISSUES_SQL}), f AS {FILINGS}, w(rule, tag) AS (VALUES ('empty item', 'ITEM'), ('empty heading', 'TI'), ('graphic without file', 'GRAPHIC'), ('paragraph in cell', 'TBLCELL'), ('date label', 'DATE')),
  l AS (SELECT doc_id, unnest(string_split(raw, chr(10))) AS t, generate_subscripts(string_split(raw, chr(10)), 1) AS line FROM f)
  SELECT i.doc_id, i.category AS dimension, i.severity, i.rule AS name, CAST(min(l.line) AS INT) AS line FROM i JOIN w USING (rule) JOIN l ON l.doc_id = i.doc_id AND regexp_matches(l.t, '<' || w.tag || '[\\s>/]') GROUP BY ALL""")
def x09_issue_cards(spark, root):
    """Cards for structural issues, at the first line that shows the tag in question."""
    d = filings(spark, root)
    return X.issue_cards(d, R.filing_issues(d, list(ENTITIES)), {"empty item": "ITEM", "empty heading": "TI", "graphic without file": "GRAPHIC", "paragraph in cell": "TBLCELL", "date label": "DATE"})


@query(f"""SELECT doc_id, contains(raw, '<QUOTE') AS has_quote, contains(raw, '<POLIDENT') AS has_polident, regexp_matches(raw, '<(PART|SEC)[\\s>]') AS has_part_sec, regexp_matches(raw, '<(MISCLAW|LEGIDDOC)[\\s>]') AS is_tsx_special FROM {FILINGS}""")
def p02_flags(spark, root):
    """What a first look at the markup tells of each filing's kind."""
    return filings(spark, root).select("doc_id", *[x.alias(n) for n, x in A.first_look(F.col("raw")).items()])


D_ = "(SELECT DISTINCT * FROM decisions)"


@query(f"""SELECT sgml_file, decision_id, normalised_score FROM (SELECT *, row_number() OVER (ORDER BY normalised_score, decision_id) AS k FROM {D_} WHERE normalised_score IS NOT NULL) WHERE k <= 20""")
def o06_lowest_scores(spark, root):
    """The twenty decisions of the lowest scores."""
    d = table(spark, root, "decisions").distinct().where("normalised_score IS NOT NULL")
    return d.orderBy("normalised_score", "decision_id").limit(20).select("sgml_file", "decision_id", "normalised_score")


@query(f"""SELECT DISTINCT doc_id, {SQUEEZE('lower(text)')} AS text FROM headings WHERE text IS NOT NULL UNION SELECT DISTINCT doc_id, {SQUEEZE('lower(doc_title)')} AS text FROM sgml_content WHERE doc_title IS NOT NULL""")
def u02_heading_sources(spark, root):
    """All heading texts of a filing from every place that has some."""
    h = table(spark, root, "headings").where("text IS NOT NULL").select("doc_id", T.squeeze(F.lower("text")).alias("text"))
    return h.unionByName(table(spark, root, "sgml_content").where("doc_title IS NOT NULL").select("doc_id", T.squeeze(F.lower("doc_title")).alias("text"))).distinct()


# --- markup of filings -----------------------------------------------------------


@query(f"""SELECT doc_id, name, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(raw, '&([A-Za-z][A-Za-z0-9]*);', 1)) AS name FROM {FILINGS}) WHERE name NOT IN ('amp', 'lt', 'gt', 'quot') GROUP BY ALL""")
def j21_unknown_entities(spark, root):
    """Entities of the filings beyond those of well-formed text."""
    rows = filings(spark, root).select("doc_id", F.explode(M.entity_names(F.col("raw"))).alias("name"))
    return rows.where(~F.col("name").isin(*ENTITIES)).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT s.doc_id, s.label FROM sgml_content s ANTI JOIN instruments i ON s.doc_number = i.doc_number AND s.label = i.label WHERE s.label IS NOT NULL""")
def j25_unknown_labels(spark, root):
    """Filings whose label isn't that of the instrument with their number."""
    s = table(spark, root, "sgml_content").where("label IS NOT NULL").select("doc_id", "doc_number", "label").distinct()
    return s.join(table(spark, root, "instruments").select("doc_number", "label"), ["doc_number", "label"], "left_anti").select("doc_id", "label").distinct()


@query("""WITH v AS (SELECT DISTINCT doc_id, upper(text) AS value FROM headings WHERE side = 'sgml'), t AS (SELECT DISTINCT doc_id, text FROM headings WHERE side = 'pdf_l4'),
  f AS (SELECT *, array_to_string(list_transform(string_split(lower(value), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM v WHERE regexp_matches(value, '[A-Z]') AND NOT regexp_matches(value, '[a-z]') AND length(value) > 2)
  SELECT f.doc_id, value FROM f JOIN t ON f.doc_id = t.doc_id GROUP BY f.doc_id, value HAVING bool_or(contains(text, lower(value)) OR contains(text, title)) AND NOT bool_or(contains(text, value))""")
def j19_lower_cased(spark, root):
    """Headings, in capitals, that the printed side has in small or title letters only."""
    v = table(spark, root, "headings").where("side = 'sgml'").select("doc_id", F.upper("text").alias("value"))
    return J.lower_cased(v, table(spark, root, "headings").where("side = 'pdf_l4'").select("doc_id", "text"))


@query(f"""WITH f AS {FILINGS}, l AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, string_split(raw, chr(10)) AS s FROM f)), a AS (SELECT doc_id, min(k) AS line FROM l WHERE contains(t, '<TI') GROUP BY doc_id)
  SELECT a.doc_id, CAST(a.line AS INT) AS line, string_agg(CASE WHEN l.k = a.line THEN '> ' ELSE '  ' END || l.t, chr(10) ORDER BY l.k) AS snippet FROM a JOIN l ON l.doc_id = a.doc_id AND l.k BETWEEN a.line - 2 AND a.line + 2 GROUP BY ALL""")
def t22_context(spark, root):
    """Lines around the first heading of each filing."""
    d = filings(spark, root)
    return M.context_lines(d, M.first_line(d, "<TI"))


@query("""WITH RECURSIVE f AS """ + FILINGS + """, ev AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, list_transform(regexp_extract_all(raw, '<(/?[A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x)) AS t FROM f)),
  st AS (SELECT doc_id, 0 AS k, []::VARCHAR[] AS s, NULL::VARCHAR AS path FROM f UNION ALL SELECT st.doc_id, ev.k,
    CASE WHEN ev.t IN ('graphic', 'tblcdef') THEN st.s WHEN ev.t NOT LIKE '/%' THEN list_append(st.s, ev.t) WHEN list_contains(st.s, substr(ev.t, 2)) THEN st.s[1 : len(st.s) - list_position(list_reverse(st.s), substr(ev.t, 2))] ELSE st.s END,
    CASE WHEN ev.t NOT LIKE '/%' THEN array_to_string(list_append(st.s, ev.t), '/') END FROM st JOIN ev ON ev.doc_id = st.doc_id AND ev.k = st.k + 1)
  SELECT path, count(*) AS n FROM st WHERE path IS NOT NULL GROUP BY path""")
def t21_tag_paths(spark, root):
    """How often each path of open tags occurs in the filings."""
    return M.tag_paths(filings(spark, root), M.MarkupVocabulary()).groupBy("path").agg(F.count("*").alias("n"))


_WORDY = lambda tag, n: HOW_MANY(EACH(tag), f"len(regexp_extract_all({INNER('x')}, '[^{BL[1:-2]}]+')) >= {n}")


@query(f"""WITH f AS {FILINGS} SELECT doc_id, CAST(length({INNER('raw')}) AS INT) AS n, CAST({_WORDY('P', 5)} AS INT) AS paragraphs, CAST({HOW_MANY(EACH('TI'), INNER('x') + " <> ''")} AS INT) AS headings, CAST({_WORDY('TBLCELL', 2)} AS INT) AS cells,
  CAST({N('TABLE')} AS INT) AS tables, {N('APPENDIX')} > 0 AS has_appendix FROM f""")
def t14_contents(spark, root):
    """Sizes of what a comparison reads of each filing."""
    c = filings(spark, root).select("doc_id", M.contents(F.col("raw"), M.MarkupVocabulary()).alias("c"))
    return c.select("doc_id", F.length("c.text").alias("n"), *[F.size(f"c.{x}").alias(x) for x in ("paragraphs", "headings", "cells")], "c.counts.tables", "c.has_appendix")


@query(f"""WITH f AS {FILINGS}, v AS (SELECT doc_id, raw, CASE WHEN {N('BLOCK2')} >= 2 THEN 'BLOCK2' WHEN {N('BLOCK3')} >= 2 THEN 'BLOCK3' WHEN {N('BLOCK1')} >= 2 THEN 'BLOCK1' ELSE 'BLOCK2' END AS lv FROM f),
  p AS (SELECT doc_id, lv, unnest(s) AS part, generate_subscripts(s, 1) - 1 AS ord FROM (SELECT doc_id, lv, string_split(regexp_replace(raw, '(?i)(<' || lv || '[\\s>])', chr(1) || '\\1', 'g'), chr(1)) AS s FROM v)),
  c AS (SELECT *, {INNER('part')} AS content, list_filter(list_transform({EACH('TI', 'part')}, lambda x: {INNER('x')}), lambda x: x <> '') AS h FROM p)
  SELECT doc_id, CAST(ord AS INT) AS ord, coalesce(h[1], '') AS heading, content, CAST(length(content) AS INT) AS raw_len FROM c WHERE regexp_matches(part, '(?i)^<' || lv || '[\\s>]') OR len(regexp_extract_all(content, '[^{BL[1:-2]}]+')) >= 10""")
def t15_sections(spark, root):
    """Sections of the filings at the first block level that repeats."""
    return M.sections(filings(spark, root), M.MarkupVocabulary())


# --- classes and summaries -------------------------------------------------------


@query(rf"""WITH b AS (SELECT doc_id, unnest(list_slice(string_split(regexp_replace(raw, '(?i)(<BLOCK[123][\s>])', chr(1) || '\1', 'g'), chr(1)), 2, 1000000)) AS p FROM {FILINGS}), n AS (SELECT doc_id, count(*) AS n FROM b WHERE NOT regexp_matches(string_split(regexp_replace(p, '(?i)</BLOCK[123]>', chr(2), 'g'), chr(2))[1], '(?i)<TI[\s>]') GROUP BY doc_id)
  SELECT f.doc_id, CAST({N('TI').replace('/]', ']')} AS INT) AS headings, CAST(coalesce(n, 0) AS INT) AS bare FROM {FILINGS} f LEFT JOIN n USING (doc_id)""")
def g7_bare_blocks(spark, root):
    """Headings of the filings and blocks without one."""
    return D.blocks_without_heading(filings(spark, root))


_CASES = lambda tests, other="NULL": "CASE " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in tests) + f" ELSE {other} END"
_WORDS = lambda column, words: [(f"contains(upper({column}), '{a}')", b) for a, b in words]
_PLACES = [("ALBERTA", "Alberta"), ("BRITISHCOLUMBIA", "BritishColumbia"), ("MANITOBA", "Manitoba"), ("NEWBRUNSWICK", "NewBrunswick"), ("NEWFOUNDLAND", "Newfoundland"), ("NFLD", "Newfoundland"), ("NOVASCOTIA", "NovScotia"), ("/NWT/", "NWT"), ("NUNAVUT", "Nunavut"), ("ONTARIO", "Ontario"), ("PEI", "PEI"), ("QUEBEC", "Quebec"), ("SASKATCHEWAN", "Saskatchewan"), ("TSX", "TSX"), ("TMX", "TSX"), ("CIRO", "CIRO"), ("IIROC", "CIRO")]
_LABELS = [("ASC", "Alberta"), ("BCSC", "BritishColumbia"), ("MSC", "Manitoba"), ("NSSSC", "NovScotia"), ("OSC", "Ontario"), ("SFSA", "Saskatchewan"), ("TSX", "TSX"), ("TMX", "TSX"), ("CIRO", "CIRO"), ("IIROC", "CIRO"), ("CSA", "CSA"), ("NATIONAL INSTRUMENT", "National"), ("NI ", "National")]


@query(f"""WITH p AS (SELECT doc_id, max(path) AS path, max(filename) AS name FROM sgml_content GROUP BY doc_id), r AS (SELECT doc_id, raw, path, name, regexp_extract(raw, 'LABEL="([^"]+)"', 1) AS label, contains(raw, '<QUOTE>') OR contains(raw, '<QUOTE ') AS q, regexp_matches(raw, '<POLIDENT[\\s>]') AS i, regexp_matches(raw, '<PART[\\s>]') OR regexp_matches(raw, '<SEC[\\s>]') AS s FROM {FILINGS} JOIN p USING (doc_id)),
  j AS (SELECT *, coalesce({_CASES(_WORDS('path', _PLACES))}, {_CASES(_WORDS('label', _LABELS))}, 'Unknown') AS j, regexp_matches(lower(name), 'amending|amendment|implementing') AS am FROM r),
  k AS (SELECT *, NOT i AND (j = 'TSX' OR regexp_matches(name, 'By-Law|By-law|ByLaw|by-law|bylaw|Form|form|Capital-Markets-Tribunal')) AS sp FROM j)
  SELECT doc_id, coalesce(nullif(regexp_extract(raw, 'LANG="(EN|FR)"', 1), ''), 'EN') AS lang, CASE WHEN sp THEN 'TSX_SPECIAL' WHEN q OR am THEN 'AMENDMENT' WHEN s THEN 'INSTRUMENT' ELSE 'NOTICE' END AS doc_type, j AS jurisdiction, q AS has_quote, i AS has_polident, sp AS is_special, s AS has_part_sec, label,
  regexp_extract(raw, 'ADDDATE="([^"]+)"', 1) AS adddate, CAST(CASE WHEN sp THEN 0.95 WHEN q THEN 0.98 WHEN am THEN 0.85 WHEN s THEN 0.9 ELSE 0.85 END AS DOUBLE) AS confidence FROM k""")
def p02_filing_class(spark, root):
    """Kind, language and jurisdiction of every filing by its tags, label and path."""
    names = table(spark, root, "sgml_content").groupBy("doc_id").agg(F.max("path").alias("path"), F.max("filename").alias("name"))
    return filings(spark, root).join(names, "doc_id").select("doc_id", A.filing_class(F.col("raw"), F.col("path"), F.col("name")).alias("c")).select("doc_id", "c.*")


@query(f"""WITH f AS {FILINGS}, i AS ({ISSUES_SQL}) SELECT f.doc_id, round(greatest(0.0, 8.0 - coalesce(sum(CASE severity WHEN 'critical' THEN 2.5 WHEN 'major' THEN 1.0 WHEN 'minor' THEN 0.3::DOUBLE ELSE 0.0 END), 0.0)), 6) AS text, round(greatest(0.0, 1 - count(i.rule) * 0.04::DOUBLE), 6) AS coverage FROM f LEFT JOIN i USING (doc_id) GROUP BY f.doc_id""".replace("WITH f AS", "WITH RECURSIVE f AS", 1))
def a12_severity_points(spark, root):
    """Points and coverage left by the filings' issues, each counted as a missing text."""
    d = filings(spark, root)
    found = R.filing_issues(d, list(ENTITIES)).select("doc_id", F.lit("missing").alias("kind"), "severity")
    return D.severity_points(d, found).withColumn("text", F.round("text", 6)).withColumn("coverage", F.round("coverage", 6))


@query(f"""SELECT coalesce(upper(human_decision), '-') AS expected, coalesce(upper(validator_decision), '-') AS decision, CAST(count(*) AS BIGINT) AS n, round(avg(normalised_score), 6) AS mean, min(normalised_score) AS low, max(normalised_score) AS high FROM {D_} GROUP BY ALL""")
def k11_calibration(spark, root):
    """How the validator's decisions fall on what reviewers decided."""
    d = table(spark, root, "decisions").distinct()
    return K.calibration(d.withColumns({"e": F.coalesce("human_decision", F.lit("-")), "g": F.coalesce("validator_decision", F.lit("-"))}), "e", "g", "normalised_score").withColumn("mean", F.round("mean", 6))


@query(f"""WITH f AS {FILINGS}, t AS (SELECT doc_id, unnest(e) AS t, generate_subscripts(e, 1) - 1 AS ord FROM (SELECT doc_id, {EACH('SGMLTBL')} AS e FROM f)), r AS (SELECT doc_id, ord, {N('TBLCELL', 'r')} AS cells FROM (SELECT doc_id, ord, unnest({EACH('TBLROW', 't')}) AS r FROM t)),
  c AS (SELECT doc_id, ord, cells, count(*) AS n FROM r GROUP BY ALL) SELECT doc_id, CAST(ord AS INT) AS ord, CAST(cells AS INT) AS mode, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY n DESC, cells) = 1""")
def a15_modal_cells(spark, root):
    """Most frequent number of cells in the rows of each table of the filings."""
    rows = M.table_parts(filings(spark, root)).select("doc_id", "ord", F.explode(M.elements(F.col("content"), "TBLROW")).alias("r"))
    return L.modal_value(rows.select("doc_id", "ord", M.count_tag(F.col("r"), "TBLCELL").alias("cells")), ["doc_id", "ord"], "cells")


@query(f"""WITH f AS {FILINGS}, r AS (SELECT doc_id, unnest(e) AS r, generate_subscripts(e, 1) - 1 AS k FROM (SELECT doc_id, {EACH('TBLROW')} AS e FROM f)), c AS (SELECT doc_id || '-' || k AS row_id, unnest(regexp_extract_all(r, 'COLSTART="([0-9]+)"', 1)) AS s FROM r)
  SELECT row_id, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY row_id HAVING min(CAST(s AS INT)) <> 1 OR max(CAST(s AS INT)) <> count(*) OR count(DISTINCT s) <> count(*)""")
def w08_column_starts(spark, root):
    """Table rows of the filings whose columns aren't numbered 1 to n."""
    rows = filings(spark, root).select("doc_id", F.posexplode(M.elements(F.col("raw"), "TBLROW")).alias("k", "r"))
    starts = F.explode(F.regexp_extract_all("r", F.lit('COLSTART="([0-9]+)"'), F.lit(1)))
    cells = rows.select(F.concat_ws("-", "doc_id", "k").alias("row_id"), starts.alias("s")).withColumn("s", F.col("s").cast("int"))
    return R.not_sequential(cells, "row_id", "s")
