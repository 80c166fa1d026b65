"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireline.functions import entities as E
from quireline.functions import text as T
from quireline.functions.udf import nfc, page_text, seq_ratio, xml_ok
from quireline.operators import compare as J
from quireline.operators import corpus as A
from quireline.operators import fixes as X
from quireline.operators import layout as L
from quireline.operators import markup as M
from quireline.operators import report as K
from quireline.operators import rules as R
from quireline.plans import validate as V
from quireline.plans.judge import OfflineJudge, judge_pairs
from quireline.sources.tables import table
from quireline.streaming import decisions as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# --- parts that queries share ------------------------------------------------


def paras(spark: SparkSession, root: str, side: str) -> DataFrame:
    """Paragraphs of one side; resent rows once."""
    return table(spark, root, "paragraphs").where(F.col("side") == side).select("para_id", "doc_id", "idx", "page", "text").dropDuplicates(["para_id"])


def heads(spark: SparkSession, root: str, side: str) -> DataFrame:
    return table(spark, root, "headings").where(F.col("side") == side).select("heading_id", "doc_id", "idx", "text").dropDuplicates(["heading_id"])


def pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages with their bytes as text, one sign a byte, so that tags are found in any charset."""
    return table(spark, root, "documents").select("doc_id", F.decode("raw", "ISO-8859-1").alias("raw"))


def plain():
    """Words of a text in small ASCII letters and digits."""
    return T.words(T.plain_words_text(F.col("text")))


P = lambda side: f"(SELECT DISTINCT para_id, doc_id, idx, page, text FROM paragraphs WHERE side = '{side}')"
H = lambda side: f"(SELECT DISTINCT heading_id, doc_id, idx, text FROM headings WHERE side = '{side}')"
WORDS = "list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
BL = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQUEEZE = lambda x: f"trim(regexp_replace({x}, '{BL}', ' ', 'g'))"
RAW = "(SELECT doc_id, raw::VARCHAR AS raw FROM documents)"


# --- markup -----------------------------------------------------------------


@query(f"""SELECT doc_id, tag, CAST(count(*) FILTER (WHERE NOT closing) AS BIGINT) AS opens, CAST(count(*) FILTER (WHERE closing) AS BIGINT) AS closes FROM (
  SELECT doc_id, lower(replace(t, '/', '')) AS tag, t LIKE '/%' AS closing FROM (SELECT doc_id, unnest(regexp_extract_all(raw, '<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM {RAW})) GROUP BY ALL""")
def t02_tag_counts(spark, root):
    """Opening and closing tags of every page."""
    return M.tag_counts(pages(spark, root))


@query(rf"""SELECT doc_id, nullif(regexp_extract(raw, '(?is)<html\s[^>]*?\blang\s*=\s*\\x22([^\\]*)\\x22', 1), '') AS lang FROM {RAW}""")
def t04_attribute(spark, root):
    """Language attribute of the root tag."""
    return pages(spark, root).select("doc_id", M.attribute(F.col("raw"), "html", "lang").alias("lang"))


@query(r"""SELECT doc_id, ord, heading FROM (SELECT doc_id, unnest(h) AS heading, generate_subscripts(h, 1) - 1 AS ord FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(TRY(decode(raw)), '(?is)<h1(?:\s[^>]*)?>(.*?)</h1>', 1), lambda x: """ + SQUEEZE("regexp_replace(x, '<[^>]*>', ' ', 'g')") + r"""), lambda x: x <> '') AS h FROM documents))""")
def t07_headings(spark, root):
    """Headings of the pages that are UTF-8."""
    d = table(spark, root, "documents").select("doc_id", F.col("raw").cast("string").alias("raw"))
    ok = F.when(F.is_valid_utf8("raw"), F.col("raw"))
    return d.select("doc_id", F.posexplode(M.element_texts(ok, "h1")).alias("ord", "heading"))


@query()
def t07_all_headings(spark, root):
    """Headings of all pages, each in its own charset; DuckDB can't decode them."""
    d = table(spark, root, "documents").select("doc_id", page_text("raw", "headers").alias("raw"))
    return d.select("doc_id", F.posexplode(M.element_texts(F.col("raw"), "h1")).alias("ord", "heading"))


@query(rf"""SELECT doc_id, CAST(len(regexp_extract_all(raw, '(?i)<p[\s>/]')) AS INT) AS p, CAST(len(regexp_extract_all(raw, '(?i)<li[\s>/]')) AS INT) AS li, CAST(len(regexp_extract_all(raw, '(?i)<a[\s>/]')) AS INT) AS a FROM {RAW}""")
def t08_count_tag(spark, root):
    """Numbers of paragraph, item and link tags."""
    return pages(spark, root).select("doc_id", *[M.count_tag(F.col("raw"), t).alias(t) for t in ("p", "li", "a")])


@query()
def t12_paragraphs(spark, root):
    """Paragraphs of the pages' markup."""
    return pages(spark, root).select("doc_id", F.posexplode(M.paragraphs(F.col("raw"), M.HTML)).alias("ord", "text"))


@query(f"""WITH e AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, regexp_extract_all(raw, '<(/?[A-Za-z][A-Za-z0-9]*)', 1) AS t FROM {RAW})),
  s AS (SELECT doc_id, k, sum(CASE WHEN lower(replace(t, '/', '')) IN ('meta', 'br', 'img', 'link', 'hr', 'input') THEN 0 WHEN t LIKE '/%' THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS s FROM e),
  m AS (SELECT doc_id, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY k)) AS d FROM s)
  SELECT d.doc_id, CAST(coalesce(max(m.d), 0) AS INT) AS depth FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id""")
def t18_nesting_depth(spark, root):
    """Greatest nesting depth of every page."""
    return pages(spark, root).select("doc_id", M.nesting_depth(F.col("raw"), M.HTML.void).alias("depth"))


@query(rf"""SELECT doc_id, CAST((length(h) - length(replace(h, '\x0A', ''))) / 4 + 1 AS INT) AS line FROM (SELECT doc_id, substr(raw, 1, instr(raw, '<p>') - 1) AS h FROM {RAW} WHERE instr(raw, '<p>') > 0)""")
def t19_line_of(spark, root):
    """Line of the first paragraph tag."""
    at = F.instr("raw", F.lit("<p>"))
    return pages(spark, root).where(at > 0).select("doc_id", M.line_of(F.col("raw"), at - 1).alias("line"))


@query(f"""SELECT doc_id, CAST(len(list_filter(list_distinct(list_transform(regexp_extract_all(raw, '<([A-Za-z][A-Za-z0-9]*)', 1), lambda t: upper(t))), lambda t: t NOT IN ('HTML', 'HEAD', 'BODY', 'TITLE', 'META', 'P', 'A', 'UL', 'LI', 'DIV', 'H1'))) AS INT) AS n FROM {RAW}""")
def j20_unknown_tags(spark, root):
    """Number of tags that aren't among the usual ones."""
    known = ["html", "head", "body", "title", "meta", "p", "a", "ul", "li", "div", "h1"]
    return pages(spark, root).select("doc_id", F.size(R.unknown_tags(F.col("raw"), known)).alias("n"))


@query()
def f02_resolved_entities(spark, root):
    """Length of the pages once their entities are resolved."""
    return pages(spark, root).select("doc_id", F.length(E.resolve_entities(F.col("raw"), E.entity_map())).alias("n"))


@query()
def t11_well_formed(spark, root):
    """Whether the marked-up paragraphs are well-formed by themselves."""
    return paras(spark, root, "sgml").select("para_id", xml_ok("text").alias("ok"))


@query(f"""SELECT doc_id, tag, opens, closes FROM (SELECT doc_id, tag, CAST(count(*) FILTER (WHERE NOT closing) AS BIGINT) AS opens, CAST(count(*) FILTER (WHERE closing) AS BIGINT) AS closes FROM (
  SELECT doc_id, lower(replace(t, '/', '')) AS tag, t LIKE '/%' AS closing FROM (SELECT doc_id, unnest(regexp_extract_all(raw, '<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM {RAW})) GROUP BY ALL)
  WHERE tag IN ('html', 'body', 'p', 'li', 'ul', 'a', 'div', 'h1') AND opens <> closes""")
def x_c18_balance(spark, root):
    """Tags that don't open as often as they close."""
    return R.tag_balance(pages(spark, root), ("html", "body", "p", "li", "ul", "a", "div", "h1"))


# --- text functions -----------------------------------------------------------


@query(rf"""SELECT para_id, md5({SQUEEZE("replace(translate(lower(nfc_normalize(text)), '“”‘’–' || chr(160), chr(34) || chr(34) || chr(39) || chr(39) || '- '), '—', '--')")}) AS digest FROM {P('sgml')}""")
def f04_loose_norm(spark, root):
    """Digest of each paragraph's loose form."""
    return paras(spark, root, "sgml").select("para_id", F.md5(T.loose_norm(F.col("text"), nfc)).alias("digest"))


@query(rf"""SELECT para_id, md5(regexp_replace(regexp_replace({SQUEEZE("lower(translate(nfc_normalize(text), '“”‘’—–' || chr(160) || chr(8209) || chr(8722), chr(34) || chr(34) || chr(39) || chr(39) || '-- --'))")}, '([\p{{L}}\p{{N}}_]-) ([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '([\p{{L}}\p{{N}}_]) ([;:,.])', '\1\2', 'g')) AS digest FROM {P('sgml')}""")
def f06_strict_norm(spark, root):
    """Digest of each paragraph's strict form."""
    return paras(spark, root, "sgml").select("para_id", F.md5(T.strict_norm(F.col("text"), nfc)).alias("digest"))


@query(f"SELECT para_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM {P('pdf_l4')}")
def f08_plain_words(spark, root):
    """Digest of each merged paragraph's letters and digits."""
    return paras(spark, root, "pdf_l4").select("para_id", F.md5(T.plain_words_text(F.col("text"))).alias("digest"))


BARE = lambda x: f"trim(ltrim({x}, ' -–—'))"
FIRST = lambda x: f"string_split({x}, ' ')[1]"
NEXT = lambda x: f"array_to_string(string_split({x}, ' ')[2:], ' ')"
LABELLED = "['part', 'section', 'article', 'chapter', 'subsection', 'division', 'appendix', 'annex', 'schedule', 'exhibit']"
# By words: a label takes the letters and digits of the next word along.
STRIPPED = lambda x: f"""CASE WHEN list_contains({LABELLED}, lower({FIRST(x)})) AND regexp_matches({NEXT(x)}, '^ *[A-Za-z0-9]') THEN {BARE("regexp_replace(" + NEXT(x) + ", '^ *[A-Za-z0-9]+[ .–—-]*', '')")}
  WHEN ascii({x}) BETWEEN 48 AND 57 THEN {BARE(f"ltrim({x}, '0123456789.')")}
  WHEN {x} LIKE '% %' AND length(replace({FIRST(x)}, '.', '')) BETWEEN 1 AND length({FIRST(x)}) AND {FIRST(x)} NOT LIKE '%.%_' AND {FIRST(x)} NOT LIKE '%..' AND list_has_all(['i', 'v', 'x'], string_split(lower(replace({FIRST(x)}, '.', '')), '')) THEN {BARE(NEXT(x))}
  ELSE {BARE(x)} END"""  # noqa: E731
STRIP = lambda x: f"(CASE WHEN {STRIPPED(x)} = '' THEN {x} ELSE {STRIPPED(x)} END)"


@query(f"SELECT heading_id, {STRIP('text')} AS bare FROM {H('sgml')}")
def f09_heading_prefix(spark, root):
    """Headings without their leading labels."""
    return heads(spark, root, "sgml").select("heading_id", T.strip_heading_prefix(F.col("text")).alias("bare"))


@query("""SELECT a.doc_number AS a, b.doc_number AS b FROM instruments a JOIN instruments b ON split_part(a.doc_number, '-', 1) = split_part(b.doc_number, '-', 1) AND a.doc_number < b.doc_number
  WHERE list_sort(string_split(split_part(a.doc_number, '-', 2), '')) = list_sort(string_split(split_part(b.doc_number, '-', 2), ''))
     OR hamming(split_part(a.doc_number, '-', 2), split_part(b.doc_number, '-', 2)) = 1""")
def f13_near_numbers(spark, root):
    """Reference numbers of one prefix that are a digit or a turn apart."""
    n = table(spark, root, "instruments").select("doc_number")
    part = lambda c, k: F.split_part(F.col(c), F.lit("-"), F.lit(k))
    a, b = n.select(F.col("doc_number").alias("a")).withColumn("p", part("a", 1)), n.select(F.col("doc_number").alias("b")).withColumn("p", part("b", 1))
    return a.join(b, "p").where((F.col("a") < F.col("b")) & T.near_number(part("a", 2), part("b", 2))).select("a", "b")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(lower(trim(url)), '^(?:https?://)?(?:www\.)?', ''), '[/.,;:)]+$', '') AS url FROM documents""")
def f14_url_norm(spark, root):
    """Addresses in their normal form."""
    return table(spark, root, "documents").select("doc_id", T.norm_url(F.col("url")).alias("url"))


@query(rf"""SELECT para_id, CAST(length(t) - length(replace(t, chr(1), '')) + 1 AS INT) AS n FROM (SELECT para_id, regexp_replace(text, '([.;!?])\s+([A-Z"(“])', '\1' || chr(1) || '\2', 'g') AS t FROM {P('sgml')})""")
def f17_sentences(spark, root):
    """Number of sentences by the plain split."""
    return paras(spark, root, "sgml").select("para_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query(rf"""SELECT para_id, CAST(len(list_filter(string_split(t, chr(1)), lambda x: trim(x) <> '')) AS INT) AS n FROM (SELECT para_id, regexp_replace(regexp_replace(regexp_replace(text, ';\s+', chr(1), 'g'), '\s+(\([a-z0-9]{{1,3}}\)\s)', chr(1) || '\1', 'g'), '\s*[•▪◦]\s*', chr(1), 'g') AS t FROM {P('sgml')})""")
def f18_bullets(spark, root):
    """Number of items of each paragraph's enumeration."""
    return paras(spark, root, "sgml").select("para_id", F.size(T.bullets(F.col("text"))).alias("n"))


CONTENT = r"list_filter(regexp_extract_all(lower(text), '([a-z\x{e0}-\x{ff}0-9]+)', 1), lambda w: length(w) > 2 AND NOT list_contains(string_split('the a an of and or to in for is are by with that this it its as at on be was has have had will shall may must not any all each no if where who which', ' '), w))"


@query(f"SELECT para_id, CAST(len({CONTENT}) AS INT) AS n, CAST(len(list_distinct({CONTENT})) AS INT) AS kinds FROM {P('pdf_l4')}")
def f19_content_words(spark, root):
    """Content words and different ones."""
    w = T.content_words(F.col("text"))
    return paras(spark, root, "pdf_l4").select("para_id", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds"))


@query(f"""SELECT heading_id, CASE WHEN len(w) > 0 THEN round(CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) AS DOUBLE) / len(w), 6) ELSE 0.0 END AS ratio, regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]') AS caps
  FROM (SELECT heading_id, text, list_filter(string_split({SQUEEZE('text')}, ' '), lambda x: length(x) >= 4) AS w FROM {H('pdf_l4')})""")
def f20_capitals(spark, root):
    """Share of capitalised words, and whether a heading is all capitals."""
    return heads(spark, root, "pdf_l4").select("heading_id", F.round(T.title_case_ratio(F.col("text")), 6).alias("ratio"), T.all_caps(F.col("text")).alias("caps"))


@query("""SELECT DISTINCT doc_id, CAST(coalesce(try_strptime(adddate, '%Y%m%d'), try_strptime(adddate, '%Y-%m-%d')) AS DATE) AS added FROM sgml_content""")
def f23_dates(spark, root):
    """Dates in either form."""
    return table(spark, root, "sgml_content").select("doc_id", T.stamp_date(F.col("adddate")).alias("added")).distinct()


@query()
def f12_seq_ratio(spark, root):
    """Similarity of the headings that stand in one place on both sides."""
    a = heads(spark, root, "sgml").select("doc_id", "idx", F.col("text").alias("a"))
    b = heads(spark, root, "pdf_l4").select("doc_id", "idx", F.col("text").alias("b"))
    return a.join(b, ["doc_id", "idx"]).select("doc_id", "idx", F.round(seq_ratio("a", "b"), 6).alias("ratio"))


# --- layout --------------------------------------------------------------------


@query(rf"""SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches(trim(text), '^[0-9]{{1,4}}$')) AS BIGINT) AS numbers, CAST(count(*) FILTER (WHERE regexp_matches(text, '^[0-9]{{1,3}}\s+\S')) AS BIGINT) AS notes FROM {P('pdf_l1')} GROUP BY doc_id""")
def l03_line_kinds(spark, root):
    """Page numbers and note lines of every filing."""
    return paras(spark, root, "pdf_l1").groupBy("doc_id").agg(
        F.count_if(L.is_page_number(F.col("text"))).alias("numbers"), F.count_if(L.is_footnote_line(F.col("text"))).alias("notes")
    )


RUN = lambda n, share, least: f"""WITH l AS (SELECT doc_id, page, {SQUEEZE('lower(text)')} AS norm FROM {P('pdf_l1')}), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY doc_id)
  SELECT doc_id, norm, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, norm, {n} AS n FROM l GROUP BY ALL) JOIN p USING (doc_id) WHERE n >= greatest({least}, pages * {share})"""  # noqa: E731


@query(RUN("count(DISTINCT page)", 0.4, 2.0))
def l05_running_by_pages(spark, root):
    """Running heads by the pages that show them."""
    return L.running_lines(paras(spark, root, "pdf_l1"))


@query(RUN("count(*)", 0.5, 3.0))
def l06_running_by_count(spark, root):
    """Running heads by how often they occur."""
    return L.running_lines(paras(spark, root, "pdf_l1"), by="occurrences", share=0.5, least=3)


@query("""SELECT doc_id, v[len(v) // 2 + 1] AS median FROM (SELECT doc_id, list_sort(list(n_words)) AS v FROM (SELECT DISTINCT para_id, doc_id, n_words FROM paragraphs WHERE side = 'pdf_l1' AND n_words IS NOT NULL) GROUP BY doc_id)""")
def l07_upper_median(spark, root):
    """Upper median of the words of a filing's lines."""
    rows = table(spark, root, "paragraphs").where("side = 'pdf_l1'").select("para_id", "doc_id", "n_words").dropDuplicates(["para_id"])
    return L.upper_median(rows, ["doc_id"], "n_words")


@query("""SELECT doc_id, n_words AS mode, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, n_words, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, n_words) AS k
  FROM (SELECT DISTINCT para_id, doc_id, n_words FROM paragraphs WHERE side = 'pdf_l1' AND n_words IS NOT NULL) GROUP BY doc_id, n_words) WHERE k = 1""")
def l08_mode(spark, root):
    """Most frequent number of words of a filing's lines."""
    rows = table(spark, root, "paragraphs").where("side = 'pdf_l1'").select("para_id", "doc_id", "n_words").dropDuplicates(["para_id"])
    return L.modal_value(rows, ["doc_id"], "n_words")


@query()
def l12_distinct_headings(spark, root):
    """Headings without near copies."""
    return L.distinct_headings(heads(spark, root, "pdf_l4")).select("doc_id", F.posexplode("headings").alias("ord", "text"))


@query()
def l16_line_merge(spark, root):
    """Printed lines merged into paragraphs."""
    return L.paragraphs_from_lines(paras(spark, root, "pdf_l1"))


@query("""SELECT DISTINCT doc_id, CASE WHEN length(regexp_replace(first_page_text, '[^éèêàâùûîôçœÉÈÊÀÂÙÛÎÔÇŒ]', '', 'g')) > 5 THEN 'FR' ELSE 'EN' END AS hint FROM pdf_data""")
def l19_language_hint(spark, root):
    """Language hint by French letters."""
    return table(spark, root, "pdf_data").select("doc_id", T.language_hint(F.col("first_page_text")).alias("hint")).distinct()


@query(rf"""WITH w AS (SELECT doc_id, label, unnest(string_split({SQUEEZE('label')}, ' ')) AS w, generate_subscripts(string_split({SQUEEZE('label')}, ' '), 1) AS i FROM (SELECT DISTINCT doc_id, label FROM sgml_content)),
  n AS (SELECT *, regexp_extract(lag(w) OVER o, '[\p{{L}}\p{{N}}_]+$') AS p, lag(w) OVER o AS full_p, regexp_extract(lag(w, 2) OVER o, '[\p{{L}}\p{{N}}_]+$') AS pp, regexp_extract(w, '^[0-9]{{2}}-[0-9]{{3}}\b') AS num FROM w WINDOW o AS (PARTITION BY doc_id, label ORDER BY i)),
  k AS (SELECT *, CASE WHEN lower(p) IN ('ni', 'mi', 'csa', 'osc', 'msc', 'asc', 'bcsc', 'amf') THEN 1 WHEN lower(full_p) = 'instrument' AND lower(pp) IN ('national', 'multilateral') THEN 2
    WHEN lower(p) IN ('rule', 'policy', 'notice', 'bulletin', 'guideline') THEN 3 END AS kind FROM n WHERE num <> ''),
  b AS (SELECT doc_id, label, CASE WHEN kind = 2 THEN pp || ' ' || p ELSE p END || ' ' || num AS said FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY kind, i) = 1)
  SELECT DISTINCT d.doc_id, coalesce(b.said, nullif(regexp_extract({SQUEEZE('d.label')}, '\b[0-9]{{2}}-[0-9]{{3}}\b'), '')) AS number FROM sgml_content d LEFT JOIN b ON d.doc_id = b.doc_id AND d.label IS NOT DISTINCT FROM b.label""")
def l20_reference_number(spark, root):
    """Reference number in a filing's label."""
    return table(spark, root, "sgml_content").select("doc_id", T.number_reference(F.col("label")).alias("number")).distinct()


# Month names by number, English, shortened and French; longer ones first.
MONTH_NAMES = "january february march april may june july august september october november december jan feb mar apr - jun jul aug sep oct nov dec janvier février mars avril mai juin juillet août septembre octobre novembre décembre"
NAMED = "|".join(sorted((n for n in MONTH_NAMES.split() if n != "-"), key=len, reverse=True))
MONTH_OF = lambda x: f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN CAST({x} AS INT) ELSE (list_position(string_split('{MONTH_NAMES}', ' '), lower({x})) - 1) % 12 + 1 END"
DATE_OF = lambda p, y, m, d: f"CASE WHEN regexp_matches(t, '{p}') THEN TRY_CAST(regexp_extract(t, '{p}', {y}) || '-' || lpad(CAST({MONTH_OF(f"regexp_extract(t, '{p}', {m})")} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(t, '{p}', {d}), 2, '0') AS DATE) END".replace("{{", "{").replace("}}", "}")


@query(rf"""SELECT DISTINCT doc_id, coalesce({DATE_OF("(?i)\\b(" + NAMED + ") ([0-9]{{1,2}}),? ([0-9]{{4}})\\b", 3, 1, 2)}, {DATE_OF("(?i)\\b([0-9]{{1,2}}) (" + NAMED + ") ([0-9]{{4}})\\b", 3, 2, 1)}, {DATE_OF("\\b([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})\\b", 1, 2, 3)}, {DATE_OF("(?i)\\bdate: ?([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})\\b", 1, 2, 3)}) AS date FROM (SELECT doc_id, {SQUEEZE('first_page_text')} AS t FROM pdf_data)""")
def l21_text_date(spark, root):
    """First date of a filing's first page."""
    return table(spark, root, "pdf_data").select("doc_id", T.text_date(F.col("first_page_text")).alias("date")).distinct()


# --- comparison ------------------------------------------------------------------


GRAMS = lambda n: f"list_distinct(list_transform(range(1, len(w) - {n - 1} + 1), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')))"


@query(f"""WITH p AS (SELECT doc_id, para_id, {WORDS} AS w FROM {P('pdf_l4')}), q AS (SELECT doc_id, {WORDS} AS w FROM {P('sgml')}),
  s AS (SELECT doc_id, para_id, unnest(CASE WHEN len(w) >= 5 THEN {GRAMS(5)} ELSE [array_to_string(w, ' ')] END) AS g FROM p WHERE len(w) > 0),
  t AS (SELECT DISTINCT doc_id, unnest({GRAMS(5)}) AS g FROM q WHERE len(w) >= 5 UNION SELECT DISTINCT doc_id, g FROM (SELECT DISTINCT s.doc_id, s.g, q.w FROM s JOIN q USING (doc_id) WHERE len(string_split(s.g, ' ')) < 5)
    WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || g || ' '))
  SELECT s.doc_id, para_id, CAST(count(*) AS BIGINT) AS grams, CAST(count(t.g) AS BIGINT) AS hits, round(CAST(count(t.g) AS DOUBLE) / count(*), 6) AS coverage FROM s LEFT JOIN t ON s.doc_id = t.doc_id AND s.g = t.g GROUP BY ALL""")
def j01_coverage(spark, root):
    """Share of each printed paragraph's 5-grams that the marked-up text has."""
    c = J.gram_coverage(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), plain())
    return c.withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH s AS (SELECT doc_id, para_id, unnest(range(1, len(w) - 14 + 1, 8)) AS k, w FROM (SELECT doc_id, para_id, {WORDS} AS w FROM {P('pdf_l4')}) WHERE len(w) >= 15),
  e AS (SELECT doc_id, para_id, k, unnest(list_slice(w, k, k + 14)) AS x FROM s), t AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS x FROM {P('sgml')}),
  c AS (SELECT e.doc_id, para_id, k, CAST(count(t.x) AS DOUBLE) / count(*) AS c FROM e LEFT JOIN t ON e.doc_id = t.doc_id AND e.x = t.x GROUP BY ALL)
  SELECT doc_id, para_id, CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE c >= 0.6) AS BIGINT) AS covered FROM c GROUP BY ALL""")
def j02_window_coverage(spark, root):
    """Sliding windows of the printed paragraphs that the marked-up text covers."""
    return J.window_coverage(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), plain())


HW = lambda x: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda q: q <> ''))"
JAC = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


@query(f"""WITH a AS (SELECT doc_id, heading_id, {HW('text')} AS r, {HW(STRIP('text'))} AS s FROM {H('sgml')}), b AS (SELECT doc_id, heading_id, {HW('text')} AS r, {HW(STRIP('text'))} AS s FROM {H('pdf_l4')}),
  p AS (SELECT a.doc_id, a.heading_id AS i, b.heading_id AS k, greatest({JAC('a.r', 'b.r')}, {JAC('a.r', 'b.s')}, {JAC('a.s', 'b.r')}, {JAC('a.s', 'b.s')}) AS v FROM a JOIN b USING (doc_id)),
  f AS (SELECT doc_id, avg(CASE WHEN coalesce(v, 0) >= 0.5 THEN 1.0 ELSE 0.0 END) AS x FROM (SELECT a.doc_id, heading_id, v FROM a LEFT JOIN (SELECT i, max(v) AS v FROM p GROUP BY i) ON heading_id = i) GROUP BY doc_id),
  g AS (SELECT doc_id, avg(CASE WHEN coalesce(v, 0) >= 0.5 THEN 1.0 ELSE 0.0 END) AS x FROM (SELECT b.doc_id, heading_id, v FROM b LEFT JOIN (SELECT k, max(v) AS v FROM p GROUP BY k) ON heading_id = k) GROUP BY doc_id)
  SELECT doc_id, round(coalesce(f.x, 0.0), 6) AS forward, round(coalesce(g.x, 0.0), 6) AS backward, round(greatest(coalesce(f.x, 0.0), coalesce(g.x, 0.0)), 6) AS ratio FROM f FULL JOIN g USING (doc_id)""")
def j03_heading_match(spark, root):
    """Headings found on the other side, both ways."""
    m = J.heading_match(heads(spark, root, "sgml"), heads(spark, root, "pdf_l4"))
    return m.select("doc_id", *[F.round(c, 6).alias(c) for c in ("forward", "backward", "ratio")])


@query(f"""WITH s AS (SELECT doc_id, para_id, list_distinct({CONTENT}) AS w FROM {P('pdf_l4')}), t AS (SELECT doc_id, para_id AS other, list_distinct({CONTENT}) AS w FROM {P('sgml')}),
  c AS (SELECT s.doc_id, para_id, other, CAST(len(list_intersect(s.w, t.w)) AS DOUBLE) / greatest(len(s.w), len(t.w)) AS score FROM s JOIN t USING (doc_id) WHERE len(list_intersect(s.w, t.w)) > 0)
  SELECT doc_id, para_id, other, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY score DESC, other) AS k FROM c) WHERE k = 1""")
def j07_pairs(spark, root):
    """Marked-up paragraph that fits each printed one best."""
    p = J.pair_texts(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), T.content_words(F.col("text")))
    return p.withColumn("score", F.round("score", 6))


AMOUNT = r"([0-9]{1,3}(?:[.,][0-9]+)+)"


@query(rf"""WITH s AS (SELECT doc_id, k, min(i) AS item FROM (SELECT doc_id, i, lower(regexp_replace(i, '[\s().+-]', '', 'g')) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{AMOUNT}', 1)) AS i FROM {P('pdf_l4')})) GROUP BY ALL),
  t AS (SELECT doc_id, lower(regexp_replace(i, '[\s().+-]', '', 'g')) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{AMOUNT}', 1)) AS i FROM {P('sgml')}))
  SELECT doc_id, item FROM s ANTI JOIN t USING (doc_id, k)""")
def j09_missing_items(spark, root):
    """Amounts of the printed side that the marked-up side lacks."""
    return J.missing_items(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), F.regexp_extract_all("text", F.lit(AMOUNT), F.lit(1)))


@query(r"""WITH u AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(https?://[^\s)]+)', 1)) AS url FROM documents) SELECT doc_id, url FROM u ANTI JOIN (SELECT DISTINCT host FROM documents) h ON split_part(split_part(url, '//', 2), '/', 1) = h.host""")
def j10_foreign_links(spark, root):
    """Links to hosts that no page of the crawl is from."""
    d = table(spark, root, "documents")
    u = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(https?://[^\s)]+)"), F.lit(1))).alias("url")).distinct()
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return u.withColumn("host", host).join(d.select("host").distinct(), "host", "left_anti").select("doc_id", "url")


@query(f"""WITH i AS (SELECT doc_id, heading_id, unnest(list_distinct({CONTENT})) AS w FROM {H('pdf_l4')}), p AS (SELECT DISTINCT doc_id, unnest({CONTENT}) AS w FROM {P('sgml')})
  SELECT i.doc_id, heading_id, round(CAST(count(p.w) AS DOUBLE) / count(*), 6) AS coverage FROM i LEFT JOIN p ON i.doc_id = p.doc_id AND i.w = p.w GROUP BY ALL""")
def j11_pool_coverage(spark, root):
    """Share of a heading's words that the filing's paragraphs use."""
    w = T.content_words(F.col("text"))
    c = J.pool_coverage(heads(spark, root, "pdf_l4"), paras(spark, root, "sgml"), w, w)
    return c.withColumn("coverage", F.round("coverage", 6))


@query(f"""SELECT heading_id, doc_id FROM {H('sgml')} a WHERE NOT EXISTS (SELECT 1 FROM {H('pdf_l4')} b WHERE b.doc_id = a.doc_id AND (contains(lower(b.text), lower(a.text)) OR contains(lower(a.text), lower(b.text))))""")
def j12_absent_headings(spark, root):
    """Headings that the other side has in no form."""
    return J.not_contained(heads(spark, root, "sgml"), heads(spark, root, "pdf_l4")).select("heading_id", "doc_id")


YEAR = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)"
DELTA = f"""s AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{YEAR}', 1)) AS token FROM {P('pdf_l4')}) GROUP BY ALL), t AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{YEAR}', 1)) AS token FROM {P('sgml')}) GROUP BY ALL),
  d AS (SELECT doc_id, token, CAST(coalesce(s.n, 0) AS BIGINT) AS n_source, CAST(coalesce(t.n, 0) AS BIGINT) AS n_target FROM s FULL JOIN t USING (doc_id, token) WHERE coalesce(s.n, 0) <> coalesce(t.n, 0))"""


def year_delta(spark, root):
    return J.multiset_delta(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), F.regexp_extract_all("text", F.lit(YEAR), F.lit(1)))


@query(f"WITH {DELTA} SELECT * FROM d")
def j13_multiset_delta(spark, root):
    """Years that the two sides have in different numbers."""
    return year_delta(spark, root)


@query()
def j13_substitutions(spark, root):
    """Reference numbers that were probably swapped for a near one: those of each
    jurisdiction against the same with their last figures turned."""
    n = table(spark, root, "instruments").where("doc_number IS NOT NULL").select(F.col("jurisdiction").alias("doc_id"), F.col("doc_number").alias("text"))
    turned = n.select("doc_id", F.concat(F.left("text", F.length("text") - 2), F.reverse(F.right("text", F.lit(2)))).alias("text"))
    return J.number_substitutions(J.multiset_delta(n, turned, F.regexp_extract_all("text", F.lit(r"\b([0-9]{2}-[0-9]{3})\b"), F.lit(1))), "string")


@query(f"""WITH {DELTA} SELECT a.doc_id, CAST(a.token AS DOUBLE) AS source_value, min(CAST(b.token AS DOUBLE)) AS target_value FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.n_source > a.n_target AND b.n_target > b.n_source
  AND abs(CAST(a.token AS DOUBLE) - CAST(b.token AS DOUBLE)) <= 20 GROUP BY ALL""")
def j14_close_years(spark, root):
    """Years that may stand for a near one of the other side."""
    return J.close_values(year_delta(spark, root), 20.0)


DECIMAL = r"\b([0-9]+\.[0-9]+)\b"


@query(f"""WITH {DELTA.replace(YEAR, DECIMAL)} SELECT a.doc_id, CAST(a.token AS DOUBLE) AS source_value, min(CAST(b.token AS DOUBLE)) AS target_value FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.n_source > a.n_target AND b.n_target > b.n_source
  AND abs(CAST(a.token AS DOUBLE) - CAST(b.token AS DOUBLE)) <= 1.0 GROUP BY ALL""")
def j14_close_decimals(spark, root):
    """Decimal numbers that may stand for a near one of the other side."""
    number = F.regexp_extract_all("text", F.lit(DECIMAL), F.lit(1))
    return J.close_values(J.multiset_delta(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), number), 1.0)


@query(f"""SELECT doc_id, idx, a.text AS a_value, b.text AS b_value FROM {H('sgml')} a JOIN {H('pdf_l4')} b USING (doc_id, idx) WHERE a.text IS DISTINCT FROM b.text""")
def j17_positions(spark, root):
    """Headings that differ place by place."""
    return J.positional_differences(heads(spark, root, "sgml"), heads(spark, root, "pdf_l4"), ["doc_id", "idx"], "text")


@query(f"""SELECT h.doc_id, min(p.idx) AS line FROM (SELECT DISTINCT doc_id, doc_title AS text FROM sgml_content) h JOIN {P('pdf_l1')} p USING (doc_id) WHERE len(string_split({SQUEEZE('h.text')}, ' ')) >= 2 AND contains({SQUEEZE('lower(p.text)')}, {SQUEEZE('lower(h.text)')}) GROUP BY ALL""")
def j27_locate(spark, root):
    """First printed line that holds the filing's title."""
    t = table(spark, root, "sgml_content").select("doc_id", F.col("doc_title").alias("text")).distinct().withColumn("k", F.col("doc_id"))
    return J.locate(t, paras(spark, root, "pdf_l1"), key="k").select("doc_id", "line")


@query(f"""SELECT a.heading_id, CASE WHEN EXISTS (SELECT 1 FROM {H('pdf_l4')} b WHERE b.doc_id = a.doc_id AND lower(b.text) = lower(a.text)) THEN 'same'
  WHEN EXISTS (SELECT 1 FROM {H('pdf_l4')} b WHERE b.doc_id = a.doc_id AND (contains(lower(b.text), lower(a.text)) OR contains(lower(a.text), lower(b.text)))) THEN 'part'
  WHEN EXISTS (SELECT 1 FROM {P('pdf_l1')} b WHERE b.doc_id = a.doc_id AND contains(lower(b.text), lower(a.text))) THEN 'line' END AS found_by FROM {H('sgml')} a""")
def j04_cascade(spark, root):
    """How the headings of the marked-up side are found on the printed one."""
    b = heads(spark, root, "pdf_l4")
    return J.cascade(heads(spark, root, "sgml"), [("same", b, "equal"), ("part", b, "either"), ("line", paras(spark, root, "pdf_l1"), "within")]).select("heading_id", "found_by")


@query()
def d8_word_gaps(spark, root):
    """Words lost, added or replaced between paired paragraphs."""
    return J.word_gaps(paired(spark, root)).select("para_id", F.explode("gaps").alias("g")).select("para_id", "g.kind", "g.source", "g.target")


def paired(spark, root):
    """Printed paragraphs with the marked-up one that fits best."""
    p = J.pair_texts(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), T.content_words(F.col("text"))).select("para_id", "other")
    s = paras(spark, root, "pdf_l4").select("para_id", F.col("text").alias("source_text"))
    t = paras(spark, root, "sgml").select(F.col("para_id").alias("other"), F.col("text").alias("target_text"))
    return p.join(s, "para_id").join(t, "other")


@query()
def g0_judged_pairs(spark, root):
    """Paired paragraphs as the offline judge sees them."""
    return judge_pairs(paired(spark, root).select("para_id", "source_text", "target_text"), OfflineJudge()).select("para_id", F.round("agreement", 6).alias("agreement"))


@query()
def t17_guided_split(spark, root):
    """Printed paragraph at which each heading of the marked-up side begins."""
    return J.guided_split(heads(spark, root, "sgml"), paras(spark, root, "pdf_l4"))


@query(f"""WITH w AS (SELECT doc_id, para_id, {WORDS} AS w FROM {P('pdf_l4')}), l AS (SELECT * FROM w WHERE len(w) >= 15), x AS (SELECT doc_id, {WORDS} AS w FROM {P('sgml')}), t AS (SELECT DISTINCT doc_id, unnest({GRAMS(6)}) AS g FROM x WHERE len(w) >= 6),
  lost AS (SELECT doc_id, para_id, array_to_string(list_slice(w, 1, 6), ' ') AS g FROM l), r AS (SELECT doc_id, para_id, unnest(list_distinct(list_filter(list_slice(w, 7, 100006), lambda q: length(q) >= 4))) AS q FROM l), v AS (SELECT DISTINCT doc_id, unnest(w) AS q FROM x),
  kept AS (SELECT r.doc_id, para_id FROM r LEFT JOIN v ON r.doc_id = v.doc_id AND r.q = v.q GROUP BY ALL HAVING CAST(count(v.q) AS DOUBLE) / count(*) >= 0.65)
  SELECT doc_id, para_id FROM (SELECT doc_id, para_id FROM lost ANTI JOIN t USING (doc_id, g)) SEMI JOIN kept USING (doc_id, para_id)""")
def g9_truncated_heads(spark, root):
    """Printed paragraphs whose beginning the marked-up side lacks."""
    return J.truncated_heads(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), plain())


@query(rf"""WITH s AS (SELECT doc_id, para_id, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS no FROM (SELECT doc_id, para_id, string_split(regexp_replace(text, '([.;!?])\s+([A-Z"(“])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS x FROM {P('pdf_l4')})),
  g AS (SELECT doc_id, para_id, no, unnest({GRAMS(3)}) AS g FROM (SELECT doc_id, para_id, no, {CONTENT} AS w FROM s) WHERE len(w) >= 3), t AS (SELECT DISTINCT doc_id, unnest({GRAMS(3)}) AS g FROM (SELECT doc_id, {CONTENT} AS w FROM {P('sgml')}) WHERE len(w) >= 3),
  c AS (SELECT para_id, no, CAST(count(t.g) AS DOUBLE) / count(*) AS coverage FROM g LEFT JOIN t ON g.doc_id = t.doc_id AND g.g = t.g GROUP BY ALL),
  n AS (SELECT *, lag(coverage) OVER w AS prev, lead(coverage) OVER w AS next, row_number() OVER w AS k, count(*) OVER (PARTITION BY para_id) AS n FROM c WINDOW w AS (PARTITION BY para_id ORDER BY no))
  SELECT para_id, CAST(no AS INT) AS no, coverage, CASE WHEN k = 1 THEN 'first' WHEN k = n THEN 'last' ELSE k || ' of ' || n END AS place FROM n WHERE coverage < 0.1 AND greatest(coalesce(prev, 0), coalesce(next, 0)) >= 0.5""")
def g15_lost_sentences(spark, root):
    """Sentences that are lost while their neighbours are there."""
    s = paras(spark, root, "pdf_l4").select("doc_id", "para_id", F.posexplode(T.sentences(F.col("text"))).alias("no", "text")).withColumn("key", F.struct("para_id", "no"))
    w = T.content_words(F.col("text"))
    c = J.gram_coverage(s, paras(spark, root, "sgml"), w, n=3, key="key", short_texts=False)
    return J.confirmed_missing(c.select("key.para_id", "key.no", "coverage"))


# --- order -------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT doc_id, a.idx AS i, min(b.idx) AS j FROM {H('sgml')} a JOIN {H('pdf_l4')} b USING (doc_id, text) GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id),
  v AS (SELECT x.doc_id, count(*) AS v FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.i < y.i AND x.j > y.j GROUP BY ALL)
  SELECT doc_id, CAST(n AS INT) AS matched, CAST(coalesce(v, 0) AS BIGINT) AS inverted, CASE WHEN n > 1 THEN round(coalesce(v, 0) / (n * (n - 1) / 2.0), 6) ELSE 0.0 END AS ratio FROM n LEFT JOIN v USING (doc_id)""")
def w01_inversions(spark, root):
    """Headings in another order on the two sides."""
    a, b = heads(spark, root, "sgml"), heads(spark, root, "pdf_l4")
    m = a.select("doc_id", "text", F.col("idx").alias("a")).join(b.select("doc_id", "text", F.col("idx").alias("b")), ["doc_id", "text"]).groupBy("doc_id", "a").agg(F.min("b").alias("b"))
    return J.inversions(m).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH s AS (SELECT doc_id, idx AS a, array_to_string(list_slice(w, 1, 8), ' ') AS f FROM (SELECT doc_id, idx, {WORDS} AS w FROM {P('pdf_l4')}) WHERE len(w) >= 8),
  t AS (SELECT doc_id, f, min(idx) AS b FROM (SELECT doc_id, idx, array_to_string(list_slice(w, 1, 8), ' ') AS f FROM (SELECT doc_id, idx, {WORDS} AS w FROM {P('sgml')}) WHERE len(w) >= 8) GROUP BY ALL) SELECT doc_id, a, b FROM s JOIN t USING (doc_id, f)""")
def w02_fingerprints(spark, root):
    """Places of paragraphs that begin alike."""
    return J.fingerprint_places(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), plain())


@query(rf"""SELECT para_id, CAST(len(l) AS INT) AS labels, CAST(len(list_filter(range(2, len(l) + 1), lambda i: l[i] < l[i - 1])) AS INT) AS descents FROM (SELECT para_id, regexp_extract_all(text, '\(([a-z])\)', 1) AS l FROM {P('sgml')}) WHERE len(l) > 0""")
def w03_label_descents(spark, root):
    """Lettered items out of order."""
    return J.label_descents(paras(spark, root, "sgml"), ["para_id"])


@query("""WITH d AS (SELECT DISTINCT doc_id, doc_number, CAST(coalesce(try_strptime(adddate, '%Y%m%d'), try_strptime(adddate, '%Y-%m-%d')) AS DATE) AS added FROM sgml_content WHERE doc_number IS NOT NULL)
  SELECT doc_number, doc_id, added, next_added FROM (SELECT *, lead(added) OVER (PARTITION BY doc_number ORDER BY doc_id, added) AS next_added FROM d) WHERE next_added < added""")
def w04_adjacent_dates(spark, root):
    """Filings of one number whose successor is older."""
    d = table(spark, root, "sgml_content").where("doc_number IS NOT NULL").select("doc_id", "doc_number", T.stamp_date(F.col("adddate")).alias("added")).distinct()
    return A.falling_dates(d, "doc_number", ["doc_id", "added"], "added", F.expr("doc_id div 10000")).select("doc_number", "doc_id", "added", "next_added")


@query("""SELECT prefix, n, next_n FROM (SELECT prefix, n, lead(n) OVER (PARTITION BY prefix ORDER BY n) AS next_n FROM (SELECT DISTINCT split_part(doc_number, '-', 1) AS prefix, CAST(split_part(doc_number, '-', 2) AS INT) AS n FROM instruments)) WHERE next_n - n > 100""")
def w05_gaps(spark, root):
    """Gaps of more than a hundred in the instruments' numbers."""
    n = table(spark, root, "instruments").select(F.split_part("doc_number", F.lit("-"), F.lit(1)).alias("prefix"), F.split_part("doc_number", F.lit("-"), F.lit(2)).cast("int").alias("n"))
    return A.number_gaps(n, "prefix", "n", 100)


@query("""SELECT decision_id, sgml_file, CAST(k AS INT) AS k FROM (SELECT decision_id, sgml_file, row_number() OVER (PARTITION BY upper(sgml_file) ORDER BY decision_id) AS k FROM (SELECT DISTINCT decision_id, sgml_file FROM decisions WHERE sgml_file IS NOT NULL)) WHERE k > 1""")
def w07_repeats(spark, root):
    """Decisions on a file that was decided before."""
    return A.repeats(table(spark, root, "decisions").select("decision_id", "sgml_file").distinct(), "sgml_file", "decision_id")


@query(f"""SELECT para_id, CAST(len(range(1, len(w) - 14 + 1, 8)) AS INT) AS n FROM (SELECT para_id, {WORDS} AS w FROM {P('sgml')}) WHERE len(w) >= 15""")
def w09_windows(spark, root):
    """Sliding windows of each paragraph."""
    return paras(spark, root, "sgml").select("para_id", F.size(T.windows(plain(), 15, 8)).alias("n")).where("n > 0")


# --- corpus ------------------------------------------------------------------------


def features(spark, root):
    """Filings with their class and size, each once."""
    s = table(spark, root, "sgml_content").select("doc_id", "path", "label", "raw_word_count").dropDuplicates(["doc_id"])
    return s.join(table(spark, root, "document_class").select("doc_id", "jurisdiction", "doc_type"), "doc_id")


FEATURES = "(SELECT s.doc_id, s.path, s.label, s.raw_word_count, c.jurisdiction, c.doc_type FROM (SELECT DISTINCT doc_id, path, label, raw_word_count FROM sgml_content) s JOIN document_class c USING (doc_id))"


@query(f"""SELECT jurisdiction, CAST(v[CAST(floor(n * 0.1) AS BIGINT) + 1] AS INT) AS p10, CAST(v[least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) + 1] AS INT) AS p90 FROM (SELECT jurisdiction, list_sort(list(raw_word_count)) AS v, count(*) AS n FROM {FEATURES} WHERE raw_word_count IS NOT NULL GROUP BY jurisdiction)""")
def a02_nearest_rank(spark, root):
    """Word counts at the tenth and ninetieth rank of each jurisdiction."""
    return A.nearest_rank(features(spark, root), ["jurisdiction"], "raw_word_count", {"p10": 0.1, "p90": 0.9})


@query(f"""WITH x AS (SELECT doc_id, jurisdiction, unnest(list_distinct({WORDS.replace('text', 'label')})) AS word FROM {FEATURES}), n AS (SELECT jurisdiction, count(DISTINCT doc_id) AS all_docs FROM x GROUP BY ALL)
  SELECT jurisdiction, word, CAST(docs AS BIGINT) AS docs FROM (SELECT jurisdiction, word, count(DISTINCT doc_id) AS docs FROM x GROUP BY ALL) JOIN n USING (jurisdiction) WHERE docs >= all_docs * 0.5""")
def a03_common_values(spark, root):
    """Label words that half of a jurisdiction's filings share."""
    rows = features(spark, root).select("doc_id", "jurisdiction", F.explode(F.array_distinct(T.words(T.plain_words_text(F.col("label"))))).alias("word"))
    return A.common_values(rows, ["jurisdiction"], "doc_id", "word")


@query(f"""SELECT jurisdiction, label, CAST(n AS BIGINT) AS n, CAST(k AS INT) AS rank FROM (SELECT jurisdiction, label, n, row_number() OVER (PARTITION BY jurisdiction ORDER BY n DESC, label) AS k FROM (SELECT jurisdiction, label, count(*) AS n FROM {FEATURES} WHERE label IS NOT NULL GROUP BY ALL)) WHERE k <= 10""")
def a04_top_labels(spark, root):
    """Ten most frequent labels of each jurisdiction."""
    return A.top_values(features(spark, root), ["jurisdiction"], "label")


STATS = f"""SELECT jurisdiction, doc_type, CASE WHEN grouping(jurisdiction) = 0 AND grouping(doc_type) = 0 THEN 'both' WHEN grouping(doc_type) = 1 AND grouping(jurisdiction) = 0 THEN 'first' WHEN grouping(doc_type) = 0 THEN 'second' ELSE 'all' END AS grain,
  count(*) AS docs, avg(raw_word_count) AS mean, stddev_pop(raw_word_count) AS std, min(raw_word_count) AS low, max(raw_word_count) AS high FROM {FEATURES} GROUP BY GROUPING SETS ((), (jurisdiction), (doc_type), (jurisdiction, doc_type))"""


@query(f"SELECT jurisdiction, doc_type, grain, CAST(docs AS BIGINT) AS docs, round(mean, 4) AS mean, round(std, 4) AS std, low, high FROM ({STATS})")
def a05_grouping_sets(spark, root):
    """Word-count figures of all groupings in one pass."""
    s = A.grouping_stats(features(spark, root), "jurisdiction", "doc_type", "raw_word_count")
    return s.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(f"""WITH s AS ({STATS}), f AS {FEATURES}
  SELECT f.doc_id, coalesce(a.grain, b.grain, c.grain, d.grain) AS base_grain, round(CASE WHEN coalesce(a.std, b.std, c.std, d.std) > 0 THEN (raw_word_count - coalesce(a.mean, b.mean, c.mean, d.mean)) / coalesce(a.std, b.std, c.std, d.std) END, 4) AS z FROM f
  LEFT JOIN s a ON a.grain = 'both' AND a.docs >= 3 AND a.jurisdiction = f.jurisdiction AND a.doc_type = f.doc_type LEFT JOIN s b ON b.grain = 'first' AND b.docs >= 2 AND b.jurisdiction = f.jurisdiction LEFT JOIN s c ON c.grain = 'second' AND c.doc_type = f.doc_type LEFT JOIN s d ON d.grain = 'all'""")
def c7_z_scores(spark, root):
    """How far each filing's size lies from its group's."""
    f = features(spark, root)
    r = A.with_baseline(f, A.grouping_stats(f, "jurisdiction", "doc_type", "raw_word_count"), "jurisdiction", "doc_type")
    z = A.z_score(F.col("raw_word_count"), F.col("base_mean"), F.col("base_std"))
    return r.select("doc_id", "base_grain", F.round(z, 4).alias("z"))


D = "(SELECT DISTINCT * FROM decisions)"


@query(f"""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE upper(validator_decision) IN ('ACCEPT', 'ACCEPT_WITH_WARNINGS')) AS BIGINT) AS passed, round(CAST(count(*) FILTER (WHERE upper(validator_decision) IN ('ACCEPT', 'ACCEPT_WITH_WARNINGS')) AS DOUBLE) / count(*), 6) AS pass_rate,
  round(avg(normalised_score) FILTER (WHERE normalised_score > 0), 6) AS mean_score FROM {D} GROUP BY source""")
def a07_summary(spark, root):
    """Decisions, pass rate and mean score by source."""
    s = K.decision_summary(table(spark, root, "decisions").distinct(), [F.col("source")])
    return s.withColumns({"pass_rate": F.round("pass_rate", 6), "mean_score": F.round("mean_score", 6)})


@query(f"SELECT CAST(floor(normalised_score / 10) * 10 AS INT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM {D} WHERE normalised_score IS NOT NULL GROUP BY ALL")
def a10_histogram(spark, root):
    """Scores in steps of ten."""
    return A.score_histogram(table(spark, root, "decisions").distinct(), "normalised_score")


@query(f"SELECT upper(human_decision) AS decision, CAST(count(*) AS BIGINT) AS n FROM {D} GROUP BY ALL")
def a11_history(spark, root):
    """Human decisions."""
    return ST.counts(table(spark, root, "decisions").distinct())


@query("""WITH a AS (SELECT o_orderdate AS k, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT l_shipdate AS k, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT k AS day, CAST(coalesce(a.n, 0) AS BIGINT) AS n_source, CAST(coalesce(b.n, 0) AS BIGINT) AS n_target FROM a FULL JOIN b USING (k) WHERE abs(coalesce(a.n, 0) - coalesce(b.n, 0)) > greatest(5, floor(coalesce(a.n, 0) * 0.01))""")
def x_l1b_row_parity(spark, root):
    """Days with other numbers of rows in two tables."""
    a = table(spark, root, "orders").select(F.col("o_orderdate").alias("day"))
    return R.row_parity(a, table(spark, root, "lineitem").select(F.col("l_shipdate").alias("day")), "day")


PATHS = [("Valcourt", "Valcourt"), ("Harrow", "Harrow Territory"), ("Carrow", "Isle of Carrow"), ("Northmark", "Northmark"), ("Tamber", "Tamber Plains")]


@query("SELECT DISTINCT doc_id, CASE " + " ".join(f"WHEN contains(upper(path), '{k.upper()}') THEN '{v}'" for k, v in PATHS) + " ELSE 'Unknown' END AS jurisdiction FROM sgml_content")
def p01_keyword_class(spark, root):
    """Jurisdiction by the first keyword of the path."""
    return table(spark, root, "sgml_content").select("doc_id", A.keyword_class(F.col("path"), PATHS, "Unknown").alias("jurisdiction")).distinct()


# --- signs and fixes -----------------------------------------------------------------

SIGNS = "".join(R.ENTITY_OF)


@query(f"""SELECT para_id, c AS sign, CAST(count(*) AS BIGINT) AS n FROM (SELECT para_id, unnest(string_split(text, '')) AS c FROM {P('sgml')}) WHERE contains('{SIGNS.replace(chr(160), "")}' || chr(160), c) AND c <> '' GROUP BY ALL""")
def d6_raw_signs(spark, root):
    """Signs that should be written as entities."""
    lines = paras(spark, root, "sgml").select("doc_id", F.col("para_id").alias("line"), "text")
    return X.sign_cards(lines).select(F.col("line").alias("para_id"), "sign", "n")


SIGN_SIZES = "[" + ", ".join(f"{{'s': '{a}', 'n': {len(b)}}}" for a, b in X.ENTITY_OF.items()) + "]"


@query(f"""SELECT para_id, CAST(coalesce(len(h), 0) AS INT) AS applied, CAST(length(text) + coalesce(list_sum(list_transform(h, lambda x: x.n - 1)), 0) AS INT) AS n FROM (SELECT para_id, text, list_filter({SIGN_SIZES}, lambda x: contains(text, x.s)) AS h FROM {P('sgml')})""")
def x11_apply_fixes(spark, root):
    """Paragraphs after their sign cards are applied, one place a card."""
    rows = paras(spark, root, "sgml").select(F.col("para_id").alias("doc_id"), F.col("text").alias("raw"))
    cards = X.sign_cards(rows.select("doc_id", F.lit(1).alias("line"), F.col("raw").alias("text")))
    fixes = cards.select("doc_id", F.ascii("sign").alias("ord"), F.col("sign").alias("wrong"), F.col("entity").alias("right"))
    return X.apply_fixes(rows, fixes).select(F.col("doc_id").alias("para_id"), "applied", F.length("fixed").alias("n"))


@query(f"""SELECT doc_id, side, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(substr(text, 1, 60)) ORDER BY side, text) AS k FROM (SELECT DISTINCT doc_id, side, text FROM headings)) WHERE k = 1""")
def o05_first_keys(spark, root):
    """Headings whose first letters no earlier one has."""
    return X.first_keys(table(spark, root, "headings").select("doc_id", "side", "text").distinct(), "text", "side")


@query()
def k01_reports(spark, root):
    """One JSON record for each filing."""
    return K.report_json(features(spark, root))


# --- streams ---------------------------------------------------------------------------


def log_stream(spark, root):
    path = f"{root}/decisions.parquet"
    like = spark.read.parquet(path)
    # A table of one file is read through its folder.
    one = [p.split("/")[-1] for p in like.inputFiles()] == ["decisions.parquet"]
    return ST.read_log(spark, root if one else path, like, pattern="decisions.parquet" if one else None)


@query("SELECT upper(human_decision) AS decision, CAST(count(*) AS BIGINT) AS n FROM decisions GROUP BY ALL")
def st1_counts(spark, root):
    """Running decision counts."""
    return ST.run_once(ST.counts(log_stream(spark, root)))


@query("""SELECT sgml_file, upper(validator_decision) AS decision, "at" FROM (SELECT *, row_number() OVER (PARTITION BY sgml_file ORDER BY "at" DESC NULLS LAST, decision_id DESC NULLS LAST) AS k FROM (SELECT *,
  coalesce(try_strptime(logged_at, '%Y-%m-%dT%H:%M:%S'), try_strptime(logged_at, '%Y-%m-%d %H:%M:%S'), try_strptime(logged_at, '%d/%m/%Y %H:%M'), TRY_CAST(logged_at AS TIMESTAMP)) AS "at" FROM decisions)) WHERE k = 1""")
def st2_latest(spark, root):
    """Latest decision of each document."""
    return ST.run_once(ST.latest(log_stream(spark, root)))


@query()
def st4_override_rate(spark, root):
    """Overrides by day."""
    return ST.run_once(ST.override_rate(log_stream(spark, root), window="1 day"), "append")


# --- more of markup, comparison and corpus ---------------------------------------------


def crawl_lines(spark, root):
    """Lines of the pages' texts, numbered from 0."""
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))


LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS idx FROM documents WHERE text IS NOT NULL)"


@query(f"""SELECT doc_id, CAST(section AS INT) AS section, max(CASE WHEN s = 1 THEN text END) AS heading, CAST(coalesce(sum(CASE WHEN s = 0 THEN length(text) + 1 END) - 1, 0) AS INT) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY idx) AS section FROM (SELECT *, CASE WHEN contains(text, ' | ') THEN 1 ELSE 0 END AS s FROM {LINES})) GROUP BY doc_id, section""")
def t16_islands(spark, root):
    """Pages cut at their menu and footer lines."""
    got = J.islands(crawl_lines(spark, root), F.contains("text", F.lit(" | ")))
    return got.select("doc_id", "section", "heading", F.length("content").alias("n"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(raw, '\x0A')) AS text, unnest(range(1, len(string_split(raw, '\x0A')) + 1)) AS line FROM {RAW}) SELECT doc_id, CAST(min(line) AS INT) AS line FROM l WHERE regexp_matches(text, '<h1') GROUP BY doc_id""")
def t24_first_line(spark, root):
    """First line that opens a heading."""
    return M.first_line(pages(spark, root), "<h1")


@query(f"""WITH t AS (SELECT doc_id, lower(replace(t, '/', '')) AS tag FROM (SELECT doc_id, unnest(regexp_extract_all(raw, '<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM {RAW}) WHERE t NOT LIKE '/%')
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS tags, CAST(count(*) AS BIGINT) AS kinds, list(tag ORDER BY n DESC, tag)[1] AS most FROM (SELECT doc_id, tag, count(*) AS n FROM t GROUP BY ALL) GROUP BY doc_id""")
def a01_features(spark, root):
    """Tags of every page, different ones and the most frequent."""
    d = pages(spark, root)
    f = A.tag_features(d, M.tag_counts(d))
    return f.select("doc_id", "tags", "kinds", F.get("top_tags", F.lit(0))["tag"].alias("most"))


@query(f"""SELECT source, CAST(count(normalised_score) AS BIGINT) AS n, round(avg(normalised_score), 2) AS mean, min(normalised_score) AS low, max(normalised_score) AS high,
  list_sort(list(normalised_score) FILTER (WHERE normalised_score IS NOT NULL))[CAST(floor(count(normalised_score) * 0.1) AS BIGINT) + 1] AS p10,
  list_sort(list(normalised_score) FILTER (WHERE normalised_score IS NOT NULL))[least(count(normalised_score) - 1, CAST(floor(count(normalised_score) * 0.9) AS BIGINT)) + 1] AS p90 FROM {D} WHERE source IS NOT NULL GROUP BY source""")
def a08_score_summary(spark, root):
    """Scores of each source."""
    return A.score_summary(table(spark, root, "decisions").distinct().where("source IS NOT NULL"), ["source"], "normalised_score")


@query(f"""WITH g AS (SELECT para_id, unnest({GRAMS(5)}) AS g, doc_id FROM (SELECT doc_id, para_id, {WORDS} AS w FROM {P('pdf_l4')}) WHERE len(w) >= 5), t AS (SELECT DISTINCT doc_id, unnest({GRAMS(5)}) AS g FROM (SELECT doc_id, {WORDS} AS w FROM {P('sgml')}) WHERE len(w) >= 5),
  c AS (SELECT para_id, CAST(count(t.g) AS DOUBLE) / count(*) AS c FROM g LEFT JOIN t ON g.doc_id = t.doc_id AND g.g = t.g GROUP BY ALL),
  x AS (SELECT doc_id, para_id, unnest(list_distinct({WORDS})) AS q FROM {P('pdf_l4')}), v AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS q FROM {P('sgml')}), w AS (SELECT para_id, CAST(count(v.q) AS DOUBLE) / count(*) AS w FROM x LEFT JOIN v ON x.doc_id = v.doc_id AND x.q = v.q GROUP BY ALL),
  s AS (SELECT doc_id, para_id, unnest(range(1, len(w) - 14 + 1, 8)) AS k, w FROM (SELECT doc_id, para_id, {WORDS} AS w FROM {P('pdf_l4')}) WHERE len(w) >= 15), e AS (SELECT doc_id, para_id, k, unnest(list_slice(w, k, k + 14)) AS q FROM s),
  r AS (SELECT para_id, avg(CASE WHEN z >= 0.6 THEN 1.0 ELSE 0.0 END) AS r FROM (SELECT para_id, k, CAST(count(v.q) AS DOUBLE) / count(*) AS z FROM e LEFT JOIN v ON e.doc_id = v.doc_id AND e.q = v.q GROUP BY ALL) GROUP BY para_id)
  SELECT p.para_id, CASE WHEN c >= 0.55 THEN 'grams' WHEN w >= 0.9 THEN 'words' WHEN r >= 0.55 THEN 'windows' END AS method FROM {P('pdf_l4')} p LEFT JOIN c USING (para_id) LEFT JOIN w USING (para_id) LEFT JOIN r USING (para_id)""")
def j02_staged(spark, root):
    """How each printed paragraph is covered by the marked-up text."""
    return J.staged_coverage(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), plain()).select("para_id", "method")


@query(f"""WITH f AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY idx, heading_id) AS k FROM {H('sgml')}), b AS (SELECT doc_id, k FROM f WHERE k <= 30 AND EXISTS (SELECT 1 FROM {P('pdf_l1')} p WHERE p.doc_id = f.doc_id AND contains(p.text, f.text)))
  SELECT f.doc_id, CAST(count(*) AS BIGINT) AS sampled, CAST(count(*) FILTER (WHERE b.k IS NULL) AS BIGINT) AS missing FROM (SELECT * FROM f WHERE k <= 30) f LEFT JOIN b ON f.doc_id = b.doc_id AND f.k = b.k GROUP BY f.doc_id""")
def j18_sampled_values(spark, root):
    """Headings of the marked-up side that no printed line holds."""
    v = heads(spark, root, "sgml").select("doc_id", F.struct("idx", "heading_id").alias("ord"), F.col("text").alias("value"))
    return J.sampled_values(v, paras(spark, root, "pdf_l1"))


@query(rf"""WITH i AS (SELECT doc_id, para_id, unnest(b) AS item, generate_subscripts(b, 1) - 1 AS no FROM (SELECT doc_id, para_id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, ';\s+', chr(1), 'g'), '\s+(\([a-z0-9]{{1,3}}\)\s)', chr(1) || '\1', 'g'), '\s*[•▪◦]\s*', chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS b FROM {P('pdf_l4')}) WHERE len(b) >= 2),
  h AS (SELECT *, array_to_string(list_slice({WORDS.replace('lower(text)', 'lower(item)')}, 1, 12), ' ') AS h FROM i), t AS (SELECT doc_id, ' ' || array_to_string({WORDS}, ' ') || ' ' AS t FROM {P('sgml')})
  SELECT doc_id, para_id, CAST(no AS INT) AS no, item FROM h WHERE h <> '' AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = h.doc_id AND contains(t.t, ' ' || h.h || ' '))""")
def g10_absent_items(spark, root):
    """Items of printed enumerations that the marked-up text lacks."""
    return J.absent_items(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), lambda c: T.words(T.plain_words_text(c)))


@query(f"""WITH s AS (SELECT doc_id, para_id, {WORDS} AS w FROM {P('pdf_l4')}), g AS (SELECT doc_id, para_id, unnest({GRAMS(5)}) AS g FROM s WHERE len(w) >= 10), t AS (SELECT DISTINCT doc_id, unnest({GRAMS(5)}) AS g FROM (SELECT doc_id, {WORDS} AS w FROM {P('sgml')}) WHERE len(w) >= 5),
  c AS (SELECT g.doc_id, para_id, CAST(count(t.g) AS DOUBLE) / count(*) AS c FROM g LEFT JOIN t ON g.doc_id = t.doc_id AND g.g = t.g GROUP BY ALL), r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE c >= 0.6) AS f FROM c GROUP BY doc_id)
  SELECT doc_id, CAST(n AS BIGINT) AS paragraphs, CAST(f AS BIGINT) AS found, CAST(CASE WHEN f / n >= 0.9 THEN 20.0 WHEN f / n >= 0.75 THEN 18.0 WHEN f / n >= 0.6 THEN 15.0 WHEN f / n >= 0.45 THEN 12.0 WHEN f / n >= 0.3 THEN 8.0 ELSE 0.0 END AS DOUBLE) AS text FROM r""")
def c2_text_scores(spark, root):
    """Share of the printed paragraphs that the marked-up text holds, as points."""
    return V.text_scores(paras(spark, root, "pdf_l4"), paras(spark, root, "sgml"), plain()).select("doc_id", "paragraphs", "found", "text")


@query("""WITH t(prio, category, keyword, template) AS (VALUES (0, 'page', 'page', 'PAGE'), (1, 'note', 'page', 'OTHER'), (2, 'note', 'see', 'SEE')),
  n AS (SELECT DISTINCT decision_id, lower(reviewer_note) AS d, source FROM decisions) SELECT decision_id, (SELECT min_by(t.template, struct_pack(m := CASE WHEN t.category <> 'note' THEN 1 ELSE 0 END, p := t.prio)) FROM t WHERE contains(n.d, t.keyword)) AS template FROM n""")
def j26_templates(spark, root):
    """Template that fits each reviewer's note."""
    n = table(spark, root, "decisions").select(F.col("decision_id").alias("issue_id"), F.lit("note").alias("category"), F.col("reviewer_note").alias("description"), "source").distinct()
    t = spark.createDataFrame([(0, "page", "page", "PAGE"), (1, "note", "page", "OTHER"), (2, "note", "see", "SEE")], "prio int, category string, keyword string, template string")
    return X.match_templates(n, t).select(F.col("issue_id").alias("decision_id"), "template")


@query("SELECT DISTINCT label FROM sgml_content WHERE label IS NOT NULL")
def a06_known_labels(spark, root):
    """All labels in use."""
    return A.known_values(table(spark, root, "sgml_content"), "label")