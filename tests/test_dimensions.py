import pytest
from pyspark.sql import functions as F

from quireline.functions import text as T
from quireline.operators import compare as J
from quireline.operators import corpus as A
from quireline.operators import dimensions as D
from quireline.operators import fixes as X
from quireline.operators import layout as L
from quireline.operators import markup as M
from quireline.operators import rules as R
from tests.test_markup import CLEAN, docs, found

COUNTS = "doc_id bigint, s_tables int, t_tables int, s_images int, t_images int, s_footnotes int, t_footnotes int, s_headings int, t_headings int, first_page string, t_appendix boolean, extra string"
STATED = "doc_id bigint, label string, lang string, adddate string, moddate string, number string, s_lang string, s_date string, first_page string"


def hits(spark, schema, rows, checks):
    got = {}
    for r in D.apply_checks(spark.createDataFrame(rows, schema), checks).collect():
        got.setdefault(r.doc_id, {})[r.name] = r.points
    return got


def test_completeness(spark):
    rows = [
        (1, 0, 0, 0, 0, 0, 0, 2, 2, "plain", False, "x"), (2, 3, 0, 2, 0, 5, 0, 10, 4, "See Schedule A", False, "x"), (3, 8, 5, 6, 3, 9, 5, 10, 6, "Appendix 1", True, "x"),
        (4, None, None, None, None, None, None, None, None, None, None, None), (5, 1, 2, 1, 0, 4, 0, 30, 2, "", False, "x"),
    ]
    got = hits(spark, COUNTS, rows, D.completeness())
    assert got == {
        2: {"tables lost": 1.5, "images lost": pytest.approx(0.6), "footnotes lost": 1.0, "sections lost": 1.0, "appendix lost": 0.5},
        3: {"tables differ": 1.0, "images fewer": 0.5, "footnotes fewer": 0.5, "sections fewer": 0.5}, 5: {"images lost": pytest.approx(0.3)},
    }
    assert hits(spark, COUNTS, [], D.completeness()) == {}


def test_metadata(spark):
    good = ("Rule", "EN", "20200101", "20200102", "45-106", "EN", "20200110", "Notice 45-106 of the day")
    rows = [(1, *good), (2, *good[:1], "FR", *good[2:]), (3, *good[:4], "45-930", *good[5:]), (4, *good[:6], "20100101", good[7]), (5, *good[:6], "20190101", good[7]), (6, None, " ", "2020-01-01", "20190101", None, None, None, None), (7, "12", "XX", "20200101", "20190101", "2025-008", "XX", None, "")]
    got = hits(spark, STATED, rows, D.metadata())
    assert 1 not in got and got[2] == {"language": 1.0} and got[3] == {"number": 1.0} and got[4] == {"date": 1.0} and got[5] == {"date of keying": 0.0}
    assert got[6] == {"label missing": 0.0, "lang missing": 0.0, "adddate form": 0.0, "language unknown": 0.0}
    assert got[7] == {"language unknown": 0.0, "dates turned": 0.0, "label form": 0.0}


def test_ordering(spark):
    schema = "doc_id bigint, matched int, ratio double, s_headings int, t_headings int, two_column boolean"
    rows = [(1, 4, 1.0, 5, 5, False), (2, 4, 0.2, 5, 5, None), (3, 4, 1.0, 5, 5, True), (4, 2, 1.0, 5, 5, False), (5, 9, 0.05, 9, 9, False)]
    assert hits(spark, schema, rows, D.ordering()) == {1: {"order": 2.0}, 2: {"order in part": 0.5}}


def test_inversions_equal_all_pairs(spark):
    import random

    r = random.Random(3)
    rows = [(d, i, r.randint(0, 9)) for d in range(4) for i in range(25)]
    got = {x.doc_id: x.inverted for x in J.inversions(spark.createDataFrame(rows, "doc_id int, a int, b int")).collect()}
    assert got == {d: sum(x[2] > y[2] for x in rows for y in rows if x[0] == y[0] == d and x[1] < y[1]) for d in range(4)}
    assert J.inversions(spark.createDataFrame([(1, 5, 5)], "doc_id int, a int, b int")).first().ratio == 0.0


def test_contacts(spark):
    s = spark.createDataFrame([(1, "Call (416) 593-8314 or 1-800-555-1234, mail a.b@c.ca, see https://a.example/path and www.b.example."), (2, "none"), (3, None)], "doc_id int, text string")
    t = spark.createDataFrame([(1, "416.593.8314 https://a.example/path"), (1, None)], "doc_id int, text string")
    items, points = D.contacts(s, t)
    assert {(x.kind, x.item) for x in items.collect()} == {("phone", "1-800-555-1234"), ("mail", "a.b@c.ca"), ("link", "www.b.example.")}
    assert points.first().points == pytest.approx(0.9)
    many = spark.createDataFrame([(1, " ".join(f"x{i}@c.ca" for i in range(9)))], "doc_id int, text string")
    assert D.contacts(many, t)[1].first().points == 1.5 and D.contacts(s.limit(0), t)[0].count() == 0


def test_tagging_cascade(spark):
    items = spark.createDataFrame([(1, "Scope of this rule"), (1, "Annual filing dates"), (1, "Staff Notice 41-307 revised"), (1, "Entirely other words"), (1, "Page 12 of it"), (1, "Short")], "doc_id int, text string")
    headings = spark.createDataFrame([(1, "scope of the rule"), (2, "entirely other words"), (1, None)], "doc_id int, text string")
    numbers = spark.createDataFrame([(1, "41-307 revised")], "doc_id int, text string")
    body = spark.createDataFrame([(1, "The annual filing dates are set.")], "doc_id int, text string")
    stages = [("similar", headings, 0.7), ("number", numbers, "holds"), ("body", body, "within")]
    got = {r.text: r.found_by for r in D.fuzzy_cascade(items, stages).collect()}
    assert got == {"Scope of this rule": "similar", "Staff Notice 41-307 revised": "number", "Annual filing dates": "body", "Entirely other words": None, "Page 12 of it": None, "Short": None}
    assert [r.text for r in D.untagged(items, stages).collect()] == ["Entirely other words"]


def test_count_tiers(spark):
    df = spark.createDataFrame([(0, 0), (2, 0), (3, 0), (10, 9), (10, 6), (10, 3), (10, 2), (4, 9)], "s int, t int")
    assert [r[0] for r in df.select(D.table_points(F.col("s"), F.col("t"))).collect()] == [4.0, 2.0, 0.0, 4.0, 2.0, 1.0, 0.0, 4.0]
    assert [r[0] for r in df.select(D.footnote_points(F.col("s"), F.col("t"))).collect()] == [3.0, 1.5, 0.0, 3.0, 1.5, 0.0, 0.0, 3.0]
    w = spark.createDataFrame([(2000, 400, False), (1500, 400, False), (1500, 400, True), (100, 400, None), (1000, 200, False)], "s int, t int, x boolean")
    assert [r[0] for r in w.select(D.catastrophic_loss(F.col("s"), F.col("t"), F.col("x"))).collect()] == [True, True, False, False, False]
    p = spark.createDataFrame([(0.96, 0.0, False, 5, 5), (0.72, 0.0, False, 5, 5), (0.72, 0.0, True, 5, 5), (0.1, 20.0, False, 5, 5), (0.1, 18.0, False, 5, 0), (0.0, 0.0, False, 0, 5)], "r double, x double, p boolean, s int, t int")
    assert [r[0] for r in p.select(D.section_points(*[F.col(c) for c in ("r", "x", "p", "s", "t")])).collect()] == [8.0, 4.0, 6.0, 4.0, 2.0, 8.0]


def test_corpus_checks(spark):
    schema = "doc_id int, jurisdiction string, label string, known_label boolean, doc_type string, z double, depth int, corpus_depth int, missing_common int, has_parts boolean, has_free_form boolean, n_table int, n_body int, has_ident boolean, special boolean"
    rows = [(1, "ON", "a", True, "instrument", -1.0, 5, 9, 0, True, True, 1, 1, True, False), (2, "Unknown", "b", False, "instrument", -4.1, 20, 9, 4, False, False, 2, 1, False, False), (3, None, None, None, "notice", None, None, None, None, True, True, 0, 0, False, True), (4, "ON", "a", True, "notice", 5.0, 1, 9, 0, False, True, 0, 0, True, False)]
    got = hits(spark, schema, rows, D.corpus_checks())
    assert 1 not in got and set(got[3]) == {"no baseline", "notice with parts"} and got[4] == {"long": 0.0}
    assert got[2] == {"unknown": 2.0, "label unknown": 1.0, "far too short": 4.0, "deep": 2.0, "common tags missing": 1.0, "instrument without parts": 3.0, "no free form": 3.0, "tables unpaired": 2.0, "no ident block": 2.0}
    d = spark.createDataFrame(rows, schema)
    scores = {(r.doc_id, r.dimension): r.score for r in D.dimension_scores(d, D.apply_checks(d, D.corpus_checks()), D.CORPUS_POINTS).collect()}
    assert scores[2, "jurisdiction"] == 2.0 and scores[2, "patterns"] == 0.0 and scores[1, "statistics"] == 10.0


def test_more_structural_faults(spark):
    assert found(spark, CLEAN.replace("</P></BLOCK2>\n", "</P> these are seven words without any opener </P></BLOCK2>\n")) == {"end without paragraph": 1}
    assert found(spark, CLEAN.replace("<P>One", '<DATE LABEL="Made">x</DATE><P>One')) == {"date label": 1}
    assert found(spark, CLEAN + '<POLIDOC ADDDATE="20260101">') == {"dates rising": 1}
    assert found(spark, CLEAN.replace("<N>1</N>", "")) == {"ident without number": 1} and found(spark, CLEAN.replace("<TI>Title</TI>", "")) == {"ident without title": 1}
    bare = "<TABLE><SGMLTBL></SGMLTBL></TABLE>"
    assert found(spark, CLEAN.replace("<P>One", bare * 5 + "<P>One"))["no table body"] == 3
    d = docs(spark, CLEAN.replace("<P>One", "<BLOCK2><BLOCK4></BLOCK4></BLOCK2><P>One"), None, "")
    assert {(r.doc_id, r.rule, r.points) for r in R.filing_issues(d, ["amp"]).collect() if "block" in r.rule and "ident" not in r.rule} == {(0, "block level skipped", 1.0)}
    # Prepared columns give what the plain expressions give.
    tampered = docs(spark, *[CLEAN.replace("<P>One", x + "<P>One") for x in (bare, "<ITEM></ITEM>", "<P><ITEM></ITEM></P>", "<TI>a.</TI>", "")])
    plain = {tuple(r) for r in R.issues(tampered, R.filing_rules(F.col("raw"), ["amp"])).collect()}
    assert plain == {tuple(r) for r in R.issues(R.prepared(tampered), R.filing_rules(F.col("raw"), ["amp"], ready=True)).collect()}


def test_direct_children(spark):
    d = docs(spark, "<a><b><c></c></b><d>x</d><b></b><br><e></e></a>")
    assert d.select(M.direct_children(F.col("raw"), "a", ("br",))).first()[0] == ["b", "d", "br", "e"]


def test_heading_labels(spark):
    want = {"Part 2 - Scope": "Scope", "1.2.3 Overview": "Overview", "IV. Terms": "Terms", "Part 5": "Part 5", "Appendix B: Forms": ": Forms", "Scope": "Scope", "– 3 – Dates": "3 – Dates", "Schedule A — Fees": "Fees", "": "", "ivory": "ivory", "Section": "Section"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.b for r in df.select("t", T.strip_heading_prefix(F.col("t")).alias("b")).collect()} == want


def test_reference_numbers(spark):
    want = {
        "see 45-106 and NI 31-103": "NI 31-103", "Multilateral Instrument 11-102 or Notice 12-345": "Multilateral Instrument 11-102", "(Notice\n11-326)": "Notice 11-326", "of 2020: 45-106.": "45-106",
        "osc Rule 14-501": "Rule 14-501", "OSC 14-501": "OSC 14-501", "no number 1-2": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.n for r in df.select("t", T.number_reference(F.col("t")).alias("n")).collect()} == want


def test_heading_levels(spark):
    df = spark.createDataFrame([(16.1, 10.0, False, 3), (16.0, 10.0, False, 3), (12.0, 10.0, False, 3), (10.6, 10.0, False, 3), (10.5, 10.0, False, 3), (10.0, 10.0, True, 3), (10.0, 10.0, True, 30)], "s double, b double, bold boolean, w int")
    assert [r[0] for r in df.select(L.heading_level(*[F.col(c) for c in ("s", "b", "bold", "w")])).collect()] == [1, 2, 3, 4, 0, 4, 0]


def test_cards(spark):
    raw = '<POLIDOC LANG="EN">\n<N>45-1</N>\n<P>Some bold words here</P>\n<ITEM></ITEM>'
    d = spark.createDataFrame([(1, raw), (2, "")], "doc_id int, raw string")
    wrong = spark.createDataFrame([(1, "metadata", "language", "major", 1.0), (1, "metadata", "number", "major", 1.0), (1, "metadata", "label missing", "warning", 0.0), (2, "metadata", "language", "major", 1.0)], "doc_id int, dimension string, name string, severity string, points double")
    shown = spark.createDataFrame([(1, "FR"), (2, "FR")], "doc_id int, s_lang string")
    got = {(r.doc_id, r.name, r.line, r.wrong, r.right, r.auto) for r in X.metadata_cards(d, wrong, shown).collect()}
    assert got == {(1, "language", 1, '<POLIDOC LANG="EN">', '<POLIDOC LANG="FR">', True), (1, "number", 2, "<N>45-1</N>", None, False)}
    issues = spark.createDataFrame([(1, "empty item", "nesting", "major", 1, 1.0), (1, "other", "nesting", "major", 1, 1.0)], "doc_id int, rule string, category string, severity string, n int, points double")
    assert [(r.doc_id, r.name, r.line) for r in X.issue_cards(d, issues, {"empty item": "ITEM"}).collect()] == [(1, "empty item", 4)]
    lines = spark.createDataFrame([(1, 3, "<P>Some bold words here</P>"), (1, 5, "again some BOLD words")], "doc_id int, line int, text string")
    items = spark.createDataFrame([(1, "bold words"), (1, "nowhere found")], "doc_id int, text string")
    assert [(r.line, r.right, r.auto) for r in X.wrapping_cards(items, lines, "BOLD").collect()] == [(3, "<P>Some <BOLD>bold words</BOLD> here</P>", True)]
    pairs = spark.createDataFrame([(1, 0, 2, "a"), (1, 1, 1, "b"), (1, 2, 3, "c")], "doc_id int, a int, b int, text string")
    assert [(r.first, r.second) for r in X.inverted_cards(pairs).collect()] == [("a", "b")]
    source = spark.createDataFrame([(1, 10, 0, 4), (1, 11, 1, None), (1, 12, 2, 7), (1, 9, -1, None)], "doc_id int, para_id int, idx int, found_at int")
    missing = spark.createDataFrame([(1, 11), (1, 9)], "doc_id int, para_id int")
    assert {(r.para_id, r.after) for r in X.placement_cards(missing, source, None).collect()} == {(11, 4), (9, None)}


def test_first_look(spark):
    d = docs(spark, "<PART><SEC></SEC><QUOTE>", "<MISCLAW ><PARTS>", None)
    got = [tuple(r) for r in d.select(*[c.alias(n) for n, c in A.first_look(F.col("raw")).items()]).collect()]
    assert got == [(True, False, True, False), (False, False, False, True), (None, None, None, None)]
