import io
import zipfile

from pyspark.sql import functions as F

from quireline.functions import text as T
from quireline.operators import compare as J
from quireline.operators import corpus as A
from quireline.operators import markup as M
from quireline.operators import report as K
from quireline.operators import rules as R
from quireline.plans import validate as V
from quireline.sources.office import xlsx_rows
from tests.test_markup import CLEAN

WORDS = "doc_id bigint, para_id bigint, idx int, text string"
BOOK = (
    '<POLIDOC LANG="EN" ADDDATE="20250101" CLIPDATE="20250101" MODDATE="20250101"><N>1</N><DATE>May 1, 2025</DATE><FREEFORM><BLOCK2><TI>1</TI><TABLE><SGMLTBL><TBLHEAD><TBLCDEFS><TBLCDEF COLWD="50"><TBLCDEF COLWD="50"></TBLCDEFS></TBLHEAD>'
    '<TBLBODY TBLROWS="1"><TBLCDEFS><TBLCDEF COLWD="50"><TBLCDEF COLWD="50"></TBLCDEFS><TBLROW><TBLCELL COLSTART="1">a</TBLCELL><TBLCELL COLSTART="2">b</TBLCELL></TBLROW></TBLBODY></SGMLTBL></TABLE></BLOCK2></FREEFORM></POLIDOC>'
)


def plain(c=None):
    return T.words(T.plain_words_text(F.col("text") if c is None else c))


def hits(spark, raw):
    d = spark.createDataFrame([(1, raw)], "doc_id bigint, raw string")
    return {r.rule: r.n for r in R.issues(d, R.tabular_rules(F.col("raw"))).collect()}


def test_tabular_rules(spark):
    assert hits(spark, BOOK) == {}
    assert hits(spark, BOOK.replace("</TBLROW>", "")) == {"balance": 1}
    assert hits(spark, BOOK.replace('COLWD="50"', 'COLWD="30"')) == {"column widths": 2}
    assert hits(spark, BOOK.replace('COLSTART="2"', 'COLSTART="3"')) == {"column order": 1}
    assert hits(spark, BOOK.replace(">a<", ">None<").replace(">b<", ">1.23456 & é<")) == {"literal none": 1, "cell of none": 1, "accented signs": 1, "bare ampersand": 1}
    assert hits(spark, BOOK.replace('<TBLCDEF COLWD="50"></TBLCDEFS></TBLHEAD>', "</TBLCDEFS></TBLHEAD>"))["column numbers"] == 1


def test_column_order_in_late_rows(spark):
    row = '<TBLROW><TBLCELL COLSTART="{}">a</TBLCELL><TBLCELL COLSTART="{}">b</TBLCELL></TBLROW>'
    raw = row.format(1, 2) * 120 + row.format(2, 1) * 2
    d = spark.createDataFrame([(1, raw)], "doc_id bigint, raw string")
    found = {r.rule: r.n for r in R.issues(d, R.tabular_rules(F.col("raw"))).collect()}
    assert found["column order"] == 2


def test_structure_scores(spark):
    d = spark.createDataFrame([(1, CLEAN), (2, ""), (3, CLEAN.replace("<P>One", "<SGMLTBL></SGMLTBL><P>One"))], "doc_id bigint, raw string")
    s = {r.doc_id: (r.structure, r.critical) for r in V.structure_scores(d, R.filing_rules(F.col("raw"), ["amp"])).collect()}
    assert s[1] == (40.0, False) and s[2] == (0.0, True) and s[3][1]


def test_text_scores(spark):
    source = [(1, i, i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(10)]
    for present, points in ((9, 20.0), (8, 18.0), (6, 15.0), (5, 12.0), (3, 8.0), (2, 0.0)):
        target = [(1, 99, 0, " ".join(t for *_, t in source[:present]))]
        got = V.text_scores(spark.createDataFrame(source, WORDS), spark.createDataFrame(target, WORDS), plain()).first()
        assert (got.found, got.text) == (present, points)


def test_islands(spark):
    rows = [(1, 0, "before"), (1, 1, "# A"), (1, 2, "x"), (1, 3, "y"), (1, 4, "# B"), (2, 0, "# C")]
    df = spark.createDataFrame(rows, "doc_id bigint, idx int, text string")
    for block in (5000, 2):
        got = {(r.doc_id, r.section): (r.heading, r.content) for r in J.islands(df, F.startswith("text", F.lit("#")), block=block).collect()}
        assert got == {(1, 0): (None, "before"), (1, 1): ("# A", "x y"), (1, 2): ("# B", ""), (2, 1): ("# C", "")}


def test_staged_and_items(spark):
    s = spark.createDataFrame([(1, 1, 0, "a b c d e f"), (1, 2, 1, "f e d c b a"), (1, 3, 2, "q r s"), (1, 4, 3, "")], WORDS)
    t = spark.createDataFrame([(1, 9, 0, "a b c d e f")], WORDS)
    assert {r.para_id: r.method for r in J.staged_coverage(s, t, plain()).collect()} == {1: "grams", 2: "words", 3: None, 4: None}
    s = spark.createDataFrame([(1, 1, 0, "We hold: (a) one thing; (b) another thing")], WORDS)
    t = spark.createDataFrame([(1, 2, 0, "we hold one a one thing")], WORDS)
    assert {r.item for r in J.absent_items(s, t, plain).collect()} == {"We hold:", "(b) another thing"} - {"We hold:"}


def test_values(spark):
    v = spark.createDataFrame([(1, 0, "A & B"), (1, 1, "gone"), (1, 2, "USD")], "doc_id bigint, ord int, value string")
    t = spark.createDataFrame([(1, "x A &amp; B y usd")], "doc_id bigint, text string")
    assert tuple(J.sampled_values(v, t).first()) == (1, 3, 2)
    assert tuple(J.sampled_values(v, t, k=1).first()) == (1, 1, 0)
    assert [r.value for r in J.lower_cased(v, t).collect()] == ["USD"]


def test_markup_parts(spark):
    d = spark.createDataFrame([(1, CLEAN)], "doc_id bigint, raw string")
    v = M.MarkupVocabulary()
    assert d.select(M.direct_children(F.col("raw"), "BLOCK2")).first()[0] == ["TI", "P"]
    c = d.select(M.contents(F.col("raw"), v, 4).alias("c")).first().c
    assert len(c.paragraphs) == 2 and c.headings[0] == "Title" and c.counts.sections == 1 and not c.has_appendix
    lines = spark.createDataFrame([(1, "a\nb\nc\nd")], "doc_id bigint, raw string")
    assert M.context_lines(lines, M.first_line(lines, "^b"), 1).first().snippet == "  a\n> b\n  c"
    t = M.table_parts(spark.createDataFrame([(1, BOOK)], "doc_id bigint, raw string")).first()
    assert (t.has_head, t.columns, t.rows) == (True, 2, 1)


def test_features_and_summaries(spark):
    d = spark.createDataFrame([(1, "<a><b></b><b></b></a>"), (2, "")], "doc_id bigint, raw string")
    f = {r.doc_id: r for r in A.tag_features(d, M.tag_counts(d), 1).collect()}
    assert (f[1].tags, f[1].kinds, [x.tag for x in f[1].top_tags]) == (3, 2, ["b"]) and f[2].tags is None
    r = spark.createDataFrame([("k", 9.0, 10.0), ("k", 7.5, 10.0), ("k", 1.0, 10.0), ("k", 1.0, 0.0)], "k string, s double, m double")
    g = A.share_of_maximum(r, ["k"], "s", "m").first()
    assert (g.good, g.fair, g.bad) == (1, 1, 1)
    assert A.score_summary(r, ["k"], "s").first().high == 9.0


def test_workbook_round_trip(spark, tmp_path):
    b = K.xlsx_bytes([(1, "a & b", None), (2, "é", 2.5)], ["n", "t", "v"])
    cells = list(xlsx_rows(io.BytesIO(b), "x"))
    assert {(c[3], c[4], c[5] if c[5] is not None else c[6]) for c in cells} == {(1, 1, "n"), (1, 2, "t"), (1, 3, "v"), (2, 1, 1.0), (2, 2, "a & b"), (3, 1, 2.0), (3, 2, "é"), (3, 3, 2.5)}
    assert zipfile.ZipFile(io.BytesIO(b)).testzip() is None
    out = K.write_xlsx(spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").coalesce(1), str(tmp_path / "w"), 1).collect()
    assert len(out) == 2
