from pyspark.sql import functions as F

from quireline.operators import markup as M
from quireline.operators import rules as R

CLEAN = (
    '<POLIDOC LABEL="L" LANG="EN" ADDDATE="20250101"><POLIDENT><N>1</N><TI>Title</TI></POLIDENT><FREEFORM>'
    "<BLOCK2><TI>First heading</TI><P>One two three four.</P></BLOCK2>\n<BLOCK2><TI>Second heading</TI><P>Five six seven eight.</P></BLOCK2></FREEFORM></POLIDOC>"
)
V = M.MarkupVocabulary()


def docs(spark, *raws):
    return spark.createDataFrame(list(enumerate(raws)), "doc_id bigint, raw string")


def found(spark, raw):
    d = docs(spark, raw)
    return {r.rule: r.n for r in R.issues(d, R.filing_rules(F.col("raw"), ["amp", "eacute"])).collect()}


def test_events_and_lines(spark):
    d = docs(spark, "<a x=\"1\">\n<b></b></a>", "", None)
    rows = [(r.ord, r.tag, r.closing, r.offset, r.line, r.attrs) for r in M.tag_events(d).orderBy("ord").collect()]
    assert rows == [(1, "a", False, 0, 1, 'x="1"'), (2, "b", False, 10, 2, ""), (3, "b", True, 13, 2, ""), (4, "a", True, 17, 2, "")]
    assert {(r.tag, tuple(r.lines)) for r in M.tag_lines(d).collect()} == {("a", (1,)), ("b", (2,))}
    assert M.nth_tag_line(M.tag_events(d), "b", 1).first().line == 2


def test_attributes(spark):
    r = docs(spark, '<POLIDOC A="1" B="2" A="3">').select(M.root_attributes(F.col("raw"), "POLIDOC").alias("m"), M.attribute(F.col("raw"), "POLIDOC", "B").alias("b")).first()
    assert r.m == {"A": "3", "B": "2"} and r.b == "2"


def test_paragraphs_match_exact_tags(spark):
    d = docs(spark, CLEAN.replace("<P>One", '<PARA>x</PARA><P ID="a">One'))
    assert d.select(M.paragraphs(F.col("raw"), V).alias("p")).first().p == ["One two three four.", "Five six seven eight."]
    t = docs(spark, "<P>see <TABLE><P>no no no</P></TABLE> below here</P>").select(M.paragraphs(F.col("raw"), V).alias("p")).first()
    assert t.p == ["see [TABLE] below here"]


def test_sections_and_depth(spark):
    s = M.sections(docs(spark, CLEAN), V).orderBy("ord").collect()
    assert [r.heading for r in s] == ["First heading", "Second heading"]
    assert docs(spark, "<a><b></b></b></b><c>", "", "</x>").select(M.nesting_depth(F.col("raw"))).collect()[0][0] == 2


def test_sections_are_whole(spark):
    long = "word " * 2000 + "end"
    d = docs(spark, f"<BLOCK2><TI>One</TI><P>{long}</P></BLOCK2><BLOCK2><TI>Two</TI></BLOCK2>")
    first = M.sections(d, V).orderBy("ord").first()
    assert first.content == "One " + long and first.raw_len == len(first.content)
    assert M.sections(d, V, longest=50).orderBy("ord").first().content == ("One " + long)[:50]


def test_paths(spark):
    p = M.tag_paths(docs(spark, "<a><b><c></b><d></a><e>"), M.MarkupVocabulary(void=("c",))).orderBy("ord").collect()
    assert [r.path for r in p] == ["a", "a/b", "a/b/c", "a/d", "e"]
    f = M.block_order_faults(docs(spark, "<BLOCK2><BLOCK4></BLOCK4></BLOCK2><BLOCK3><BLOCK2></BLOCK2></BLOCK3>")).collect()
    assert {(r.kind, r.outer, r.inner) for r in f} == {("skip", 2, 4), ("reverse", 3, 2)}


def test_clean_document_has_no_issue(spark):
    assert found(spark, CLEAN) == {}
    d = docs(spark, CLEAN)
    s = R.category_scores(d, R.issues(d, R.filing_rules(F.col("raw"), ["amp"])), R.FILING_POINTS).agg(F.sum("score")).first()[0]
    assert s == 40.0


def test_tampered_documents(spark):
    assert found(spark, CLEAN.replace("<P>One", "<DIV>x</DIV><P>One")) == {"unknown tag": 1}
    assert found(spark, CLEAN.replace('LANG="EN"', 'LANG="XX"')) == {"language": 1}
    assert found(spark, CLEAN.replace("<P>One", "<ITEM></ITEM><ITEM> </ITEM><P>One")) == {"empty item": 2}
    assert "forbidden child" in found(spark, CLEAN.replace("<P>One", "<TABLE><SGMLTBL><TBLBODY><TBLROW><TBLCELL><P>x</P></TBLCELL></TBLROW></TBLBODY></SGMLTBL></TABLE><P>One"))
    assert found(spark, CLEAN.replace("<P>One", "<SGMLTBL><TBLBODY></TBLBODY></SGMLTBL><P>One")) == {"table body outside table": 1}
    assert found(spark, CLEAN.replace("One", "&foo; &bar; &foo; A&B é")) == {"unknown entity": 2, "bare ampersand": 1, "raw sign": 1}
    cells = "<TABLE><SGMLTBL><TBLBODY><TBLROW><TBLCELL>a</TBLCELL></TBLROW></TBLBODY><TBLCELL>x</TBLCELL></SGMLTBL></TABLE>"
    assert found(spark, CLEAN.replace("<P>One", cells + "<P>One")) == {"cell outside row": 1}
    assert found(spark, CLEAN.replace("<POLIDENT><N>1</N><TI>Title</TI></POLIDENT>", "")) == {"no ident block": 1}
    assert found(spark, CLEAN.replace("<P>One", '<GRAPHIC FILENAME="SB000001.BMP"><GRAPHIC FILENAME="sb000001.bmp"><GRAPHIC FILENAME="x.jpg"><P>One')) == {"graphic twice": 1, "graphic name": 1, "graphic outside paragraph": 3}


def test_balance(spark):
    b = R.tag_balance(docs(spark, "<TBLROW><TBLROW></TBLROW>"), R.BALANCED).collect()
    assert [(r.tag, r.opens, r.closes) for r in b] == [("tblrow", 2, 1)]
    assert docs(spark, None).select(F.size(R.unknown_tags(F.col("raw"), ["P"]))).first()[0] in (-1, None)
