import io
import json
import zipfile

from pyspark.sql import functions as F

from quireline.operators import corpus as A
from quireline.operators import fixes as X
from quireline.operators import report as K
from quireline.operators import rules as R
from quireline.plans.judge import judge_pairs
from quireline.sources import office
from quireline.sources import tables as S
from quireline.streaming import decisions as ST


def test_nearest_rank_and_histogram(spark):
    rows = spark.createDataFrame([("a", x) for x in range(20)] + [("b", 5), ("c", None)], "k string, v int")
    got = {r.k: (r.p10, r.p90) for r in A.nearest_rank(rows, ["k"], "v", {"p10": 0.1, "p90": 0.9}).collect()}
    assert got == {"a": (2, 18), "b": (5, 5)}
    assert {(r.bucket, r.n) for r in A.score_histogram(rows, "v").collect()} == {(0, 11), (10, 10)}


def test_baseline_fallback(spark):
    rows = spark.createDataFrame([("x", "t", 1.0), ("x", "t", 3.0), ("y", "t", 5.0)], "j string, t string, v double")
    r = A.with_baseline(rows, A.grouping_stats(rows, "j", "t", "v"), "j", "t").collect()
    assert {(x.j, x.base_grain, x.base_docs) for x in r} == {("x", "first", 2), ("y", "second", 3)}
    z = spark.createDataFrame([(590.0, 1000.0, 100.0), (1.0, 1.0, 0.0)], "v double, m double, s double").select(A.z_score(F.col("v"), F.col("m"), F.col("s"))).collect()
    assert [x[0] for x in z] == [-4.1, None]


def test_top_and_common(spark):
    rows = spark.createDataFrame([("k", 1, "b"), ("k", 2, "a"), ("k", 3, "a"), ("k", 4, "c")], "k string, d int, v string")
    assert [r.v for r in A.top_values(rows, ["k"], "v", 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r.v for r in A.common_values(rows, ["k"], "d", "v").collect()] == ["a"]
    c = spark.createDataFrame([("the XYC rule",), ("none",), (None,)], "t string").select(A.keyword_class(F.col("t"), [("xyc", "Somewhere"), ("rule", "Other")], "Unknown"))
    assert [r[0] for r in c.collect()] == ["Somewhere", "Unknown", "Unknown"]


def test_templates(spark):
    i = spark.createDataFrame([(1, "tables", "Cell has P inside"), (2, "text", "cell empty"), (3, "x", "nothing")], "issue_id int, category string, description string")
    t = spark.createDataFrame([(0, "text", "cell", "A"), (1, "tables", "has p", "B"), (2, "tables", "cell", "C")], "prio int, category string, keyword string, template string")
    assert {r.issue_id: r.template for r in X.match_templates(i, t).collect()} == {1: "B", 2: "A", 3: None}


def test_cards_and_fold(spark):
    d = spark.createDataFrame([(1, "a — b ° c — d"), (2, "plain"), (3, None)], "doc_id bigint, raw string")
    cards = X.sign_cards(d.select("doc_id", F.lit(1).alias("line"), F.col("raw").alias("text")))
    assert {(r.doc_id, r.sign, r.n) for r in cards.collect()} == {(1, "—", 2), (1, "°", 1)}
    f = spark.createDataFrame([(1, 0, "—", "&mdash;"), (1, 1, "°", "&deg;"), (1, 2, "zzz", "y"), (1, 3, "&mdash; b", "&mdash; B")], "doc_id bigint, ord int, wrong string, right string")
    r = {x.doc_id: (x.fixed, x.applied) for x in X.apply_fixes(d, f).collect()}
    assert r[1] == ("a &mdash; B &deg; c — d", 3) and r[2] == ("plain", 0) and r[3][0] is None


def test_highlights_and_order(spark):
    f = spark.createDataFrame([(1, "minor", [5, 6]), (1, "critical", [5])], "doc_id bigint, severity string, lines array<int>")
    assert {(r.line, r.severity) for r in X.highlights(f).collect()} == {(5, "critical"), (6, "minor")}
    c = spark.createDataFrame([(1, i, "minor", "d3", None) for i in range(4)] + [(1, 9, "critical", "d2", 3)], "doc_id bigint, card_id int, severity string, dimension string, line int")
    out = X.ordered_cards(c, {"d3": 2}).orderBy("rank").collect()
    assert [r.card_id for r in out] == [9, 0, 1]


def test_rows_and_headers(spark):
    a = spark.createDataFrame([("x",)] * 100, "k string")
    assert [tuple(r) for r in R.row_parity(a, a.limit(94), "k").collect()] == [("x", 100, 94)]
    assert R.row_parity(a, a.limit(95), "k").count() == 0
    cells = [(1, "S", 1, 1, "Title:", None), (1, "S", 1, 2, "x", None), (1, "S", 3, 1, "Name", None), (1, "S", 3, 2, "Value", None), (1, "S", 4, 1, None, 2.0)]
    df = spark.createDataFrame([c + (None,) for c in cells], "doc_id bigint, sheet string, row int, col int, v_str string, v_num double, v_ts timestamp")
    h = R.header_row(df)
    assert h.first().header_row == 3
    assert R.data_rows(df, h).count() == 1


def test_reports(spark, tmp_path):
    r = K.report_json(spark.createDataFrame([(1, 1.23456, None)], "doc_id bigint, score double, note string")).first().report
    assert json.loads(r) == {"score": 1.23}
    i = spark.createDataFrame([(1, "b", "critical"), (1, "a", "critical"), (1, "c", "minor")], "doc_id bigint, rule string, severity string")
    assert tuple(K.flat_issues(i).first()) == (1, 3, "a; b")
    K.append_log(i, str(tmp_path / "log"))
    K.append_log(i, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.sgm").write_bytes(b"caf\xe9 ok")
    (tmp_path / "a/x_TR.sgm").write_text("t")
    (tmp_path / "a/X.pdf").write_text("p")
    t = S.whole_texts(spark, str(tmp_path))
    assert {r.filename: r.raw for r in t.collect()}["x.sgm"] == "caf� ok"
    keep = S.without_suffix(t)
    assert [r.filename for r in keep.collect()] == ["x.sgm"]
    pdf = S.whole_texts(spark, str(tmp_path), "*.pdf")
    assert S.find_by_stem(keep, pdf).first().source_path.endswith("X.pdf")
    assert S.pair_by_stem(keep, pdf).first().source_path is None
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"sgml_file":"a","source":"s"}\nnot json\n')
    assert S.decision_log(spark, str(tmp_path / "log")).where("sgml_file IS NOT NULL").count() == 1
    assert S.stored_baseline(spark, str(tmp_path / "none")) is None


def workbook() -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>2.5</v></c></row></sheetData></worksheet>')
    return b.getvalue()


def document() -> bytes:
    b = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(
            "word/document.xml",
            f"<w:document {w}><w:body><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Two words</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc>"
            "<w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
        )
    return b.getvalue()


def test_office_sources(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook())
    (tmp_path / "d.docx").write_bytes(document())
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.sgm", "hi")
    office.register(spark)
    c = spark.read.format("xlsx_cells").load(str(tmp_path)).collect()
    assert {(r.col, r.v_str, r.v_num) for r in c if r.cell_type != "error"} == {(1, "Name", None), (28, None, 2.5)}
    assert sum(r.cell_type == "error" for r in c) == 1
    d = spark.read.format("docx_parts").load(str(tmp_path)).collect()
    assert {(r.kind, r.text) for r in d} == {("paragraph", "Two words"), ("bold", "Two words"), ("cell", "cell")}
    z = spark.read.format("zip_members").load(str(tmp_path)).collect()
    assert [(r.member, bytes(r.content)) for r in z] == [("in/a.sgm", b"hi")]


def test_streams(spark, tmp_path):
    rows = [(1, "2017-01-01T10:00:00", "a", "ACCEPT", "reject"), (2, "2017-01-01 11:00:00", "a", "REJECT", None), (3, None, "b", "accept", "accept")]
    df = spark.createDataFrame(rows, "decision_id bigint, logged_at string, sgml_file string, validator_decision string, human_decision string")
    df.write.parquet(str(tmp_path / "log"))
    s = lambda: ST.read_log(spark, str(tmp_path / "log"), df)
    assert {(r.decision, r.n) for r in ST.run_once(ST.counts(s())).collect()} == {("REJECT", 1), ("ACCEPT", 1), (None, 1)}
    assert {(r.sgml_file, r.decision) for r in ST.run_once(ST.latest(s())).collect()} == {("a", "REJECT"), ("b", "ACCEPT")}


def test_judge(spark):
    class Flaky:
        def judge(self, pairs):
            if any(a == "bad" for a, _ in pairs):
                raise ValueError
            return [1.0 for _ in pairs]

    df = spark.createDataFrame([("x", "y"), ("bad", "y"), ("z", "y")], "source_text string, target_text string").coalesce(1)
    assert [r.agreement for r in judge_pairs(df, Flaky(), 1).collect()] == [1.0, None, 1.0]
