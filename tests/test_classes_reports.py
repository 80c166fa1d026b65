import glob
import json

import pytest
from pyspark.sql import functions as F

from quireline.operators import corpus as A
from quireline.operators import dimensions as D
from quireline.operators import layout as L
from quireline.operators import report as K
from quireline.sources.settings import Settings


def test_filing_class(spark):
    rows = [
        ("<POLIDOC LANG=\"FR\" LABEL=\"OSC Rule\" ADDDATE=\"20200101\"><POLIDENT><PART>", "/x/a.sgm", "a.sgm"), ("<QUOTE>", "/TMX/By-Law-1.sgm", "By-Law-1.sgm"),
        ("<POLIDENT ><QUOTE >", "c/alberta/x", "x"), ("<POLIDENT>", None, "amending-x.sgm"), ("<POLIDENT>", "", ""), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "raw string, path string, name string")
    got = [(r.lang, r.doc_type, r.jurisdiction, r.confidence) for r in df.select(A.filing_class(F.col("raw"), F.col("path"), F.col("name")).alias("c")).select("c.*").collect()]
    assert got[:5] == [("FR", "INSTRUMENT", "Ontario", 0.9), ("EN", "TSX_SPECIAL", "TSX", 0.95), ("EN", "AMENDMENT", "Alberta", 0.98), ("EN", "AMENDMENT", "Unknown", 0.85), ("EN", "NOTICE", "Unknown", 0.85)]
    assert len(got) == 6


def test_corpus_jurisdiction(spark):
    rows = [("juri\\NS_\\a", "osc", "45-1"), ("x/y", "BC Notice 1", None), (None, "Staff of CIRO", None), (None, None, "96-101"), (None, "other", "By-Law 1"), (None, None, None)]
    df = spark.createDataFrame(rows, "p string, l string, n string").select(A.corpus_jurisdiction(F.col("p"), F.col("l"), F.col("n")).alias("j"))
    assert [tuple(r.j) for r in df.collect()] == [("Nova_Scotia", "directory_path"), ("British_Columbia", "label:BC Notice 1"), ("CIRO", "label_partial:Staff of CIRO"), ("British_Columbia", "doc_number:96-101"), ("TSX", "doc_number:By-Law 1"), ("unknown", "undetected")]


def test_summaries(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    found = spark.createDataFrame([(1, "missing", "critical"), (1, "altered", "minor"), (1, "missing", None)] + [(2, "missing", "critical")] * 30, "doc_id int, kind string, severity string")
    got = {r.doc_id: (round(r.text, 6), round(r.coverage, 6)) for r in D.severity_points(docs, found).collect()}
    assert got == {1: (5.4, 0.88), 2: (0.0, 0.0), 3: (8.0, 1.0)}
    u = D.union_issues({"L1": spark.createDataFrame([(1, "a")], "doc_id int, rule string"), "L2": spark.createDataFrame([(2, 0.5)], "doc_id int, points double")})
    assert {(r.doc_id, r.level, r.rule, r.points) for r in u.collect()} == {(1, "L1", "a", None), (2, "L2", None, 0.5)}
    cards = spark.createDataFrame([(1, "D2", "minor", True), (1, "D2", "minor", False), (1, "D7", "major", None)], "doc_id int, dimension string, severity string, auto boolean")
    assert {(r.dimension, r.n, r.auto) for r in D.fix_summary(cards).collect()} == {("D2", 2, 1), ("D7", 1, 0)}
    b = spark.createDataFrame([(1, "<BLOCK1><TI>a</TI></BLOCK1><BLOCK2><P>x</P></BLOCK2><TI>b</TI>"), (2, ""), (3, None)], "doc_id int, raw string")
    assert {r.doc_id: (r.headings, r.bare) for r in D.blocks_without_heading(b).collect()} == {1: (2, 1), 2: (0, 0), 3: (None, 0)}


def test_heading_positions(spark):
    t = spark.createDataFrame([(1, 0, "Scope of rule"), (1, 1, "Other"), (1, 2, None)], "doc_id int, idx int, text string")
    s = spark.createDataFrame([(1, 5, "Scope of the rule"), (1, 3, "scope of rule"), (1, 7, "scope of rule"), (2, 1, "Other")], "doc_id int, idx int, text string")
    assert [(r.a, r.b) for r in D.heading_positions(t, s).collect()] == [(0, 3)]


def test_cells_and_sentences(spark):
    cells = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 50)], "doc_id int, cell_id int")
    covered = spark.createDataFrame([(1, i, "grams" if i < 8 else None) for i in range(10)], "doc_id int, cell_id int, method string")
    assert {(r.doc_id, r.share, r.points) for r in D.cell_points(cells, covered).collect()} == {(1, 0.8, 0.75), (2, 0.0, 1.5)}
    here, moved, lost = "alpha bravo charlie delta echo foxtrot", "golf hotel india juliet kilo lima", "mike november oscar papa quebec romeo"
    s = spark.createDataFrame([(1, 0, 1, here), (1, 0, 2, moved), (1, 0, 3, lost), (1, 0, 4, "too short"), (1, 0, 5, None)], "doc_id int, section int, key int, text string")
    section = spark.createDataFrame([(1, 0, here), (1, 1, moved)], "doc_id int, section int, text string")
    whole = spark.createDataFrame([(1, here), (1, moved)], "doc_id int, text string")
    assert [r.key for r in D.local_losses(s, section, whole).collect()] == [3]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "REJECT", 12.34), (2, "ACCEPT", 99.0)], "doc_id int, decision string, score double")
    issues = spark.createDataFrame([(1, x, s) for x, s in [("b", "major"), ("a", "critical"), ("c", "major"), ("d", "major"), ("e", "MAJOR")]], "doc_id int, rule string, severity string")
    lines = {r.doc_id: r.lines for r in K.console_lines(rows, issues).collect()}
    assert lines == {1: ["REJECT 12.3", "CRITICAL: a", "MAJOR: b, c, d and 1 more"], 2: ["ACCEPT 99.0"]}
    assert K.exit_code(rows) == 2 and K.exit_code(rows.where("doc_id = 2")) == 0 and K.exit_code(rows.limit(0)) == 0
    flat = K.flat_report(rows, "2020-01-01T00:00:00")
    assert tuple(flat.columns) == K.FLAT and {r.generated for r in flat.collect()} == {"2020-01-01T00:00:00"}
    K.batch_array(K.report_json(rows), str(tmp_path / "a"))
    found = [x for f in glob.glob(f"{tmp_path}/a/part-*.txt") for x in json.loads(open(f).read() or "[]")]
    assert sorted(x["score"] for x in found) == [12.34, 99.0]
    K.write_fixed(spark.createDataFrame([(7, "one\ntwo")], "doc_id int, fixed string"), str(tmp_path / "f"))
    assert open(glob.glob(f"{tmp_path}/f/doc_id=7/*.txt")[0]).read() == "one\ntwo\n"
    c = K.calibration(spark.createDataFrame([("accept", "ACCEPT", 90.0), ("accept", "REJECT", 10.0), ("ACCEPT", "accept", 80.0)], "expected string, decision string, score double"))
    assert {(r.expected, r.decision, r.n, r["mean"]) for r in c.collect()} == {("ACCEPT", "ACCEPT", 2, 85.0), ("ACCEPT", "REJECT", 1, 10.0)}


def test_pages(spark):
    blocks = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id int, block_type int")
    listed = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, "z")], "doc_id int, name string")
    assert {tuple(r) for r in L.image_count(blocks, listed).collect()} == {(1, 1), (2, 1), (3, 1)} and {tuple(r) for r in L.image_count(blocks).collect()} == {(1, 1), (2, 0)}
    box = "doc_id int, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    rules = [(1, 1, (0.0, y, 100.0, y + 1)) for y in (0.0, 20.0, 40.0)] + [(1, 1, (x, 0.0, x + 1, 40.0)) for x in (0.0, 50.0, 100.0)] + [(1, 1, (0.0, 0.0, 5.0, 1.0))]
    spans = spark.createDataFrame([(1, 1, "a", (5.0, 5.0, 20.0, 10.0)), (1, 1, "b", (60.0, 25.0, 70.0, 30.0)), (1, 1, "c", (72.0, 25.0, 80.0, 30.0)), (1, 2, "d", (5.0, 5.0, 9.0, 9.0)), (1, 1, "out", (200.0, 5.0, 210.0, 9.0))], "doc_id int, page int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    cells = {(r.row, r.col): r.text for r in L.ruled_cells(spark.createDataFrame(rules, box), spans).collect()}
    assert cells == {(0, 0): "a", (0, 1): "", (1, 0): "", (1, 1): "b c"}
    at = lambda *rows: spark.createDataFrame(list(rows), "doc_id int, page int, y0 double, text string")
    got = L.interleaved(at((1, 1, 50.0, "low"), (1, 2, 0.0, "next")), at((1, 1, 10.0, "table")), at((1, 1, 90.0, "note"))).orderBy("ord").collect()
    assert [(r.kind, r.text) for r in got] == [("table", "table"), ("block", "low"), ("block", "next"), ("note", "note")]


def test_settings():
    s = Settings.of({"CORPUS_DIR": "/c", "DECISIONS_FILE": ""})
    assert s == Settings("/c", None) and s.need_corpus() == "/c"
    with pytest.raises(ValueError):
        Settings.of({}).need_corpus()


def test_neighbours_over_blocks(spark):
    import random

    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, *range(9)])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {x.i: x.next for x in A.adjacent(df, ["k"], ["i"], "v", F.expr("i div 7")).collect()}
    want = {}
    for key in ("a", "b", None):
        own = [x for x in rows if x[0] == key]
        want |= {x[1]: y[2] for x, y in zip(own, [*own[1:], (None, None, None)])}
    assert got == want
    n = {x.i: x.k2 for x in A.numbered(df, ["k"], ["i"], F.expr("i div 7"), "k2").collect()}
    assert n == {x[1]: sum(y[0] == x[0] and y[1] <= x[1] for y in rows) for x in rows}
    assert A.adjacent(df.limit(0), ["k"], ["i"], "v", F.expr("i div 7")).count() == 0
    names = spark.createDataFrame([(1, "A"), (2, "a"), (3, None), (4, None), (100_001, "a")], "i int, n string")
    assert {(x.i, x.k) for x in A.repeats(names, "n", "i").collect()} == {(2, 2), (100_001, 3)}


def test_small_operators(spark, tmp_path):
    import zipfile

    from quireline.functions import entities as E
    from quireline.operators import compare as J
    from quireline.operators import markup as M
    from quireline.plans import validate as V
    from quireline.sources import office as O

    d = spark.createDataFrame([(1, "<a>x&eacute;y &#160;&zz; b</a>\n<a>\nz"), (2, "<a><b></a>"), (3, None), (4, "<a>1</a><a>2</a>"), (5, "")], "doc_id int, raw string")
    assert [r[0] for r in d.select(E.plain_text(F.col("raw"))).collect()] == ["xéy b z", "", None, "12".replace("12", "1 2"), ""]
    assert [(r.doc_id, r.k, r.line) for r in M.pattern_lines(d, "<a>").orderBy("doc_id", "k").collect()] == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (4, 1, 1)]
    assert [(r.doc_id, r.line) for r in M.pattern_lines(d, "<a>", 2).collect()] == [(1, 2)]
    assert {r.doc_id for r in M.unparsable(d, E.entity_map()).collect()} == {1, 2}
    rows = spark.createDataFrame([(1, i, "annex" if i == 3 else "p") for i in range(6)] + [(2, i, "p") for i in range(12)], "doc_id int, idx int, text string")
    got = [(r.doc_id, r.idx) for r in J.before_mark(rows, F.col("text") == "annex").orderBy("doc_id", "idx").collect()]
    assert got == [(1, 0), (1, 1), (1, 2)] + [(2, i) for i in range(8)]
    lv = spark.createDataFrame([(1, 30.0, None), (2, 35.0, 40.0), (3, None, None)], "doc_id int, a double, b double")
    assert {r.doc_id: r.normalised for r in V.overall(lv, {"a": 35.0, "b": 40.0}).collect()} == {1: pytest.approx(30 / 35 * 100), 2: 100.0, 3: None}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("x/one.sgm", "x/one.PDF", "y/one.pdf", "x/two.SGM"):
            z.writestr(n, "t")
    O.register(spark)
    members = spark.read.format("zip_members").option("path", str(tmp_path)).load()
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    opened = O.opened(spark, str(tmp_path), "zip_members").collect()
    assert sorted(r.member for r in opened if r.error is None) == sorted(("x/one.sgm", "x/one.PDF", "y/one.pdf", "x/two.SGM")) and sum(r.error is not None for r in opened) == 1
    books = K.workbooks(spark.createDataFrame([(1, "a"), (2, None)], "x int, y string").repartition(1)).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / books[0].name).write_bytes(bytes(books[0].content))
    cells = O.opened(spark, str(tmp_path / "b"), "xlsx_cells").collect()
    assert {(c.row, c.col, c.v_str, c.v_num) for c in cells} == {(1, 1, "x", None), (1, 2, "y", None), (2, 1, None, 1.0), (2, 2, "a", None), (3, 1, None, 2.0)}
    assert {(r.member, r.source_member) for r in O.pair_in_archives(members.where("error IS NULL")).collect()} == {("x/one.sgm", "x/one.PDF"), ("x/two.SGM", None)}
