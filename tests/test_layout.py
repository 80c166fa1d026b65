from pyspark.sql import functions as F

from quireline.operators import layout as L

SPAN = (
    "doc_id bigint, page int, page_w double, page_h double, block int, block_type int, line int, span int, text string, size double, flags int, font string, "
    "bbox struct<x0:double,y0:double,x1:double,y1:double>"
)


def span(page, line, k, text, size=10.0, flags=0, font="Plain", y=100.0, x=50.0, w=300.0):
    return (1, page, 600.0, 800.0, 0, 0, line, k, text, size, flags, font, (x, y, x + w, y + 10))


def test_span_lines(spark):
    s = spark.createDataFrame([span(0, 0, 1, "world"), span(0, 0, 0, "Hello"), span(0, 1, 0, "  "), span(0, 2, 0, "Bold", flags=16)], SPAN)
    rows = L.span_lines(s).orderBy("line").collect()
    assert [(r.text, r.bold) for r in rows] == [("Hello world", False), ("Bold", True)]
    assert L.span_lines(s, "").orderBy("line").first().text == "Helloworld"
    assert [r.text for r in L.styled_spans(s, L.BOLD_FLAG, "bold").collect()] == ["Bold"]


def test_medians_and_modes(spark):
    v = spark.createDataFrame([(1, x) for x in (5, 1, 3, 3)] + [(2, 7), (3, None)], "doc_id bigint, v int")
    assert {r.doc_id: r["median"] for r in L.upper_median(v, ["doc_id"], "v").collect()} == {1: 3, 2: 7}
    m = spark.createDataFrame([(1, 2), (1, 1), (1, 2), (1, 1)], "doc_id bigint, v int")
    assert L.modal_value(m, ["doc_id"], "v").first().mode == 1


def test_merge(spark):
    rows = [(1, i, t) for i, t in enumerate(["The first line", "goes on here.", "A second one is long enough to be a paragraph of its own, and it has an end.", "Last"])]
    out = L.paragraphs_from_lines(spark.createDataFrame(rows, "doc_id bigint, idx int, text string"), least_words=1).orderBy("ord").collect()
    assert [r.text for r in out] == ["The first line goes on here.", rows[2][2], "Last"]


def test_merge_over_block_borders(spark):
    long = "A line that is long enough to be a paragraph of its own, since it goes on and on."
    texts = ["An open line", "goes on here", "and then ends.", "Next", "one (a);", "small (b);", "small (c); and more of it, until it is long;", "not joined to that", long, "small again."] * 3
    df = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(texts)], "doc_id bigint, idx int, text string")

    def merged(block):
        out = L.paragraphs_from_lines(df, least_words=2, block=block).orderBy("doc_id", "chunk", "ord").collect()
        return [r.text for r in out if r.doc_id == 1], [(r.chunk, r.ord) for r in out if r.doc_id == 2]

    whole = df.where("doc_id = 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("l"))
    plain = whole.select(L.merge_lines("transform(l, x -> x.text)").alias("p")).first().p
    for block in (2000, 10, 4, 1):
        texts, places = merged(block)
        assert texts == [p for p in plain if len(p.split()) >= 2], block
        assert len(set(places)) == len(places)


def test_running_heads(spark):
    rows = [(1, p, t) for p in range(4) for t in ("Head", f"text {p}")]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, text string")
    assert [(r.norm, r.n) for r in L.running_lines(df).collect()] == [("head", 4)]
    assert L.without_running(df).count() == 4


def test_distinct_headings(spark):
    rows = [(1, i, t) for i, t in enumerate(["General Rules of Play", "general rules of play!", "Costs", "Rules"])]
    df = spark.createDataFrame(rows, "doc_id bigint, idx int, text string")
    assert L.distinct_headings(df).first().headings == ["General Rules of Play", "Costs", "Rules"]
    assert L.distinct_headings(df, most=2).first().headings == ["General Rules of Play", "Costs", "Rules"]


def test_distinct_headings_in_parts(spark):
    # The third is like the second, the second like the first, the third not like the first.
    texts = ["a b c d e f g h i", "a b c d e f g h i j", "b c d e f g h i j k", "other", "a b c d e f g h i"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id bigint, idx int, text string")
    for most in (2000, 3, 2, 1):
        assert L.distinct_headings(df, most=most).first().headings == [texts[0], texts[2], "other"], most
    late = df.selectExpr("doc_id", "CASE idx WHEN 0 THEN 0 ELSE idx + 1 END AS idx", "text")
    assert L.distinct_headings(late, most=2).first().headings == [texts[0], texts[2], "other"]


def test_columns_and_order(spark):
    s = spark.createDataFrame([span(0, i, 0, "x" * 30, x=x, y=y, w=200.0) for i, (x, y) in enumerate([(50.0, 10.0), (320.0, 5.0), (50.0, 30.0), (320.0, 40.0)])], SPAN)
    lines = L.span_lines(s)
    assert L.two_columns(lines).first().two_column
    assert [r.line for r in L.reading_order(L.column_of(lines)).orderBy("ord").collect()] == [0, 2, 1, 3]


def test_zones_boxes_tables(spark):
    s = spark.createDataFrame([span(0, 0, 0, "head", y=10.0), span(0, 1, 0, "body", y=400.0)], SPAN)
    assert [r.text for r in L.in_content_zone(L.span_lines(s)).collect()] == ["body"]
    box = "doc_id bigint, page int, block int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    blocks = spark.createDataFrame([(1, 0, 0, "cell", (1.0, 1.0, 9.0, 9.0)), (1, 0, 1, "free", (50.0, 50.0, 60.0, 60.0))], box)
    tables = spark.createDataFrame([(1, 0, (0.0, 0.0, 10.0, 10.0))], "doc_id bigint, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r.text for r in L.outside_tables(blocks, tables).collect()] == ["free"]
    rules = spark.createDataFrame([(1, 0, (0.0, float(i), 100.0, float(i) + 1)) for i in range(4)], "doc_id bigint, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert L.table_pages(rules).first().tables == 1


def test_page_break(spark):
    rows = [(1, 0, 0, "It goes", "F", 10.0, False), (1, 1, 0, "on here.", "F", 10.5, False), (1, 2, 0, "New", "F", 10.0, False)]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, ord int, text string, font string, size double, heading boolean")
    assert [r.text for r in L.joins_next_page(df).collect()] == ["It goes on here."]


def test_predicates(spark):
    df = spark.createDataFrame([("12",), ("Page 1 of 3",), ("continued",), ("1 A note",), ("Text",), (None,)], "text string")
    r = df.select(L.is_page_number(F.col("text")), L.is_omitted(F.col("text")), L.is_footnote_line(F.col("text"))).collect()
    assert [tuple(x) for x in r] == [(True, True, False), (False, True, False), (False, True, False), (False, False, True), (False, False, False), (None, None, None)]
