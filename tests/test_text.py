import datetime

from pyspark.sql import functions as F

from quireline.functions import entities as E
from quireline.functions import text as T
from quireline.functions.udf import nfc, seq_ratio, xml_ok


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_norms(spark):
    t = F.col("t")
    r = one(spark, "  “Don’t” — ét\xa0é–x ", T.loose_norm(t, nfc).alias("a"), T.strict_norm(t, nfc).alias("b"))
    assert r.a == '"don\'t" -- ét é-x'
    assert r.b == '"don\'t" - ét é-x'
    assert one(spark, "well- known , yes", T.strict_norm(t).alias("b")).b == "well-known, yes"
    assert one(spark, None, T.loose_norm(t).alias("a"), T.word_count(t).alias("n")).a is None
    assert one(spark, "", T.word_count(t).alias("n"), F.size(T.sentences(t)).alias("s")).n == 0


def test_headings(spark):
    rows = spark.createDataFrame([("Part 1 — Definitions",), ("1.2.3 - Overview",), ("IV. Costs",), ("12",), ("Plain",)], "t string")
    assert [r[0] for r in rows.select(T.strip_heading_prefix(F.col("t"))).collect()] == ["Definitions", "Overview", "Costs", "12", "Plain"]
    two = spark.createDataFrame([("Part 1 Terms used", "Terms used"), ("A", "B"), ("", "")], "a string, b string")
    assert [r[0] for r in two.select(T.heading_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_numbers_and_dates(spark):
    rows = spark.createDataFrame([("103", "130"), ("333", "334"), ("106", "160"), ("12", "123"), ("55", "55"), ("123", "456")], "a string, b string")
    assert [r[0] for r in rows.select(T.near_number(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False, False]
    t = spark.createDataFrame([("On April 15, 2026 it",), ("le 3 août 2019",), ("2020-02-30",), ("Date: 20250417",), ("none",), (None,)], "t string")
    d = datetime.date
    assert [r[0] for r in t.select(T.text_date(F.col("t"))).collect()] == [d(2026, 4, 15), d(2019, 8, 3), None, d(2025, 4, 17), None, None]
    assert one(spark, "See National\nInstrument 45-106 now", T.number_reference(F.col("t")).alias("n")).n == "National Instrument 45-106"


def test_arrays(spark):
    w = T.words(F.col("t"))
    r = one(spark, "a b c d", T.ngrams(w, 3).alias("g"), T.ngrams(w, 5).alias("none"), T.windows(w, 2, 2).alias("w"))
    assert r.g == ["a b c", "b c d"] and r.none == [] and r.w == [["a", "b"], ["c", "d"]]
    r = one(spark, "(a) one; (b) two • three", F.size(T.bullets(F.col("t"))).alias("n"))
    assert r.n == 3
    assert one(spark, "He said so. Then left! (Yes)", F.size(T.sentences(F.col("t"))).alias("n")).n == 3
    assert one(spark, "The ROAD to Rome", T.title_case_ratio(F.col("t")).alias("n")).n == 1.0


def test_entities(spark):
    known = E.entity_map({"own": "X"})
    r = one(spark, "a &eacute; &own; &nope; &#65; &amp; b", E.resolve_entities(F.col("t"), known).alias("a"), E.resolve_entities(F.col("t"), known, " ", False).alias("b"))
    assert r.a == "a é X  &#65; &amp; b"
    assert r.b == "a é X     &amp; b"
    assert one(spark, '<!DOCTYPE x><?pi?><GRAPHIC F="1">&eacute;', E.preprocess(F.col("t"), known).alias("a")).a == '<GRAPHIC F="1"/>é'


def test_wrapping_and_cells(spark):
    r = spark.createDataFrame([("The Big dog", "big"), ("none", "x"), ("a.b", "a.b")], "l string, p string")
    assert [x[0] for x in r.select(T.wrap_in_tag(F.col("l"), F.col("p"), "EM")).collect()] == ["The <EM>Big</EM> dog", "none", "<EM>a.b</EM>"]
    assert one(spark, "<B>1 &lt; 2</B> &amp;", T.cell_text(F.col("t")).alias("c")).c == "1 < 2 &"


def test_udfs(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(seq_ratio("a", "b")).collect()] == [0.75, None]
    df = spark.createDataFrame([("<a>x</a>",), ("<a>",), (None,)], "a string")
    assert [r[0] for r in df.select(xml_ok("a")).collect()] == [True, False, None]
