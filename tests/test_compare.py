import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireline.functions import text as T
from quireline.operators import compare as J

WORDS = "doc_id bigint, para_id bigint, idx int, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, WORDS)


def plain():
    return T.words(T.plain_words_text(F.col("text")))


def test_gram_coverage_equals_brute_force(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcde") for _ in range(n))
    src = [(d, i, i, text(r.randint(0, 14))) for d in range(3) for i in range(5)]
    tgt = [(d, i, i, text(r.randint(0, 40))) for d in range(3) for i in range(2)]
    got = {(x.doc_id, x.para_id): (x.grams, x.hits) for x in J.gram_coverage(frame(spark, src), frame(spark, tgt), plain(), 3).collect()}
    grams = lambda t, n: {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
    want, long_ = {}, {}
    for d, i, _, t in src:
        # A text of fewer words than a gram is one by itself.
        n = min(3, len(t.split()))
        g = grams(t, n) if n else set()
        if g:
            have = set().union(*[grams(x[3], n) for x in tgt if x[0] == d])
            want[d, i] = (len(g), len(g & have))
            if n == 3:
                long_[d, i] = want[d, i]
    assert got == want and any(n == 1 for n, _ in want.values())
    only = J.gram_coverage(frame(spark, src), frame(spark, tgt), plain(), 3, short_texts=False).collect()
    assert {(x.doc_id, x.para_id): (x.grams, x.hits) for x in only} == long_


def test_inversions_equal_brute_force(spark):
    r = random.Random(7)
    rows = [(d, i, j) for d in range(4) for i, j in enumerate(r.sample(range(20), 12))]
    got = {x.doc_id: (x.matched, x.inverted) for x in J.inversions(spark.createDataFrame(rows + [(9, 0, 0)], "doc_id bigint, a int, b int")).collect()}
    for d in range(4):
        seq = [j for x, _, j in rows if x == d]
        assert got[d] == (12, sum(seq[p] > seq[q] for p in range(12) for q in range(p + 1, 12)))
    assert got[9] == (1, 0)


def test_headings_and_pairs(spark):
    a = spark.createDataFrame([(1, 1, 0, "Part 1 Terms"), (1, 2, 1, "Costs of filing"), (2, 3, 0, "Alone")], "doc_id bigint, heading_id bigint, idx int, text string")
    b = spark.createDataFrame([(1, 4, 0, "Terms"), (1, 5, 1, "Other thing")], "doc_id bigint, heading_id bigint, idx int, text string")
    m = {r.doc_id: (r.forward, r.backward) for r in J.heading_match(a, b).collect()}
    assert m == {1: (0.5, 0.5), 2: (0.0, 0.0)}
    s = frame(spark, [(1, 1, 0, "red fox jumps"), (1, 2, 1, "no match here")])
    t = frame(spark, [(1, 10, 0, "the fox jumps high"), (1, 11, 1, "red fox jumps")])
    assert [(r.para_id, r.other, r.score) for r in J.pair_texts(s, t, plain()).collect()] == [(1, 11, 1.0)]


def test_numbers(spark):
    n = F.regexp_extract_all("text", F.lit(r"\b([0-9]{2}-[0-9]{3})\b"), F.lit(1))
    s = frame(spark, [(1, 1, 0, "45-106 and 45-106")])
    t = frame(spark, [(1, 2, 0, "45-106 and 45-160")])
    d = J.multiset_delta(s, t, n)
    assert [tuple(r) for r in J.number_substitutions(d).collect()] == [(1, "45-106", "45-160")]
    y = F.regexp_extract_all("text", F.lit(r"\b([0-9]{4})\b"), F.lit(1))
    d = J.multiset_delta(frame(spark, [(1, 1, 0, "2018"), (2, 1, 0, "1990")]), frame(spark, [(1, 2, 0, "2011"), (2, 2, 0, "2018")]), y)
    assert [tuple(r) for r in J.close_values(d, 20.0).collect()] == [(1, 2018.0, 2011.0)]


def test_missing_prefix_and_sentence(spark):
    text = "alpha beta gamma delta epsilon zeta " + " ".join(f"word{i}" for i in range(12))
    s, t = frame(spark, [(1, 1, 0, text)]), frame(spark, [(1, 2, 0, text.split(" ", 6)[6])])
    assert [tuple(r) for r in J.truncated_heads(s, t, plain()).collect()] == [(1, 1)]
    assert J.truncated_heads(s, s, plain()).count() == 0
    rows = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.0), (1, 2, 0.9), (2, 0, 0.0)], "para_id bigint, no int, coverage double")
    assert [tuple(r) for r in J.confirmed_missing(rows).collect()] == [(1, 1, 0.0, "2 of 3")]


def test_labels_items_gaps(spark):
    rows = frame(spark, [(1, 1, 0, "(a) x (c) y (b) z"), (1, 2, 1, "none")])
    assert [tuple(r) for r in J.label_descents(rows, ["para_id"]).collect()] == [(1, 3, 1)]
    items = F.regexp_extract_all("text", F.lit(r"(\+?[0-9][0-9 .-]{5,}[0-9])"), F.lit(1))
    lost = J.missing_items(frame(spark, [(1, 1, 0, "call 555 123-4567 or 999 888 777")]), frame(spark, [(1, 2, 0, "5551234567")]), items).collect()
    assert [r.item for r in lost] == ["999 888 777"]
    g = J.word_gaps(spark.createDataFrame([("a b c d", "a c x d"), (None, "a")], "source_text string, target_text string")).collect()
    assert [(x.kind, x.source, x.target) for x in g[0].gaps] == [("delete", "b", ""), ("insert", "", "x")]


def test_cascade(spark):
    h = "doc_id bigint, text string"
    a = spark.createDataFrame([(1, "Same"), (1, "Part of it"), (1, "Nowhere")], h)
    b = spark.createDataFrame([(1, "same"), (1, "The part of it all")], h)
    assert {r.text: r.found_by for r in J.cascade(a, [("e", b, "equal"), ("w", b, "within")]).collect()} == {"Same": "e", "Part of it": "w", "Nowhere": None}


def test_empty_tables(spark):
    e = frame(spark, [])
    for df in (J.gram_coverage(e, e, plain()), J.pair_texts(e, e, plain()), J.window_coverage(e, e, plain()), J.truncated_heads(e, e, plain())):
        assert df.count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=0, max_size=8), st.lists(st.integers(0, 30), min_size=0, max_size=8))
def test_jaccard(a, b):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    x, y = [str(v) for v in a], [str(v) for v in b]
    got = spark.createDataFrame([(x, y)], "a array<string>, b array<string>").select(T.jaccard(F.col("a"), F.col("b"))).first()[0]
    assert got == (len({*x} & {*y}) / len({*x} | {*y}) if x or y else 0.0)


def test_holding_equals_brute_force(spark):
    r = random.Random(11)
    text = lambda n: "".join(r.choice("ab c") for _ in range(n))
    texts = [(d, text(r.randint(0, 25))) for d in range(3) for _ in range(8)]
    parts = [(d, text(r.randint(0, 9))) for d in range(3) for _ in range(25)]
    got = {(x.doc_id, x.x, x.y) for x in J.holding(spark.createDataFrame(texts, "doc_id int, y string"), spark.createDataFrame(parts, "doc_id int, x string")).collect()}
    want = {(d, x, y) for d, x in parts for e, y in texts if d == e and x and x in y}
    assert {g for g in got if g[1]} == want
    assert {(d, x) for d, x, _ in got if not x} == {(d, x) for d, x in parts if not x}
