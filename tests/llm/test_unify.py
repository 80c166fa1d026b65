import pytest

from quireline.llm import unify as U

COLS = "para_id bigint, doc_id bigint, side string, text string, look string"


def key(t):
    return U.transducer(True)(t)


def test_same_look():
    pairs = [
        ("é", "é"), ("ＡＢＣ１", "ABC1"), ("a\xa0b", "a b"), ("a　 b", "a b"), ("o​n\xad", "on"), ("ﬁne oﬃce", "fine office"), ("раура", "paypa"),
        ("Νo", "No"), ("ｶﾞｰﾄﾞ", "ガード"), ("ё", "ë"), ("ﺳﻼم", "سلام"), (" a ", "a"), ("e​́", "é"), ("q̣̇", "q̣̇"),
    ]
    for a, b in pairs:
        assert key(a) == key(b), (a, b)


def test_different_look():
    for a, b in [("l", "1"), ("O", "0"), ("é", "e"), ("A", "a"), ("x²", "x2"), ("“a”", '"a"'), ("a–b", "a-b"), ("a—b", "a-b"), ("№", "No"), ("ab", "a b"), ("й", "и"), ("۳", "3")]:
        assert key(a) != key(b), (a, b)


def test_table_is_checked():
    with pytest.raises(ValueError):
        U.check_injective({"а": "a", "ӑ": "a"}, "Cyrillic")
    U.lookalikes()


def test_readable_keeps_scripts():
    assert U.readable("Ρrοf. Τarquil") == "Prof. Tarquil"
    assert U.readable("учёт сорт") == "учёт сорт"
    assert U.readable("банкa") == "банка"
    assert U.readable("ｶﾀｶﾅ カタカナー") == "カタカナ カタカナー"


def test_traced_offsets():
    out, ends = U.transducer(True).traced("é​a.​ Ｘ")
    assert out == "éa. X" and ends == [1, 3, 4, 6, 7]
    assert U.transducer(True).traced("plain") == ("plain", None)


def test_pairs(spark):
    rows = [
        (1, 1, "sgml", "A café", "x"), (2, 1, "pdf_l4", "A café", "x"), (2, 1, "pdf_l4", "A café", "x"), (3, 1, "pdf_l4", "A café", "x"),
        (4, 2, "pdf_l4", "A café", "x"), (5, 1, "sgml", None, None), (6, None, "sgml", "A", None), (7, 1, "sgml", "", None), (8, 1, "pdf_l4", "​", None), (9, 1, "pdf_l1", "A café", None),
    ]
    got = {tuple(r) for r in U.same_looking_pairs(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {(1, 2), (7, 8)}
    assert U.same_looking_pairs(spark.createDataFrame([], COLS)).count() == 0


def test_pairs_equal_brute_force(spark):
    import random

    r = random.Random(3)
    forms = ["a b", "a\xa0b", "а b", "ab", "a  b", "Ａ b", "A b"]
    rows = [(i, r.randint(1, 2), r.choice(["sgml", "pdf_l4"]), r.choice(forms), None) for i in range(40)]
    got = {tuple(x) for x in U.same_looking_pairs(spark.createDataFrame(rows, COLS)).collect()}
    want = {
        (min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows
        if a[2] == "sgml" and b[2] == "pdf_l4" and a[1] == b[1] and a[3] != b[3] and key(a[3]) == key(b[3])
    }
    assert got == want


def test_unify_replaces_columns(spark):
    df = spark.createDataFrame([("ﬁ", 1), (None, 2)], "text string, unified int")
    assert [tuple(r) for r in U.unify(df, key="look").collect()] == [("ﬁ", "fi", "fi"), (None, None, None)]
    with pytest.raises(ValueError):
        U.unify(df, text="none")
def test_clusters_are_precomputed():
    for alike in (True, False):
        table = U.build_table(alike)
        like = U.lookalikes() if alike else {}
        clusters = [k for k in table if len(k) > 1]
        assert len(clusters) > 900 and all(table[k] == U.derive(k, like) for k in table)
        form = U.transducer(alike)
        assert all(form(k) == table[k].strip(" ") for k in clusters)
    form = U.transducer(True)
    # A base of another script, marks out of order, unseen signs between: one form.
    assert form("е\u0301") == form("é") == form("e\u200d\u0301") == "é" and form("a\u0323\u0302") == form("a\u0302\u0323") == form("ậ")


def test_letters_of_one_script_stay_apart():
    table = dict(U.build_table(True))
    U.check_table(table)
    for clash in ({"б": "a"}, {"ж": "ш"}, {"q": "p"}):
        with pytest.raises(ValueError):
            U.check_table({**table, **clash})


def test_borrowed_letters():
    form = U.transducer(True)
    assert form("ρaper") == "paper" and form("αt") == "at" and form("ᎪᏢ") == "AP" and form("Ⲟne") == "One"
    assert form("б") != form("6") and form("p") != form("q") and form("A") != form("a")


