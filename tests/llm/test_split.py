import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireline.llm import split as S


def check(text, limit=S.LIMIT, overlap=S.OVERLAP):
    cuts = S.best_cuts(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(0 <= e - s <= limit for s, e in cuts)
    for (_, e), (s2, e2) in zip(cuts, cuts[1:]):
        assert overlap[0] <= e - s2 <= overlap[1] and e2 > e
    whole = text[: cuts[0][1]] + "".join(text[e:e2] for (_, e), (_, e2) in zip(cuts, cuts[1:]))
    assert whole == text
    return cuts


def test_prose_is_cut_after_sentences():
    text = "This is a sentence of some length, and it ends here. " * 60
    for _, e in check(text)[:-1]:
        assert text[:e].rstrip().endswith(".")


def test_scripts_without_blanks():
    text = "発行者は最新のリストを公表するものとする。" * 120
    for _, e in check(text)[:-1]:
        assert text[e - 1] == "。"


def hard(text):
    return max(S.best_path(text)[1]) > S.LIMIT


def test_hard_runs():
    assert hard("x" * 1201) and not hard("x" * 1200) and not hard("x," * 1300) and hard("a " + "字" * 1300)
    assert not hard("a " * 10 + "x" * 1190 + " b" * 300) and hard("x" * 1201 + ".") and not hard(" " * 3000)
    text = "Words before the run. " * 20 + "A1b2" * 700 + ". Words after it. " * 20
    inside = [e for _, e in check(text)[:-1] if text[e - 1].isalnum() and text[e : e + 1].isalnum()]
    assert 0 < len(inside) <= 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["x" * 700, "x" * 1201, "字" * 1300, " ", ", ", "。", ".", "word ", "\n"]), max_size=8))
def test_hard_as_counted(parts):
    text = "".join(parts)
    marks = S.SENTENCE_MARKS + S.CLAUSE_MARKS
    longest = max(map(len, "".join(" " if c.isspace() or c in marks else c for c in text).split(" ")), default=0)
    assert hard(text) == (longest > S.LIMIT)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["ab ", "c. ", "d, ", "efghijklmnopqrstu ", "字。"]), min_size=1, max_size=12))
def test_least_cost(parts):
    """No other choice of cuts costs less."""
    text, limit, overlap = "".join(parts), 40, (4, 12)
    b = S.boundaries(text, limit, overlap)
    if len(text) <= limit or len(b.at) > 16:
        return
    even = S.even_size(len(text), limit, overlap)
    start = [0] + [S.overlap_start(text, int(p), b.at, b.cost, overlap) for p in b.at[1:]]

    def cost(path):
        sizes = [b.at[j] - start[i] for i, j in zip(path, path[1:])]
        return sum(((x - even) / limit) ** 2 for x in sizes) + sum(b.cost[j] + 0.5 for j in path[1:]) if max(sizes) <= limit else float("inf")

    end = len(b.at) - 1
    least = min(cost((0, *mid, end)) for n in range(end) for mid in combinations(range(1, end), n))
    place = {int(p): k for k, p in enumerate(b.at)}
    assert cost((0, *[place[e] for _, e in S.best_cuts(text, limit, overlap)])) == pytest.approx(least)


def test_small_and_odd_texts():
    assert S.best_cuts("") == [(0, 0)] and S.best_cuts("short") == [(0, 5)] and len(S.best_cuts("x" * 1200)) == 1
    check("e" + "́" * 3000)
    check(" " * 5000)
    check("\n".join(["para " * 40] * 40))
    with pytest.raises(ValueError):
        S.best_cuts("x", 100, (80, 120))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4000), st.integers(0, 10_000))
def test_any_text(n, seed):
    r = random.Random(seed)
    check("".join(r.choice("ab .,\n字。́") for _ in range(n)), 200, (20, 40))


def test_frame(spark):
    cols = "item string, item_id bigint, text string, piece int"
    rows = [("p", 1, "a b " * 400, 7), ("p", 1, "a b " * 400, 7), ("p", 2, None, 0), ("h", 1, "", 0), ("h", 3, "x", 0)]
    df = spark.createDataFrame(rows, cols)
    got = S.split_items(df).collect()
    assert {(r.item, r.item_id) for r in got} == {("p", 1), ("h", 1), ("h", 3)}
    assert [r.piece for r in got if r.item == "p"] == [0, 1]
    assert {(r.item, r.item_id) for r in S.split_items(df, only_long=True).collect()} == {("p", 1)}
    assert S.split_items(spark.createDataFrame([], cols)).count() == 0
    back = S.rebuilt(S.split_items(df)).collect()
    assert len(back) == 3 and all(r.too_long == 0 and r.wrong_overlaps == 0 for r in back)
