import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireline.llm import mix as M
from quireline.llm import pack as P
from quireline.llm import tokens as T


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 6))
def test_every_constraint_holds(sizes, docs):
    s = np.array(sizes, dtype=np.int64)
    where = P.pack_sizes(s, 100, docs, 6000) if (s * s <= 6000).all() else P.pack_sizes(s, 100, docs, 10_000)
    cost = 6000 if (s * s <= 6000).all() else 10_000
    for b in set(where.tolist()):
        got = s[where == b]
        assert got.sum() <= 100 and len(got) <= docs and (got * got).sum() <= cost
    if len(s) and docs >= 6 and cost == 10_000:
        # Best-fit decreasing needs at most 11/9 of the least number, and one more.
        assert len(set(where.tolist())) <= np.ceil(s.sum() / 100) * 11 / 9 + 1 + len(s) / docs


def test_pack(spark):
    r = random.Random(1)
    rows = [(i, r.randint(1, 900), "x") for i in range(600)] + [(9001, 5000, "x"), (9002, 0, "x"), (9003, None, "x"), (9004, 2048, "x"), (9004, 2048, "x"), (None, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, bin string")
    for group in (20_000, 100):
        got = P.pack(df, group_items=group).collect()
        sizes, total = {}, 0
        for x in got:
            if x.container is not None:
                sizes[x.container] = sizes.get(x.container, 0) + x["size"]
                total += x["size"]
        assert max(sizes.values()) <= 2048
        assert sorted((x.part, x["size"]) for x in got if x.doc_id == 9001) == [(0, 2048), (1, 2048), (2, 904)]
        assert {x.doc_id for x in got if x.container is None} == {9002, 9003}
        assert total == sum(t or 0 for _, t, _ in rows) - 2048
        assert len(sizes) <= -(-total // 2048) + 3
        assert all(x.fill == sizes[x.container] for x in got if x.container is not None)
    assert P.pack(df.limit(0)).count() == 0


def naive(sizes, capacity, docs, cost, weights=P.WEIGHTS):
    """Best fit without any index: every item against every container."""
    bins, where = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s, best = sizes[i], None
        for k, b in enumerate(bins):
            t, d, c = sum(b), len(b), sum(x * x for x in b)
            if t + s > capacity or d + 1 > docs or c + s * s > cost:
                continue
            norm = weights[0] * ((capacity - t - s) / capacity) ** 2 + weights[1] * ((docs - d - 1) / docs) ** 2 + weights[2] * ((cost - c - s * s) / cost) ** 2
            if best is None or norm < best[0]:
                best = (norm, k)
        if best is None:
            bins.append([])
        k = len(bins) - 1 if best is None else best[1]
        bins[k].append(s)
        where[i] = k
    return [sorted(b) for b in bins]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(2, 6), st.integers(3000, 10_000))
def test_all_containers_are_weighed(sizes, docs, cost):
    where = P.pack_sizes(np.array(sizes, dtype=np.int64), 100, docs, cost).tolist()
    bins = naive(sizes, 100, docs, cost)
    got = [sorted(s for s, w in zip(sizes, where) if w == k) for k in range(len(bins))]
    # Equal norms may be taken in another order.
    assert sorted(map(sum, got)) == sorted(map(sum, bins)) and sum(map(len, got)) == len(sizes)


def test_each_capacity_binds():
    small = np.array([10] * 400)
    assert max(np.bincount(P.pack_sizes(small))) == P.MOST_DOCS
    large = np.array([1995] * 5 + [30] * 5)
    alone = P.pack_sizes(large, most_cost=1995 * 1995 + 30 * 30 - 1)
    assert len(set(alone.tolist())) == 6 and len(set(P.pack_sizes(large).tolist())) == 5
    # What costs too much by itself has a container of its own.
    assert P.pack_sizes(np.array([2040, 2, 2]), most_cost=4_000_000).tolist() == [0, 1, 1]


def test_rows_without_a_name_are_items(spark):
    df = spark.createDataFrame([(None, 1500)] * 3 + [("a", 1500)] * 2, "doc_id string, tokens int")
    got = P.pack(df, group_items=2).collect()
    assert len(got) == 4 and len({x.container for x in got}) == 4
    report = P.fill_report(P.pack(df)).first()
    assert (report.containers, report.least) == (4, 3) and report.token_fill == pytest.approx(1500 / 2048)


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, s, r.randint(50, 150)) for i, s in enumerate(["big"] * 4000 + ["mid"] * 1000 + ["small"] * 50)] + [(90_001, None, 100), (90_002, "other", 100), (90_003, "big", 0), (90_004, "big", None)]
    df = spark.createDataFrame([x + ("y",) for x in rows] + [rows[0] + ("y",)], "doc_id bigint, source string, tokens bigint, copies string")
    w = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.19, 2), ("none", 0.01, 1)], "source string, target_share double, max_repeats int")
    used, report = M.mix(df, w, slice_pages=600)
    u = used.collect()
    assert len({x.doc_id for x in u}) == len(u) and {x.source for x in u} == {"big", "mid", "small"}
    assert all(1 <= x.copies <= {"big": 1, "mid": 3, "small": 2}[x.source] for x in u)
    rep = {x.source: x for x in report.collect()}
    assert rep["none"].tokens == 0 and rep["small"].expected_copies == 2.0 and rep["small"].tokens == 2 * rep["small"].available
    total = sum(x["tokens"] * x.copies for x in u)
    for s in ("big", "mid"):
        assert abs(rep[s].tokens / (rep[s].expected_copies * rep[s].available) - 1) < 0.01
        assert rep[s].actual_share == pytest.approx(rep[s].tokens / total)
    # Copies of the pages of a source differ by one at most.
    assert {x.copies for x in u if x.source == "mid"} <= {1, 2}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")
    w = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    used, report = M.mix(df, w)
    assert used.count() == 0 and report.first().actual_share == 0.0


def test_tokens(spark):
    enc = T.encoding(T.FOLDER, T.FILE)
    for t in ("", "Hello, world <|endoftext|>", "发行人应当提交", "a b " * 40_000, "字" * 120_000, "ab3" * 60_000):
        assert T.count_tokens(t) == len(enc.encode_ordinary(t))
    df = spark.createDataFrame([("Hello",), ("",), (None,)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(T.token_count(F.col("t"))).collect()] == [T.count_tokens("Hello"), 0, None]
