"""Problem 3: oversized items cut at natural boundaries.

Method: dynamic programming over boundary positions. ``boundaries`` gives every
place where a text may be cut with a penalty (sentence end, clause end, blank, other
mark, then places inside a run where nothing better is near); ``best_path`` takes the
cuts whose penalties and deviations from an even size are least in sum, subject
to the maximum length and the overlap of consecutive pieces, and tells which of them
had to cut a run that no piece can hold.
"""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm.common import need, parts_of

#: Largest piece and overlap of consecutive pieces, in code points.
LIMIT, OVERLAP = 1200, (80, 120)

# Marks that end a sentence or a clause, by script.
SENTENCE_MARKS = ".!?…" + "。！？．｡︒" + "।॥" + "؟۔" + "։" + "።፧፨" + "၊။" + "។៕" + "᠃᠉" + "‼⁇⁈⁉"
CLAUSE_MARKS = ",;:" + "、，；：､" + "،؛" + "՝" + "፣፤፥" + "᠂᠈" + "·"
CLOSERS = "\"'”’»›)]}）］｝」』】》〉〕"

PENALTY = {"paragraph": 0.0, "sentence": 0.05, "clause": 0.6, "blank": 1.0, "mark": 6.0, "run": 40.0, "sign": 80.0}

_CUTS = re.compile(
    "(?P<paragraph>\\s*\\n\\s*)"
    f"|(?P<sentence>[{re.escape(SENTENCE_MARKS)}]+[{re.escape(CLOSERS)}]*(?:\\s+|$|(?<=[。！？।॥؟])))"
    f"|(?P<clause>[{re.escape(CLAUSE_MARKS)}][{re.escape(CLOSERS)}]*(?:\\s+|(?<=[、，；：،؛])))"
    "|(?P<blank>\\s+)"
    f"|(?P<mark>[{re.escape(SENTENCE_MARKS + CLAUSE_MARKS)}])"
)
_JOINTS = re.compile(r"[_=/\\|&+~-]")


@dataclass
class Boundaries:
    """Places after which a text may be cut, ascending, both ends among them: their
    penalties, and for a place inside a run without blank and ending mark the length of
    that run, else 0."""

    at: np.ndarray
    cost: np.ndarray
    run: np.ndarray


def boundaries(text: str, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> Boundaries:
    """Where ``text`` may be cut. Between two natural boundaries that no piece can span
    there are joints of a run and, if need be, places between grapheme clusters."""
    at, cost, begins = [0], [0.0], []
    for m in _CUTS.finditer(text):
        if m.end() > at[-1]:
            at.append(m.end())
            cost.append(PENALTY[m.lastgroup])
            begins.append(m.start())
    if at[-1] != len(text):
        at.append(len(text))
        cost.append(0.0)
        begins.append(len(text))
    else:
        cost[-1] = 0.0
    reach = limit - overlap[1]
    extra_at, extra_cost, extra_run = [], [], []
    step = max(1, min(16, overlap[0] // 4, reach // 4))
    for a, b, end in zip(at, at[1:], begins):
        if b - a <= reach:
            continue
        joints = {a + m.end() for m in _JOINTS.finditer(text[a:b])}
        places = sorted(joints | set(range(a + step, b, step)))
        for p in places:
            # A cluster of more marks than any script uses may be cut.
            last = min(b, p + 32)
            while p < last and U.category(text[p]) in ("Mn", "Mc", "Me", "Cf"):
                p += 1
            if a < p < b and not (extra_at and extra_at[-1] >= p):
                extra_at.append(p)
                extra_cost.append(PENALTY["run"] if p in joints else PENALTY["sign"])
                extra_run.append(end - a if p < end else 0)
    both = np.array(at + extra_at), np.array(cost + extra_cost), np.array([0] * len(at) + extra_run)
    order = np.argsort(both[0], kind="stable")
    return Boundaries(both[0][order], both[1][order], both[2][order])


def overlap_start(text: str, cut: int, at: np.ndarray, cost: np.ndarray, overlap: tuple[int, int]) -> int:
    """Where the piece after ``cut`` begins: the best boundary that repeats as
    much as the overlap asks for, else the longest overlap between clusters."""
    lo, hi = max(0, cut - overlap[1]), max(0, cut - overlap[0])
    i, j = np.searchsorted(at, [lo, hi + 1])
    if i < j:
        k = i + int(np.argmin(cost[i:j]))
        return int(at[k])
    start = (lo + hi) // 2
    while start > lo and U.category(text[start]) in ("Mn", "Mc", "Me", "Cf"):
        start -= 1
    return start


def best_path(text: str, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> tuple[list[tuple[int, int]], list[int]]:
    """``(start, end)`` of the pieces of ``text``, in order, and for each the length of
    the run that its end lies in, 0 at a natural boundary.

    A text within the limit is one piece, an empty one too. Time grows with the
    length times the boundaries within one limit, memory with the length.
    """
    n = len(text)
    if limit <= 2 * overlap[1] or overlap[0] > overlap[1] or overlap[0] < 0:
        raise ValueError("the limit must exceed twice the overlap")
    if n <= limit:
        return [(0, n)], [0]
    places = boundaries(text, limit, overlap)
    at, cost = places.at, places.cost
    starts = np.array([0] + [overlap_start(text, int(p), at, cost, overlap) for p in at[1:]])
    even = even_size(n, limit, overlap)
    best = np.full(len(at), np.inf)
    back = np.zeros(len(at), dtype=np.int64)
    best[0] = 0.0
    # The first boundary whose piece reaches each place; starts needn't ascend strictly.
    first = np.searchsorted(np.maximum.accumulate(starts), at - limit)
    for j in range(1, len(at)):
        f = first[j]
        if f >= j:
            continue
        size = at[j] - starts[f:j]
        uneven = (size - even) / limit
        total = np.where(size <= limit, best[f:j] + uneven * uneven, np.inf)
        k = int(total.argmin())
        # A cut starts a new piece, so each cut costs something by itself.
        best[j] = total[k] + cost[j] + 0.5
        back[j] = f + k
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = int(back[j])
    cuts.reverse()
    return [(int(starts[int(back[j])]), int(at[j])) for j in cuts], [int(places.run[j]) for j in cuts]


def even_size(n: int, limit: int, overlap: tuple[int, int]) -> float:
    """Length of the pieces of a text of ``n`` code points if all were equal."""
    pieces = int(np.ceil((n - overlap[1]) / (limit - overlap[1])))
    return min(limit, n / pieces + overlap[0])


def best_cuts(text: str, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``text``, in order."""
    return best_path(text, limit, overlap)[0]


def _split_batches(limit: int, overlap: tuple[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, key, text in zip(b["item"], b["item_id"], b["text"]):
                pieces, runs = best_path(text, limit, overlap)
                # No piece can hold such a run, so the best path had to cut inside it.
                hard = int(max(runs) > limit)
                for no, ((s, e), inside) in enumerate(zip(pieces, runs)):
                    rows.append((item, key, no, s, e, text[s:e], inside, hard))
            yield pd.DataFrame(rows, columns=["item", "item_id", "piece", "start", "end", "text", "inside", "hard"])

    return run


def split_items(items: DataFrame, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP, only_long: bool = False) -> DataFrame:
    """``(item, item_id, piece, start, end, text, inside, hard)``: the pieces of each
    text of ``items(item, item_id, text)``, offsets in code points. ``inside`` is the
    length of the run without natural boundary that a piece's end cuts, 0 if it cuts
    none; ``hard`` is 1 if the text's best cuts lie in a run above the limit.

    Every piece has at most ``limit`` code points; each but the first repeats the
    last ``overlap[0]`` to ``overlap[1]`` code points of its predecessor; without
    the repeated parts the pieces are the text. A null text gives no piece, an
    empty one a single empty piece; with ``only_long`` texts within the limit give
    none. Items that come several times (same ``item`` and ``item_id``) count
    once; other columns are ignored.
    """
    need(items, "item", "item_id", "text")
    rows = items.select("item", "item_id", "text").where(F.col("text").isNotNull())
    if only_long:
        rows = rows.where(F.char_length("text") > limit)
    # Few bytes are much work here, so their partitions are fixed.
    rows = rows.repartition(parts_of(rows.sparkSession), "item", "item_id").dropDuplicates(["item", "item_id"])
    key = dict(rows.dtypes)["item_id"]
    return rows.mapInPandas(
        _split_batches(limit, overlap),
        f"item string, item_id {key}, piece int, start int, end int, text string, inside int, hard int",
    )


def rebuilt(pieces: DataFrame, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> DataFrame:
    """``(item, item_id, digest, too_long, wrong_overlaps)``: digest of the text that
    the pieces give without what they repeat, how many are above the limit, and how
    many repeat another length or another text than the overlap asks for."""
    one = pieces.groupBy("item", "item_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "end", "text"))).alias("p"))
    before = F.concat(F.array(F.lit(None).cast("struct<piece:int,start:int,end:int,text:string>")), F.slice("p", 1, F.size("p") - 1))
    pairs = F.arrays_zip(before.alias("a"), F.col("p").alias("b"))
    again = lambda x: F.coalesce(x["a"]["end"] - x["b"]["start"], F.lit(0))
    wrong = lambda x: x["a"].isNotNull() & (
        ~again(x).between(*overlap) | (F.right(x["a"]["text"], again(x)) != F.left(x["b"]["text"], again(x)))
    )
    new = lambda x: F.substring(x["b"]["text"], again(x) + 1, F.length(x["b"]["text"]))
    return one.select("item", "item_id", pairs.alias("q")).select(
        "item", "item_id", F.md5(F.array_join(F.transform("q", new), "")).alias("digest"),
        F.size(F.filter("q", lambda x: F.length(x["b"]["text"]) > limit)).alias("too_long"), F.size(F.filter("q", wrong)).alias("wrong_overlaps"),
    )
