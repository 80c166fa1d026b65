"""A judge that looks at pairs of texts; swappable, offline by default."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Judge(Protocol):
    """Decides for a batch of ``(source, target)`` pairs how far they agree, 0 to 1."""

    def judge(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class OfflineJudge:
    """Share of the source's words that the target has in the same order."""

    def judge(self, pairs: list[tuple[str, str]]) -> list[float]:
        from difflib import SequenceMatcher

        out = []
        for a, b in pairs:
            x, y = (a or "").split(), (b or "").split()
            same = sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
            out.append(same / len(x) if x else 1.0)
        return out


def judge_pairs(pairs: DataFrame, judge: Judge, batch: int = 3) -> DataFrame:
    """Pairs with ``agreement``: the judge sees ``batch`` of them at a time, tries twice
    and leaves null what it can't answer."""
    names = pairs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got: list[float | None] = []
            rows = list(zip(f["source_text"], f["target_text"]))
            for i in range(0, len(rows), batch):
                part: list[float | None] = [None] * len(rows[i : i + batch])
                for _ in range(2):
                    try:
                        part = list(judge.judge(rows[i : i + batch]))
                        break
                    except Exception:  # noqa: BLE001
                        continue
                got += part
            yield f.assign(agreement=pd.Series(got, dtype="float64", index=f.index))[[*names, "agreement"]]

    kinds = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return pairs.mapInPandas(run, f"{kinds}, agreement double")
