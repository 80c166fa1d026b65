"""Problem 6: containers of fixed capacity, as full as possible.

Method: vector best-fit. Every container has residual capacities of tokens,
documents and attention cost (sum of squared lengths). Items come in order of
falling size; each goes to the container, among those with room under every
constraint, whose weighted residual norm is least after taking it. Items longer
than the capacity fill whole containers, their rest is packed like an item.

The work is split: items are dealt by hash to groups of bounded size, each packed
by one task; containers that a group leaves partly empty are opened and packed
again together with those of other groups, until one group holds them all or a
round saves less than a stated part of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm.common import cut, need

#: Capacities of a container: tokens, documents, attention cost. An item that costs
#: more than the attention capacity by itself gets a container of its own.
CAPACITY, MOST_DOCS, MOST_COST = 2048, 48, 4_000_000
#: Weights of the three residuals in the norm.
WEIGHTS = (1.0, 0.05, 0.05)
#: Items that one group holds at most (on average), and the fill from which on a
#: container stays closed; a round of packing again that closes less than this part of
#: its items is the last.
GROUP_ITEMS, FULL, LEAST_GAIN = 20_000, 0.998, 0.02


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY, most_docs: int = MOST_DOCS, most_cost: int = MOST_COST, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Container number of each item; no size may exceed the capacity.

    Every item is compared with all open containers; a container that can't take
    even the smallest item is closed.
    """
    order = np.argsort(-sizes, kind="stable")
    where = np.full(len(sizes), -1, dtype=np.int64)
    if not len(sizes):
        return where
    least = int(sizes.min())
    # Residual tokens, documents and cost, and number, of the open containers.
    room = np.zeros((4, len(sizes)), dtype=np.int64)
    n, made = 0, 0
    for turn, i in enumerate(order):
        s = int(sizes[i])
        square = s * s
        if turn % 256 == 255:
            live = (room[0, :n] >= least) & (room[1, :n] > 0) & (room[2, :n] >= least * least)
            room[:, : int(live.sum())] = room[:, :n][:, live]
            n = int(live.sum())
        able = np.flatnonzero((room[0, :n] >= s) & (room[1, :n] > 0) & (room[2, :n] >= square))
        if len(able):
            left = room[:3, able] - np.array([[s], [1], [square]])
            norm = weights[0] * (left[0] / capacity) ** 2 + weights[1] * (left[1] / most_docs) ** 2 + weights[2] * (left[2] / most_cost) ** 2
            b = int(able[int(norm.argmin())])
            room[:3, b] -= (s, 1, square)
        else:
            b, n = n, n + 1
            room[:, b] = (capacity - s, most_docs - 1, max(0, most_cost - square), made)
            made += 1
        where[i] = room[3, b]
    return where


def _pack_group(capacity: int, most_docs: int, most_cost: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["size", "item", "row"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        where = pack_sizes(g["size"].to_numpy(), capacity, most_docs, most_cost)
        fill = np.bincount(where, weights=g["size"].to_numpy())
        return pd.DataFrame({"item": g["item"], "row": g["row"], "part": g["part"], "size": g["size"], "grp": g["grp"], "bin": where, "fill": fill[where].astype("int64")})

    return run


def pack(items: DataFrame, item: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY, most_docs: int = MOST_DOCS, most_cost: int | None = None,
         group_items: int = GROUP_ITEMS, least_gain: float = LEAST_GAIN) -> DataFrame:
    """``(item, part, size, container, fill)``: the container of every item.

    ``part`` is 0 for a whole item; an item above the capacity comes in parts of
    the capacity and a rest. ``most_cost`` is the sum of squared sizes that a container
    of several items holds at most (``MOST_COST`` for the default capacity, in
    proportion for others). Null sizes count as 0; items of size 0 need no container
    and get none (null). Items that come several times with one name count once, with
    their greatest size; a null name tells nothing, so each such row is an item. Other
    columns are ignored.
    """
    need(items, item, size)
    cost = most_cost if most_cost is not None else MOST_COST * capacity * capacity // (CAPACITY * CAPACITY)
    total = F.coalesce(F.col(size).cast("long"), F.lit(0))
    named = items.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.max(total).alias("total"), F.lit(0).cast("long").alias("row"))
    bare = items.where(F.col(item).isNull()).select(F.col(item).alias("item"), total.alias("total"), F.monotonically_increasing_id().alias("row"))
    rows = cut(named.unionByName(bare))
    over = F.expr(f"total div {capacity}")
    whole = rows.where(F.col("total") > capacity).select(
        "item", "row", F.explode(F.sequence(F.lit(0), (over - 1).cast("int"))).alias("part"), F.lit(capacity).cast("long").alias("size")
    )
    rest = rows.where((F.col("total") > 0) & ((F.col("total") <= capacity) | (F.col("total") % capacity > 0))).select(
        "item", "row", F.when(F.col("total") > capacity, over).otherwise(0).cast("int").alias("part"),
        F.when(F.col("total") > capacity, F.col("total") % capacity).otherwise(F.col("total")).alias("size"),
    )
    kind = dict(rows.dtypes)["item"]
    schema = f"item {kind}, row bigint, part int, size bigint, grp bigint, bin bigint, fill bigint"
    closed = None
    todo = rest
    r, before = 0, None
    while n := todo.count():
        groups = max(1, -(-n // group_items))
        dealt = todo.withColumn("grp", F.abs(F.xxhash64("item", "row", "part", F.lit(r))) % groups)
        done = cut(dealt.groupBy("grp").applyInPandas(_pack_group(capacity, most_docs, cost), schema))
        last = groups == 1 or before is not None and n > (1 - least_gain) * before
        shut = done if last else done.where(F.col("fill") >= int(FULL * capacity))
        named = shut.select("item", "part", "size", F.concat_ws("-", F.lit(r), "grp", "bin").alias("container"), "fill")
        closed = named if closed is None else closed.unionByName(named)
        if last:
            break
        todo, before, r = done.where(F.col("fill") < int(FULL * capacity)).select("item", "row", "part", "size"), n, r + 1
    full = whole.select("item", "part", "size", F.concat_ws("-", F.lit("w"), F.xxhash64("item", "row"), "part").alias("container"), F.lit(capacity).cast("long").alias("fill"))
    none = rows.where("total = 0").select("item", F.lit(0).alias("part"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("long").alias("fill"))
    out = full.unionByName(none)
    return (out if closed is None else out.unionByName(closed)).withColumnRenamed("item", item)


def fill_report(packed: DataFrame, capacity: int = CAPACITY, most_docs: int = MOST_DOCS, most_cost: int = MOST_COST) -> DataFrame:
    """``(containers, least, token_fill, doc_fill, cost_fill, full_docs, full_cost)``:
    the number of containers, the fewest that the tokens need, the mean fill under each
    capacity, in how many the documents are at their capacity, and in how many the cost
    forbids one item of the size that is left."""
    one = packed.where(F.col("container").isNotNull()).groupBy("container").agg(
        F.sum("size").alias("t"), F.count("*").alias("d"), F.sum(F.col("size") * F.col("size")).alias("c")
    )
    return one.agg(
        F.count("*").alias("containers"), F.ceil(F.sum("t") / capacity).cast("long").alias("least"), F.avg(F.col("t") / capacity).alias("token_fill"),
        F.avg(F.col("d") / most_docs).alias("doc_fill"), F.avg(F.least(F.lit(1.0), F.col("c") / most_cost)).alias("cost_fill"),
        F.count_if(F.col("d") >= most_docs).alias("full_docs"), F.count_if((F.col("c") + (F.lit(capacity) - F.col("t")) ** 2 > most_cost) & (F.col("t") < capacity)).alias("full_cost"),
    )
