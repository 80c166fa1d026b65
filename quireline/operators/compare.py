"""Comparison of a target with its source: joins, set and multiset differences,
order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quireline.functions import text as T


def gram_coverage(source: DataFrame, target: DataFrame, words: Column, n: int = 5, doc: str = "doc_id", key: str = "para_id", short_texts: bool = True) -> DataFrame:
    """``(doc, key, grams, hits, coverage)``: share of each source text's different
    word n-grams that stand in the document's target texts.

    ``words`` is the word array of both sides. Grams travel as 64-bit hashes; each
    side is made distinct before they meet, so a document of many copies is small.
    A text of fewer words is one gram of itself (none without ``short_texts``), a text
    without words none.
    """
    w = F.col("__w")
    s = source.select(doc, key, words.alias("__w"))
    t = target.select(doc, words.alias("__w"))
    if not short_texts:
        t = t.select(doc, F.explode(T.gram_hashes(w, n)).alias("g")).distinct().withColumn("hit", F.lit(1))
        return _share_of_grams(s.select(doc, key, F.explode(T.gram_hashes(w, n)).alias("g")), t, doc, key)
    short = F.size(w).between(1, n - 1)
    lengths = s.where(short).groupBy(doc).agg(F.collect_set(F.size(w)).alias("__n"))
    spans = F.flatten(F.transform("__n", lambda k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))))
    # Shorter spans of the target are only needed where a source has such texts.
    small = t.join(lengths, doc).select(doc, F.explode(F.array_distinct(spans)).alias("g"))
    s = s.select(doc, key, F.explode(F.when(short, F.array(F.xxhash64(w))).otherwise(T.gram_hashes(w, n))).alias("g"))
    t = t.select(doc, F.explode(T.gram_hashes(w, n)).alias("g")).unionByName(small).distinct().withColumn("hit", F.lit(1))
    return _share_of_grams(s, t, doc, key)


def _share_of_grams(s: DataFrame, t: DataFrame, doc: str, key: str) -> DataFrame:
    return s.join(t, [doc, "g"], "left").groupBy(doc, key).agg(F.count("*").alias("grams"), F.count("hit").alias("hits")).withColumn("coverage", F.col("hits") / F.col("grams"))


def word_containment(source: DataFrame, target: DataFrame, words: Column, doc: str = "doc_id", key: str = "para_id") -> DataFrame:
    """``(doc, key, words, hits)``: different words of each source text that occur in
    the document's target texts as words."""
    s = source.select(doc, key, F.explode(F.array_distinct(words)).alias("w"))
    t = target.select(doc, F.explode(F.array_distinct(words)).alias("w")).distinct().withColumn("hit", F.lit(1))
    return s.join(t, [doc, "w"], "left").groupBy(doc, key).agg(F.count("*").alias("words"), F.count("hit").alias("hits"))


def window_coverage(source: DataFrame, target: DataFrame, words: Column, size: int = 15, step: int = 8, least: float = 0.6, doc: str = "doc_id", key: str = "para_id") -> DataFrame:
    """``(doc, key, windows, covered)``: sliding windows of each source text, and
    those ``least`` of whose words occur in the target."""
    s = source.select(doc, key, words.alias("__w")).select(doc, key, F.posexplode(T.windows(F.col("__w"), size, step)).alias("k", "w")).select(doc, key, "k", F.explode("w").alias("w"))
    t = target.select(doc, F.explode(F.array_distinct(words)).alias("w")).distinct().withColumn("hit", F.lit(1))
    each = s.join(t, [doc, "w"], "left").groupBy(doc, key, "k").agg((F.count("hit") / F.count("*")).alias("c"))
    return each.groupBy(doc, key).agg(F.count("*").alias("windows"), F.count_if(F.col("c") >= least).alias("covered"))


def best_headings(a: DataFrame, b: DataFrame, doc: str = "doc_id", key: str = "heading_id") -> DataFrame:
    """``(doc, key, best)``: for each heading of ``a`` the best similarity among the
    document's headings ``b``; 0 if it has none.

    Pairs need a common word to be similar at all, so headings meet over their words
    instead of all with all; words are made distinct first.
    """
    forms = lambda c: F.array_union(T.heading_words(c), T.heading_words(T.strip_heading_prefix(c)))
    x = a.select(doc, key, F.col("text").alias("x"), F.explode(forms(F.col("text"))).alias("w"))
    y = b.select(doc, F.col("text").alias("y")).distinct().select(doc, "y", F.explode(forms(F.col("y"))).alias("w"))
    met = x.join(y, [doc, "w"]).select(doc, key, "x", "y").distinct()
    best = met.withColumn("s", T.heading_similarity(F.col("x"), F.col("y"))).groupBy(doc, key).agg(F.max("s").alias("best"))
    return a.select(doc, key).join(best, [doc, key], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def heading_match(source: DataFrame, target: DataFrame, least: float = 0.5, doc: str = "doc_id") -> DataFrame:
    """``(doc, forward, backward, ratio)``: share of source headings found among the
    target's, the same the other way round, and the greater of both."""
    f = best_headings(source, target, doc).groupBy(doc).agg(F.avg(F.when(F.col("best") >= least, 1.0).otherwise(0.0)).alias("forward"))
    b = best_headings(target, source, doc).groupBy(doc).agg(F.avg(F.when(F.col("best") >= least, 1.0).otherwise(0.0)).alias("backward"))
    both = f.join(b, doc, "full_outer").withColumns({"forward": F.coalesce("forward", F.lit(0.0)), "backward": F.coalesce("backward", F.lit(0.0))})
    return both.withColumn("ratio", F.greatest("forward", "backward"))


def pair_texts(source: DataFrame, target: DataFrame, words: Column, doc: str = "doc_id", key: str = "para_id") -> DataFrame:
    """``(doc, key, other, score)``: for each source text the target text of its
    document with the greatest share of common words (of the larger one's); ties go
    to the smaller key. Texts meet over their words."""
    s = source.select(doc, key, F.array_distinct(words).alias("ws"))
    t = target.select(doc, F.col(key).alias("other"), F.array_distinct(words).alias("wt"))
    met = s.select(doc, key, F.size("ws").alias("ns"), F.explode("ws").alias("w")).join(t.select(doc, "other", F.size("wt").alias("nt"), F.explode("wt").alias("w")), [doc, "w"])
    score = met.groupBy(doc, key, "other", "ns", "nt").agg(F.count("*").alias("c")).withColumn("score", F.col("c") / F.greatest("ns", "nt"))
    return score.groupBy(doc, key).agg(F.max(F.struct("score", (-F.col("other")).alias("o"))).alias("b")).select(doc, key, (-F.col("b.o")).alias("other"), F.col("b.score").alias("score"))


def missing_items(source: DataFrame, target: DataFrame, items: Column, norm=T.norm_item, doc: str = "doc_id") -> DataFrame:
    """``(doc, item)``: items (an array column of both sides) that a document's
    source has and its target lacks, by their normal form."""
    s = source.select(doc, F.explode(items).alias("item")).withColumn("k", norm(F.col("item"))).groupBy(doc, "k").agg(F.min("item").alias("item"))
    t = target.select(doc, F.explode(items).alias("item")).select(doc, norm(F.col("item")).alias("k")).distinct()
    return s.join(t, [doc, "k"], "left_anti").select(doc, "item")


def multiset_delta(source: DataFrame, target: DataFrame, tokens: Column, doc: str = "doc_id") -> DataFrame:
    """``(doc, token, n_source, n_target)`` of the tokens whose numbers differ."""
    count = lambda df, n: df.select(doc, F.explode(tokens).alias("token")).groupBy(doc, "token").agg(F.count("*").alias(n))
    both = count(source, "n_source").join(count(target, "n_target"), [doc, "token"], "full_outer")
    both = both.withColumns({"n_source": F.coalesce("n_source", F.lit(0)), "n_target": F.coalesce("n_target", F.lit(0))})
    return both.where(F.col("n_source") != F.col("n_target"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sorted one-to-one choice among candidate pairs of one document."""
    used_s, used_t, out = set(), set(), []
    for s, t in sorted(set(zip(pdf["s"], pdf["t"]))):
        if s not in used_s and t not in used_t:
            used_s.add(s)
            used_t.add(t)
            out.append((pdf["doc_id"].iloc[0], s, t))
    return pd.DataFrame(out, columns=["doc_id", "source_number", "target_number"])


def number_substitutions(delta: DataFrame, kind: str = "bigint") -> DataFrame:
    """``(doc_id, source_number, target_number)``: numbers NN-NNN that the source has
    more often and near numbers of the same prefix that only the target has, one to
    one in sorted order. Only near pairs reach the groups."""
    part = lambda c, k: F.split_part(c, F.lit("-"), F.lit(k))
    s = delta.where("n_source > n_target").select("doc_id", F.col("token").alias("s"), part("token", 1).alias("p"), part("token", 2).alias("a"))
    t = delta.where("n_source = 0").select("doc_id", F.col("token").alias("t"), part("token", 1).alias("p"), part("token", 2).alias("b"))
    near = s.join(t, ["doc_id", "p"]).where(T.near_number(F.col("a"), F.col("b"))).select("doc_id", "s", "t")
    return near.groupBy("doc_id").applyInPandas(_greedy, f"doc_id {kind}, source_number string, target_number string")


def close_values(delta: DataFrame, within: float) -> DataFrame:
    """``(doc_id, source_value, target_value)``: values that the source has more often
    and the least value that the target has more often, at most ``within`` away.

    Values are put into buckets of that width, so only neighbours meet.
    """
    v = F.col("token").cast("double")
    s = delta.where("n_source > n_target").select("doc_id", v.alias("sv")).withColumn("bucket", F.explode(F.array(*[F.floor(F.col("sv") / within) + d for d in (-1, 0, 1)])))
    t = delta.where("n_target > n_source").select("doc_id", v.alias("tv")).withColumn("bucket", F.floor(F.col("tv") / within))
    met = s.join(t, ["doc_id", "bucket"]).where(F.abs(F.col("sv") - F.col("tv")) <= within)
    return met.groupBy("doc_id", F.col("sv").alias("source_value")).agg(F.min("tv").alias("target_value"))


def pool_coverage(items: DataFrame, pool: DataFrame, item_words: Column, pool_words: Column, doc: str = "doc_id", key: str = "heading_id") -> DataFrame:
    """``(doc, key, coverage)``: share of an item's words that occur in the
    document's pool."""
    i = items.select(doc, key, F.explode(F.array_distinct(item_words)).alias("w"))
    p = pool.select(doc, F.explode(F.array_distinct(pool_words)).alias("w")).distinct().withColumn("hit", F.lit(1))
    return i.join(p, [doc, "w"], "left").groupBy(doc, key).agg((F.count("hit") / F.count("*")).alias("coverage"))


def holding(texts: DataFrame, parts: DataFrame, doc: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc, x, y, *carry)``: texts ``y`` of a document that hold one of its parts
    ``x`` anywhere, inside words too. ``texts(doc, y, *carry)``, ``parts(doc, x)``.

    They meet over keys, not all with all: a part of three and more words over its
    longest inner word, which a holder has between the same blanks; a shorter one
    over its first four letters (first letter, if it has fewer). An empty part is
    held by the first text of its document. They are merged: Spark takes a text's keys
    for no larger than the text and would send them all to the driver.
    """
    p = parts.where(F.col("x").isNotNull()).select(doc, "x").distinct()
    t = texts.where(F.col("y").isNotNull()).select(doc, "y", *carry).distinct()
    w = F.split("x", " ")
    inner = F.filter(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))), lambda q: q != "")
    longest = F.array_max(F.transform(inner, lambda q: F.struct(F.length(q).alias("n"), q.alias("q"))))["q"]
    p = p.withColumn("__k", longest)
    by_word = p.where("__k IS NOT NULL").hint("merge").join(t.withColumn("__k", F.explode(F.array_distinct(F.split("y", " ")))), [doc, "__k"])
    short = p.where("__k IS NULL AND x != ''").withColumn("__k", F.when(F.length("x") >= 4, F.substring("x", 1, 4)).otherwise(F.substring("x", 1, 1)))
    grams = F.when(F.length("y") >= 4, F.transform(F.sequence(F.lit(1), F.length("y") - 3), lambda i: F.substring(F.col("y"), i, F.lit(4)))).otherwise(F.array().cast("array<string>"))
    # 64 bits of a document's keys leave out most of the others before they are rows.
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.xxhash64(k).bitwiseAND(63).cast("int"))
    some = t.join(short.groupBy(doc).agg(F.bit_or(bit(F.col("__k"))).alias("__m")).hint("merge"), doc)
    keys = F.filter(F.array_distinct(F.concat(grams, F.split("y", ""))), lambda k: bit(k).bitwiseAND(F.col("__m")) != 0)
    by_gram = short.hint("merge").join(some.withColumn("__k", F.explode(keys)).drop("__m"), [doc, "__k"])
    met = by_word.unionByName(by_gram).where(F.contains("y", "x")).drop("__k")
    first = t.groupBy(doc).agg(F.min(F.struct(*[c for c in (*carry, "y")])).alias("f")).select(doc, "f.*")
    return met.unionByName(p.where("x = ''").drop("__k").join(first.hint("merge"), doc))


def not_contained(items: DataFrame, blobs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Items whose text stands in none of the document's texts nor holds one of
    them, in small letters."""
    x = items.select(doc, F.lower(F.col(text)).alias("x"))
    y = blobs.select(doc, F.lower(F.col(text)).alias("y"))
    inside = holding(y, x, doc).select(doc, "x")
    around = holding(x.withColumnRenamed("x", "y"), y.withColumnRenamed("y", "x"), doc).select(doc, F.col("y").alias("x"))
    hit = inside.unionByName(around).distinct()
    return items.withColumn("x", F.lower(F.col(text))).join(hit, [doc, "x"], "left_anti").drop("x")


def positional_differences(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """``(*key, a_value, b_value)`` of places that both sides have with other values."""
    x, y = a.select(*key, F.col(value).alias("a_value")), b.select(*key, F.col(value).alias("b_value"))
    return x.join(y, key).where(~F.col("a_value").eqNullSafe(F.col("b_value")))


@F.pandas_udf(LongType())
def _inverted(places: pd.Series) -> pd.Series:
    """Pairs in falling order: each place is put into the sorted ones before it."""
    from bisect import bisect_right, insort

    def one(seq) -> int:
        seen, n = [], 0
        for v in seq:
            n += len(seen) - bisect_right(seen, v)
            insort(seen, v)
        return n

    return places.map(one)


def inversions(pairs: DataFrame, doc: str = "doc_id", a: str = "a", b: str = "b") -> DataFrame:
    """``(doc, matched, inverted, ratio)``: pairs of a matching whose order differs
    on the two sides; ``pairs(doc, a, b)`` are places on both. The places of one
    document are counted by insertion into a sorted list, not by all pairs."""
    seq = pairs.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(a).alias("i"), F.col(b).alias("j")))), lambda x: x["j"].cast("long")).alias("s"))
    out = seq.select(doc, F.size("s").alias("matched"), _inverted("s").alias("inverted"))
    return out.withColumn("ratio", F.when(F.col("matched") > 1, F.col("inverted") / (F.col("matched") * (F.col("matched") - 1) / 2)).otherwise(0.0))


def fingerprint_places(source: DataFrame, target: DataFrame, words: Column, first: int = 8, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """``(doc, a, b)``: places of source and target texts that begin with the same
    ``first`` words; the first target place counts."""
    print_ = F.array_join(F.slice(words, 1, first), " ")
    s = source.where(F.size(words) >= first).select(doc, F.col(order).alias("a"), print_.alias("f"))
    t = target.where(F.size(words) >= first).groupBy(doc, print_.alias("f")).agg(F.min(order).alias("b"))
    return s.join(t, [doc, "f"]).select(doc, "a", "b")


def label_descents(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``(*key, labels, descents)``: lettered labels (a), (b) ... of each text and how
    often one follows a later one."""
    letters = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\(([a-z])\)"), F.lit(1)), F.ascii)
    got = rows.select(*key, letters.alias("l")).where(F.size("l") > 0)
    down = F.size(F.filter(F.zip_with("l", F.slice("l", F.lit(2), F.size("l")), lambda x, y: y < x), lambda z: F.coalesce(z, F.lit(False))))
    return got.select(*key, F.size("l").alias("labels"), down.alias("descents"))


def confirmed_missing(sentences: DataFrame, least_neighbour: float = 0.5, most: float = 0.1, key: str = "para_id") -> DataFrame:
    """Sentences of coverage below ``most`` one of whose neighbours is covered, with
    their place in the paragraph. ``sentences(key, no, coverage)``."""
    w = Window.partitionBy(key).orderBy("no")
    n = F.count("*").over(Window.partitionBy(key))
    rows = sentences.withColumns({"prev": F.lag("coverage").over(w), "next": F.lead("coverage").over(w), "k": F.row_number().over(w), "n": n})
    place = F.when(F.col("k") == 1, "first").when(F.col("k") == F.col("n"), "last").otherwise(F.concat_ws(" of ", F.col("k").cast("string"), F.col("n").cast("string")))
    hit = (F.col("coverage") < most) & (F.greatest(F.coalesce("prev", F.lit(0.0)), F.coalesce("next", F.lit(0.0))) >= least_neighbour)
    return rows.where(hit).select(key, "no", "coverage", place.alias("place"))


def truncated_heads(source: DataFrame, target: DataFrame, words: Column, head: int = 6, least_words: int = 15, tail: float = 0.65, doc: str = "doc_id", key: str = "para_id") -> DataFrame:
    """``(doc, key)``: source texts whose first ``head`` words stand together nowhere
    in the target while most words of four and more letters of the rest do."""
    w = F.col("__w")
    src, tgt = source.select(doc, key, words.alias("__w")), target.select(doc, words.alias("__w"))
    long_ = src.where(F.size(w) >= least_words)
    heads = long_.select(doc, key, F.xxhash64(F.slice(w, 1, head)).alias("g"))
    grams = tgt.select(doc, F.explode(T.gram_hashes(w, head)).alias("g")).distinct()
    lost = heads.join(grams, [doc, "g"], "left_anti").select(doc, key)
    rest = F.filter(F.slice(w, F.lit(head + 1), F.size(w)), lambda x: F.length(x) >= 4)
    r = long_.select(doc, key, F.explode(F.array_distinct(rest)).alias("w"))
    t = tgt.select(doc, F.explode(F.array_distinct(w)).alias("w")).distinct().withColumn("hit", F.lit(1))
    kept = r.join(t, [doc, "w"], "left").groupBy(doc, key).agg((F.count("hit") / F.count("*")).alias("c")).where(F.col("c") >= tail)
    return lost.join(kept, [doc, key], "left_semi")


def _guided(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best paragraph for each heading of one document, each used once."""
    taken, out = set(), []
    for h, g in sorted(pdf.groupby("h_ord"), key=lambda x: x[0]):
        for r in g.sort_values(["score", "p_ord"], ascending=[False, True]).itertuples():
            if r.p_ord not in taken:
                taken.add(r.p_ord)
                out.append((r.doc_id, h, r.p_ord, r.score))
                break
    return pd.DataFrame(out, columns=["doc_id", "h_ord", "p_ord", "score"])


def guided_split(headings: DataFrame, paragraphs: DataFrame, least: float = 0.75, kind: str = "bigint") -> DataFrame:
    """``(doc_id, h_ord, p_ord, score)``: where each heading of the target begins in a
    flat source: a paragraph that starts with it scores 0.9 and more, else the share
    of its content words, at least ``least``; each paragraph is used once."""
    hw, pw = T.content_words(F.col("h")), T.content_words(F.col("p"))
    h = headings.select("doc_id", F.col("idx").alias("h_ord"), F.col("text").alias("h")).withColumn("hw", F.array_distinct(hw))
    p = paragraphs.select("doc_id", F.col("idx").alias("p_ord"), F.col("text").alias("p")).withColumn("pw", F.array_distinct(pw))
    met = h.select("doc_id", "h_ord", "h", "hw", F.explode("hw").alias("w")).join(p.select("doc_id", "p_ord", "p", F.explode("pw").alias("w")), ["doc_id", "w"])
    s = met.groupBy("doc_id", "h_ord", "p_ord", "h", "p").agg((F.count("*") / F.max(F.size("hw"))).alias("c"))
    prefix = F.startswith(F.lower("p"), F.lower("h"))
    score = F.when(prefix, 0.9 + 0.1 * F.col("c")).otherwise(F.col("c"))
    return s.withColumn("score", score).where(F.col("score") >= least).select("doc_id", "h_ord", "p_ord", "score").groupBy("doc_id").applyInPandas(
        _guided, f"doc_id {kind}, h_ord int, p_ord int, score double"
    )


def _gaps(least: int):
    def run(source: pd.Series, target: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out = []
        for s, t in zip(source, target):
            a, b = (s or "").split(), (t or "").split()
            ops = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
            out.append([{"kind": k, "source": " ".join(a[i:j]), "target": " ".join(b[x:y])} for k, i, j, x, y in ops if k != "equal" and max(j - i, y - x) >= least])
        return pd.Series(out)

    return run


def word_gaps(pairs: DataFrame, source: str = "source_text", target: str = "target_text", least: int = 1) -> DataFrame:
    """Pairs with ``gaps``: runs of words deleted, inserted or replaced between two
    aligned texts."""
    udf = F.pandas_udf(_gaps(least), "array<struct<kind:string,source:string,target:string>>")
    return pairs.withColumn("gaps", udf(F.col(source), F.col(target)))


def cascade(items: DataFrame, stages: list[tuple[str, DataFrame, str]], doc: str = "doc_id", key: str = "text") -> DataFrame:
    """Items with the first stage that finds them, or null: ``stages`` are ``(name,
    texts, how)`` with how ``equal`` (same text), ``either`` (one holds the other) or
    ``within`` (the item stands in the text). The stages are looked up side by side and
    the first hit of each text is kept, so no stage repeats those before it."""
    rows = items.withColumn("__k", F.lower(F.col(key)))
    k = rows.select(doc, F.col("__k").alias("x")).distinct()
    hits = None
    for no, (_, texts, how) in enumerate(stages):
        t = texts.select(doc, F.lower("text").alias("y"))
        if how == "equal":
            hit = t.select(doc, F.col("y").alias("__k"))
        else:
            hit = holding(t, k, doc).select(doc, F.col("x").alias("__k"))
            if how == "either":
                around = holding(k.withColumnRenamed("x", "y"), t.withColumnRenamed("y", "x"), doc)
                hit = hit.unionByName(around.select(doc, F.col("y").alias("__k")))
        hit = hit.withColumn("__no", F.lit(no))
        hits = hit if hits is None else hits.unionByName(hit)
    if hits is None:
        return items.withColumn("found_by", F.lit(None).cast("string"))
    first = hits.groupBy(doc, "__k").agg(F.min("__no").alias("__no"))
    names = F.array(*[F.lit(name) for name, _, _ in stages])
    return rows.join(first, [doc, "__k"], "left").select(*items.columns, F.get(names, F.col("__no")).alias("found_by"))


def locate(items: DataFrame, lines: DataFrame, least_words: int = 2, doc: str = "doc_id", key: str = "heading_id", order: str = "idx") -> DataFrame:
    """``(doc, key, line)``: first line of the document that holds each item's text."""
    i = items.where(T.word_count(F.col("text")) >= least_words).select(doc, key, T.squeeze(F.lower("text")).alias("x"))
    t = lines.select(doc, F.col(order).alias("line"), T.squeeze(F.lower("text")).alias("y"))
    found = holding(t, i, doc, ("line",)).groupBy(doc, "x").agg(F.min("line").alias("line"))
    return i.join(found, [doc, "x"]).select(doc, key, "line")


def islands(lines: DataFrame, starts: Column, doc: str = "doc_id", order: str = "idx", block: int = 5000) -> DataFrame:
    """``(doc, section, heading, content)``: runs of lines, a new one at every line
    that ``starts`` marks; lines before the first are section 0 without heading.

    Sections are numbered in two steps, within blocks of lines and over the blocks,
    so a long document doesn't pass through one task.
    """
    rows = lines.withColumns({"__s": starts.cast("int"), "__b": F.expr(f"{order} div {block}")})
    base = rows.groupBy(doc, "__b").agg(F.sum("__s").alias("__n"))
    before = Window.partitionBy(doc).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(doc, "__b", "__before")
    inner = Window.partitionBy(doc, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.join(base, [doc, "__b"]).withColumn("section", (F.col("__before") + F.sum("__s").over(inner)).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__s") == 0, F.struct(order, "text")))), lambda x: x["text"]), " ")
    return numbered.groupBy(doc, "section").agg(F.max(F.when(F.col("__s") == 1, F.col("text"))).alias("heading"), body.alias("content"))


def staged_coverage(source: DataFrame, target: DataFrame, words: Column, doc: str = "doc_id", key: str = "para_id", grams: float = 0.55, single: float = 0.9, runs: float = 0.55) -> DataFrame:
    """``(doc, key, method, confidence)``: how each source text is covered: by its
    5-grams, else by its words, else by its windows; null if by none."""
    g = gram_coverage(source, target, words, 5, doc, key, short_texts=False).select(doc, key, F.col("coverage").alias("g"))
    w = word_containment(source, target, words, doc, key).select(doc, key, (F.col("hits") / F.col("words")).alias("w"))
    r = window_coverage(source, target, words, doc=doc, key=key).select(doc, key, (F.col("covered") / F.col("windows")).alias("r"))
    all_ = source.select(doc, key).join(g, [doc, key], "left").join(w, [doc, key], "left").join(r, [doc, key], "left")
    method = F.when(F.col("g") >= grams, "grams").when(F.col("w") >= single, "words").when(F.col("r") >= runs, "windows")
    value = F.when(method == "grams", F.col("g")).when(method == "words", F.col("w")).when(method == "windows", F.col("r"))
    return all_.select(doc, key, method.alias("method"), value.alias("confidence"))


def absent_items(source: DataFrame, target: DataFrame, words, least_items: int = 2, first: int = 12, doc: str = "doc_id", key: str = "para_id") -> DataFrame:
    """``(doc, key, no, item)``: items of enumerations whose first words stand
    together nowhere in the target; ``words`` makes the words of a text."""
    parts = source.select(doc, key, T.bullets(F.col("text")).alias("__b")).where(F.size("__b") >= least_items)
    items = parts.select(doc, key, F.posexplode("__b").alias("no", "item")).withColumn("__h", F.slice(words(F.col("item")), 1, first))
    items = items.withColumn("n", F.size("__h")).where("n > 0").withColumn("g", F.xxhash64("__h"))
    t = target.select(doc, words(F.col("text")).alias("__w"))
    # The lengths that a document's items have, at most ``first``; the target is read once.
    lengths = items.groupBy(doc).agg(F.collect_set("n").alias("__n"))
    spans = F.transform("__n", lambda n: F.struct(n.alias("n"), F.when(F.size("__w") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("__w") - n + 1), lambda i: F.xxhash64(F.slice("__w", i, n))))).otherwise(F.array().cast("array<bigint>")).alias("g")))
    grams = t.join(lengths, doc).select(doc, F.explode(spans).alias("s")).select(doc, "s.n", F.explode("s.g").alias("g")).distinct()
    return items.join(grams, [doc, "n", "g"], "left_anti").select(doc, key, "no", "item")


def sampled_values(values: DataFrame, blobs: DataFrame, k: int = 30, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """``(doc, sampled, missing)``: of the first ``k`` values of each document, those
    that stand nowhere in its text, neither plain nor escaped."""
    first = values.withColumn("__k", F.row_number().over(Window.partitionBy(doc).orderBy(order))).where(F.col("__k") <= k)
    escaped = F.replace(F.replace(F.replace("value", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    forms = first.select(doc, "__k", F.explode(F.array_distinct(F.array(F.col("value"), escaped))).alias("x"))
    held = holding(blobs.select(doc, F.col("text").alias("y")), forms, doc).select(doc, "x").distinct()
    hit = forms.join(held, [doc, "x"]).select(doc, "__k").distinct().withColumn("hit", F.lit(1))
    return first.join(hit, [doc, "__k"], "left").groupBy(doc).agg(F.count("*").alias("sampled"), F.count_if(F.col("hit").isNull()).alias("missing"))


def lower_cased(values: DataFrame, blobs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, value)``: values all in capitals that the target has only in small or
    capitalised letters."""
    v = values.where(T.all_caps(F.col("value")) & (F.length("value") > 2)).select(doc, "value").distinct()
    texts = blobs.select(doc, F.col("text").alias("y"))
    forms = v.select(doc, "value", F.explode(F.array(F.struct(F.lit(True).alias("same"), F.col("value").alias("x")), F.struct(F.lit(False).alias("same"), F.lower("value").alias("x")), F.struct(F.lit(False).alias("same"), F.initcap("value").alias("x")))).alias("f")).select(doc, "value", "f.*")
    held = holding(texts, forms, doc).select(doc, "x").distinct()
    # Merged, since Spark takes three forms for no larger than their value.
    met = forms.join(held.hint("merge"), [doc, "x"]).groupBy(doc, "value").agg(F.bool_or("same").alias("same"))
    return met.where(~F.col("same")).select(doc, "value")


def before_mark(rows: DataFrame, mark: Column, most: int = 8, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """The first ``most`` rows of each document (as many as an introduction is taken to
    have) that come before the first row that ``mark`` holds for."""
    first = rows.where(mark).groupBy(doc).agg(F.min(order).alias("__first"))
    early = rows.join(first, doc, "left").where(F.col("__first").isNull() | (F.col(order) < F.col("__first"))).drop("__first")
    return early.withColumn("__k", F.row_number().over(Window.partitionBy(doc).orderBy(order))).where(F.col("__k") <= most).drop("__k")
