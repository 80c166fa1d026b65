"""Corpus features, baselines and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, key: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``(*key, name...)``: for each share the value at ``int(n * share)`` in sorted
    order, counted from 0 and at most the last; over counted values, so large
    groups stay small."""
    w = Window.partitionBy(*key)
    c = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("__n"))
    c = c.withColumns({"__u": F.sum("__n").over(w.orderBy(value)), "__all": F.sum("__n").over(w)})
    pick = lambda s: F.least(F.floor(F.col("__all") * s), F.col("__all") - 1)
    hit = lambda s: F.min(F.when((F.col("__u") > pick(s)) & (F.col("__u") - F.col("__n") <= pick(s)), F.col(value)))
    return c.groupBy(*key).agg(*[hit(s).alias(name) for name, s in shares.items()])


def grouping_stats(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """``(a, b, grain, docs, mean, std, low, high)`` for all rows, each ``a``, each
    ``b`` and each pair, in one pass over grouping sets."""
    named = F.when(F.grouping_id() == 0, "both").when(F.grouping_id() == 1, "first").when(F.grouping_id() == 2, "second").otherwise("all")
    return rows.cube(a, b).agg(
        named.alias("grain"), F.count("*").alias("docs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("low"), F.max(value).alias("high"),
    )


def common_values(rows: DataFrame, key: list[str], doc: str, value: str, share: float = 0.5) -> DataFrame:
    """``(*key, value, docs)``: values that at least ``share`` of a group's documents have."""
    n = rows.select(*key, doc).distinct().groupBy(*key).agg(F.count("*").alias("all_docs"))
    have = rows.select(*key, doc, value).distinct().groupBy(*key, value).agg(F.count("*").alias("docs"))
    return have.join(n, key).where(F.col("docs") >= F.col("all_docs") * share).drop("all_docs")


def top_values(rows: DataFrame, key: list[str], value: str, k: int = 10) -> DataFrame:
    """``(*key, value, n, rank)``: the ``k`` most frequent values of each group; of
    equally frequent ones the smaller."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), value)
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_baseline(rows: DataFrame, stats: DataFrame, a: str, b: str, least_both: int = 3, least_first: int = 2) -> DataFrame:
    """Rows with ``base_grain, base_docs, base_mean, base_std``: the pair's figures if
    it has enough documents, else the first key's, else the second's, else all.

    Baselines hold one row for each group, so the joins are left to the optimizer.
    """
    s = stats.where((F.col("grain") != "both") | (F.col("docs") >= least_both)).where((F.col("grain") != "first") | (F.col("docs") >= least_first))
    figures = F.struct("grain", "docs", "mean", "std")
    both = s.where("grain = 'both'").select(F.col(a).alias("__a"), F.col(b).alias("__b"), figures.alias("s1"))
    first = s.where("grain = 'first'").select(F.col(a).alias("__a"), figures.alias("s2"))
    second = s.where("grain = 'second'").select(F.col(b).alias("__b"), figures.alias("s3"))
    everything = s.where("grain = 'all'").select(F.lit(1).alias("__one"), figures.alias("s4"))
    r = rows.withColumns({"__a": F.col(a), "__b": F.col(b), "__one": F.lit(1)})
    r = r.join(both, ["__a", "__b"], "left").join(first, "__a", "left").join(second, "__b", "left").join(F.broadcast(everything), "__one", "left")
    best = F.coalesce("s1", "s2", "s3", "s4")
    return r.withColumns({f"base_{x}": best[x] for x in ("grain", "docs", "mean", "std")}).drop("__a", "__b", "__one", "s1", "s2", "s3", "s4")


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """Distance from a mean in standard deviations; null if they don't vary."""
    return F.when(std > 0, (value - mean) / std)


def score_histogram(rows: DataFrame, value: str, width: int = 10) -> DataFrame:
    """``(bucket, n)`` of values in steps of ``width``."""
    return rows.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def keyword_class(text: Column, ordered: list[tuple[str, str]], default: str) -> Column:
    """Value of the first keyword (in order) that a text holds, in any case."""
    up = F.upper(text)
    out = F.lit(default)
    for keyword, value in reversed(ordered):
        out = F.when(F.contains(up, F.lit(keyword.upper())), F.lit(value)).otherwise(out)
    return out


def tag_features(docs: DataFrame, events: DataFrame, top: int = 30, key: str = "doc_id") -> DataFrame:
    """``(key, tags, kinds, top_tags)``: opening tags of each document, different ones
    and the ``top`` most frequent with their numbers. ``events(key, tag, opens)``."""
    w = Window.partitionBy(key).orderBy(F.desc("opens"), "tag")
    ranked = events.where("opens > 0").withColumn("k", F.row_number().over(w))
    f = ranked.groupBy(key).agg(
        F.sum("opens").alias("tags"), F.count("*").alias("kinds"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= top, F.struct("k", "tag", "opens")))), lambda x: F.struct(x["tag"].alias("tag"), x["opens"].alias("n"))).alias("top_tags"),
    )
    return docs.select(key).join(f, key, "left")


def score_summary(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """Number, mean, extremes and outer ranks of a score in each group."""
    s = rows.groupBy(*by).agg(F.count(score).alias("n"), F.round(F.avg(score), 2).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"))
    return s.join(nearest_rank(rows, by, score, {"p10": 0.1, "p90": 0.9}), by)


def share_of_maximum(rows: DataFrame, by: list[str], score: str, most: str, good: float = 0.85, bad: float = 0.7) -> DataFrame:
    """Mean share of the points reached in each group, and how many rows are good,
    bad or between."""
    share = F.when(F.col(most) > 0, F.col(score) / F.col(most))
    return rows.groupBy(*by).agg(F.avg(share).alias("share"), F.count_if(share >= good).alias("good"), F.count_if((share < good) & (share >= bad)).alias("fair"), F.count_if(share < bad).alias("bad"))


def first_look(raw: Column) -> dict[str, Column]:
    """What the tags of a raw text tell of its kind: quoted amendments, an ident block,
    parts and sections, special roots."""
    has = lambda p: F.regexp_like(raw, F.lit(p))
    return {"has_quote": has("<QUOTE"), "has_polident": has("<POLIDENT"), "has_part_sec": has(r"<(PART|SEC)[\s>]"), "is_tsx_special": has(r"<(MISCLAW|LEGIDDOC)[\s>]")}


# --- classes of filings ----------------------------------------------------------

# Words in a path or label, in order, and the jurisdiction they mean.
PATH_WORDS = (
    ("ALBERTA", "Alberta"), ("BRITISHCOLUMBIA", "BritishColumbia"), ("MANITOBA", "Manitoba"), ("NEWBRUNSWICK", "NewBrunswick"), ("NEWFOUNDLAND", "Newfoundland"), ("NFLD", "Newfoundland"),
    ("NOVASCOTIA", "NovScotia"), ("/NWT/", "NWT"), ("NUNAVUT", "Nunavut"), ("ONTARIO", "Ontario"), ("PEI", "PEI"), ("QUEBEC", "Quebec"), ("SASKATCHEWAN", "Saskatchewan"), ("TSX", "TSX"), ("TMX", "TSX"),
    ("CIRO", "CIRO"), ("IIROC", "CIRO"),
)
LABEL_WORDS = (
    ("ASC", "Alberta"), ("BCSC", "BritishColumbia"), ("MSC", "Manitoba"), ("NSSSC", "NovScotia"), ("OSC", "Ontario"), ("SFSA", "Saskatchewan"), ("TSX", "TSX"), ("TMX", "TSX"), ("CIRO", "CIRO"),
    ("IIROC", "CIRO"), ("CSA", "CSA"), ("NATIONAL INSTRUMENT", "National"), ("NI ", "National"),
)
# Folders, beginnings of labels (in order), words in labels and beginnings
# of numbers, and the jurisdiction of the corpus that they mean.
FOLDERS = {
    "Alberta": "Alberta", "British_Columbia": "British_Columbia", "CIRO_": "CIRO", "Manitoba": "Manitoba", "Montreal-Exchange": "Montreal", "NB_": "New_Brunswick", "NFLD_": "Newfoundland",
    "NS_": "Nova_Scotia", "NWT_": "NWT", "Ontario": "Ontario", "PEI": "PEI", "Quebec": "Quebec", "Saskatchewan": "Saskatchewan", "Toronto-Stock-Exchange": "TSX", "Yukon_": "Yukon",
}
LABEL_BEGINNINGS = (
    ("osc", "Ontario"), ("csa", "CSA_National"), ("ciro", "CIRO"), ("tmx", "TSX"), ("tsx", "TSX"), ("bcsc", "British_Columbia"), ("bc ", "British_Columbia"), ("bc instrument", "British_Columbia"),
    ("bc notice", "British_Columbia"), ("bc policy", "British_Columbia"), ("asc", "Alberta"), ("msc", "Manitoba"), ("ontario securities commission", "Ontario"), ("superintendent order", "Nova_Scotia"),
    ("advisory notice", "NWT"), ("blanket order", "British_Columbia"), ("csa multilateral", "CSA_National"), ("multilateral instrument", "CSA_National"), ("national instrument", "CSA_National"),
)
LABEL_PARTS = (("csa", "CSA_National"), ("ciro", "CIRO"), ("tmx", "TSX"), ("tsx", "TSX"))
NUMBER_BEGINNINGS = (
    ("11-", "CSA_National"), ("13-", "CSA_National"), ("23-", "CSA_National"), ("24-", "CSA_National"), ("25-", "British_Columbia"), ("31-", "CSA_National"), ("33-", "CSA_National"), ("35-", "Alberta"),
    ("41-", "CSA_National"), ("44-", "Nova_Scotia"), ("45-", "CSA_National"), ("51-", "Ontario"), ("71-", "CSA_National"), ("81-", "CSA_National"), ("91-", "Quebec"), ("93-", "Quebec"), ("94-", "Quebec"),
    ("96-", "British_Columbia"), ("TSX", "TSX"), ("By-Law", "TSX"),
)
# Words in a file's name that tell its kind.
SPECIAL_NAMES = ("By-Law", "By-law", "ByLaw", "by-law", "bylaw", "Form", "form", "Capital-Markets-Tribunal")
AMENDING_NAMES = ("amending", "amendment", "implementing")


def _first(tests: list[tuple[Column, Column]]) -> Column:
    """Value of the first test that holds, else null."""
    out = F.lit(None).cast("string")
    for hit, value in reversed(tests):
        out = F.when(hit, value).otherwise(out)
    return out


def jurisdiction(path: Column, label: Column) -> Column:
    """Jurisdiction by the words of a path, else of a label, else Unknown."""
    said = lambda text, table: keyword_class(F.coalesce(text, F.lit("")), list(table), "")
    return F.coalesce(F.nullif(said(path, PATH_WORDS), F.lit("")), F.nullif(said(label, LABEL_WORDS), F.lit("")), F.lit("Unknown"))


def corpus_jurisdiction(path: Column, label: Column, number: Column) -> Column:
    """``(code, method)`` of the corpus: by a folder of the path, else by how the label
    begins or what it holds, else by how the number begins."""
    folders = F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/")
    table = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    folder = F.get(F.filter(folders, lambda x: F.map_contains_key(table, x)), F.lit(0))
    small = F.lower(label)
    label_code = _first([(F.startswith(small, F.lit(a)), F.lit(b)) for a, b in LABEL_BEGINNINGS])
    part_code = _first([(F.contains(small, F.lit(a)), F.lit(b)) for a, b in LABEL_PARTS])
    number_code = _first([(F.startswith(number, F.lit(a)), F.lit(b)) for a, b in NUMBER_BEGINNINGS])
    one = lambda code, method: F.struct(code.alias("code"), method.alias("method"))
    return (
        F.when(folder.isNotNull(), one(F.try_element_at(table, folder), F.lit("directory_path"))).when(label_code.isNotNull(), one(label_code, F.concat(F.lit("label:"), label)))
        .when(part_code.isNotNull(), one(part_code, F.concat(F.lit("label_partial:"), label))).when(number_code.isNotNull(), one(number_code, F.concat(F.lit("doc_number:"), number)))
        .otherwise(one(F.lit("unknown"), F.lit("undetected")))
    )


def has_parts(raw: Column) -> Column:
    """Whether a text is built of parts or sections, as instruments are; others are notices."""
    return F.regexp_like(raw, F.lit(r"<(?:PART|SEC)[\s>]"))


def filing_class(raw: Column, path: Column, name: Column) -> Column:
    """``(lang, doc_type, jurisdiction, has_quote, has_polident, is_special,
    has_part_sec, label, adddate, confidence)`` of a raw text and its file."""
    first = lambda p: F.nullif(F.regexp_extract(raw, p, 1), F.lit(""))
    has = lambda p: F.regexp_like(raw, F.lit(p))
    label, place = F.coalesce(first('LABEL="([^"]+)"'), F.lit("")), jurisdiction(path, first('LABEL="([^"]+)"'))
    named = lambda words, text: F.coalesce(sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    quote, ident, parts = has(r"<QUOTE[\s>]"), has(r"<POLIDENT[\s>]"), has_parts(raw)
    special = ~ident & ((place == "TSX") | named(SPECIAL_NAMES, name))
    amending = named(AMENDING_NAMES, F.lower(name))
    kind = F.when(special, "TSX_SPECIAL").when(quote | amending, "AMENDMENT").when(parts, "INSTRUMENT").otherwise("NOTICE")
    sure = F.when(special, 0.95).when(quote, 0.98).when(amending, 0.85).when(parts, 0.9).otherwise(0.85)
    return F.struct(
        F.coalesce(first('LANG="(EN|FR)"'), F.lit("EN")).alias("lang"), kind.alias("doc_type"), place.alias("jurisdiction"), quote.alias("has_quote"), ident.alias("has_polident"), special.alias("is_special"),
        parts.alias("has_part_sec"), label.alias("label"), F.coalesce(first('ADDDATE="([^"]+)"'), F.lit("")).alias("adddate"), sure.alias("confidence"),
    )


# --- neighbours ------------------------------------------------------------------


def adjacent(rows: DataFrame, key: list[str], order: list[str], value: str, block: Column, out: str = "next") -> DataFrame:
    """Rows with the ``value`` of the next row of their key in ``order`` as ``out``.

    A key's rows are ordered within blocks of bounded size (``block`` must rise with the
    order) and the blocks' ends are joined, so a key of very many rows doesn't pass
    through one task."""
    rows = rows.withColumn("__b", block)
    inner, over = Window.partitionBy(*key, "__b").orderBy(*order), Window.partitionBy(*key).orderBy("__b")
    firsts = rows.groupBy(*key, "__b").agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__f")).withColumn("__n", F.lead("__f").over(over)).drop("__f")
    rows = rows.withColumn("__v", F.lead(F.struct(F.col(value).alias("v"))).over(inner))
    met = [rows[k].eqNullSafe(firsts[k]) for k in [*key, "__b"]]
    joined = rows.join(firsts, met, "left")
    return joined.select(*[rows[c] for c in rows.columns if c not in ("__b", "__v")], F.coalesce(rows["__v"], firsts["__n"])["v"].alias(out))


def numbered(rows: DataFrame, key: list[str], order: list[str], block: Column, out: str = "k") -> DataFrame:
    """Rows with their number in their key's ``order``, from 1, counted within blocks as
    ``adjacent`` does and over the blocks."""
    rows = rows.withColumn("__b", block)
    before = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*key, "__b").agg(F.count("*").alias("__c")).withColumn("__s", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*key, "__b").orderBy(*order)))
    met = [rows[k].eqNullSafe(sizes[k]) for k in [*key, "__b"]]
    return rows.join(sizes, met).select(*[rows[c] for c in rows.columns if c not in ("__b", "__i")], (rows["__i"] + sizes["__s"]).cast("int").alias(out))


def falling_dates(rows: DataFrame, key: str, order: list[str], date: str, block: Column) -> DataFrame:
    """Rows of a key whose successor has an earlier date, with it as ``next_<date>``."""
    name = f"next_{date}"
    return adjacent(rows, [key], order, date, block, name).where(F.col(name) < F.col(date))


def number_gaps(rows: DataFrame, key: str, number: str, most: int, width: int = 100_000) -> DataFrame:
    """``(key, number, next_<number>)``: neighbouring numbers of a key that lie more than
    ``most`` apart."""
    name = f"next_{number}"
    return adjacent(rows.select(key, number).distinct(), [key], [number], number, F.expr(f"{number} div {width}"), name).where(F.col(name) - F.col(number) > most)


def repeats(rows: DataFrame, name: str, order: str, width: int = 100_000) -> DataFrame:
    """Rows whose ``name`` (in any case) an earlier row of the ``order`` has, with the
    number of the time ``k``; no name repeats none."""
    keyed = rows.where(F.col(name).isNotNull()).withColumn("__name", F.upper(name))
    return numbered(keyed, ["__name"], [order], F.expr(f"{order} div {width}")).where("k > 1").drop("__name")


def known_values(rows: DataFrame, value: str) -> DataFrame:
    """The different values of a column, without null."""
    return rows.select(value).where(F.col(value).isNotNull()).distinct()
