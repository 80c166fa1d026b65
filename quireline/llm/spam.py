"""Problem 8: pages of repeated keywords, links or product tags.

Method: term recurrence and positional autocorrelation. A page is read as sequences
of terms: each running line is one, and short lines in a row together are one; an
address is a term like any. In windows of a sequence the gaps between the recurrences
of every term and the autocorrelation at short lags, weighed by the length of the
terms, tell whether words come back too regularly for sentences; text of scripts
without blanks is read in windows of n-grams of signs as well. Lists of many different
names (parts of a line between separators, or short lines) that hold hardly a function
word and no final mark are the second kind; function words are those that a great part
of a language's pages hold, counted over all pages. Both kinds are weighed by length
against sentences; menus, notices, titles and footers weigh on neither side.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quireline.llm.common import need, spread

#: Terms of a window, longest lag, least regularity of stuffed text.
WINDOW, MAX_LAG, LEAST_REGULAR = 48, 7, 0.3
#: Longest mean gap of a term that recurs regularly, largest spread of its gaps.
MEAN_GAP, GAP_SPREAD = 8.0, 0.75
#: Terms to one final mark in running text, and the regularity that is too much even
#: there.
SENTENCE_TERMS, FAR_TOO_REGULAR = 16, 0.35
#: Signs of a term from which on it is a clause of a script without blanks.
CLAUSE_SIGNS = 7
#: Signs of an n-gram, of a window of n-grams and of the longest mean gap between
#: the recurrences of one, in text without blanks; three times as many where each
#: sign was garbled into three.
GRAM, GRAM_WINDOW, GRAM_GAP = 4, 200, 24
#: Signs to one final mark in running text of such a script, and the share of n-grams
#: that is too much even there.
SENTENCE_SIGNS, FAR_TOO_MANY_GRAMS = 3 * SENTENCE_TERMS, 0.6
#: Terms of a short line.
SHORT_LINE = 9
#: Parts and terms of a list at least, its mean length of a part in terms.
MANY_PARTS, MANY_TERMS, PART_TERMS = 16, 20, 6.0
#: Most function words among the terms of a list's different parts.
MOST_FUNCTION = 0.3
#: Fewest different terms among those of a list's windows, on average.
LEAST_DISTINCT = 0.25
#: Part of a language's pages that hold a function word at least.
FUNCTION_SHARE = 0.5
#: Share of the own text above which a page is spam.
LEAST_SHARE = 0.5

LINK = "<link>"
#: How a text is cut into terms, and signs that aren't part of one at its ends; Java's
#: and Python's expressions read it alike.
URL, BETWEEN = r"https?://[^\s)\]]+|www\.[^\s)\]]+", r"[\s,;|、，。！？；]+"
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’¿¡।؟—–·•…「」『』（）"

_URL = re.compile(URL)
_BETWEEN = re.compile(BETWEEN)
_END = re.compile(r"[^\W\d_][\])\"»”’]*\s?[.!?…][\"»”)\]’]*(?=\s|$)|[。！？।؟][”」»\")]*")
_PARTS = re.compile(r"\s+[|·•*/＊»>–—-]{1,2}\s+|\s*[|,;、，]\s*|\t|(?:^|\s)#")
_WIDE = re.compile("[぀-ヿ㐀-鿿]")
_MARKS = frozenset("。！？；、，.!?「」『』（）()“”")
_GARBLED = re.compile("[\x80-\xff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122\ufffd]")
_FOOTER = re.compile(r"(?:19|20)\d\d \S+\.\w{2,} \|")
_NAV = re.compile(r"\s(?:[|>›»·•]|/)\s")

Terms = list[tuple[str, int]]


def terms(line: str) -> Terms:
    """Terms of a line in small letters and their lengths; every address is one kind
    of term."""
    small = line.lower()
    out: Terms = []
    at = 0
    for m in [*_URL.finditer(small), None] if "http" in small or "www." in small else [None]:
        for t in _BETWEEN.split(small[at : m.start()] if m else small[at:]):
            t = t.strip(EDGE)
            if t:
                out.append((t, len(t)))
        if m:
            out.append((LINK, m.end() - m.start()))
            at = m.end()
    return out


def function_words(pages: DataFrame, text: str = "text", lang: str = "lang", share: float = FUNCTION_SHARE) -> frozenset[str]:
    """Words that ``share`` of the pages of some language label hold at least, within
    two standard errors, counted over all pages before any shuffle.

    Bounded whatever the number of pages: of each label there can be no more than the
    mean number of different words of a page divided by ``share``; labels are cut to
    two letters. Pages with null text or label count nowhere.
    """
    label = F.lower(F.substring(F.trim(F.col(lang)), 1, 2))
    rows = pages.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).withColumn("l", label)
    total = rows.groupBy("l").agg(F.count("*").alias("all"))
    words = F.array_distinct(F.split(F.lower(F.regexp_replace(F.col(text), URL, " ")), BETWEEN))
    counts = rows.select("l", F.explode(words).alias("w")).where("w != ''").groupBy("l", "w").agg(F.count("*").alias("n"))
    often = counts.join(F.broadcast(total), "l").where(F.col("n") - 2 * F.sqrt("n") >= share * F.col("all"))
    return frozenset(r["w"].strip(EDGE) for r in often.select("w").distinct().collect()) - {""}


def regularity(codes: np.ndarray, size: np.ndarray) -> float:
    """How regularly terms come back, 0 to 1, by length: the greater of the best
    autocorrelation within ``MAX_LAG`` (a lag and its neighbour together, since
    fillers shift the beat) and the share of terms whose gaps are short and even.
    Equal ``codes`` are one term, negative ones prove nothing."""
    n = len(codes)
    if n < 8:
        return 0.0
    plain = codes >= 0
    total = float(size.sum())
    kinds, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
    lags = []
    for k in range(1, min(MAX_LAG, n // 2) + 1):
        same = (codes[k:] == codes[:-k]) & plain[k:]
        lags.append(float(size[k:][same].sum() / size[k:].sum()))
    best = max([a + b for a, b in zip(lags, lags[1:])] + lags)
    even = 0.0
    for k in np.flatnonzero((counts >= 4) & (kinds >= 0)):
        at = np.flatnonzero(place == k)
        gaps = np.diff(at)
        if gaps.mean() <= MEAN_GAP and gaps.std() <= GAP_SPREAD * gaps.mean():
            even += float(size[at].sum())
    return max(best, even / total)


def stuffed_share(line_terms: Terms, ends: int, function: frozenset) -> float:
    """Share of a sequence's length that lies in windows of unnaturally regular
    repetition; ``ends`` is the number of final marks in it."""
    n = len(line_terms)
    if n < 10:
        return 0.0
    counts: dict[str, int] = {}
    for t, _ in line_terms:
        counts[t] = counts.get(t, 0) + 1
    # Function words recur in every language, and so do figures and letters that count
    # or measure; their beat proves nothing. Nor do signs that a wrong charset erased.
    codes_of = {t: k for k, t in enumerate(t for t, c in counts.items() if c > 1 and not proves_nothing(t, function))}
    if not codes_of:
        return 0.0
    codes = np.array([codes_of.get(t, -1 - i) for i, (t, _) in enumerate(line_terms)])
    size = np.array([k for _, k in line_terms], dtype=float)
    upto = np.concatenate([[0.0], np.cumsum(size)])
    again = np.concatenate([[0.0], np.cumsum(np.where(codes >= 0, size, 0.0))])
    least = FAR_TOO_REGULAR if ends * SENTENCE_TERMS >= n else LEAST_REGULAR
    hit = np.zeros(n)
    seen = np.zeros(n)
    for a in range(0, max(1, n - WINDOW // 2), WINDOW // 2):
        b = min(n, a + WINDOW)
        seen[a:b] += 1
        # Each match is a term that was there before; with too few of those no lag, nor
        # two together, can reach the least regularity, and neither can even gaps.
        if again[b] - again[a] >= LEAST_REGULAR / 2 * (upto[b] - upto[a]) * (b - a - MAX_LAG) / (b - a):
            hit[a:b] += regularity(codes[a:b], size[a:b]) >= least
    if not hit.any():
        return 0.0
    return float(size[hit / np.maximum(seen, 1) >= 0.5].sum() / size.sum())


def proves_nothing(t: str, function: frozenset) -> bool:
    """Whether the recurrence of a term tells nothing."""
    if t == LINK:
        return False
    wide = bool(_WIDE.search(t))
    return t in function or t.isdigit() or len(t) < 3 and not wide or 2 * t.count("\ufffd") >= len(t) or wide and len(t) >= CLAUSE_SIGNS


def gram_cover(codes: np.ndarray, size: int, gap: float) -> float:
    """Share of the signs that lie in n-grams whose recurrences are short and even
    gaps apart; ``codes`` has the n-gram that begins at each sign, negative if it
    proves nothing."""
    order = np.argsort(codes, kind="stable")
    kinds, starts, counts = np.unique(codes[order], return_index=True, return_counts=True)
    covered = np.zeros(len(codes) + size - 1, dtype=bool)
    for k in np.flatnonzero((counts >= 4) & (kinds >= 0)):
        at = order[starts[k] : starts[k] + counts[k]]
        gaps = np.diff(at)
        # An n-gram that overlaps itself is a row of one sign, a rule or dots.
        if size <= gaps.mean() <= gap and gaps.std() <= GAP_SPREAD * gaps.mean():
            for a in at:
                covered[a : a + size] = True
    return float(covered.mean())


def stuffed_grams(line: str, ends: int) -> float:
    """Share of a line of a script without blanks, garbled or not, that lies in
    windows whose n-grams recur too regularly; 0 for other lines."""
    garbled = 2 * len(_GARBLED.findall(line)) >= len(line)
    if not garbled and 3 * len(_WIDE.findall(line)) < len(line):
        return 0.0
    unit = 3 if garbled else 1
    size, window = GRAM * unit, GRAM_WINDOW * unit
    n = len(line) - size + 1
    if n < 3 * size:
        return 0.0
    names: dict[str, int] = {}
    grams = [line[i : i + size] for i in range(n)]
    # Keywords hold no marks; signs that a wrong charset has erased prove nothing.
    codes = np.array([-1 if 2 * g.count("\ufffd") >= size or not _MARKS.isdisjoint(g) else names.setdefault(g, len(names)) for g in grams])
    least = FAR_TOO_MANY_GRAMS if ends * SENTENCE_SIGNS >= len(line) else LEAST_REGULAR
    hit = np.zeros(n)
    seen = np.zeros(n)
    for a in range(0, max(1, n - window // 2), window // 2):
        b = min(n, a + window)
        hit[a:b] += gram_cover(codes[a:b], size, GRAM_GAP * unit) >= least
        seen[a:b] += 1
    return float(np.mean(hit / np.maximum(seen, 1) >= 0.5))


def is_list(parts: list[str], ends: int, function: frozenset) -> bool:
    """Many short parts of many different terms, hardly a final mark or function word
    among the different parts. What repeats few terms is left to their recurrence."""
    if len(parts) < MANY_PARTS:
        return False
    words = [terms(p) for p in parts]
    n = sum(map(len, words))
    if n < MANY_TERMS or n / len(parts) > PART_TERMS or ends > len(parts) / 10:
        return False
    flat = [t for w in words for t, _ in w]
    windows = [flat[i : i + WINDOW] for i in range(0, n, WINDOW)]
    if sum(len(set(w)) for w in windows) < LEAST_DISTINCT * n:
        return False
    # A keyword may hold a function word; repeated parts count once.
    kinds = [t for w in {tuple(t for t, _ in w) for w in words} for t in w]
    return sum(t in function for t in kinds) <= MOST_FUNCTION * len(kinds)


def stuffed(text: str, line_terms: Terms, ends: int, function: frozenset) -> float:
    """Share of a sequence that is repeated keywords or links, by terms or n-grams."""
    return max(stuffed_share(line_terms, ends, function), stuffed_grams(text, ends))


def weigh(text: str, function: frozenset) -> tuple[float, float]:
    """Code points of ``text`` in repeated keywords, links or tags, and in sentences."""
    spam = prose = 0.0
    block: list[tuple[str, Terms]] = []

    def close() -> None:
        """Weigh short lines in a row: a list, or a menu and a title."""
        nonlocal spam
        if block:
            size = sum(len(line) for line, _ in block)
            if is_list([line for line, _ in block], 0, function):
                spam += size
            else:
                spam += size * stuffed("\n".join(line for line, _ in block), [t for _, w in block for t in w], 0, function)
        block.clear()

    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        if _FOOTER.search(line) and len(line) < 160:
            close()
            continue
        words = terms(line)
        bare = _URL.sub(" ", line)
        ends = len(_END.findall(bare))
        length = len(words) + len(_WIDE.findall(line)) / 2
        if length < SHORT_LINE and not ends or len(bare) < len(line) and not ends and length < 2 * SHORT_LINE:
            block.append((line, words))
            continue
        close()
        if is_list([p for p in _PARTS.split(line) if p], ends, function):
            spam += len(line)
        elif not (len(_NAV.findall(line)) >= 2 and ends == 0 and len(words) < 40):
            share = stuffed(line, words, ends, function)
            spam += share * len(line)
            prose += (1 - share) * len(line)
    close()
    return spam, prose


WEIGHT = StructType([StructField("spam", DoubleType()), StructField("prose", DoubleType())])


def weigh_udf(function: frozenset):
    """``weigh`` with these function words."""

    @F.pandas_udf(WEIGHT)
    def run(text: pd.Series) -> pd.DataFrame:
        rows = [weigh(t, function) if isinstance(t, str) else (None, None) for t in text]
        return pd.DataFrame(rows, columns=["spam", "prose"], dtype=float)

    # Declared not deterministic, lest the optimizer evaluates it once more for a filter.
    return run.asNondeterministic()


def spam_share(pages: DataFrame, text: str = "text", out: str = "spam_share", function: frozenset = frozenset()) -> DataFrame:
    """``pages`` with the share of the own text that is repeated keywords, links or
    tags in column ``out`` (replaced if there); ``function`` are the function words.

    Null text gives null; a text that has neither such parts nor sentences 0. No
    shuffle but to spread a scan of too few pieces.
    """
    need(pages, text)
    w = spread(pages).withColumn("__w", weigh_udf(function)(F.col(text)))
    total = F.col("__w.spam") + F.col("__w.prose")
    share = F.when(F.col(text).isNull(), None).when(total > 0, F.col("__w.spam") / total).otherwise(0.0)
    return w.withColumn(out, share).drop("__w")


def spam_pages(pages: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``(doc_id, spam_share)`` of the pages more than ``least`` of whose own text
    is spam. Pages resent with the same id count once; mirrors count each."""
    need(pages, "doc_id", "text", "lang")
    rows = pages.select("doc_id", "text").where(F.col("text").isNotNull())
    return spam_share(rows, function=function_words(pages)).where(F.col("spam_share") > least).select("doc_id", "spam_share").dropDuplicates(["doc_id"])
