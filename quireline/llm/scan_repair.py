"""Problem 2: continuous, rightly spelled paragraphs from scanned pages.

Method: sequence labelling of printed lines. A hidden Markov model with the
states head, body, break (last line of a paragraph), aside and foot reads the
lines of a page with layout features (place on the page, length, shape of numbers,
recurrence on other pages, endings); its tables are counted on a bounded sample of
filings whose lines can be found in the marked-up text. Lines labelled head or
foot are page furniture. Body lines are then reassembled: a word that a line end
breaks is joined with the next body line's first word, and words that the corpus
doesn't know are repaired over a table of confused signs.

Words are looked up in a lexicon counted over all marked-up texts. Lines travel in
page blocks of bounded size, words as distinct strings in equi-joins; nothing but
the sample and the most frequent words reaches the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quireline.llm.common import cut, need
from quireline.llm.unify import look_key, transducer

HEAD, BODY, BREAK, ASIDE, FOOT = range(5)
STATES = ("head", "body", "break", "aside", "foot")
#: Training sample: filings (at most twice as many), pages of each that are read, length
#: and number of marked-up paragraphs of each.
SAMPLE_FILINGS, SAMPLE_PAGES, SAMPLE_SIGNS, SAMPLE_TEXTS = 300, 200, 20_000, 200
#: Lines from which on a page travels in several blocks of as many.
BLOCK_LINES = 400
#: Most frequent words that are broadcast, to leave the known words where they are.
COMMON_WORDS = 4_000

# What recognition makes of letters and figures (wrong, right).
CONFUSED = (
    ("c", "e"), ("!", "i"), ("f", "t"), ("@", "a"), ("0", "o"), ("5", "s"), ("1", "l"), ("1", "i"), ("n", "u"), ("u", "n"),
    ("9", "g"), ("rn", "m"), ("b", "h"), ("6", "é"), ("vv", "w"), ("h", "li"), ("d", "cl"), ("m", "rn"), ("l", "i"),
    ("8", "b"), ("|", "l"), ("|", "i"),
)
FIGURES = {"O": "0", "o": "0", "Q": "0", "l": "1", "I": "1", "|": "1", "i": "1", "!": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "b": "6"}
BREAKS = "-‐\xad¬"
#: Words after a hyphen that ends its word ("short- and long-term").
SUSPENDING = frozenset("and or et ou y o u e und oder bzw sowie to bis".split())

_EDGE = "\"'()[]{}<>«»“”„‘’‚.,;:?…¿¡*†‡§$€£¥%·•—–"
_ROMAN = re.compile(r"[ivxlcdm]{1,6}\Z", re.I)
_NUMBERISH = re.compile(r"[\d\[\]().,/–—-]+\Z")
_FIGURE_WORD = re.compile(r"[0-9OoQlI|i!SsBZzgb]+(?:[.,:'/-][0-9OoQlI|i!SsBZzgb]+)*\Z")
_MUST = re.compile(r"[@!|0-9]")
_WORDS = re.compile(r"[^\W\d_]+")
_END_MARK = re.compile(r"[.!?…:;。！？।؟]\s*[\"'»”’)\]」』]*\s*\Z")


# --- lines ---------------------------------------------------------------


def fold(word: str) -> str:
    """A word with the signs that recognition confuses fallen together."""
    w = word.lower().translate(str.maketrans("01!5@9638|", "oiisageebi")).replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("li", "h")
    return w.replace("l", "i").translate(str.maketrans("ctuhé", "efnbe"))


def shape(text: str) -> str:
    """Kind of line by its numbers and capitals."""
    t = text.strip()
    words = t.split()
    if not words:
        return "empty"
    if len(words) > 12 or len(words) > 7 and " / " not in t:
        return "text"
    core = [w.strip(_EDGE + "-") for w in words]
    numeric = [not c or bool(_NUMBERISH.match(c)) or bool(_FIGURE_WORD.match(c)) and any(x.isdigit() for x in c) for c in core]
    if re.fullmatch(r"[\[(–—-]\s*\S{1,4}\s*[\])–—-]", t):
        return "marked number"
    if len(words) == 1 and _ROMAN.match(core[0]):
        return "roman"
    if all(numeric):
        return "number"
    if " / " in t and numeric[-1] and len(words) <= 12:
        return "slashes"
    if len(words) > 7 or _OTHER_SCRIPT.search(t):
        return "text"
    if re.match(r"\(\s*\)", t):
        return "form"
    if len(words) == 4 and numeric[1] and numeric[3]:
        return "page of"
    upper = sum(1 for c in core if c[:1].isupper())
    caps = upper and upper >= 0.5 * sum(1 for c in core if c and not c[:1].isdigit())
    if caps and not _END_MARK.search(t):
        if numeric[0] or words[0].startswith("["):
            return "number title"
        if numeric[-1] or _ROMAN.match(core[-1]):
            return "title number"
        if any(re.search(r"\d-\d", w) for w in words):
            return "title with number"
        return "title"
    return "text"


def initial(text: str) -> str:
    """Kind of the first sign of a text."""
    c = text.lstrip()[:1]
    return "small" if c.islower() else "capital" if c.isupper() else "figure" if c.isdigit() else "letter" if c.isalpha() else "mark" if c else ""


def line_features(lines: list[str], first: int, last: int, at: list[int], again: list[int], after: str = "") -> list[tuple]:
    """Layout features of each line of a block. ``first`` and ``last`` are the
    places of the page's ends, ``at`` those of the lines, ``again`` on how many
    pages each masked line occurs, ``after`` the line that follows the block. Lengths
    are relative to the block's usual line."""
    out = []
    lengths = sorted(map(len, lines))
    width = max(60, lengths[int(0.8 * len(lengths))]) if lengths else 60
    for i, t in enumerate(lines):
        top, bottom = min(at[i] - first, 2), min(last - at[i], 2)
        share = len(t) / width
        size = 0 if share < 0.3 else 1 if share < 0.6 else 2 if share < 0.85 else 3
        nxt = lines[i + 1] if i + 1 < len(lines) else after
        s = t.rstrip()
        end = "mark" if _END_MARK.search(s) else "hyphen" if s[-1:] in BREAKS else "open"
        out.append((
            ("place", top, bottom), ("shape", shape(t), size),
            ("again", min(again[i], 3), size, min(top, bottom, 2) if size < 3 and again[i] > 1 else 2),
            ("end", end, initial(nxt)), ("start", initial(t)),
            ("running", again[i] > 1 and size < 3 and min(top, bottom) <= 1 and end == "open" and initial(t) in ("capital", "figure", "mark")),
        ))
    return out


@dataclass
class LineModel:
    """Tables of the hidden Markov model, in logarithms."""

    start: list[float]
    step: list[list[float]]
    stop: list[float]
    emit: list[dict] = field(default_factory=list)
    unseen: list[dict] = field(default_factory=list)
    known: dict = field(default_factory=dict, compare=False)

    def scores(self, feats: tuple) -> list[float]:
        """Score of every state for a line with these features; lines look alike, so
        they are remembered."""
        got = self.known.get(feats)
        if got is None:
            got = [sum(e.get(f, u.get(f[0], -8.0)) for f in feats) for e, u in zip(self.emit, self.unseen)]
            if len(self.known) < 100_000:
                self.known[feats] = got
        return got

    def decode(self, feats: list[tuple], enter: list[float] | None = None, leave: list[float] | None = None) -> list[int]:
        """Most probable states (Viterbi). ``enter`` and ``leave`` are the scores of the
        first and last state; by default those of a page's ends."""
        if not feats:
            return []
        if not self.emit:
            return [BODY] * len(feats)
        best = [a + b for a, b in zip(enter or self.start, self.scores(feats[0]))]
        back = []
        for f in feats[1:]:
            here = self.scores(f)
            row, new = [0] * len(STATES), [0.0] * len(STATES)
            for s, before in enumerate(COMES_FROM):
                top, k = -1e18, before[0]
                for r in before:
                    v = best[r] + self.step[r][s]
                    if v > top:
                        top, k = v, r
                row[s], new[s] = k, top + here[s]
            back.append(row)
            best = new
        stop = leave or self.stop
        s = max(range(len(STATES)), key=lambda r: best[r] + stop[r])
        out = [s]
        for row in reversed(back):
            s = row[s]
            out.append(s)
        return out[::-1]

    def through(self, feats: list[tuple]) -> np.ndarray:
        """Best score of a block's lines for every first (row) and last state (column)."""
        if not self.emit:
            return np.zeros((len(STATES), len(STATES)))
        step = np.array(self.step)
        best = np.where(np.eye(len(STATES), dtype=bool), np.array(self.scores(feats[0])), NEVER)
        for f in feats[1:]:
            best = (best[:, :, None] + step[None]).max(1) + np.array(self.scores(f))
        return best

    def borders(self, blocks: list[np.ndarray]) -> list[tuple[int, int]]:
        """First and last state of each block on the best path of their whole page;
        ``blocks`` are what ``through`` gives, in order."""
        if not self.emit:
            return [(BODY, BODY)] * len(blocks)
        step, back = np.array(self.step), []
        at = np.array(self.start)
        for m in blocks:
            # How the block's first state is best reached, then its last one.
            reach = (at[:, None] + step) if back else np.where(np.eye(len(STATES), dtype=bool), at, NEVER)
            first = reach.max(0)[:, None] + m
            back.append((reach.argmax(0), first.argmax(0)))
            at = first.max(0)
        out, s = [], int((at + np.array(self.stop)).argmax())
        for before, first in reversed(back):
            q = int(first[s])
            out.append((q, s))
            s = int(before[q])
        return out[::-1]


#: Score of what can't be.
NEVER = -1e12


def only(state: int) -> list[float]:
    """Scores that leave one state."""
    return [0.0 if s == state else NEVER for s in range(len(STATES))]


#: Steps that a page allows: heads come first, feet last.
ALLOWED = {HEAD: (HEAD, BODY, BREAK, ASIDE), BODY: (BODY, BREAK, ASIDE, FOOT), BREAK: (BODY, BREAK, ASIDE, FOOT), ASIDE: (BODY, BREAK, ASIDE, FOOT), FOOT: (FOOT,)}
COMES_FROM = tuple(tuple(r for r in ALLOWED if s in ALLOWED[r]) for s in range(len(STATES)))


def fit_lines(pages: list[tuple[list[tuple], list[int]]], smooth: float = 0.02) -> LineModel:
    """Model counted on labelled pages (features and states of their lines)."""
    n = len(STATES)
    if not any(states for _, states in pages):
        return LineModel([], [], [])
    start, stop = [smooth] * n, [smooth] * n
    step = [[smooth] * n for _ in range(n)]
    counts: list[dict] = [{} for _ in range(n)]
    kinds: dict[str, set] = {}
    for feats, states in pages:
        for i, (f, s) in enumerate(zip(feats, states)):
            for x in f:
                counts[s][x] = counts[s].get(x, 0.0) + 1
                kinds.setdefault(x[0], set()).add(x)
            if i:
                step[states[i - 1]][s] += 1
        if states:
            start[states[0]] += 1
            stop[states[-1]] += 1
    never = -1e6
    for r in range(n):
        total = sum(step[r][s] for s in ALLOWED[r])
        step[r] = [math.log(step[r][s] / total) if s in ALLOWED[r] else never for s in range(n)]
    start_total, stop_total = sum(start[:FOOT]), sum(stop[1:])
    model = LineModel(
        [math.log(x / start_total) if s != FOOT else never for s, x in enumerate(start)], step,
        [math.log(x / stop_total) if s != HEAD else never for s, x in enumerate(stop)],
    )
    for s in range(n):
        total: dict[str, float] = {}
        for x, c in counts[s].items():
            total[x[0]] = total.get(x[0], 0.0) + c
        size = {k: len(v) + 1 for k, v in kinds.items()}
        model.emit.append({x: math.log((c + smooth) / (total[x[0]] + smooth * size[x[0]])) for x, c in counts[s].items()})
        model.unseen.append({k: math.log(smooth / (total.get(k, 0.0) + smooth * size[k])) for k in kinds})
    return model


def label_by_text(lines: list[str], page_top: list[int], page_bottom: list[int], known: str, ends: set[str]) -> list[int]:
    """Training states of a filing's lines: body if its words stand in the
    marked-up text ``known``, break if one of its paragraphs ends so, else head or
    foot near the page's ends, aside elsewhere."""
    out = []
    form = transducer(True)
    for t, top, bottom in zip(lines, page_top, page_bottom):
        w = [fold(x) for x in _WORDS.findall(form(t))]
        grams = [" ".join(w[i : i + 2]) for i in range(len(w) - 1)]
        found = sum(g in known for g in grams) / len(grams) if grams else 0.0
        short = len(w) <= 1
        if not short and found >= 0.5:
            out.append(BREAK if " ".join(w[-2:]) in ends and _END_MARK.search(t) else BODY)
        elif short and w and _END_MARK.search(t):
            out.append(BREAK)
        elif shape(t) == "text" and (len(w) > 6 or not t[:1].isupper() or _END_MARK.search(t)):
            # A paragraph that the marked-up text lacks.
            out.append(BREAK if _END_MARK.search(t) and len(w) < 6 else BODY)
        elif shape(t) == "form":
            out.append(ASIDE)
        elif top <= 1 and top <= bottom:
            out.append(HEAD)
        elif bottom <= 1:
            out.append(FOOT)
        else:
            out.append(ASIDE if short or found == 0 else BODY)
    # A head follows only heads, a foot precedes only feet.
    for i, s in enumerate(out):
        if s == HEAD and i and page_top[i] and out[i - 1] != HEAD:
            out[i] = ASIDE
    for i in range(len(out) - 1, -1, -1):
        if out[i] == FOOT and page_bottom[i] and i + 1 < len(out) and out[i + 1] != FOOT:
            out[i] = ASIDE
    return out


# --- words ---------------------------------------------------------------


#: Scripts whose signs the table of confused signs doesn't treat.
_OTHER_SCRIPT = re.compile("[Ͱ-\u1dbf\u2e80-\uffff]")


def core(token: str) -> str:
    """A token in small letters without surrounding marks. An exclamation mark
    before a letter stays, since it may be a misread one."""
    t = token.strip(_EDGE + BREAKS)
    t = t.rstrip("!").rstrip(_EDGE + BREAKS)
    return t.lower()


def open_core(token: str) -> str:
    """The same with a closing exclamation mark that may be a letter."""
    return token.strip(_EDGE + BREAKS).lower()


#: Where a sentence follows the one before without a gap.
_NO_GAP = re.compile(r"(?<=[^\W_][^\W_][.?!])(?=[A-ZÀ-ÖØ-Þ][^\W\d_]|[A-ZÀ-ÖØ-Þ]['’]|[¿¡«“]|[AÀO]\Z)")


def pieces(token: str) -> list[str]:
    """A token cut where a sentence follows without a gap; most are one piece."""
    return _NO_GAP.split(token) if "." in token or "?" in token or "!" in token else [token]


def number_of(token: str) -> str | None:
    """The number that a token of figures and misread figures is, or None."""
    t = token.strip(_EDGE + BREAKS)
    if not _FIGURE_WORD.match(t) or not any(c.isdigit() for c in t):
        return None
    fixed = "".join(FIGURES.get(c, c) for c in t)
    return fixed if fixed != t else None


def is_number(token: str) -> bool:
    """Whether a token without surrounding marks is a right number."""
    return bool(re.fullmatch(r"[0-9]+(?:[.,:'’/-][0-9]+)*", token))


#: Every confused sign as the plainest signs that it may stand for, so that a word and
#: all its misreadings, however many signs are wrong, have one skeleton.
SKELETON = {"m": "ru", "n": "u", "w": "vv", "h": "ii", "b": "ii", "8": "ii", "d": "ei", "c": "e", "l": "i", "1": "i", "!": "i", "|": "i", "f": "t", "@": "a", "0": "o", "5": "s", "9": "g", "6": "é"}
if any(("".join(SKELETON.get(c, c) for c in a)) != "".join(SKELETON.get(c, c) for c in b) for a, b in CONFUSED):
    raise ValueError("a confused pair has two skeletons")


def skeleton(word: Column) -> Column:
    """Skeleton of a word; equal for any two words that the table of confused signs
    turns into each other."""
    single = {a: b for a, b in SKELETON.items() if len(b) == 1}
    out = F.translate(word, "".join(single), "".join(single.values()))
    for a, b in SKELETON.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


_CONFUSED_AT: dict[str, list[tuple[str, str]]] = {}
for _wrong, _right in CONFUSED:
    _CONFUSED_AT.setdefault(_wrong[0], []).append((_wrong, _right))


def changes(read: str, right: str) -> int | None:
    """Fewest confused signs that make ``right`` of ``read``, or None if no number of
    them does. Signs that no word contains are always misread ones."""
    # Fewest changes for each place in the right word that a place in the read one meets.
    meets: list[dict[int, int]] = [{} for _ in range(len(read) + 1)]
    meets[0][0] = 0
    for i, c in enumerate(read):
        for j, n in meets[i].items():
            if right[j : j + 1] == c and not (c in _CONFUSED_AT and _MUST.match(c)):
                meets[i + 1][j + 1] = min(n, meets[i + 1].get(j + 1, n))
            for wrong, plain in _CONFUSED_AT.get(c, ()):
                if read.startswith(wrong, i) and right.startswith(plain, j):
                    to, k = meets[i + len(wrong)], j + len(plain)
                    to[k] = min(n + 1, to.get(k, n + 1))
    return meets[-1].get(len(right))


def joined_forms(left: str, right: str) -> list[str]:
    """Ways to write a word that a line end broke: without and with its hyphen."""
    a, b = left.lower(), right.lower()
    return [a + b, a + "-" + b]


# --- the distributed part --------------------------------------------------

_LINE = "idx int, para_id bigint, text string, m bigint"


def mask_code(text):
    """Hash of a line in small letters with its numbers masked and the signs that
    recognition confuses fallen together, so that a running line is the same on
    every page; a Column expression."""
    number = r"(?<=^|\s)[\[(–—-]*(?:[0-9ivxlcdm!|]{1,6}|[0-9.,/()–—-]+)[\])–—-]*(?=\s|$)"
    t = F.translate(F.regexp_replace(F.lower(text), number, "#"), "01!5@9638|", "oiisageebi")
    for a, b in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.xxhash64(F.translate(t, "lctuhé", "iefnbe"))


def page_blocks(paragraphs: DataFrame) -> DataFrame:
    """The blocks of ``blocks_and_parts``."""
    return blocks_and_parts(paragraphs)[0]


def blocks_and_parts(paragraphs: DataFrame) -> tuple[DataFrame, int]:
    """Printed lines as ``(doc_id, page, block, lines, first, last, again, after,
    parts)``: each page in one block, or in ``parts`` blocks of at most ``BLOCK_LINES``
    lines in order if it has more; with the places of the page's ends, the number of
    pages on which each masked line occurs and the text of the line after the block.
    Besides, the most blocks of a page, so that what only long pages need is left out of
    the plan where there are none."""
    rows = paragraphs.where((F.col("side") == "pdf_l1") & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("idx", F.pmod("para_id", F.lit(2**31 - 1)).cast("int")).alias("idx"), "para_id", "text"
    )
    rows = rows.withColumn("m", mask_code(F.col("text"))).withColumn("piece", F.expr(f"idx div {BLOCK_LINES}").cast("int"))
    # Resent rows are equal, so the set holds each line once.
    pieces = cut(rows.groupBy("doc_id", "page", "piece").agg(
        F.array_sort(F.collect_set(F.struct("idx", "para_id", "text", "m"))).alias("lines")
    ))
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("piece")
    sizes = pieces.select("doc_id", "page", "piece", F.size("lines").alias("n"), F.col("lines")[0]["idx"].alias("a"), F.element_at("lines", -1)["idx"].alias("b"), F.col("lines")[0]["text"].alias("t"))
    sizes = sizes.withColumns({
        "first": F.min("a").over(page), "last": F.max("b").over(page), "total": F.sum("n").over(page), "count": F.count("*").over(page),
        "head": F.min("piece").over(page), "after": F.lead("t").over(order),
    })
    long_ = F.col("total") > BLOCK_LINES
    sizes = sizes.select(
        "doc_id", "page", "piece", "first", "last", F.when(long_, F.col("piece")).otherwise(F.col("head")).alias("block"),
        F.when(long_, F.col("count")).otherwise(1).cast("int").alias("parts"), (~long_ & (F.col("count") > 1)).alias("split"), F.when(long_, F.col("after")).alias("after"),
    )
    sizes = cut(sizes)
    seen = sizes.agg(F.coalesce(F.max("parts"), F.lit(1)).alias("parts"), F.coalesce(F.bool_or("split"), F.lit(False)).alias("split")).first()
    # Sizes grow with the input, so they aren't broadcast while they are small.
    placed = pieces.join(sizes.hint("merge"), ["doc_id", "page", "piece"])
    cols = ["doc_id", "page", "block", "lines", "first", "last", "after", "parts"]
    # A page that lies over a border of pieces comes together again.
    joined = placed.where("split").groupBy("doc_id", "page", "block", "first", "last", "parts").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("piece", "lines")))["lines"]).alias("lines"), F.lit(None).cast("string").alias("after")
    )
    blocks = placed.where("NOT split").select(cols).unionByName(joined.select(cols)) if seen["split"] else placed.select(cols)
    masks = pieces.select("doc_id", "page", F.explode(F.array_distinct("lines.m")).alias("m")).distinct()
    # Pages are counted before lines meet: a hot mask moves one row a page.
    often = masks.groupBy("doc_id", "m").agg(F.count("*").alias("n")).where("n > 1")
    again = masks.join(often, ["doc_id", "m"]).groupBy("doc_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias("again"))
    return blocks.join(again, ["doc_id", "page"], "left"), int(seen["parts"])


def _block_features(lines, first: int, last: int, again: dict, after: str | None = None) -> tuple[list[str], list[int], list[tuple]]:
    texts = [x["text"] for x in lines]
    at = [x["idx"] for x in lines]
    return texts, at, line_features(texts, first, last, at, [int(again.get(x["m"], 1)) for x in lines], after or "")


def train_lines(blocks: DataFrame, paragraphs: DataFrame, filings: int = SAMPLE_FILINGS, pages: int = SAMPLE_PAGES, signs: int = SAMPLE_SIGNS, texts: int = SAMPLE_TEXTS) -> LineModel:
    """Line model from a sample of about ``filings`` filings, drawn by the hash of
    their id among those with printed lines. At most twice as many reach the driver,
    the first in the order of that hash, with their first ``pages`` pages and up to
    ``texts`` times ``filings`` marked-up paragraphs of up to ``signs`` code points, so
    equal tables give equal models."""
    ids = paragraphs.where((F.col("side") == "pdf_l1") & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    total = max(1, ids.count())
    code = F.abs(F.xxhash64("doc_id")) % 1_000_000
    pick = code < int(min(1.0, filings / total) * 1_000_000) + 1
    some = [r["doc_id"] for r in ids.where(pick).orderBy(code, "doc_id").limit(2 * filings).collect()]
    few = blocks.where(F.col("doc_id").isin(some) & (F.col("page") < pages) & (F.col("parts") == 1)).collect()
    marked: dict[int, list[str]] = {}
    rows = paragraphs.where((F.col("side") == "sgml") & (F.char_length("text") <= signs) & F.col("doc_id").isin(some)).select("doc_id", "para_id", "text").dropDuplicates(["para_id"])
    for r in rows.orderBy(F.xxhash64("para_id"), "para_id").limit(texts * filings).collect():
        marked.setdefault(r["doc_id"], []).append(r["text"])
    form = transducer(True)
    labelled = []
    known: dict[int, tuple[set, set]] = {}
    for d, ts in marked.items():
        words = [[fold(x) for x in _WORDS.findall(form(t))] for t in ts]
        known[d] = {" ".join(w[i : i + 2]) for w in words for i in range(len(w) - 1)}, {" ".join(w[-2:]) for w in words}
    for r in sorted(few, key=lambda r: (r["doc_id"], r["page"])):
        if r["doc_id"] not in known:
            continue
        lines, at, feats = _block_features(r["lines"], r["first"], r["last"], r["again"] or {})
        grams, ends = known[r["doc_id"]]
        labelled.append((feats, label_by_text(lines, [i - r["first"] for i in at], [r["last"] - i for i in at], grams, ends)))
    return fit_lines(labelled)


def _count_batches(batches):
    """Words of marked-up texts with their number in each batch."""
    form = transducer(True)
    for b in batches:
        raw: dict[str, int] = {}
        for t in b["text"]:
            for w in t.split():
                raw[w] = raw.get(w, 0) + 1
        counts: dict[str, int] = {}
        for w, n in raw.items():
            for piece in pieces(form(w)):
                c = core(piece)
                if c:
                    counts[c] = counts.get(c, 0) + n
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())}, columns=["word", "n"])


def lexicon(paragraphs: DataFrame) -> DataFrame:
    """``(word, n)``: every word of the marked-up texts in comparison form, counted
    in each batch before the shuffle. Resent rows count as often as they came, since
    the numbers only order the readings of a word; the texts needn't move for it."""
    texts = paragraphs.where((F.col("side") == "sgml") & F.col("text").isNotNull()).select("text")
    return texts.mapInPandas(_count_batches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


ITEM = StructType([
    StructField("para_id", LongType()), StructField("pos", IntegerType()), StructField("kind", StringType()),
    StructField("raw", StringType()), StructField("right", StringType()), StructField("forms", ArrayType(StringType())),
])


def broken(token: str) -> bool:
    """Whether a token ends like a word that goes on in the next line."""
    t = token.rstrip()
    return len(t) > 1 and t[-1] in BREAKS and (t[-2].isalnum() or t[-2] in "@!")


def left_part(token: str) -> str:
    return transducer(True)(token.rstrip()[:-1]).lstrip(_EDGE).lower()


def word_forms(token: str, common: frozenset) -> list[str]:
    """What to look up for a token that may be misread; nothing if it is known,
    a right number or of a script without confused signs."""
    if _OTHER_SCRIPT.search(token):
        return []
    f = transducer(True)(token)
    w = core(f)
    if not w or w in common or is_number(w):
        return []
    o = open_core(f)
    return [w] if o == w or not o.endswith("!") else [w, o]


_FORMS: dict[int, dict[str, list[str]]] = {}


def remembered_forms(common: frozenset) -> dict[str, list[str]]:
    """The process's memory of ``word_forms`` for these common words: most tokens
    recur. It is emptied when it grows large."""
    memory = _FORMS.setdefault(hash(common), {})
    if len(memory) > 50_000:
        memory.clear()
    return memory


def token_items(tokens: list[tuple[int, str]], common: frozenset, start: int = 0) -> list[tuple]:
    """Items to look up in a run of body tokens ``(para_id, token)``: words that
    aren't common and words broken at a line end."""
    out, i = [], 0
    memory = remembered_forms(common)
    while i < len(tokens):
        pid, raw = tokens[i]
        if raw[-1] in BREAKS and broken(raw) and i + 1 < len(tokens):
            item = break_item(pid, start + i, raw, tokens[i + 1][1])
            if item:
                out.append(item)
                i += 2
                continue
        for piece in pieces(raw):
            forms = memory.get(piece)
            if forms is None:
                forms = memory[piece] = word_forms(piece, common)
            if forms:
                out.append((pid, start + i, "word", piece, None, forms))
        i += 1
    return out


def break_item(pid: int, pos: int, raw: str, nxt: str) -> tuple | None:
    if _OTHER_SCRIPT.search(raw) or _OTHER_SCRIPT.search(nxt):
        return None
    a, b = left_part(pieces(raw)[-1]), core(transducer(True)(pieces(nxt)[0]))
    if not a or not b or b in SUSPENDING or not (b[0].isalnum() or b[0] in "@!"):
        return None
    return (pid, pos, "break", raw, nxt, joined_forms(a, b))


BLOCK_OUT = StructType([
    StructField("furniture", ArrayType(LongType())), StructField("items", ArrayType(ITEM)),
    StructField("first", StructType([StructField("para_id", LongType()), StructField("raw", StringType())])),
    StructField("pending", StructType([StructField("para_id", LongType()), StructField("raw", StringType())])),
    StructField("lead", ArrayType(StringType())), StructField("trail", ArrayType(StringType())), StructField("head", StringType()), StructField("tail", StringType()),
    StructField("states", ArrayType(IntegerType())),
])

#: Place of a block's last token if its word goes on in the next block.
PAST = 1 << 20
#: Code points of the body on both sides of furniture that find it in a merged paragraph.
CONTEXT = 12


def _read_block(model: LineModel, common: frozenset, lines, feats: list[tuple], enter: list[float] | None = None, leave: list[float] | None = None):
    states = model.decode(feats, enter, leave)
    furniture, tokens, lead, trail, head, tail = [], [], [], [], None, None
    for x, s in zip(lines, states):
        if s in (HEAD, FOOT):
            furniture.append(x["para_id"])
            (lead if tail is None else trail).append(x["text"])
        elif s != ASIDE:
            tokens += [(x["para_id"], w) for w in x["text"].split()]
            if x["text"].strip():
                head = head if head is not None else x["text"]
                tail, trail = x["text"], []
    one = tokens[0] if tokens else None
    over = tokens[-1] if len(tokens) > 1 and broken(tokens[-1][1]) else None
    # The first word may be the rest of the block before, the last one go on.
    items = token_items(tokens[1 : -1 if over else None], common, 1)
    return (
        furniture, items, one, over, lead, trail,
        head[:CONTEXT] if head else None, tail[-CONTEXT:] if tail else None, states,
    )


def read_blocks(blocks: DataFrame, model: LineModel, common: frozenset, parts: int | None = None) -> DataFrame:
    """Labels and items of every block. Pages of several blocks are read in three steps:
    what each block makes of every state that enters it, the best states at all borders
    of the page (200 bytes a block meet there), and the lines between them; ``parts``, the
    most blocks of a page, tells if there are such pages."""
    session = blocks.sparkSession
    shared = session.sparkContext.broadcast((model, common))
    names = ("lines", "first", "last", "again", "after")

    def features(x, first, last, again, after):
        return _block_features(x, first, last, dict(again) if again is not None else {}, after)[2]

    @F.pandas_udf(BLOCK_OUT)
    def whole(lines: pd.Series, first: pd.Series, last: pd.Series, again: pd.Series, after: pd.Series) -> pd.DataFrame:
        m, known = shared.value
        rows = [_read_block(m, known, b[0], features(*b)) for b in zip(lines, first, last, again, after)]
        return pd.DataFrame(rows, columns=BLOCK_OUT.fieldNames())

    @F.pandas_udf(ArrayType(DoubleType()))
    def through(lines: pd.Series, first: pd.Series, last: pd.Series, again: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([shared.value[0].through(features(*b)).ravel() for b in zip(lines, first, last, again, after)])

    def borders(rows: pd.DataFrame) -> pd.DataFrame:
        g = rows.sort_values("block")
        found = shared.value[0].borders([np.array(m).reshape(len(STATES), -1) for m in g["m"]])
        return pd.DataFrame({"doc_id": g["doc_id"], "page": g["page"], "block": g["block"], "enter": [a for a, _ in found], "leave": [b for _, b in found]})

    @F.pandas_udf(BLOCK_OUT)
    def between(lines: pd.Series, first: pd.Series, last: pd.Series, again: pd.Series, after: pd.Series, enter: pd.Series, leave: pd.Series) -> pd.DataFrame:
        m, known = shared.value
        rows = [_read_block(m, known, b[0], features(*b), only(p), only(q)) for *b, p, q in zip(lines, first, last, again, after, enter, leave)]
        return pd.DataFrame(rows, columns=BLOCK_OUT.fieldNames())

    key = ["doc_id", "page", "block"]
    if parts == 1:
        return blocks.select(*key, whole(*names).alias("r"))
    long_ = blocks.where("parts > 1")
    states = long_.select(*key, through(*names).alias("m")).groupBy("doc_id", "page").applyInPandas(borders, f"doc_id {dict(blocks.dtypes)['doc_id']}, page int, block int, enter int, leave int")
    short = blocks.where("parts = 1").select(*key, whole(*names).alias("r"))
    return short.unionByName(long_.join(states, key).select(*key, between(*names, "enter", "leave").alias("r")))


MERGED_OUT = StructType([StructField("furniture", IntegerType()), StructField("items", ArrayType(ITEM)), StructField("text", StringType())])


def without_run(text: str, a: str | None, run: list[str], b: str | None) -> str:
    """``text`` without the furniture lines ``run`` of a page boundary, between the
    body ``a`` and ``b`` around it (null at an end of the filing); nothing is left
    of a text that is the run or consecutive lines of it."""
    if a is not None and b is not None:
        text = text.replace(f"{a} {' '.join(run)} {b}", f"{a} {b}")
    # A text that is longer than the run can't be a part of it.
    if len(text) <= sum(map(len, run)) + len(run):
        if any(text == " ".join(run[i:j]) for i in range(len(run)) for j in range(i + 1, len(run) + 1)):
            return ""
    return text


def _merged_udf(common: frozenset, session):
    shared = session.sparkContext.broadcast(common)

    @F.pandas_udf(MERGED_OUT)
    def run(para_id: pd.Series, text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        known = shared.value
        rows = []
        for pid, t, rs in zip(para_id, text, runs):
            kept = t
            for r in sorted(rs, key=lambda r: -sum(map(len, r["f"]))) if rs is not None else ():
                kept = without_run(kept, r["a"], list(r["f"]), r["b"])
            rows.append((int(kept != t), token_items([(pid, w) for w in kept.split()], known), kept))
        return pd.DataFrame(rows, columns=["furniture", "items", "text"])

    return run


def furniture_runs(read: DataFrame) -> DataFrame:
    """``(doc_id, pages, tail, f, b, before_all, ...)``: the furniture lines ``f``
    between the last body line of a block and the first of the next that has body;
    blocks without body lie inside the run. ``before_all`` are the lines before the
    filing's first body; ``tail`` or ``b`` is null where the filing begins or ends."""
    order = Window.partitionBy("doc_id").orderBy("page", "block")
    has = F.col("r.tail").isNotNull()
    blocks = read.select("doc_id", "page", "block", "r.lead", "r.trail", "r.head", "r.tail", "r.pending", "r.first", has.alias("has"))
    blocks = blocks.withColumn("g", F.count_if("has").over(order))
    one = lambda c: F.max_by(c, "has").alias(c)
    after = F.when(F.col("has"), F.col("trail")).otherwise(F.col("lead"))
    runs = blocks.groupBy("doc_id", "g").agg(
        F.array_sort(F.collect_list(F.struct("page", "block", after.alias("f")))).alias("l"), *[one(c) for c in ("lead", "head", "tail", "pending", "first")]
    )
    order = Window.partitionBy("doc_id").orderBy("g")
    return runs.withColumns({
        "next_page": F.lead("l").over(order)[0]["page"], "next_lead": F.lead("lead").over(order), "b": F.lead("head").over(order),
        "next_first": F.lead("first").over(order), "before": F.lag("pending").over(order),
        "is_first": F.row_number().over(order) == 1,
    }).select(
        "doc_id", F.array_distinct(F.array_compact(F.concat("l.page", F.array("next_page")))).alias("pages"), "tail", "b", "head", "pending", "first", "next_first", "before",
        F.concat(F.flatten("l.f"), F.coalesce("next_lead", F.array().cast("array<string>"))).alias("f"),
        F.when(F.col("is_first") & (F.col("g") > 0), F.col("lead")).alias("before_all"),
    )


@F.pandas_udf(IntegerType())
def _changes_of(read: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([changes(a, b) for a, b in zip(read, right)], dtype="Int32")


#: Declared not deterministic, lest the optimizer evaluates it once more for a filter.
_changes_udf = _changes_of.asNondeterministic()


def resolve(forms: DataFrame, words: DataFrame) -> DataFrame:
    """``(form, n, fix, fix_n, changes)`` for each different ``form``: its count in
    the lexicon or, if it isn't there, the word with the fewest changes (then the most
    frequent) that it may be a misreading of. Both meet over their skeleton, so no
    number of changes is too many."""
    kinds = cut(forms.select("form").distinct().join(words.withColumnRenamed("word", "form"), "form", "left"))
    near = kinds.where("n IS NULL").select("form", skeleton(F.col("form")).alias("k")).join(words.select("word", F.col("n").alias("often"), skeleton(F.col("word")).alias("k")), "k")
    near = near.withColumn("changes", _changes_udf("form", "word")).where("changes IS NOT NULL")
    best = near.groupBy("form").agg(F.min(F.struct("changes", (-F.col("often")).alias("k"), "word")).alias("best"))
    return kinds.join(best, "form", "left").select(
        "form", "n", F.col("best.word").alias("fix"), (-F.col("best.k")).alias("fix_n"), F.col("best.changes").alias("changes")
    )


@dataclass
class Repair:
    """What the repair of a set of filings found."""

    findings: DataFrame
    merged: DataFrame
    blocks: DataFrame
    lines: DataFrame


def repair(paragraphs: DataFrame, filings: int = SAMPLE_FILINGS, common_words: int = COMMON_WORDS) -> Repair:
    """Furniture, broken and misread words of sides ``pdf_l1`` and ``pdf_l4``.

    ``findings`` is ``(para_id, doc_id, noise, repaired, pos, raw, right)``.
    Rows with null text or ``doc_id`` have none, empty texts neither; a null page
    counts as 0, a null idx as the order of ``para_id``; rows resent with the same ``para_id`` count once; other
    columns are ignored; without marked-up text nothing is known, so nothing is
    found misread, and all lines are body.
    """
    need(paragraphs, "para_id", "doc_id", "side", "idx", "page", "text")
    session = paragraphs.sparkSession
    words = cut(lexicon(paragraphs))
    # Written first: collected at once, every partition would send its own list.
    common = frozenset(r["word"] for r in cut(words.orderBy(F.desc("n"), "word").limit(common_words).select("word")).collect())
    blocks, parts = blocks_and_parts(paragraphs)
    model = train_lines(blocks, paragraphs, filings)
    read = cut(read_blocks(blocks, model, common, parts))

    runs = cut(furniture_runs(read))
    between = runs.select("doc_id", "pages", F.col("tail").alias("a"), "f", "b").unionByName(
        runs.where("before_all IS NOT NULL").select("doc_id", F.slice("pages", 1, 1).alias("pages"), F.lit(None).cast("string").alias("a"), F.col("before_all").alias("f"), F.col("head").alias("b"))
    )
    blank = F.filter(F.transform("f", lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    between = between.withColumn("f", blank).where(F.size("f") > 0).select("doc_id", F.explode("pages").alias("page"), F.struct("a", "f", "b").alias("run"))
    merged = paragraphs.where((F.col("side") == "pdf_l4") & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        "para_id", "doc_id", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("idx", F.lit(0)).alias("idx"), "text"
    ).dropDuplicates(["para_id"])
    order = Window.partitionBy("doc_id").orderBy("idx", "para_id")
    spans = merged.select("para_id", "doc_id", "page", "idx").withColumn("end", F.coalesce(F.lead("page").over(order), F.col("page") + 1))
    spans = spans.select("para_id", "doc_id", F.explode(F.sequence("page", F.greatest("page", "end"))).alias("page"))
    near = spans.join(between, ["doc_id", "page"])
    near = near.groupBy("para_id").agg(F.collect_set("run").alias("runs"))
    m = merged.join(near, "para_id", "left").withColumn("r", _merged_udf(common, session)("para_id", "text", "runs"))
    m = cut(m.select("para_id", "doc_id", "idx", "page", "r.*"))

    # Words that a page break splits, and first words that are whole.
    shared = session.sparkContext.broadcast(common)

    @F.pandas_udf(ArrayType(ITEM))
    def edges(pid: pd.Series, raw: pd.Series, nxt: pd.Series, first: pd.Series, word: pd.Series, joined: pd.Series) -> pd.Series:
        def one(p, r, x, f, w, j):
            over = break_item(int(p), PAST, r, x) if r is not None and x is not None else None
            forms = [] if j or w is None else word_forms(w, shared.value)
            return ([over] if over else []) + ([(int(f), 0, "word", w, None, forms)] if forms else [])

        return pd.Series([one(*x) for x in zip(pid, raw, nxt, first, word, joined)])

    edge = runs.select("doc_id", edges("pending.para_id", "pending.raw", "next_first.raw", "first.para_id", "first.raw", F.col("before").isNotNull()).alias("e"))
    items = read.select("doc_id", F.explode("r.items").alias("i")).unionByName(m.select("doc_id", F.explode("items").alias("i"))).unionByName(edge.select("doc_id", F.explode("e").alias("i")))
    items = cut(items.select("doc_id", "i.*"))

    forms = items.select("doc_id", "para_id", "pos", "kind", "raw", "right", F.posexplode("forms").alias("k", "form"))
    known = resolve(forms, words)
    looked = forms.join(known, "form").groupBy("doc_id", "para_id", "pos", "kind", "raw", "right").agg(
        F.min(F.when(F.col("k") == 0, F.col("form"))).alias("plain"),
        F.max(F.when(F.col("n").isNotNull(), F.struct("n", (-F.col("k")).alias("k"), "form"))).alias("hit"),
        F.min(F.when(F.col("fix").isNotNull(), F.struct("changes", (-F.col("fix_n")).alias("w"), "k", "fix"))).alias("near"),
    )

    @F.pandas_udf(StringType())
    def number(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: number_of(transducer(True)(x)), na_action="ignore")

    whole = looked.where((F.col("kind") == "word") & F.col("hit").isNull())
    misread = whole.withColumn("repaired", F.coalesce(number("raw"), F.col("near.fix"))).where("repaired IS NOT NULL")
    split = looked.where(F.col("kind") == "break")
    letters = F.regexp_like("plain", F.lit(r"^[\p{L}\p{M}'’-]+$"))
    split = split.withColumn("repaired", F.coalesce("hit.form", "near.fix", F.when(letters, F.col("plain")))).where("repaired IS NOT NULL")
    cols = ["para_id", "doc_id", "noise", "repaired", "pos", "raw", "right"]
    found = misread.withColumn("noise", F.lit("misread")).select(cols)
    found = found.unionByName(split.withColumn("noise", F.lit("hyphen")).select(cols))
    found = found.unionByName(split.where("hit IS NULL AND near IS NOT NULL").withColumn("noise", F.lit("misread")).select(cols))
    none = [F.lit("").alias("repaired"), F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("right")]
    pieces = read.select(F.explode("r.furniture").alias("para_id"), "doc_id").unionByName(m.where("furniture = 1").select("para_id", "doc_id"))
    found = found.unionByName(pieces.select("para_id", "doc_id", F.lit("furniture").alias("noise"), *none))
    return Repair(cut(found), m, read, blocks)


def one_word(a: str, b: str, word: str) -> str:
    """``word`` in the place of the two tokens that a line end made of it."""
    *before, last = pieces(a)
    first, *after = pieces(b)
    return "".join([*before, in_place(last[:-1] + first, word), *after])


def mended(tokens: list[str], fixes) -> list[str]:
    """The tokens of a run with its fixes, whose places count them; what is joined to
    the token before is left empty."""
    out, at = list(tokens), {}
    for f in fixes:
        at.setdefault(f["pos"], []).append(f)
    for i, list_ in sorted(at.items(), reverse=True):
        if i >= len(out):
            continue
        split = [f for f in list_ if f["noise"] == "hyphen"]
        if split and i + 1 < len(out):
            out[i], out[i + 1] = one_word(out[i], out[i + 1], split[0]["repaired"]), ""
            continue
        for f in list_:
            if f["noise"] == "misread":
                out[i] = "".join(in_place(x, f["repaired"]) if x == f["raw"] else x for x in pieces(out[i]))
    return out


@F.pandas_udf(StringType())
def _apply_udf(text: pd.Series, fixes: pd.Series) -> pd.Series:
    def one(t, fs):
        if fs is None:
            return t
        # Tokens lie between blanks of any kind, as they were read.
        parts = re.split(r"(\s+)", t)
        words = [i for i in range(0, len(parts), 2) if parts[i]]
        for i, w in zip(words, mended([parts[i] for i in words], fs)):
            parts[i] = w
            if not w:
                parts[i - 1] = ""
        return "".join(parts)

    return pd.Series([None if t is None else one(t, fs) for t, fs in zip(text, fixes)])


def in_place(token: str, word: str) -> str:
    """``word`` with the marks around ``token`` and its capital."""
    left = len(token) - len(token.lstrip(_EDGE))
    right = len(token.rstrip(_EDGE))
    inner = token[left:right]
    if inner[:1].isupper():
        word = word.upper() if inner.isupper() and len(inner) > 1 else word[:1].upper() + word[1:]
    return token[:left] + word + token[right:]


def repaired_paragraphs(done: Repair) -> DataFrame:
    """``(para_id, doc_id, idx, text)``: the merged paragraphs without furniture,
    whole and rightly spelled; a paragraph without damage stays as it is, a row of
    furniture alone is left out."""
    fixes = done.findings.where("noise != 'furniture'").groupBy("para_id").agg(F.collect_set(F.struct("pos", "noise", "repaired", "raw")).alias("fixes"))
    rows = done.merged.where("furniture = 0 OR text != ''").select("para_id", "doc_id", "idx", "text").join(fixes, "para_id", "left")
    return rows.select("para_id", "doc_id", "idx", _apply_udf("text", "fixes").alias("text"))


FRAGMENT = StructType([
    StructField("para_id", LongType()), StructField("idx", IntegerType()), StructField("text", StringType()),
    StructField("ended", BooleanType()), StructField("joined", BooleanType()), StructField("aside", BooleanType()),
])


def fragments(lines, states, fixes) -> list[tuple]:
    """Repaired paragraphs of a block's lines, those aside after the others. The first may
    go on from the block before, the last is open if it doesn't end here; ``joined`` if
    its last word holds the first token of the next block. A broken word ends nothing."""
    over = next((f for f in fixes if f["pos"] == PAST and f["noise"] == "hyphen"), None)
    hyphens = {f["pos"] for f in fixes if f["noise"] == "hyphen"}
    tokens, owner, out, aside = [], [], [], []
    for x, s in zip(lines, states):
        words = x["text"].split()
        if s in (HEAD, FOOT) or not words:
            continue
        if s == ASIDE:
            aside.append((x["para_id"], x["idx"], x["text"], True, False, True))
            continue
        if not out or out[-1][2]:
            out.append([x["para_id"], x["idx"], False])
        tokens += words
        owner += [len(out) - 1] * len(words)
        out[-1][2] = s == BREAK and len(tokens) - 1 not in hyphens
    words = mended(tokens, [f for f in fixes if f["pos"] < PAST])
    if over and out:
        words[-1] = one_word(words[-1], over["right"], over["repaired"])
        out[-1][2] = False
    texts = [[] for _ in out]
    for k, w in zip(owner, words):
        if w:
            texts[k].append(w)
    return [(p, i, " ".join(t), e, bool(over) and k == len(out) - 1, False) for k, ((p, i, e), t) in enumerate(zip(out, texts))] + aside


@F.pandas_udf(ArrayType(FRAGMENT))
def _fragments_udf(lines: pd.Series, states: pd.Series, fixes: pd.Series) -> pd.Series:
    return pd.Series([fragments(x, s, f if f is not None else ()) for x, s, f in zip(lines, states, fixes)])


def line_paragraphs(done: Repair) -> DataFrame:
    """``(para_id, doc_id, idx, text)``: the paragraphs that the printed lines make
    without furniture, over line and page breaks, whole and rightly spelled; ``para_id``
    and ``idx`` are those of the first line. Only numbers of paragraphs are summed up
    over a filing's blocks; texts meet by paragraph."""
    key = ["doc_id", "page", "block"]
    lines = done.lines.select(*key, "lines")
    fixes = done.findings.where("noise != 'furniture'").select("para_id", F.struct("pos", "noise", "repaired", "raw", "right").alias("fix"))
    fixes = lines.select(*key, F.explode("lines.para_id").alias("para_id")).join(fixes.hint("merge"), "para_id").groupBy(key).agg(F.collect_set("fix").alias("fixes"))
    rows = lines.join(done.blocks.select(*key, "r.states").hint("merge"), key).join(fixes.hint("merge"), key, "left")
    got = cut(rows.select(*key, _fragments_udf("lines", "states", "fixes").alias("f")))
    before = Window.partitionBy("doc_id").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, -1)
    ended = got.select(*key, F.size(F.filter("f", lambda x: x["ended"] & ~x["aside"])).alias("n"))
    ended = ended.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    each = got.select(*key, F.posexplode("f").alias("k", "x")).select(*key, "k", "x.*")
    whole = each.where("NOT aside").join(ended.hint("merge"), key).withColumn("no", F.col("n") + F.col("k"))
    whole = whole.groupBy("doc_id", "no").agg(F.array_sort(F.collect_list(F.struct("page", "block", "para_id", "idx", "text", "joined"))).alias("l"))
    # The first token belongs to the last word before it.
    text = F.transform("l", lambda x, i: F.when(F.get("l", i - 1)["joined"], F.regexp_replace(x["text"], "^[^ ]+ ?", "")).otherwise(x["text"]))
    first = F.col("l")[0]
    whole = whole.select(first["para_id"].alias("para_id"), "doc_id", first["idx"].alias("idx"), F.array_join(F.filter(text, lambda t: t != ""), " ").alias("text"))
    return whole.where("text != ''").unionByName(each.where("aside").select("para_id", "doc_id", "idx", "text"))
