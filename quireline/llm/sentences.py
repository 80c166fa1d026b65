"""Problem 4: sentences in all scripts.

Method: the standard sentence-break rules by character property (terminators of
every script from the property Sentence_Break, closers and blanks that follow them, no
break inside numbers or before a lower-case continuation), with abbreviations
suppressed by language and quotations and brackets paired first, so that what ends
inside one doesn't end the sentence around it. The language is a column's, or the
language model of problem 5 is asked where, and only where, a word before a stop
abbreviates in some language. The rules read the text in its one form (problem 1), so
invisible or borrowed signs don't hide a mark; offsets are of the stored text.
"""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quireline.llm.common import need
from quireline.llm.unify import transducer

_SIGNS = "".join(chr(c) for c in range(0x1E000) if not 0xD800 <= c < 0xE000)
#: Signs that end a sentence by themselves, of all scripts, and full stops, which may
#: also abbreviate.
FINAL = "".join(regex.findall(r"\p{Sentence_Break=STerm}", _SIGNS))
STOP = "".join(regex.findall(r"\p{Sentence_Break=ATerm}", _SIGNS))
ELLIPSIS = "…"
OPEN = "([{（［｛「『【《〈〔“‘«‹„‚"
CLOSE = ")]}）］｝」』】》〉〕”’»›"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "｛": "｝", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "«": "»", "‹": "›"}
DOUBLE = '"“”„'
INVERTED = "¿¡"

ENDING, DOTS, CLOSING = frozenset(FINAL + STOP + ELLIPSIS), frozenset(STOP + ELLIPSIS), frozenset(CLOSE + DOUBLE + "'")
OPENING, QUOTE, BEFORE_WORD = frozenset(OPEN + DOUBLE), frozenset(DOUBLE + "'"), frozenset(OPEN + DOUBLE + INVERTED + ",;:/")

# Abbreviations by language and by what may follow.
# "title": a name follows; "inner": the sentence always goes on; "number": it goes
# on if a number or a small letter follows; "last": may well end a sentence.
ABBREVIATIONS = {
    "en": {
        "title": "mr mrs ms dr prof rev hon gen sen rep messrs capt col lt sgt",
        "inner": "e.g i.e cf vs viz approx",
        "number": "no nos vol vols p pp s ss sec secs art arts ch para paras fig figs cl reg regs pt pts",
        "last": "co corp inc ltd llc l.p plc bros a.m p.m etc ff jr u.s u.k esq",
    },
    "fr": {
        "title": "m mm mme mmes mlle dr pr",
        "inner": "c.-à-d cf env p.ex",
        "number": "no nos p pp art arts al paragr par ch vol ex chap fig",
        "last": "suiv etc inc ltée cie s.a",
    },
    "de": {
        "title": "hr fr dr prof dipl",
        "inner": "z b d h z.b d.h u.a i.d.r vgl bzw ca evtl ggf gem inkl sog",
        "number": "nr abs art s st ziff kap bd",
        "last": "usw ff f etc co",
    },
    "es": {
        "title": "sr sra sres srta dr dra lic",
        "inner": "ej p.ej aprox",
        "number": "núm núms pág págs art arts p vol cap fig párr",
        "last": "etc s.a ss cía",
    },
    "pt": {
        "title": "sr sra srs dr dra eng prof",
        "inner": "p.ex aprox",
        "number": "n núm pág págs p pp ex art arts vol cap fig",
        "last": "etc s.a cia ltda",
    },
    "ru": {
        "title": "г-н г-жа д-р проф акад",
        "inner": "т е д см им т.е т.д ср напр",
        "number": "ст п пп ч с стр рис гл абз",
        "last": "г гг руб коп др пр тыс млн млрд",
    },
    "ar": {"title": "د أ م", "number": "ص ج رقم"},
    "hi": {"title": "डॉ श्री पं प्रो", "number": "सं पृ"},
    "zh": {},
    "ja": {"number": "no"},
}
# German months, after which a number with a stop is an ordinal.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

_PAIR_SIGN = re.compile(f"[{re.escape(OPEN + CLOSE + DOUBLE)}]")
_MARKS = FINAL + STOP + ELLIPSIS + CLOSE + DOUBLE
#: Where something may end; with signs beyond the Basic Multilingual Plane the search is
#: slower, so they are only looked for in texts that have such.
_PLACE = re.compile(f"[{re.escape(''.join(c for c in _MARKS if ord(c) < 0x10000))}]")
_PLACE_BEYOND = re.compile(f"[{re.escape(_MARKS)}]")
_FIGURE = re.compile(r"[OSIBZ](?:[\d.,;OSIl]|\s)|[IVXLC]+\b|No\b")
_CAPS_WORD = re.compile(r"[\w'’-]+")
_DASH = re.compile(r"[—–-]\s*[^\W\d_]")
_TAIL = re.compile("[^\u2e80-\uffff]*$")
_STYLED = re.compile(r"[^\W\d_]-[^\W\d_]{2}|[a-z][A-Z]")
_FOLD = str.maketrans("01!5@96", "oiisage")


def _fold(word: str) -> str:
    """A word as a scanner might have read it: signs that are confused fall together."""
    w = word.translate(_FOLD).replace("rn", "m").replace("vv", "w").replace("l", "i")
    return w.translate(str.maketrans("ctuhé", "efnbe"))


#: Kinds of abbreviations, the later one first where a word has several.
KINDS = ("title", "inner", "number", "last")


@lru_cache(maxsize=1)
def abbreviations() -> tuple[dict[str, dict[str, str]], dict[str, dict[str, str]]]:
    """Abbreviation, in comparison form, to its kind in each language, and the same for
    those of three and more letters as misread."""
    form = transducer(True)
    exact: dict[str, dict[str, str]] = {}
    misread: dict[str, dict[str, str]] = {}
    for lang, table in ABBREVIATIONS.items():
        for kind in KINDS:
            for w in table.get(kind, "").split():
                # Capitals of some scripts have doubles where the small letters have none.
                for x in {form(w), form(w.upper()).lower()}:
                    exact.setdefault(x, {})[lang] = kind
                    if len(x) >= 3:
                        misread.setdefault(_fold(x), {})[lang] = kind
    return exact, misread


Languages = Callable[[str], str] | tuple[str, ...] | str | None
#: Signs after a stop that are read with its sentence to tell the language.
AHEAD = 60


class Clause:
    """The text around a stop: its sentence's first sign and the languages whose
    abbreviations count, asked of the stored text only when a word may be one."""

    def __init__(self, text: str, ends: list[int] | None, langs: Languages) -> None:
        self.text, self.ends, self.langs = text, ends, langs

    def stored(self, a: int, b: int) -> str:
        """Stored text of the signs from ``a`` to ``b`` of the one form."""
        if self.ends is None:
            return self.text[a:b]
        return self.text[self.ends[a - 1] if a else 0 : self.ends[min(b, len(self.ends)) - 1]]

    def languages(self, start: int, i: int) -> tuple[str, ...]:
        """Those given, or what the model says of the sentence from ``start``."""
        if self.langs is None:
            return tuple(ABBREVIATIONS)
        if isinstance(self.langs, str):
            return (self.langs,)
        return self.langs if isinstance(self.langs, tuple) else (self.langs(self.stored(start, i + AHEAD)),)

    def kind(self, kinds: dict[str, str], start: int, i: int) -> str | None:
        """Kind, or None, of an abbreviation of several languages before the stop at
        ``i``."""
        found = {kinds[x] for x in self.languages(start, i) if x in kinds}
        return next((k for k in reversed(KINDS) if k in found), None)


def pair_up(t: str) -> tuple[dict[int, int], bytearray]:
    """Opening to closing position of quotations and brackets, and for each sign
    whether it lies inside such a pair. What isn't closed doesn't count."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    n = len(t)
    for m in _PAIR_SIGN.finditer(t):
        i, c = m.start(), m[0]
        if c in PAIRS:
            stack.append((PAIRS[c], i))
        elif c in DOUBLE:
            before = t[i - 1] if i else " "
            after = t[i + 1] if i + 1 < n else " "
            opened = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            opens = c == "„" or (opened is None and (c == "“" or (c == '"' and not (after.isspace() and not before.isspace()))))
            if opens:
                stack.append(('"', i))
            elif opened is not None:
                pairs[stack[opened][1]] = i
                del stack[opened:]
        elif c in CLOSE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == c:
                    pairs[stack[k][1]] = i
                    del stack[k:]
                    break
    inside = bytearray(n + 1)
    at = 0
    for a in sorted(pairs):
        if a >= at:
            at = pairs[a]
            inside[a + 1 : at] = b"\1" * (at - a - 1)
    return pairs, inside


def _cased(c: str) -> bool:
    return c.isupper() or c.islower()


def _caps_word(t: str, i: int) -> str:
    m = _CAPS_WORD.match(t, i)
    return m[0] if m else ""


def _starts_sentence(t: str, i: int, caps: bool) -> bool:
    """Whether what begins at ``i`` can begin a sentence, if the stop before may
    also be inside one. ``caps``: the words around are in capitals, where nothing
    shows that a sentence begins."""
    c = t[i]
    if c.islower():
        return bool(_STYLED.match(t, i))
    if c.isupper():
        word = _caps_word(t, i)
        return not (caps and word.upper() == word and not any(map(str.islower, t[i : i + 16])))
    return c not in ",;:)-–—%/" and c not in CLOSE


def sentence_ends(text: str, langs: Languages = None) -> list[int]:
    """Number of code points of ``text`` up to and including the last visible sign
    of each sentence, ascending; none for a text without visible sign. ``langs`` is
    the language, several, or a function that tells that of a text; without it every
    language's abbreviations count."""
    if not text:
        return []
    t, ends = transducer(True).traced(text)
    clause = Clause(text, ends, langs)
    pairs, inside = pair_up(t)
    closes = {b: a for a, b in pairs.items()}
    n, out, start = len(t), [], 0
    caps_now: dict[int, bool] = {}

    def skip(i: int) -> int:
        while i < n and t[i].isspace():
            i += 1
        return i

    def caps(i: int) -> bool:
        """Whether the three words before ``i`` hold capitals and no small letter."""
        if i not in caps_now:
            before = t[max(0, i - 14) : i]
            caps_now[i] = sum(map(str.isupper, before)) >= 6 and not any(map(str.islower, before))
        return caps_now[i]

    def end(i: int) -> None:
        """A sentence ends before position ``i`` of ``t``."""
        nonlocal start
        last = i
        while last > start and t[last - 1].isspace():
            last -= 1
        if last > start:
            out.append(last)
            start = skip(i)

    marks = _PLACE if max(t) < "\U00010000" else _PLACE_BEYOND
    start = skip(0)
    i = start
    while True:
        # Nothing but final marks and closing signs decides anything.
        place = marks.search(t, i)
        if place is None:
            break
        i, c = place.start(), place[0]
        if i in closes and not inside[i]:
            # A pair that ends with a final mark may end the sentence.
            a, j = closes[i], i + 1
            k = i - 1
            while k > a and (t[k].isspace() or t[k] in CLOSING):
                k -= 1
            if k > a and t[k] in ENDING:
                nxt = skip(j)
                if nxt < n:
                    follow = t[nxt]
                    bracket = t[i] in ")]}）］｝"
                    if bracket:
                        ok = not t[start:a].strip() and _starts_sentence(t, nxt, caps(i))
                    elif not _cased(follow) and follow.isalpha():
                        # No case to tell: the speaker goes on, unless the script changes.
                        ok = _cased(t[k - 1])
                    else:
                        ok = _starts_sentence(t, nxt, caps(i))
                    if ok:
                        end(j)
                        i = max(j, start)
                        continue
            i += 1
            continue
        if inside[i] or c not in ENDING:
            i += 1
            continue
        j = i
        while j < n and t[j] in ENDING and not (t[j] in STOP and j > i and t[j - 1] in FINAL and t[j - 1] not in "!?"):
            j += 1
        run = t[i:j]
        while j < n and (t[j] in CLOSE or t[j] in QUOTE) and j not in pairs and not (t[j] in QUOTE and j + 1 < n and t[j + 1].isalnum()):
            j += 1
        nxt = skip(j)
        if nxt >= n:
            end(n)
            break
        gap, follow = nxt > j, t[nxt]
        ok = True
        if follow in ",;:%" or (follow in CLOSE and not gap) or follow in "—–-" and _DASH.match(t, nxt) and t[nxt + 1 :].lstrip()[:1].islower():
            ok = False
        elif run == "." or run[0] in STOP and len(run) == 1:
            ok = _stop_ends(t, start, i, nxt, gap, clause, caps(i), pairs)
        elif run[0] in DOTS:
            ok = _starts_sentence(t, nxt, caps(i))
        elif follow.islower():
            ok = bool(_STYLED.match(t, nxt))
        elif not gap and run[0] in "!?" and (follow.isdigit() or (follow.isupper() and i and t[i - 1].isupper() and caps(i))):
            ok = False
        elif gap and run == "!" and follow.isupper() and i and t[i - 1].isspace() and len(run) == 1 and caps(i):
            ok = True
        if ok:
            end(j)
            i = max(j, start)
        else:
            i = j
    if start < n:
        end(n)
    if ends is None:
        return out
    return [ends[e - 1] for e in out]


def _stop_ends(t: str, start: int, i: int, nxt: int, gap: bool, clause: Clause, caps: bool, pairs: dict) -> bool:
    """Whether the single full stop at ``i``, followed by ``t[nxt]``, ends a sentence."""
    a = i
    while a > start and not t[a - 1].isspace() and t[a - 1] not in BEFORE_WORD:
        a -= 1
    # Scripts without blanks run into Latin letters: the tail counts.
    word = _TAIL.search(t[a:i])[0] or t[a:i]
    low, follow, n = word.lower(), t[nxt], len(t)
    # An elided article isn't part of the abbreviation.
    low = re.split("['’]", low)[-1]
    if word and word[-1].isdigit():
        if not gap:
            # Inside a number, or a sentence follows with no gap.
            return follow.isupper() and nxt + 1 < n and (t[nxt + 1].islower() or caps) or nxt in pairs
        if a == start and word.isdigit() and len(word) <= 3:
            return False
        if word.isdigit() and len(word) <= 2 and follow.isdigit():
            return False
        if follow.isupper() and word.isdigit() and _caps_word(t, nxt).lower() in MONTHS:
            return False
    exact, misread = abbreviations()
    kinds = exact.get(low) or (misread.get(_fold(low)) if len(low) >= 3 else None)

    def ends(kind: str | None) -> bool:
        """Whether it does if the word is an abbreviation of this kind, or none."""
        if kind and a >= start + 2 and t[a - 1] == " " and t[a - 2] in "-‐¬":
            # The rest of a word that was broken at the end of a line.
            kind = None
        if kind is None and "." in low and gap:
            # A chain such as "p.m" or "A.B" is known by its whole or by its letters.
            kind = "last" if re.fullmatch(r"(?:[^\W\d_]\.-?)+[^\W\d_]", low) else None
        if kind is None and len(word) == 1 and word.isupper() and word.isalpha() and gap and follow.isupper():
            kind = "title"
        if not gap:
            if kind in ("title", "inner") or kind == "number" and not follow.isupper():
                return False
            if "." in word and kind != "last":
                return False
            if nxt in pairs or follow in INVERTED:
                return len(word) > 1 or not word.isalpha()
            if follow.isupper():
                return len(word) > 1 and nxt + 1 < n and (word[-1].islower() or caps or not word[-1].isalpha() or kind == "last" or not _cased(word[-1]))
            if follow.islower():
                return len(word) > 2 and bool(_STYLED.match(t, nxt))
            if follow.isdigit():
                return len(word) > 3 and word[-1].isalpha()
            if follow.isalpha():
                return len(word) > 1 or U.category(follow) == "Lo" and not word.isascii()
            return False
        if kind in ("title", "inner"):
            return False
        if kind == "number":
            # Misread figures begin with a capital that looks like one.
            return follow.isupper() and not caps and not _FIGURE.match(t, nxt) or follow in OPENING
        if kind == "last":
            return _starts_sentence(t, nxt, caps)
        if follow.islower():
            return bool(_STYLED.match(t, nxt))
        return True

    if not kinds:
        return ends(None)
    # Most often what follows decides, whichever language it is.
    ways = {ends(k) for k in (None, *kinds.values())}
    return ways.pop() if len(ways) == 1 else ends(clause.kind(kinds, start, i))


ENDS = ArrayType(IntegerType())


@F.pandas_udf(ENDS)
def _ends_of(text: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else sentence_ends(t, x if x in ABBREVIATIONS else None) for t, x in zip(text, lang)])


def ends_udf(judge: Callable[[str], str]):
    """Sentence ends with the language that ``judge`` tells where it matters."""

    @F.pandas_udf(ENDS)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sentence_ends(t, judge), na_action="ignore")

    return run


def sentence_bounds(df: DataFrame, text: str = "text", out: str = "sent_ends", lang: str | None = None, judge: Callable[[str], str] | None = None) -> DataFrame:
    """``df`` with the ends of the sentences of column ``text`` in column ``out``
    (array of code-point counts; a column already called so is replaced).

    The abbreviations are those of the language in column ``lang`` (ISO 639-1; every
    language's where it is null or has none) or, with ``judge``, of the language that
    it tells. A null text gives null, a text without visible sign an empty array; the
    last end is that of the text's last visible sign. No shuffle.
    """
    need(df, text, *([lang] if lang else []))
    said: Column = F.col(lang) if lang else F.lit(None).cast("string")
    # Declared not deterministic, lest the optimizer evaluates it once more for a filter.
    ends = ends_udf(judge).asNondeterministic()(F.col(text)) if judge else _ends_of.asNondeterministic()(F.col(text), said)
    return df.withColumn(out, ends)


def sentences(rows: DataFrame, key: str = "para_id", text: str = "text", lang: str | None = None, judge: Callable[[str], str] | None = None) -> DataFrame:
    """``(key, sent_no, sent_start, sent_end, sentence)`` for every sentence of
    ``rows``; rows resent with the same ``key`` count once, other columns are
    ignored, null and empty texts give no row. Languages as in ``sentence_bounds``."""
    need(rows, key, text)
    cut = sentence_bounds(rows.select(key, text, *([lang] if lang else [])).dropDuplicates([key]), text, "__ends", lang, judge)
    begins = F.expr("transform(sequence(0, size(__ends) - 1), i -> struct(i AS no, if(i = 0, 0, __ends[i - 1]) AS a, __ends[i] AS b))")
    return (
        cut.where(F.size("__ends") > 0).select(key, text, F.explode(begins).alias("s"))
        .select(key, F.col("s.no").alias("sent_no"), F.col("s.a").alias("sent_start"), F.col("s.b").alias("sent_end"),
                F.trim(F.substring(F.col(text), F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))).alias("sentence"))
    )
