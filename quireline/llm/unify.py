"""Problem 1: one stored form for texts that look the same.

Method: a longest-match transducer over grapheme clusters. ``build_table``
precomputes, by rule from the Unicode character database, what every sign and every
cluster of a base and its marks that has a composed sign turns into (width, joined
letters, blanks, invisible signs, accents, look-alike letters). ``check_table`` refuses
a table in which two letters of one script would fall together. ``Transducer`` compiles
the keys into one alternation that always takes the longest cluster, so a text is
rewritten in one pass from left to right; clusters that have no composed sign (and
Hangul ones, which are composed by rule) are derived from the table once and remembered.
"""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from quireline.llm.common import need

# Letters of other scripts that are drawn like a Latin letter.
CYRILLIC = ("аеорсухіѕјһԁԛԝӏАВЕКМНОРСТУХІЅЈԚԜ", "aeopcyxisjhdqwlABEKMHOPCTYXISJQW")
GREEK = ("ονραυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpauABEZHIKMNOPTYX")
ARMENIAN = ("օսհՕՍ", "ouhOU")
CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ")
COPTIC = ("ⲞⲟⲎⲒⲔⲘⲚⲢⲣⲤⲥⲦⲬ", "OoHIKMNPpCcTX")
# Katakana drawn like Han signs, and Hiragana like Katakana.
KATAKANA = ("ニカロエハタトー", "二力口工八夕卜一")
HIRAGANA = ("へべぺ", "ヘベペ")
SCRIPTS = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Coptic": COPTIC, "Katakana": KATAKANA, "Hiragana": HIRAGANA}

#: Decomposition tags under which only the drawing differs, not the sign.
SAME_SIGN = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Presentation blocks of joined letters (Latin and Armenian).
JOINED = range(0xFB00, 0xFB18)
#: Signs with no picture that aren't of the format category.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10)]))
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85  "


def check_injective(mapping: dict[str, str], script: str) -> None:
    """No two letters of one script may get one image, nor a letter the image of itself."""
    images: dict[str, str] = {}
    for a, b in mapping.items():
        if b in images or a == b:
            raise ValueError(f"{script}: {a!r} and {images.get(b, a)!r} both become {b!r}")
        images[b] = a


def lookalikes() -> dict[str, str]:
    """Look-alike letter to its common form, checked script by script."""
    out: dict[str, str] = {}
    for script, (a, b) in SCRIPTS.items():
        one = dict(zip(a, b, strict=True))
        check_injective(one, script)
        clash = out.keys() & one.keys()
        if clash:
            raise ValueError(f"{script}: {clash} mapped twice")
        out |= one
    # Drawn alike across two steps (Hiragana, Katakana, Han) end in one form.
    return {a: out.get(b, b) for a, b in out.items()}


def plain_sign(ch: str) -> str | None:
    """What a single sign turns into before look-alikes, or None if it stays."""
    cat = U.category(ch)
    if ch in UNSEEN or cat == "Cf":
        return ""
    if cat == "Zs" or ch in BLANKS:
        return " "
    tag = U.decomposition(ch).split(" ", 1)[0]
    if tag in SAME_SIGN or (tag == "<compat>" and ord(ch) in JOINED):
        return U.normalize("NFKC", ch)
    if ch == "‑":
        return "‐"
    nfc = U.normalize("NFC", ch)
    return None if nfc == ch else nfc


def derive(cluster: str, like: dict[str, str]) -> str:
    """Image of a sign or cluster by the rules, sign by sign."""
    out = U.normalize("NFC", "".join(plain_or(c) for c in cluster))
    if like:
        out = U.normalize("NFC", "".join(like.get(c, c) for c in U.normalize("NFD", out)))
        out = "".join(like.get(c, c) for c in out)
    return out


@lru_cache(maxsize=2)
def build_table(alike: bool) -> dict[str, str]:
    """Every sign of the Basic Multilingual Plane that changes, and every cluster of a
    base, its own or one drawn alike, with the marks of a composed sign; checked."""
    like = lookalikes() if alike else {}
    drawn: dict[str, list[str]] = {}
    for a, b in like.items():
        drawn.setdefault(b, []).append(a)
    table = {}
    for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0xE0000, 0xE0200)]:
        ch = chr(c)
        new = derive(ch, like)
        if new != ch:
            table[ch] = new
        parts = U.normalize("NFD", ch)
        if len(parts) > 1 and not 0xAC00 <= c < 0xD7A4:
            for base in (parts[0], *drawn.get(parts[0], ())):
                table[base + parts[1:]] = derive(base + parts[1:], like)
    check_table(table)
    return table


def check_table(table: dict[str, str]) -> None:
    """No two letters of one script may get one image. Signs that are only another way
    to store a letter (composed, wide, joined) are no letters of their own."""
    seen: dict[tuple[str, str], str] = {}
    for c in range(0x10000):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or U.category(ch) not in ("Lu", "Ll", "Lo") or plain_or(ch) != ch:
            continue
        place = U.name(ch, "").split(" ", 1)[0], table.get(ch, ch)
        if place in seen:
            raise ValueError(f"{ch!r} and {seen[place]!r} both become {place[1]!r}")
        seen[place] = ch


def _span(chars: list[str]) -> str:
    """Character class of sorted signs, runs as ranges."""
    out, codes = [], sorted(map(ord, chars))
    start = prev = None
    for c in [*codes, None]:
        if prev is not None and c == prev + 1:
            prev = c
            continue
        if prev is not None:
            out.append(re.escape(chr(start)) + ("" if start == prev else "-" + re.escape(chr(prev))))
        start = prev = c
    return "".join(out)


class Transducer:
    """One-pass rewriting of a text, cluster by cluster, longest match first."""

    #: Clusters remembered per process; the memory is emptied beyond it.
    REMEMBER = 20_000

    def __init__(self, alike: bool) -> None:
        self.alike, self.table = alike, build_table(alike)
        self.like = lookalikes() if alike else {}
        signs = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
        unseen = [c for c, new in self.table.items() if new == ""]
        blanks = [c for c, new in self.table.items() if new == " "] + [" "]
        # Some vowel signs are composed though they are no combining marks.
        marks = {c for c in signs if U.combining(c) or 0x1160 <= ord(c) < 0x1200 or c in "ﾞﾟ"} | {c for k in self.table if len(k) > 1 for c in k[1:]}
        b, i, m = _span(blanks), _span(unseen), _span(sorted({*marks, *unseen}))
        # A single plain space stays; runs of blanks and unseen signs are one cluster.
        single = [c for c in self.table if len(c) == 1]
        self.pattern = re.compile(f"[{b}{i}]{{2,}}|[^{b}][{m}]+|[{_span(single)}]", re.DOTALL)
        self.blank = re.compile(f"[{b}]")
        self.unseen = set(unseen)
        self.known: dict[str, str] = {}
        self.idle = re.compile("[ -~]*")

    def cluster(self, s: str) -> str:
        """Image of one cluster."""
        out = self.table.get(s)
        if out is None:
            out = self.known.get(s)
        if out is None:
            if self.blank.search(s):
                out = " "
            else:
                # Marks in their order, unseen signs away: most are in the table so.
                seen = U.normalize("NFD", "".join(c for c in s if c not in self.unseen))
                out = self.table.get(seen)
                if out is None:
                    out = derive(s, self.like)
            if len(self.known) >= self.REMEMBER:
                self.known.clear()
            self.known[s] = out
        return out

    def __call__(self, text: str) -> str:
        """The one form of ``text``; blanks at both ends fall away."""
        if self.idle.fullmatch(text):
            return re.sub(" +", " ", text).strip(" ")
        return self.pattern.sub(lambda m: self.cluster(m[0]), text).strip(" ")

    def traced(self, text: str) -> tuple[str, list[int] | None]:
        """The form without trimming, and for each of its signs the number of
        signs of ``text`` up to and including its last visible one (None if
        nothing changed)."""
        if not self.pattern.search(text):
            return text, None
        out, ends, at = [], [], 0
        for m in self.pattern.finditer(text):
            out.append(text[at : m.start()])
            ends.extend(range(at + 1, m.start() + 1))
            new = self.cluster(m[0])
            seen = m.end()
            while seen > m.start() + 1 and text[seen - 1] in self.unseen:
                seen -= 1
            out.append(new)
            ends.extend([seen] * len(new))
            at = m.end()
        out.append(text[at:])
        ends.extend(range(at + 1, len(text) + 1))
        return "".join(out), ends


def plain_or(ch: str) -> str:
    """A sign after the rules for width, joining, blanks and unseen signs."""
    new = plain_sign(ch)
    return ch if new is None else new


@lru_cache(maxsize=2)
def transducer(alike: bool) -> Transducer:
    """The process's transducer, with or without look-alike letters."""
    return Transducer(alike)


_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_OTHER = {"Cyrillic": re.compile("[Ѐ-ԯ]"), "Greek": re.compile("[Ͱ-Ͽ]")}
_BORROWING = re.compile("[Ͱ-Ͽ԰-֏Ѐ-ԯ]")
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=20_000)
def _one_script(word: str) -> str:
    """A word of mixed scripts in the script of its letters that have no double."""
    like = lookalikes()
    back = {s: {b: a for a, b in zip(*SCRIPTS[s], strict=True)} for s in _OTHER}
    parts = U.normalize("NFD", word)
    for script, sign in _OTHER.items():
        own = sum(1 for c in parts if sign.match(c) and c not in like)
        latin = sum(1 for c in parts if _LATIN.match(c) and c not in back[script])
        if own > latin and sign.search(parts):
            return U.normalize("NFC", "".join(back[script].get(c, c) for c in parts))
    if _LATIN.search(parts) and any(c in like for c in parts):
        return U.normalize("NFC", "".join(like.get(c, c) for c in parts))
    return word


def readable(text: str) -> str:
    """The one form for reading: widths, accents, blanks and unseen signs as in
    the key, borrowed letters given back to the script of their word."""
    out = transducer(False)(text)
    if out.isascii() or not _BORROWING.search(out):
        return out
    return _WORD.sub(lambda m: m[0] if m[0].isascii() else _one_script(m[0]), out)


@F.pandas_udf(StringType())
def _readable_udf(text: pd.Series) -> pd.Series:
    return text.map(readable, na_action="ignore")


@F.pandas_udf(StringType())
def _key_udf(text: pd.Series) -> pd.Series:
    return text.map(transducer(True), na_action="ignore")


@F.pandas_udf(BinaryType())
def _digest_of(text: pd.Series) -> pd.Series:
    from hashlib import blake2b

    form = transducer(True)
    return text.map(lambda t: blake2b(form(t).encode("utf-8", "surrogatepass"), digest_size=16).digest(), na_action="ignore")


#: Declared not deterministic, lest the optimizer evaluates it once more for a filter.
_digest_udf = _digest_of.asNondeterministic()


def look_key(text: Column) -> Column:
    """Comparison form: equal for two texts exactly if they look the same."""
    return _key_udf(text)


def unify(df: DataFrame, text: str = "text", out: str = "unified", key: str | None = None) -> DataFrame:
    """``df`` with the readable one form of column ``text`` in column ``out``
    and, if ``key`` is given, the comparison form in column ``key``.

    A null text gives null, an empty or all-blank one the empty string; a column
    that is already called ``out`` or ``key`` is replaced; rows and other
    columns stay as they are. No shuffle.
    """
    need(df, text)
    new = {out: _readable_udf(F.col(text))}
    if key:
        new[key] = look_key(F.col(text))
    return df.withColumns(new)


def same_looking_pairs(rows: DataFrame, left: str = "sgml", right: str = "pdf_l4") -> DataFrame:
    """``(para_a, para_b)``: each pair of a row of side ``left`` and one of side
    ``right`` with the same ``doc_id`` whose texts look the same and differ as
    stored; the smaller id first.

    Rows with a null ``doc_id`` or text pair with none; resent rows (same
    ``para_id``) count once; other columns are ignored. Only ids and 16-byte
    digests are shuffled, once for each side, keyed by filing and digest, so
    neither a large filing nor a text of many copies gathers foreign rows (texts
    move only where a query spreads a scan of too few pieces); the
    result itself holds every pair and therefore may be as large as the product
    of the copies.
    """
    need(rows, "para_id", "doc_id", "side", "text")
    small = (
        rows.where(F.col("side").isin(left, right) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
        .select("para_id", "doc_id", "side", F.xxhash64("text").alias("stored"), _digest_udf(F.col("text")).alias("look"))
    )
    a, b = (small.where(F.col("side") == s).dropDuplicates(["doc_id", "look", "para_id"]) for s in (left, right))
    b = b.select("doc_id", "look", F.col("para_id").alias("other_id"), F.col("stored").alias("other"))
    return (
        a.join(b, ["doc_id", "look"]).where(F.col("stored") != F.col("other"))
        .select(F.least("para_id", "other_id").alias("para_a"), F.greatest("para_id", "other_id").alias("para_b"))
    )
