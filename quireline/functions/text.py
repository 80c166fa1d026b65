"""Text functions as Column expressions; they stay inside code generation.

Patterns are written so that Java's and RE2's regular expressions read them the
same way. Blanks of all scripts count as blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks beyond ASCII, as a regular-expression class body.
BLANKS = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Typographic signs and what comparison takes them for.
LOOSE_SIGNS = {"“": '"', "”": '"', "‘": "'", "’": "'", "—": "--", "–": "-", "\xa0": " "}
STRICT_SIGNS = {**LOOSE_SIGNS, "—": "-", "‑": "-", "−": "-"}
# Months by language, for dates in running text.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11,
    "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
}
# Words without weight in coverage.
NOISE_WORDS = (
    "the", "a", "an", "of", "and", "or", "to", "in", "for", "is", "are", "by", "with", "that", "this", "it", "its", "as", "at", "on", "be", "was", "has", "have", "had",
    "will", "shall", "may", "must", "not", "any", "all", "each", "no", "if", "where", "who", "which",
)
# Words that label a heading, before a number or letter.
HEADING_LABELS = ("part", "section", "article", "chapter", "subsection", "division", "appendix", "annex", "schedule", "exhibit")
# Short names of issuing bodies, and kinds of documents, before a number.
ISSUERS = ("ni", "mi", "csa", "osc", "msc", "asc", "bcsc", "amf")
INSTRUMENTS = ("national", "multilateral")
DOCUMENT_KINDS = ("rule", "policy", "notice", "bulletin", "guideline")


def squeeze(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{BLANKS}]+", " "))


def swap_signs(text: Column, signs: dict[str, str]) -> Column:
    """Each key of ``signs`` replaced by its value."""
    one = {a: b for a, b in signs.items() if len(b) == 1}
    out = F.translate(text, "".join(one), "".join(one.values()))
    for a, b in signs.items():
        if len(b) != 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def loose_norm(text: Column, nfc=None) -> Column:
    """Form for comparing paragraphs: composed (if ``nfc`` is given), small letters,
    plain quotes, a long dash as two hyphens, single spaces."""
    return squeeze(swap_signs(F.lower(nfc(text) if nfc else text), LOOSE_SIGNS))


def strict_norm(text: Column, nfc=None) -> Column:
    """Form for comparing with a source: entities and tags must be gone; plain
    quotes and dashes, small letters, hyphens joined again to what follows them and
    blanks before closing marks removed."""
    out = squeeze(F.lower(swap_signs(nfc(text) if nfc else text, STRICT_SIGNS)))
    out = F.regexp_replace(out, r"([\p{L}\p{N}_]-) ([\p{L}\p{N}_])", "$1$2")
    return F.regexp_replace(out, r"([\p{L}\p{N}_]) ([;:,.])", "$1$2")


def plain_words_text(text: Column) -> Column:
    """Small ASCII letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """Words of a text that is already squeezed; the empty text has none."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(squeeze(text)))


def content_words(text: Column, noise: tuple[str, ...] = NOISE_WORDS) -> Column:
    """Words of three and more letters or digits that carry weight, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z\\x{e0}-\\x{ff}0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*noise))


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams in order, joined by spaces; fewer than ``n`` words give none."""
    return F.when(
        F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def gram_hashes(tokens: Column, n: int) -> Column:
    """Hashes of the different word n-grams. ``tokens`` should be a column that is
    there, not an expression: it is read once for each n-gram."""
    return F.when(
        F.size(tokens) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.xxhash64(F.slice(tokens, i, n))))
    ).otherwise(F.array().cast("array<bigint>"))


def windows(tokens: Column, size: int, step: int) -> Column:
    """Sliding windows of ``size`` words every ``step`` words."""
    return F.when(
        F.size(tokens) >= size,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - (size - 1), F.lit(step)), lambda i: F.slice(tokens, i, size)),
    ).otherwise(F.array().cast("array<array<string>>"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


_LETTERS_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP, _DASHES = " \t\n\r\f\v", "-–—"


def _past(text: Column, *signs: str) -> Column:
    """``text`` after its leading signs, set after set."""
    for group in signs:
        text = F.ltrim(text, F.lit(group))
    return text


def strip_heading_prefix(text: Column) -> Column:
    """A heading without its leading label or number ("Part 2 - ", "1.2.3 ", "IV. ");
    a heading that is nothing else stays.

    The first word tells the kind: a label takes the designator after it along, a
    number its points, a Roman number its one point.
    """
    first = F.regexp_extract(text, r"^\S+", 0)
    after = F.substring(text, F.length(first) + 1, F.length(text))
    designator = _past(after, _GAP)
    named = _past(designator, _LETTERS_DIGITS)
    label = F.lower(first).isin(*HEADING_LABELS) & (F.length(named) < F.length(designator))
    roman = F.translate(F.lower(F.rtrim(first, F.lit("."))), "ivx", "") == ""
    roman = roman & ~F.startswith(first, F.lit(".")) & (F.length(first) - F.length(F.rtrim(first, F.lit("."))) <= 1) & (after != "")
    bare = (
        F.when(label, _past(named, _GAP + "." + _DASHES))
        .when(F.substring(text, 1, 1).between("0", "9"), _past(text, "0123456789.", _GAP, _DASHES, _GAP))
        .when(roman, _past(after, _GAP, _DASHES, _GAP)).otherwise(text)
    )
    bare = F.trim(_past(bare, _GAP + _DASHES), F.lit(_GAP))
    return F.when(bare == "", text).otherwise(bare)


def heading_words(text: Column) -> Column:
    return F.array_distinct(words(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))))


def heading_similarity(a: Column, b: Column) -> Column:
    """Best word overlap of two headings, each with and without its prefix."""
    xs, ys = (a, strip_heading_prefix(a)), (b, strip_heading_prefix(b))
    return F.greatest(*[jaccard(heading_words(x), heading_words(y)) for x in xs for y in ys])


def norm_url(url: Column) -> Column:
    """An address without scheme, www and closing marks, in small letters."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^(?:https?://)?(?:www\.)?", ""), r"[/.,;:)]+$", "")


def norm_item(item: Column) -> Column:
    """A phone number or address without blanks and separators, in small letters."""
    return F.lower(F.regexp_replace(item, r"[\s().+-]", ""))


def sentences(text: Column) -> Column:
    """Plain sentence split: after . ; ! ? before a capital, a quote or a bracket."""
    return F.split(text, r"(?<=[.;!?])\s+(?=[A-Z\"(“])")


def bullets(text: Column) -> Column:
    """Items of an enumeration: after semicolons, before (a), 1. or a bullet sign."""
    return F.filter(F.split(text, r";\s+|\s+(?=\([a-z0-9]{1,3}\)\s)|\s*[•▪◦]\s*"), lambda x: F.trim(x) != "")


def title_case_ratio(text: Column) -> Column:
    """Share of words of four and more letters that begin with a capital."""
    long_ = F.filter(words(squeeze(text)), lambda w: F.length(w) >= 4)
    return F.when(F.size(long_) > 0, F.size(F.filter(long_, lambda w: F.regexp_like(w, F.lit("^[A-Z]")))) / F.size(long_)).otherwise(0.0)


def all_caps(text: Column) -> Column:
    """Whether a text has ASCII capitals and no small ASCII letter."""
    return F.regexp_like(text, F.lit("[A-Z]")) & ~F.regexp_like(text, F.lit("[a-z]"))


def near_number(a: Column, b: Column) -> Column:
    """Whether two figure strings of one length are anagrams or differ in one place."""
    x, y = F.split(a, ""), F.split(b, "")
    off = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p.eqNullSafe(q), 0).otherwise(1)), F.lit(0), lambda s, v: s + v)
    return (a != b) & (F.length(a) == F.length(b)) & ((F.array_sort(x) == F.array_sort(y)) | (off == 1))


def language_hint(text: Column) -> Column:
    """FR from six French letters on, else EN."""
    french = F.length(F.regexp_replace(text, "[^éèêàâùûîôçœÉÈÊÀÂÙÛÎÔÇŒ]", ""))
    return F.when(french > 5, "FR").otherwise("EN")


def number_reference(text: Column) -> Column:
    """First reference number of a text, with the words that say what it is: a short
    issuer ("NI 45-106"), else an instrument ("National Instrument 45-106"), else a kind
    of document ("Notice 45-106"), else the number alone. Of one kind the first counts;
    null if there is none."""
    flat = squeeze(text)
    w = F.split(flat, " ")
    word = lambda i: F.regexp_extract(F.coalesce(F.get(w, i), F.lit("")), r"[\p{L}\p{N}_]+$", 0)
    number = lambda i: F.regexp_extract(F.get(w, i), r"^[0-9]{2}-[0-9]{3}\b", 0)

    def named(i: Column) -> Column:
        last, before = F.lower(word(i - 1)), F.lower(word(i - 2))
        instrument = (last == "instrument") & (F.get(w, i - 1) == word(i - 1)) & before.isin(*INSTRUMENTS)
        kind = F.when(last.isin(*ISSUERS), 1).when(instrument, 2).when(last.isin(*DOCUMENT_KINDS), 3)
        said = F.when(instrument, F.concat_ws(" ", word(i - 2), word(i - 1))).otherwise(word(i - 1))
        return F.struct(kind.alias("kind"), i.alias("at"), F.concat_ws(" ", said, number(i)).alias("said"))

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: (i < F.size(w)) & (number(i) != ""))
    best = F.array_min(F.filter(F.transform(places, named), lambda x: x["kind"].isNotNull()))
    return F.coalesce(best["said"], F.nullif(F.regexp_extract(flat, r"\b[0-9]{2}-[0-9]{3}\b", 0), F.lit("")))


def text_date(text: Column) -> Column:
    """First date of a text as DATE: month day, year; day month year; ISO; labelled
    eight figures. A date that doesn't exist is null."""
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    month = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    flat = squeeze(text)

    def iso(pattern: str, y: int, m: int, d: int) -> Column:
        part = lambda k: F.regexp_extract(flat, pattern, k)
        number = F.coalesce(month[F.lower(part(m))].cast("string"), part(m))
        return F.concat_ws("-", part(y), F.lpad(number, 2, "0"), F.lpad(part(d), 2, "0"))

    forms = [
        (rf"(?i)\b({names}) ([0-9]{{1,2}}),? ([0-9]{{4}})\b", 3, 1, 2),
        (rf"(?i)\b([0-9]{{1,2}}) ({names}) ([0-9]{{4}})\b", 3, 2, 1),
        (r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b", 1, 2, 3),
        (r"(?i)\bdate: ?([0-9]{4})([0-9]{2})([0-9]{2})\b", 1, 2, 3),
    ]
    return F.coalesce(*[F.try_to_date(F.when(F.regexp_like(flat, F.lit(p)), iso(p, y, m, d)), "yyyy-MM-dd") for p, y, m, d in forms])


def stamp_date(text: Column) -> Column:
    """A date written yyyyMMdd or yyyy-MM-dd as DATE, else null."""
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(text, "yyyy-MM-dd"))


# Entities of a table cell and their signs, in the order they are read.
CELL_ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&nbsp;", " "),
)


def cell_text(raw: Column) -> Column:
    """Text of a table cell: tags away, the usual entities decoded, no blanks around."""
    out = F.regexp_replace(raw, "<[^>]+>", "")
    for name, sign in CELL_ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(out, F.lit(_GAP))


def wrap_in_tag(line: Column, part: Column, tag: str) -> Column:
    """``part`` in the line put between tags: its exact form, else the first that
    differs only in case; a line without it stays."""
    exact = F.instr(line, part)
    any_case = F.instr(F.lower(line), F.lower(part))
    at = F.when(exact > 0, exact).otherwise(any_case)
    size = F.length(part)
    wrapped = F.concat(F.substring(line, F.lit(1), at - 1), F.lit(f"<{tag}>"), F.substring(line, at, size), F.lit(f"</{tag}>"), F.substring(line, at + size, F.length(line)))
    return F.when(at > 0, wrapped).otherwise(line)


def tier(value: Column, steps: list[tuple[float, float]], below: float = 0.0) -> Column:
    """Points of the first step ``(least value, points)`` that a value reaches."""
    out = F.lit(float(below))
    for least, points in sorted(steps):
        out = F.when(value >= least, float(points)).otherwise(out)
    return out
