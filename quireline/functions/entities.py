"""Character entities, resolved without leaving the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entities that must stay escaped in well-formed text.
KEPT = ("amp", "lt", "gt", "quot", "apos")
_ENTITY = r"&(#?[A-Za-z0-9]+);"


def entity_map(declared: dict[str, str] | None = None) -> dict[str, str]:
    """Name to text: the HTML names, then ``declared`` ones over them; names that
    must stay escaped give themselves back."""
    known = {name: chr(code) for name, code in name2codepoint.items()}
    known |= declared or {}
    return known | {name: f"&{name};" for name in KEPT}


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    """``(name)`` of a file of ``<!ENTITY name SDATA ...>`` declarations."""
    return spark.read.text(path).select(F.regexp_extract("value", r"<!ENTITY\s+([A-Za-z0-9.]+)\s+SDATA", 1).alias("name")).where("name != ''").distinct()


def resolve_entities(text: Column, known: dict[str, str], unknown: str = "", keep_numeric: bool = True) -> Column:
    """Entities replaced by their text, unknown ones by ``unknown``; numeric ones
    stay (or count as unknown). Split and matches are zipped, so nothing is
    resolved twice."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    parts = F.split(text, "&#?[A-Za-z0-9]+;", -1)
    names = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1))
    numeric = lambda n: F.concat(F.lit("&"), n, F.lit(";")) if keep_numeric else F.lit(unknown)
    texts = F.transform(names, lambda n: F.when(n.startswith("#"), numeric(n)).otherwise(F.coalesce(F.try_element_at(table, n), F.lit(unknown))))
    pairs = F.zip_with(parts, F.concat(texts, F.array(F.lit(""))), lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
    return F.array_join(pairs, "")


def preprocess(raw: Column, known: dict[str, str], void_tags: tuple[str, ...] = ("GRAPHIC",)) -> Column:
    """Markup made ready for a parser: no document type, no processing
    instructions, void tags closed, entities resolved (unknown ones removed)."""
    out = F.regexp_replace(raw, r"(?i)<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "")
    out = F.regexp_replace(out, r"<\?[^>]*\??>", "")
    for tag in void_tags:
        out = F.regexp_replace(out, rf"<({tag})((?:\s[^>]*?)?)\s*/?>", "<$1$2/>")
    return resolve_entities(out, known)


# Entities of running text and their signs.
TEXT_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "hellip": "…", "bull": "•", "sect": "§", "para": "¶",
    "copy": "©", "reg": "®", "trade": "™", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "ccedil": "ç", "ocirc": "ô",
}


def plain_text(raw: Column, known: dict[str, str] | None = None) -> Column:
    """Running text of markup: tags, numeric and unknown entities as blanks, the usual
    entities as their signs, single blanks."""
    from quireline.functions.text import squeeze

    return squeeze(resolve_entities(F.regexp_replace(raw, "<[^>]*>", " "), known or TEXT_ENTITIES, unknown=" ", keep_numeric=False))
