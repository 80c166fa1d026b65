"""The few functions that Spark has no expression for, on Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonically composed form."""
    return text.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by matching blocks, 0 to 1; null if one is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(BooleanType())
def xml_ok(raw: pd.Series) -> pd.Series:
    """Whether a text is well-formed by itself or, failing that, put into one root."""
    import xml.etree.ElementTree as ET

    def fits(t: str) -> bool:
        try:
            ET.fromstring(t)
            return True
        except (ET.ParseError, ValueError):
            return False

    return raw.map(lambda t: fits(t) or fits(f"<all>{t}</all>"), na_action="ignore")


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
_META = re.compile(rb"<meta\s[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def decoded(raw: bytes, headers: str | None) -> str:
    """Text of a page's bytes: UTF-8 if they are, else the first charset that its
    headers or its markup declare and that fits, else one sign a byte."""
    tries = ["utf-8", *(m[1].decode("ascii") for m in (_CHARSET.search((headers or "").encode()), _META.search(raw)) if m)]
    for name in tries:
        try:
            return str(raw, name)
        except (UnicodeError, LookupError):
            pass
    return raw.decode("iso-8859-1")


@F.pandas_udf(StringType())
def page_text(raw: pd.Series, headers: pd.Series) -> pd.Series:
    """``decoded`` for columns; null bytes give null."""
    return pd.Series([None if r is None else decoded(bytes(r), h) for r, h in zip(raw, headers)], dtype=object)
