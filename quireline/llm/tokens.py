"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Folder and file of the vocabulary (byte-level pairs for many languages, as ranks).
FOLDER, FILE = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level vocabularies cut a text before pairing.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(folder: str, file: str):
    """The tokenizer of a rank file; read once by each process."""
    import tiktoken

    with open(os.path.join(folder, file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, folder: str = FOLDER, file: str = FILE) -> int:
    """Number of tokens of the whole ``text``; special tokens' names are ordinary text."""
    return len(encoding(folder, file).encode_ordinary(text))


def token_count(text: Column, folder: str = FOLDER, file: str = FILE) -> Column:
    """Tokens of each text; null for null, 0 for the empty text."""

    @F.pandas_udf(LongType())
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: count_tokens(x, folder, file), na_action="ignore").astype("Int64")

    # Not deterministic for the optimizer, lest it counts once more for a filter.
    return run.asNondeterministic()(text)
