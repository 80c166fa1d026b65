"""Where a run finds its files, from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Folder of the corpus and file of the decision log; both may be unset."""

    corpus: str | None = None
    decisions: str | None = None

    @classmethod
    def of(cls, environment: Mapping[str, str] = os.environ) -> Settings:
        """From ``CORPUS_DIR`` and ``DECISIONS_FILE``; empty values count as unset."""
        return cls(environment.get("CORPUS_DIR") or None, environment.get("DECISIONS_FILE") or None)

    def need_corpus(self) -> str:
        """The corpus folder, or a clear error if it isn't set."""
        if not self.corpus:
            raise ValueError("CORPUS_DIR must name the folder of the corpus")
        return self.corpus
