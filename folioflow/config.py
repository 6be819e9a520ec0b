"""Parameters of the engine with their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """All knobs of cleaning, chunking, search and answers."""

    # Limits that results depend on.
    max_chunk_tokens: int = 1000
    min_chunk_tokens: int = 30
    min_body_budget: int = 100
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    lexical_top_k: int = 20
    dense_top_k: int = 20
    hybrid_top_k: int = 20
    lexical_weight: float = 0.5
    dense_weight: float = 0.5
    dimension: int = 384
    scanned_page_chars: int = 50
    scanned_page_share: float = 0.5
    short_document_chars: int = 200
    question_chars: int = 1000

    @classmethod
    def from_environment(cls, prefix: str = "FOLIOFLOW_") -> Config:
        """Defaults overridden by environment variables such as ``FOLIOFLOW_BM25_K1``."""
        given = {f.name: type(f.default)(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**given)


DEFAULT = Config()
