"""Limits and defaults that the operators share."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 500_000
    per: float = 1_000_000.0
    kwic_words: int = 7
    preceding: int = 4
    following: int = 4
    large_corpus: int = 10_000
    long_text: int = 100_000
    large_file: int = 10_000_000
    slow_seconds: float = 5.0
    progress_items: int = 5_000


SETTINGS = Settings()
