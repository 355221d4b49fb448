"""Splitting of very long texts at sentence, word or character bounds."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpuscle.config import SETTINGS
from corpuscle.plans.runtime import ship

#: White space that ends a sentence: after . ? or !, but not after initials (e.g.) or a short form with a capital (Mr.).
SENTENCE = re.compile(r"(?<=[.?!])(?<!\w\.\w.)(?<![A-Z][a-z]\.)\s")


def _cuts(text: str, marks: list[int], pattern: re.Pattern, shift: int) -> list[int] | None:
    """For each mark, where the first match in what follows it begins, and shift on; None if one of them finds none.

    What is before a mark isn't looked at: a sentence that ends just there isn't seen, nor is a short form cut in two.
    """
    found = []
    for k, m in enumerate(marks):
        # Up to the next mark there is a match in most texts; only where there is none, the rest is copied.
        stop = marks[k + 1] if k + 1 < len(marks) else len(text)
        match = pattern.search(text[m:stop]) or pattern.search(text[m:])
        if match is None:
            return None
        found.append(m + match.start() + shift)
    return found


def split_text(text: str, n: float) -> list[str]:
    """n parts of about equal length: each mark goes to the next sentence's end, else all go to the next space, else they stay.

    White space at the end of a sentence begins the next part. A part is empty where two marks go to one place.
    """
    if n <= 0:
        return []
    if n <= 1:
        return [text]
    marks = [math.ceil(k / n * len(text)) for k in range(1, int(n))]
    at = _cuts(text, marks, SENTENCE, 0) if int(n) == n else None
    if at is None:
        at = _cuts(text, marks, re.compile(" "), 0) or marks
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


@F.pandas_udf(ArrayType(StringType()))
def _split(texts: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([split_text(t, n) for t, n in zip(texts, parts)])


def chunked(corpus: DataFrame, chunk_chars: int | None = None) -> DataFrame:
    """(doc_id, chunk_id, text): texts in chunks of about chunk_chars, trimmed and with one space at the end; null and empty texts go.

    Only texts that are longer pass through Python.
    """
    ship(corpus.sparkSession)
    limit = chunk_chars or SETTINGS.chunk_chars
    parts = F.ceil(F.length("text") / F.lit(limit))
    some = corpus.where("length(text) > 0")
    short = some.where(F.length("text") <= limit).select("doc_id", F.lit(0).alias("chunk_id"), "text")
    long = some.where(F.length("text") > limit).select("doc_id", F.posexplode(_split(F.col("text"), parts.cast("long"))).alias("chunk_id", "text"))
    return short.unionByName(long).withColumn("text", F.concat(F.regexp_replace("text", "^\\s+|\\s+$", ""), F.lit(" ")))
