"""Checks of tables and parameters. Schemas are checked on the driver; data in one aggregate job."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

from corpuscle.config import SETTINGS
from corpuscle.errors import DuplicateDocuments, SchemaMismatch, SizeWarning, SourceFailed, CorpusWarning, ValidationFailed
from corpuscle.schema import FREQUENCY, TAGS, TOKENS


def require(df: DataFrame, schema: StructType, what: str) -> DataFrame:
    """df, if it has the columns of schema: strings as strings, numbers as any numbers. More columns are fine."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema.fields:
        if field.name not in have:
            raise SchemaMismatch(f"{what}: column {field.name!r} is missing; there are {df.columns}")
        string = isinstance(field.dataType, StringType)
        if not isinstance(have[field.name], StringType if string else NumericType):
            raise SchemaMismatch(f"{what}: column {field.name!r} is {have[field.name].simpleString()}, not {'string' if string else 'a number'}")
    return df


def corpus(df: DataFrame, data: bool = True) -> DataFrame:
    """A corpus (doc_id, text), both strings. With data, ids that are null or twice are errors; empty, null, long texts and many documents warn."""
    if df.columns != ["doc_id", "text"] or not all(isinstance(f.dataType, StringType) for f in df.schema.fields):
        raise SchemaMismatch(f"a corpus has the columns doc_id and text, both strings; this has {df.dtypes}")
    if data:
        n = F.length("text")
        seen = df.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("text").isNull().cast("long")).alias("null"), F.sum((F.trim("text") == "").cast("long")).alias("empty"), F.max(n).alias("longest"))
        r = seen.agg(F.sum("n").alias("n"), F.count("*").alias("ids"), F.max(F.col("doc_id").isNull()).alias("no_id"), F.max(F.col("n")).alias("most"), F.sum("null").alias("null"), F.sum("empty").alias("empty"), F.max("longest").alias("longest")).first()
        if r["no_id"]:
            raise ValidationFailed("there are documents without doc_id")
        if (r["most"] or 0) > 1:
            raise DuplicateDocuments("there are doc_ids of more than one document")
        for count, what in ((r["null"], "null"), (r["empty"], "empty")):
            if count:
                warnings.warn(f"{count} texts are {what}", CorpusWarning, stacklevel=2)
        if (r["longest"] or 0) > SETTINGS.long_text:
            warnings.warn(f"the longest text has {r['longest']} characters", SizeWarning, stacklevel=2)
        if (r["n"] or 0) > SETTINGS.large_corpus:
            warnings.warn(f"there are {r['n']} documents", SizeWarning, stacklevel=2)
    return df


def tokens(df):
    """A tokens table, or Texts in its place."""
    from corpuscle.operators.texts import Texts

    return df if isinstance(df, Texts) else require(df, TOKENS, "tokens table")


def frequencies(df: DataFrame, tags_only: bool = False) -> DataFrame:
    return require(df, TAGS if tags_only else FREQUENCY, "tags table" if tags_only else "frequency table")


def layer(count_by: str, both: bool = False) -> str:
    allowed = ["pos", "ds", *(["both"] if both else [])]
    if count_by not in allowed:
        raise ValidationFailed(f"count_by is one of {allowed}, not {count_by!r}")
    return count_by


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValidationFailed(f"{what} is one of {list(allowed)}, not {value!r}")
    return value


def span(n: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or not 2 <= n <= 5:
        raise ValidationFailed(f"span is from 2 to 5, not {n!r}")
    return n


def position(at: int, of: int) -> int:
    """A position within a span: below 1 is an error, beyond the span is its end."""
    if at < 1:
        raise ValidationFailed(f"a position counts from 1, not {at}")
    return min(at, of)


def folder(path: str) -> str:
    if "://" not in path:
        if not os.path.exists(path):
            raise SourceFailed(f"there is no folder {path!r}")
        if not os.path.isdir(path):
            raise SourceFailed(f"{path!r} is no folder")
    return path


def text_files(paths: list[str]) -> list[str]:
    """Paths, if there are any; a large file warns."""
    if not paths:
        raise SourceFailed("there are no text files")
    for p in paths:
        if "://" not in p and os.path.exists(p) and os.path.getsize(p) > SETTINGS.large_file:
            warnings.warn(f"{p} has more than {SETTINGS.large_file} bytes", SizeWarning, stacklevel=2)
    return paths


def dtm(df: DataFrame) -> DataFrame:
    """A document-term matrix: doc_id, then numbers."""
    if not df.columns or df.columns[0] != "doc_id":
        raise SchemaMismatch("the first column of a document-term matrix is doc_id")
    if len(df.columns) < 2 or not all(isinstance(f.dataType, NumericType) for f in df.schema.fields[1:]):
        raise SchemaMismatch("the columns of a document-term matrix after doc_id are numbers")
    return df


def word_classes(tags: list[str]) -> None:
    """Simplification is for part-of-speech tags: one of NN, VV, II at least is there."""
    if not any(t.startswith(("NN", "VV", "II")) for t in tags):
        raise ValidationFailed("none of the tags begins with NN, VV or II: these aren't part-of-speech tags")


def why_empty(operator: str) -> list[str]:
    """What to try when an operator gives no rows."""
    common = ["check that the tokens table has rows", "check the layer (pos or ds)"]
    return {
        "ngrams": ["lower min_frequency: it is per million", *common],
        "clusters": ["check the spelling of the node", "try search_type 'contains'", *common],
        "kwic": ["check the spelling of the node", "try ignore_case=True", "try search_type 'contains'", *common],
        "collocations": ["check that the node occurs", "widen preceding and following", "drop node_tag", *common],
        "keyness": ["raise the threshold", "try swap_target=True", *common],
    }.get(operator, common)
