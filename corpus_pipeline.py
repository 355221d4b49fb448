"""Five stages over the documents, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns documents (doc_id, text, lang, source, n_chars); the last one adds copy.
Of all stages: an empty table gives an empty table; other columns of docs are dropped, whatever their names; rows with a null
in lang, source or n_chars are as any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import decontaminate, linecrf, mixing, secrets, simhash
from corpuscle.plans.runtime import Kept, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame, changed: str) -> DataFrame:
    """COLUMNS of docs, n_chars counted anew where the text has changed."""
    return docs.withColumn("n_chars", F.when(F.col(changed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field over lines rates as bad go.

    A row is judged by its text alone: repeated rows go or stay together, a null doc_id is no matter. A null, empty or
    blank text has no line that could be good, and goes. At the threshold a document stays. Without labels of both kinds there is no
    field, and all texts with a letter stay.
    """
    return linecrf.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id.

    Null and empty texts, and rows without doc_id, are in no group and stay. Rows with one doc_id are
    one document with several texts: it stays or goes as a whole, and stays as its least text (null last).
    """
    return simhash.deduplicate(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; a document of which nothing is left goes.

    Rows are judged one by one, also repeated ones and those without doc_id. Null and empty texts lose nothing and stay.
    n_chars is counted anew where something was cut out.
    """
    cleaned = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _measured(cleaned.where("__words = 0 OR length(trim(text)) > 0"), "__words")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no row goes. n_chars is counted anew where something was masked.

    Null and empty texts stay as they are; repeated rows are masked alike.
    """
    return _measured(secrets.mask(docs), "__secrets")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated to the target weights of their sources; copy counts from 1.

    Rows are ordered by doc_id, then text, nulls first; rows that tie are equal in both. A null source is one of its own; a source
    without characters has no copies.
    """
    return mixing.mix(docs).select(*COLUMNS, F.col("__copy").alias("copy"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", mixture),
]

#: The field's training and the graphs' components are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage kept is written as Parquet to the shared folder, as the next one reads it several
    times, and removed once the next one's is written; the last stage's input stays for its result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        kept = Kept(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = kept.read(), kept
    return STAGES[-1][1](spark, docs, sf_dir)
