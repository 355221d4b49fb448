"""One query for each operator, with its production parameters, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import backoff, decontaminate, ivfpq, langspans, linecrf, mixing, pseudonyms, secrets, simhash, urltrees
from corpuscle.plans.runtime import table


def op1_ivfpq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, ids that are divisible by 20, against all rows."""
    return ivfpq.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: Stands in for a table of labelled URLs, which the test tables don't have: hosts with one of these words are labelled 1.
BLOCKED_WORDS = ("casino", "bets", "pills", "ads", "poker", "viagra", "porn")


def stand_in_labels(pages: DataFrame) -> DataFrame:
    """(url, label) of the URLs of pages that have a host."""
    host = urltrees.host(F.col("url"))
    found = F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(w) for w in BLOCKED_WORDS]))
    return pages.where(host != "").select("url", found.cast("int").alias("label"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urltrees.filter_urls(pages, stand_in_labels(pages))


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key in spark.corpuscle.pseudonyms.key (hexadecimal), else a new one: nobody then undoes or continues these pseudonyms."""
    named = spark.conf.get("spark.corpuscle.pseudonyms.key", None)
    return bytes.fromhex(named) if named else os.urandom(32)


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op4_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score_documents(table(spark, sf_dir, "documents"), stable=True)


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langspans.identify(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("__copy").alias("copy"), "text")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ivfpq_neighbours,
        op2_url_filter,
        op3_pii_pseudonyms,
        op4_line_crf_quality,
        op5_simhash_near_dedup,
        op6_secret_scan,
        op7_stupid_backoff,
        op8_language_spans,
        op9_source_mixing,
        op10_benchmark_decontamination,
    )
}

ORACLES: dict[str, str] = {
    "op6_secret_scan": secrets.ORACLE,
    "op7_stupid_backoff": backoff.ORACLE,
    "op9_source_mixing": mixing.oracle(columns="doc_id, source, copy, text"),
}
