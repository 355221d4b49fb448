"""Session settings for large corpora, and small helpers around a run."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corpuscle.config import SETTINGS

log = logging.getLogger("corpuscle")

#: Adaptive plans merge small partitions and split skewed ones at run time; the sizes suit executors of some GB.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.session.timeZone": "UTC",
}


def configured(builder: SparkSession.Builder, **settings: str) -> SparkSession.Builder:
    """builder with DEFAULTS and settings (dots as double underscores: spark__sql__shuffle__partitions)."""
    for key, value in {**DEFAULTS, **{k.replace("__", "."): str(v) for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder


@contextmanager
def timed(name: str, slow: float = SETTINGS.slow_seconds) -> Iterator[None]:
    """Logs how long the block took, as a warning if it was slow. Plans are lazy: put an action inside."""
    began = time.monotonic()
    try:
        yield
    finally:
        took = time.monotonic() - began
        log.log(logging.WARNING if took > slow else logging.INFO, "%s took %.1f s", name, took)


def progress(items: Iterable, total: int, name: str = "", least: int = SETTINGS.progress_items) -> Iterator:
    """items, logging each tenth of them if there are least or more."""
    step = max(1, total // 10)
    for k, item in enumerate(items, 1):
        yield item
        if total >= least and k % step == 0:
            log.info("%s: %d of %d", name, k, total)


def is_large(corpus: DataFrame, documents: int = SETTINGS.large_corpus) -> bool:
    """Whether a corpus has more than this many documents; no more than that are looked at."""
    return corpus.select("doc_id").limit(documents + 1).count() > documents


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of any kind; which side is sent to which is left to the planner, which knows their sizes."""
    return left.join(right, on, how)
