"""Session-level helpers: shared storage for checkpoints, the workers' import path, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is missing and the executors are threads of this machine (tests, notebooks), a temporary folder
    of it is used; on a cluster it would be another folder for each executor, so that a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir isn't set: it names the folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpuscle-checkpoint-")
    sc.setCheckpointDir(named)
    return named


class Kept:
    """A table written as Parquet in the shared folder: read by columns, compressed, and removed by drop()."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers that this driver starts (a cluster gets it with --py-files)."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
