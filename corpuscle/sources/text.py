"""Corpora from folders of text files, tables, and samples."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle import validation as check
from corpuscle.errors import DuplicateDocuments, SourceFailed


def _binary(spark: SparkSession, directory: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(directory)


def get_text_paths(spark: SparkSession, directory: str, recursive: bool = False) -> list[str]:
    """Paths of the folder's text files, sorted. None are an error, unless recursive."""
    check.folder(directory)
    paths = sorted(r["path"] for r in _binary(spark, directory, recursive).select("path").toLocalIterator())
    return paths if recursive else check.text_files(paths)


def _decoded(files: DataFrame) -> DataFrame:
    """(doc_id, text) of files (path, content): UTF-8, or Latin-1 where that isn't valid; the file's name is the id."""
    content = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("doc_id"), F.regexp_replace(content, "^\\s+|\\s+$", "").alias("text"))


def _known(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there, by the file system's own listing: no job."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            there.append(p)
    return there


def readtext(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A corpus of these files, in no order. Files that aren't there, with a warning, or can't be read are empty texts.

    All files are read in one scan, by the executors; a file that fails there is left out by it, and joined again by its name.
    """
    check.text_files(paths)
    names = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    if len(set(names)) < len(names):
        raise DuplicateDocuments(f"files have the same name: {sorted({n for n in names if names.count(n) > 1})[:5]}")
    there = _known(spark, paths)
    for p in sorted({*paths} - {*there}):
        warnings.warn(f"{p} can't be read", check.CorpusWarning, stacklevel=2)
    expected = spark.createDataFrame([(n,) for n in names], "doc_id string")
    if not there:
        return expected.withColumn("text", F.lit(""))
    files = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(there)
    return expected.join(_decoded(files), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def corpus_from_folder(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """A corpus of the folder's text files, in no order, read by the executors; no file passes through the driver.

    Names are checked ahead, in one job over the listing of files, without their contents.
    """
    check.folder(directory)
    files = _binary(spark, directory, recursive)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    n, twice = files.groupBy(name.alias("doc_id")).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max(F.when(F.col("n") > 1, F.col("doc_id")))).first()
    if not n:
        raise SourceFailed(f"there are no text files in {directory!r}")
    if twice is not None:
        raise DuplicateDocuments(f"files have the same name: {twice}")
    return _decoded(files)


def corpus_from_table(table: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A corpus of two columns of any table."""
    return table.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))


def corpus_from_file(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A corpus of a Parquet, ORC, JSON lines or CSV file (by its ending) with a header."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read
    if kind == "csv":
        table = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif kind in ("json", "jsonl"):
        table = reader.json(path)
    elif kind in ("parquet", "orc"):
        table = reader.format(kind).load(path)
    else:
        raise SourceFailed(f"{path!r} ends with none of .parquet, .orc, .json, .jsonl and .csv")
    return corpus_from_table(table, doc_id, text)


def sample_tokens(spark: SparkSession, documents: int = 5) -> DataFrame:
    """A small tokens table to try operators on: invented sentences, tagged by the built-in rules."""
    from corpuscle.operators.tokens import parse

    texts = ["It s such as the data. In that case, the study was very clear and the results are strong.", "The data set, the end. Its authors would not say which of the findings may be used.", "This is a long list of things that we have seen, and it is growing quickly.", "They walked to the river in that year; 12 of them returned.", "State law shall be read as such as possible."]
    rows = [(f"sample_{k:02d}", texts[k % len(texts)]) for k in range(documents)]
    return parse(spark.createDataFrame(rows, "doc_id string, text string"))
