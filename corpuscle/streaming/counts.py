"""Tag counts over a stream of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators.groups import is_word
from corpuscle.operators.tagger import RuleTagger
from corpuscle.functions.clean import clean_corpus
from corpuscle.plans.runtime import shared_dir

#: Tags of tokens before units are joined: a unit counts at its first token.
_GOES_ON = "[0-9][02-9]$"


def tag_stream(documents: DataFrame) -> DataFrame:
    """(Tag, AF): running counts over a stream (or table) of documents (doc_id, text), for update or complete mode.

    Tagging is a projection of each document and counts are sums, so the state has one row a tag. A possessive s after
    it is known by the word before it, which the tagger hands on.
    """
    texts = clean_corpus(documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")))
    t = RuleTagger().tag(texts, before=True)
    possessive = (F.lower("token") == "s") & (F.col("before") == "it")
    own = t.where(~F.col("pos_tag").rlike(_GOES_ON)).withColumn("Tag", F.when(possessive, "GE").otherwise(F.regexp_replace("pos_tag", "[0-9][0-9]$", "")))
    return own.where(is_word("pos", "Tag")).groupBy("Tag").agg(F.count("*").alias("AF"))


def streamed_tag_counts(spark: SparkSession, path: str) -> DataFrame:
    """tag_stream over a Parquet folder or file, read as a stream to its present end, and its last state as a table."""
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # A pattern that only path matches: a stream takes no single file by its plain name.
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    query = tag_stream(source).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/result")
