"""From raw tokens to the tokens table: multi-word units, their ids, and corrections of tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.chunk import chunked
from corpuscle.functions.clean import clean_corpus
from corpuscle.operators.order import offsets
from corpuscle.operators.tagger import RuleTagger, Tagger, checked
from corpuscle.validation import corpus as valid_corpus

PUNCTUATION = "^\\p{Punct}+$"


def finish(raw: DataFrame, merge_multiword: bool = True, global_ids: bool = True) -> DataFrame:
    """The tokens table of raw tokens, with tok_idx.

    pos_id and ds_id count units from 1, over the whole corpus in the order of doc_id, or within each document if not global_ids.
    A tag that ends with two digits, the last not 1, goes on with the unit before it (merge_multiword); I- labels do.
    """
    w = Window.partitionBy("doc_id").orderBy("tok_idx")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    # Few tags have a digit before the last sign: the patterns are for these alone.
    numbered = F.substring("pos_tag", -2, 1).between("0", "9")
    goes_on = numbered & F.col("pos_tag").rlike("[0-9][02-9]$") if merge_multiword else F.lit(False)
    base = F.when(numbered, F.regexp_replace("pos_tag", "[0-9][0-9]$", "")).otherwise(F.col("pos_tag")) if merge_multiword else F.col("pos_tag")
    begins = F.col("ds_tag").startswith("B-") | F.col("ds_tag").startswith("O-")
    label = F.when(F.col("ds_tag") == "O-", "Untagged").when(begins, F.regexp_replace("ds_tag", "^(B-|O-)", ""))
    t = raw.select(
        "doc_id", "tok_idx", "token", "ws",
        F.sum(F.when(goes_on, 0).otherwise(1)).over(up_to).cast("long").alias("pos_id"),
        F.last(F.when(~goes_on, base), ignorenulls=True).over(up_to).alias("pos_tag"),
        F.sum(F.when(begins, 1).otherwise(0)).over(up_to).cast("long").alias("ds_id"),
        F.last(label, ignorenulls=True).over(up_to).alias("ds_tag"),
        F.lag("token").over(w).alias("before"),
    )
    first = F.substring("token", 1, 1)
    plain = first.between("a", "z") | first.between("A", "Z") | first.between("0", "9")
    tag = F.when(~plain & F.col("token").rlike(PUNCTUATION), "Y").when((F.lower("token") == "s") & (F.lower("before") == "it"), "GE").otherwise(F.col("pos_tag"))
    t = t.select("doc_id", F.concat("token", "ws").alias("token"), tag.alias("pos_tag"), "ds_tag", "pos_id", "ds_id", "tok_idx")
    if not global_ids:
        return t
    ends = t.groupBy("doc_id").agg(F.max("pos_id").alias("pos_id"), F.max("ds_id").alias("ds_id"))
    before = offsets(ends, ["pos_id", "ds_id"]).select("doc_id", F.col("before_pos_id").alias("p"), F.col("before_ds_id").alias("d"))
    return t.join(before, "doc_id").select("doc_id", "token", "pos_tag", "ds_tag", (F.col("pos_id") + F.col("p")).alias("pos_id"), (F.col("ds_id") + F.col("d")).alias("ds_id"), "tok_idx")


def parse(corpus: DataFrame, tagger: Tagger | None = None, clean: bool = True, merge_multiword: bool = True, global_ids: bool = True, chunk_chars: int | None = None, validate: bool = False) -> DataFrame:
    """Corpus (doc_id, text) to tokens table. Null texts go. Texts of more than chunk_chars are tagged in parts and joined again.

    validate also checks the data (ids that are null or twice), which is a job of its own.
    """
    tagger = checked(tagger or RuleTagger())
    valid_corpus(corpus, data=validate)
    # Texts are shuffled by document before all else: less than their tokens would be, whose windows and groups then need no
    # shuffle of their own, and the work is spread also where a file has few row groups.
    texts = corpus.where("text IS NOT NULL").repartition("doc_id")
    if clean:
        texts = clean_corpus(texts)
    if isinstance(tagger, RuleTagger) and chunk_chars is None:
        raw = tagger.tag(texts)  # its rules look at neighbours alone, and have no limit of length
    else:
        parts = chunked(texts, chunk_chars)
        # A part's key holds its number; a document's tokens are numbered anew over its parts in order.
        keyed = parts.select(F.to_json(F.struct(F.col("doc_id").alias("d"), F.col("chunk_id").alias("c"))).alias("doc_id"), "text")
        back = F.from_json("doc_id", "d string, c int")
        tagged = tagger.tag(keyed).withColumn("k", back)
        place = Window.partitionBy("k.d").orderBy("k.c", "tok_idx")
        raw = tagged.select(F.col("k.d").alias("doc_id"), (F.row_number().over(place) - 1).cast("long").alias("tok_idx"), "token", "ws", "pos_tag", "ds_tag")
    return finish(raw, merge_multiword, global_ids)
