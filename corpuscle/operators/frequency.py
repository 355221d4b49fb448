"""Frequencies of units, of tags, and matrices of tags by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle import validation as check
from corpuscle.config import SETTINGS
from corpuscle.operators.groups import is_word, strip, units
from corpuscle.operators.tagger import TAGS
from corpuscle.operators.texts import TOTAL, TagCounts, Texts, UnitSums
from corpuscle.schema import LAYERS


def unit_counts(tokens: DataFrame, layer: str, whole: bool = True, filtered: bool = True) -> DataFrame:
    """(doc_id, Token, Tag, n, size) of each document, and a row of it with the tag TOTAL; size is the number of its units.

    On the ds layer untagged signs go before units are joined.
    """
    tag, _ = LAYERS[layer]
    docs = units(tokens.where(is_word(layer, tag)) if filtered else tokens, layer, whole=whole)
    row = lambda token, tag, n: F.struct(token.alias("Token"), tag.alias("Tag"), n.cast("long").alias("n"))
    rows = F.concat(F.transform("units", lambda u: row(strip(u["token"]), u["tag"], F.lit(1))), F.array(row(F.lit(None).cast("string"), F.lit(TOTAL), F.size("units"))))
    each = docs.select("doc_id", F.size("units").cast("long").alias("size"), F.inline(rows))
    return each.groupBy("doc_id", "size", "Token", "Tag").agg(F.sum("n").alias("n"))


def summarise(counts: DataFrame, keys: list[str], per: float) -> DataFrame:
    """keys, AF, RF (of per) and Range (% of the documents) from counts (keys, n, docs), sums of some documents each, and of
    each a row with the tag TOTAL.

    Totals are a row of the same sums. It is known by a sum too, not by its key: a filter of the key would be moved below the
    shuffle, and what is below would be done twice; so both sides of the join read the one shuffle.
    """
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("AF"), F.sum("docs").alias("docs"), F.max(F.col("Tag") == TOTAL).alias("all"))
    total = sums.where(F.col("all")).select(F.col("AF").alias("total"), F.col("docs").alias("all_docs"))
    rows = sums.where(~F.coalesce("all", F.lit(False)))
    return rows.crossJoin(F.broadcast(total)).select(*keys, "AF", (F.col("AF") / F.col("total") * per).alias("RF"), (F.col("docs") / F.col("all_docs") * 100.0).alias("Range"))


def frequency_table(tokens: DataFrame | Texts, count_by: str = "pos", af_min: int = 0, af_max: int | None = None, rf_min: float = 0.0, rf_max: float | None = None, range_min: float = 0.0, range_max: float | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(Token, Tag, AF, RF per million, Range), by falling AF, then Token; both layers give two tables. Bounds are inclusive."""
    check.layer(count_by, both=True)
    check.tokens(tokens)
    if count_by == "both":
        return tuple(frequency_table(tokens, c, af_min, af_max, rf_min, rf_max, range_min, range_max) for c in ("pos", "ds"))
    if isinstance(tokens, Texts):
        counts = tokens.read(lambda: UnitSums(count_by), "Token string, Tag string, n long, docs long")
    else:
        counts = unit_counts(tokens, count_by).withColumn("docs", F.lit(1))
    out = summarise(counts, ["Token", "Tag"], SETTINGS.per)
    for column, low, high in (("AF", af_min, af_max), ("RF", rf_min, rf_max), ("Range", range_min, range_max)):
        if low:
            out = out.where(F.col(column) >= low)
        if high is not None:
            out = out.where(F.col(column) <= high)
    return out.orderBy(F.desc("AF"), "Token", "Tag")


def tag_counts(tokens: DataFrame, layer: str) -> DataFrame:
    """(doc_id, tag, n): units of each tag in each document, the long form of the matrix."""
    tag, id_ = LAYERS[layer]
    some = tokens.where(is_word(layer, tag))
    return some.groupBy("doc_id", F.col(tag).alias("tag")).agg(F.count_distinct(id_).alias("n"))


def tags_table(tokens: DataFrame | Texts, count_by: str = "pos") -> DataFrame | tuple[DataFrame, DataFrame]:
    """(Tag, AF, RF in percent, Range), by falling AF, then Tag."""
    check.layer(count_by, both=True)
    check.tokens(tokens)
    if count_by == "both":
        return tags_table(tokens, "pos"), tags_table(tokens, "ds")
    if isinstance(tokens, Texts):
        return summarise(_tag_sums(tokens, count_by), ["Tag"], 100.0).orderBy(F.desc("AF"), "Tag")
    docs = tag_counts(tokens, count_by).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("tag").alias("Tag"), "n")).alias("cells"), F.sum("n").alias("n"))
    counts = docs.select(F.lit(1).alias("docs"), F.inline(F.concat("cells", F.array(F.struct(F.lit(TOTAL).alias("Tag"), "n")))))
    return summarise(counts, ["Tag"], 100.0).orderBy(F.desc("AF"), "Tag")


def _tag_sums(texts: Texts, layer: str) -> DataFrame:
    return texts.read(lambda: TagCounts(layer, TAGS[layer], by_doc=False), "Tag string, n long, docs long")


def wide(long: DataFrame, tags: list[str]) -> DataFrame:
    """The matrix with a column for each of tags, 0 where there is none."""
    return long.groupBy("doc_id").pivot("tag", tags).agg(F.sum("n")).fillna(0)


def observed_tags(long: DataFrame) -> list[str]:
    """Tags by falling total, then name: columns of a matrix are tags, and a corpus has some hundreds at most."""
    return [r["tag"] for r in long.groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag").toLocalIterator()]


def tags_dtm(tokens: DataFrame | Texts, count_by: str = "pos", tags: list[str] | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """A row for each document and a column for each tag; tags given ahead save the job that looks for them."""
    check.layer(count_by, both=True)
    check.tokens(tokens)
    if count_by == "both":
        return tags_dtm(tokens, "pos", tags), tags_dtm(tokens, "ds", tags)
    if isinstance(tokens, Texts):
        names = tags if tags is not None else observed_tags(_tag_sums(tokens, count_by).where(F.col("Tag") != TOTAL).withColumnRenamed("Tag", "tag"))
        rows = tokens.read(lambda: TagCounts(count_by, names), ", ".join(["doc_id string", *(f"n{k} long" for k in range(len(names)))]))
        return rows.toDF("doc_id", *names)
    long = tag_counts(tokens, count_by)
    return wide(long, tags if tags is not None else observed_tags(long))
