"""Work on document-term matrices and frequency tables: weights, classes of words, sparse form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle import validation as check
from corpuscle.functions.stats import NAN
from corpuscle.operators.order import offsets
from corpuscle.plans.runtime import cut

#: The first pattern that a tag begins with gives its class.
CLASSES = [("NN", "#NounCommon"), ("VV", "#VerbLex"), ("J", "#Adjective"), ("R", "#Adverb"), ("P", "#Pronoun"), ("I", "#Preposition"), ("C", "#Conjunction"), ("N", "#NounOther"), ("VB", "#VerbBe"), ("V", "#VerbOther")]


def word_class(tag: Column) -> Column:
    """One of eleven classes of a part-of-speech tag."""
    out = F.lit("#Other")
    for prefix, name in reversed(CLASSES):
        out = F.when(tag.startswith(prefix), name).otherwise(out)
    return F.substring(out, 2, 99)


def class_of(tag: str) -> str:
    return next((name for prefix, name in CLASSES if tag.startswith(prefix)), "#Other")[1:]


def _quoted(name: str) -> Column:
    return F.col("`" + re.sub("`", "``", name) + "`")


def long_form(dtm: DataFrame) -> DataFrame:
    """(doc_id, tag, n, col): cells of a matrix, zeros included; col is the column's number from 0."""
    cells = F.array(*[F.struct(F.lit(c).alias("tag"), _quoted(c).cast("double").alias("n"), F.lit(k).alias("col")) for k, c in enumerate(dtm.columns[1:])])
    return dtm.select("doc_id", F.inline(cells))


def dtm_weight(dtm: DataFrame, scheme: str = "prop") -> DataFrame:
    """prop: shares of a document; scale: their z-scores by column (NaN in a constant one); tfidf: shares times log1p(N+df)-log1p(df).

    A document without any tag has NaN throughout, as has its share in means.
    """
    check.dtm(dtm)
    check.one_of(scheme, ("prop", "scale", "tfidf"), "scheme")
    names = dtm.columns[1:]
    total = sum((_quoted(c).cast("double") for c in names), F.lit(0.0))
    share = {c: F.coalesce(F.try_divide(_quoted(c).cast("double"), total), F.lit(NAN)) for c in names}
    prop = dtm.select("doc_id", *[share[c].alias(c) for c in names])
    if scheme == "prop":
        return prop
    prop = cut(prop)  # read twice: for sums by column, and for all
    q = [_quoted(c) for c in names]
    if scheme == "scale":
        moments = prop.agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(q)], *[F.stddev_samp(x).alias(f"s{k}") for k, x in enumerate(q)])
        both = prop.crossJoin(F.broadcast(moments))
        return both.select("doc_id", *[F.coalesce(F.try_divide(x - F.col(f"m{k}"), F.col(f"s{k}")), F.lit(NAN)).alias(c) for k, (c, x) in enumerate(zip(names, q))])
    counts = prop.agg(*[F.sum((x > 0).cast("double")).alias(f"d{k}") for k, x in enumerate(q)], *[F.sum((x >= 0).cast("double")).alias(f"n{k}") for k, x in enumerate(q)])
    both = prop.crossJoin(F.broadcast(counts))
    return both.select("doc_id", *[(x * (F.log1p(F.col(f"n{k}") + F.col(f"d{k}")) - F.log1p(F.col(f"d{k}")))).alias(c) for k, (c, x) in enumerate(zip(names, q))])


def dtm_simplify(dtm: DataFrame) -> DataFrame:
    """A matrix of the classes of words, in the order in which they first come among the columns. There is no shuffle."""
    check.dtm(dtm)
    names = dtm.columns[1:]
    check.word_classes(names)
    classes: dict[str, list[str]] = {}
    for c in names:
        classes.setdefault(class_of(c), []).append(c)
    return dtm.select("doc_id", *[sum((_quoted(c) for c in own[1:]), _quoted(own[0])).alias(k) for k, own in classes.items()])


def freq_simplify(frequencies: DataFrame) -> DataFrame:
    """A frequency table with classes for tags; rows stay apart."""
    check.frequencies(frequencies)
    frequencies = cut(frequencies)
    if frequencies.where(F.col("Tag").rlike("^(NN|VV|II)")).isEmpty():
        check.word_classes([])
    return frequencies.withColumn("Tag", word_class(F.col("Tag")))


def tags_simplify(dtm: DataFrame) -> DataFrame:
    """(Tag, AF, RF in percent, Range) of classes, by falling AF."""
    simple = dtm_simplify(dtm)
    cells = long_form(simple).groupBy("tag").agg(F.sum("n").cast("long").alias("AF"), F.sum((F.col("n") > 0).cast("double")).alias("docs"), F.count("*").alias("all"))
    total = F.sum("AF").over(Window.partitionBy())  # of eleven rows at most
    return cells.select(F.col("tag").alias("Tag"), "AF", F.try_divide(F.col("AF") * 100.0, total).alias("RF"), (F.col("docs") / F.col("all") * 100.0).alias("Range")).orderBy(F.desc("AF"), "Tag")


def dtm_to_coo(dtm: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matrix as (row, col, value) without zeros, its documents (row, doc_id) by doc_id, and its tags (col, tag)."""
    check.dtm(dtm)
    dtm = cut(dtm)
    one = dtm.select("doc_id").withColumn("one", F.lit(1))
    docs = offsets(one, ["one"]).select(F.col("before_one").alias("row"), "doc_id")
    cells = long_form(dtm).where("n <> 0").join(docs, "doc_id").select("row", F.col("col").cast("long").alias("col"), F.col("n").alias("value"))
    vocabulary = dtm.sparkSession.createDataFrame([(k, c) for k, c in enumerate(dtm.columns[1:])], "col long, tag string")
    return cells, docs, vocabulary
