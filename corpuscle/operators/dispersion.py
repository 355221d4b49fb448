"""Dispersion measures over the documents of a corpus, from the documents alone in which a unit occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle import validation as check
from corpuscle.functions.stats import NAN
from corpuscle.operators.frequency import TOTAL, unit_counts
from corpuscle.operators.texts import LARGE_DOC, Below, Spread, Texts
from corpuscle.plans.runtime import cut

MEASURES = ["Carrolls_D2", "Rosengrens_S", "Lynes_D3", "DC", "Juillands_D", "DP", "DP_norm"]


def _of_texts(texts: Texts, layer: str) -> tuple[DataFrame, DataFrame]:
    """(sums, totals) as dispersions_table has them, from sums of many documents each.

    apart, the sum of |v / f - s|, is 1 - ss and twice the sum of s - v / f where that is positive: in documents where a unit is rarer
    than in all, thus for units with f / total above 1 / size alone, of which there are no more than a document has units.
    """
    names = Spread.NAMES
    rows = texts.read(lambda: Spread(layer), "Token string, Tag string, " + ", ".join(f"{c} double" for c in (*names, "least", "most")))
    rows = cut(rows.groupBy("Token", "Tag").agg(*[F.sum(c).alias(c) for c in names], F.min("least").alias("least"), F.max("most").alias("most")))
    is_total = F.col("Tag").eqNullSafe(TOTAL)
    all_ = rows.where(is_total).select(F.col("f").alias("total"), F.col("ss").alias("n"), "least", "most")
    of_all = all_.first()
    total = F.lit(of_all["total"] if of_all else 1.0)
    root, share = F.sqrt(total), 1.0 / total
    sums = rows.where(~is_total).select("Token", "Tag", "f", "vlog", (F.col("root") / root).alias("root"), "vv", "roots", (F.col("r1") * total).alias("r1"), (F.col("r2") * total * total).alias("r2"), (F.col("ss") * share).alias("ss"))
    if of_all is None:
        return sums.withColumn("apart", F.lit(0.0)), all_
    most = min(of_all["most"], LARGE_DOC)
    frequent = {(r["Token"], r["Tag"]): r["f"] for r in sums.where(F.col("f") * most > total).select("Token", "Tag", "f").toLocalIterator()}
    all_units = of_all["total"]
    cells = texts.read(lambda: Below(layer, frequent, all_units), "Token string, Tag string, below double, v double, size double").join(sums.select("Token", "Tag", "f"), ["Token", "Tag"])
    below = cells.groupBy("Token", "Tag").agg(F.sum(F.coalesce("below", F.greatest(F.col("size") / total - F.col("v") / F.col("f"), F.lit(0.0)))).alias("below"))
    sums = sums.join(below, ["Token", "Tag"], "left").withColumn("apart", 1.0 - F.col("ss") + 2.0 * F.coalesce("below", F.lit(0.0)))
    return sums, all_


def dispersions_table(tokens: DataFrame | Texts, count_by: str = "pos") -> DataFrame:
    """(Token, Tag, AF, RF, and the MEASURES), by falling AF. A unit is known by its first token; the ds layer keeps signs.

    With v the counts in n documents, s their shares of all units, f the sum of v: sums over the documents without the
    unit have closed forms, so there is no matrix. One document gives NaN where the measure divides by n - 1 or log n.
    """
    check.layer(count_by)
    check.tokens(tokens)
    x, all_ = _of_texts(tokens, count_by) if isinstance(tokens, Texts) else _of_tokens(tokens, count_by)
    return _measured(x.crossJoin(F.broadcast(all_)))


def _of_tokens(tokens: DataFrame, count_by: str) -> tuple[DataFrame, DataFrame]:
    """(sums of each unit, totals)."""
    # Read three times: for the totals, and for sums that need what the ones before gave.
    counts = cut(unit_counts(tokens, count_by, whole=False, filtered=count_by == "pos").select("Token", "Tag", F.col("n").cast("double").alias("v"), "size"))
    all_ = counts.where(F.col("Tag") == TOTAL).agg(F.sum("size").cast("double").alias("total"), F.count("*").cast("double").alias("n"), F.min("size").cast("double").alias("least"))
    cells = counts.where(~F.col("Tag").eqNullSafe(TOTAL)).crossJoin(F.broadcast(all_)).select("Token", "Tag", "v", (F.col("size") / F.col("total")).alias("s"))
    v, share = F.col("v"), F.col("s")
    r = v / share
    sums = cells.groupBy("Token", "Tag").agg(
        F.sum(v).alias("f"), F.sum(v * F.log2(v)).alias("vlog"), F.sum(F.sqrt(v * share)).alias("root"), F.sum(v * v).alias("vv"), F.sum(F.sqrt(v)).alias("roots"),
        F.sum(r).alias("r1"), F.sum(r * r).alias("r2"), F.sum(share).alias("ss"),
    )
    # Deviations from the expected share need f first: a second pass, again with partial sums before the shuffle.
    apart = cells.join(sums.select("Token", "Tag", "f"), ["Token", "Tag"]).groupBy("Token", "Tag").agg(F.sum(F.abs(v / F.col("f") - share)).alias("apart"))
    return sums.join(apart, ["Token", "Tag"]), all_


def _measured(x: DataFrame) -> DataFrame:
    spread = F.greatest(F.expr("r2 / n - pow(r1 / n, 2)"), F.lit(0.0))
    one = F.col("n") == 1
    dp = 0.5 * (F.col("apart") + 1.0 - F.col("ss"))
    return x.select(
        "Token", "Tag", F.col("f").cast("long").alias("AF"), (F.col("f") / F.col("total") * 1e6).alias("RF"),
        F.when(one, F.lit(NAN)).otherwise(F.try_divide(F.expr("log2(f) - vlog / f"), F.log2("n"))).alias("Carrolls_D2"),
        (F.pow("root", F.lit(2)) / F.col("f")).alias("Rosengrens_S"),
        F.expr("1.0e0 - (n * vv - f * f) / (4.0e0 * f * f)").alias("Lynes_D3"),
        F.expr("pow(roots / n, 2) / (f / n)").alias("DC"),
        F.when(one, F.lit(NAN)).otherwise(1.0 - F.try_divide(F.sqrt(spread) / F.expr("r1 / n"), F.sqrt(F.col("n") - 1))).alias("Juillands_D"),
        dp.alias("DP"), F.coalesce(F.try_divide(dp, 1.0 - F.col("least") / F.col("total")), F.lit(NAN)).alias("DP_norm"),
    ).orderBy(F.desc("AF"), "Token", "Tag")
