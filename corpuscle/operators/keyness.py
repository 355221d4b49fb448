"""Keyness: how frequencies of a target corpus differ from those of a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle import validation as check
from corpuscle.functions.stats import chi2_tail
from corpuscle.plans.runtime import cut


def keyness_table(target: DataFrame, reference: DataFrame, correct: bool = False, tags_only: bool = False, swap_target: bool = False, threshold: float = 0.01) -> DataFrame:
    """([Token,] Tag, LL, LR, PV, RF, RF_Ref, AF, AF_Ref, Range, Range_Ref), by falling LL, of what is more frequent in the target.

    Tables are those of frequency_table, or with tags_only of tags_table. correct applies the correction of Yates; swap_target
    gives what is more frequent in the reference, with the signs turned.
    """
    check.frequencies(target, tags_only)
    check.frequencies(reference, tags_only)
    keys = ["Tag"] if tags_only else ["Token", "Tag"]
    values = ["AF", "RF", "Range"]
    a = target.select(*keys, *values)
    b = reference.select(*keys, *[F.col(c).alias(f"{c}_Ref") for c in values])
    both = cut(a.join(b, keys, "full").fillna(0))  # read twice, while what it is made of is made once
    totals = both.agg(F.sum("AF").cast("double").alias("t"), F.sum("AF_Ref").cast("double").alias("r"))
    x = both.crossJoin(F.broadcast(totals))
    x = x.withColumns({"a": F.col("AF").cast("double"), "b": F.col("AF_Ref").cast("double")})
    x = x.withColumn("off", F.expr("a - (a + b) * (t / (t + r))"))
    move = F.when(F.abs("off") > 0.25, 0.5 * F.signum("off")).otherwise(0.0) if correct else F.lit(0.0)
    x = x.withColumns({"ya": F.col("a") - move, "yb": F.col("b") + move})
    # The target's expectation takes the reference's frequency as it is, also with the correction.
    l1 = F.when(F.col("ya") > 0, F.expr("ya * ln(ya / ((ya + b) * (t / (t + r))))")).otherwise(0.0)
    l2 = F.when(F.col("yb") > 0, F.expr("yb * ln(yb / ((ya + yb) * (r / (t + r))))")).otherwise(0.0)
    size = F.abs(2.0 * (l1 + l2))
    lr = F.when(F.col("b") == 0, F.expr("log2((a / t) / (0.5e0 / r))")).when(F.col("a") == 0, F.expr("-log2((b / r) / (0.5e0 / t))")).otherwise(F.expr("log2((a / t) / (b / r))"))
    x = x.withColumns({"size": size, "LR": lr})
    x = x.withColumn("LL", F.when(F.col("RF") > F.col("RF_Ref"), F.col("size")).otherwise(-F.col("size"))).withColumn("PV", chi2_tail("size"))
    x = x.where(F.col("PV") < threshold)
    if swap_target:
        x = x.withColumns({"LL": -F.col("LL"), "LR": -F.col("LR")})
    return x.where("LL > 0").select(*keys, "LL", "LR", "PV", "RF", "RF_Ref", "AF", "AF_Ref", "Range", "Range_Ref").orderBy(F.desc("LL"), *keys)
