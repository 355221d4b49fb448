"""Mixing sources to target weights by systematic sampling.

Each document has a number of expected copies, equal within a source, which gives the source its share of the characters.
Within a source, in the order of doc_id, the prefix sums of the expected copies plus one random offset are taken; a
document is emitted once for each integer that its interval crosses. The number of copies of a document is thus its
expected number rounded up or down, and a source's total is off by less than one.

Expected copies are integers of 1/UNIT, so prefix sums are exact in any order of addition. They are found in two levels:
totals by source and range of doc_id, then within the ranges; no source is sorted as a whole by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNIT = 1_000_000
SEED = 20240607
#: Rows of documents in a range of doc_id, about.
RANGE_ROWS = 20_000
#: Ranges that are bounded by quantiles; where there are more rows, each is parted in equal steps of doc_id.
QUANTILES = 256
#: Target weights by source; a source that isn't named has OTHER. Weights count in proportion to one another.
WEIGHTS = {"src0": 0.5, "src1": 2.0, "src2": 2.0, "src3": 1.5}
OTHER = 1.0
#: Characters of the mix against those of the input.
BUDGET = 1.0


def _weight(weights: dict[str, float], other: float):
    out = F.lit(float(other))
    for source, w in sorted(weights.items()):
        out = F.when(F.col("__source") == "=" + source, F.lit(float(w))).otherwise(out)
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, other: float = OTHER, budget: float = BUDGET, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of docs (doc_id, text, source, n_chars and others), each repeated by its copies, with __copies and __copy (from 1).

    A source's expected characters are weight / sum of weights of the sources that have any, of budget times all
    characters; n_chars counts, null or negative as 0. A null source is a source of its own with the weight other. A source
    without characters has no copies; elsewhere a document without text counts as one of its source. Rows are ordered by
    doc_id (nulls first), then text (nulls first): rows that tie are equal in both, and any of them will do. An empty
    table gives no rows. Columns of docs that are called __copies or __copy are replaced, and so are those of the steps
    between (__source, __range, __rank, __before, __e, __u).
    """
    weights = WEIGHTS if weights is None else weights
    spark = docs.sparkSession
    docs = docs.drop("__copies", "__copy", "__source", "__range", "__rank", "__before", "__e", "__u")
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    size = F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(0))
    # One pass for the totals of sources, and one for the bounds of ranges: both read narrow columns alone.
    totals = docs.groupBy(key.alias("__source")).agg(F.count("*").alias("n"), F.sum(size).alias("chars"))
    totals = totals.withColumn("w", F.when(F.col("chars") > 0, _weight(weights, other)).otherwise(0.0))
    everything = totals.agg(F.sum("w").alias("w_all"), F.sum("chars").alias("c_all"))
    share = F.col("w") / F.col("w_all") * F.lit(float(budget)) * F.col("c_all").cast("double") / F.col("chars").cast("double")
    e = F.when((F.col("chars") > 0) & (F.col("w_all") > 0), F.floor(share * F.lit(float(UNIT)))).otherwise(F.lit(0)).cast("long")
    rows = [tuple(r) for r in totals.crossJoin(everything).select("__source", e, _offset(seed), "n").toLocalIterator()]  # one row a source
    per_source = spark.createDataFrame([r[:3] for r in rows], "__source string, __e long, __u long")
    parts = max(1, -(-sum(r[3] for r in rows) // range_rows))
    levels, steps = min(parts, QUANTILES), -(-parts // QUANTILES)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    cuts = sorted({int(c) for c in docs.select(F.col("doc_id").cast("double").alias("d")).stat.approxQuantile("d", [k / levels for k in range(levels + 1)], 0.2 / levels)}) if parts > 1 else []
    # How many bounds are at or below the id: ranges rise with doc_id, wherever the bounds are, and nulls are in the first.
    bounds = F.array(*[F.lit(c) for c in cuts[1:-1]]).cast("array<bigint>")
    place = F.size(F.filter(bounds, lambda c: c <= id_)).cast("long")
    if steps > 1 and len(cuts) > 1:
        low = F.element_at(F.array(*[F.lit(float(c)) for c in cuts[:-1]]), place.cast("int") + 1)
        wide_ = F.element_at(F.array(*[F.lit(float(b - a)) for a, b in zip(cuts, cuts[1:])]), place.cast("int") + 1)
        # Equal steps rise with the id as well; what is beyond a bound is in the step next to it.
        step = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(steps - 1.0), (id_.cast("double") - low) / wide_ * steps)))
        place = place * steps + step
    wide = docs.withColumns({"__source": key, "__range": place})
    counts = wide.groupBy("__source", "__range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__source", "__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before")).join(per_source, "__source")
    # The rank needs the rows of a source and range together; the join has the same keys, so texts are shuffled once.
    w = Window.partitionBy("__source", "__range").orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    at = wide.withColumn("__rank", F.row_number().over(w).cast("long")).join(starts, ["__source", "__range"])
    crossed = F.expr(f"((__before + __rank) * __e + __u) div {UNIT} - ((__before + __rank - 1) * __e + __u) div {UNIT}")
    copied = at.withColumn("__copies", crossed).where("__copies > 0")
    return copied.select(*(f"`{c}`" for c in docs.columns), "__copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy"))


def _offset(seed: int):
    """The random offset of a source, from 0 to UNIT - 1: by MD5 of the seed and its name, as any engine has it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("__source")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.lit(UNIT)


def oracle(table: str = "documents", columns: str = "doc_id, source, copy") -> str:
    """DuckDB SQL for the rows of mix() over table, with the production parameters."""
    case = " ".join(f"WHEN source = '{s}' THEN {float(w)}::DOUBLE" for s, w in sorted(WEIGHTS.items()))
    return f"""
WITH totals AS (SELECT source, count(*) AS n, sum(greatest(coalesce(n_chars, 0), 0))::BIGINT AS chars FROM {table} GROUP BY source),
weighed AS (SELECT *, CASE WHEN chars > 0 THEN CASE {case} ELSE {OTHER}::DOUBLE END ELSE 0 END AS w FROM totals),
expected AS (
  SELECT source, CASE WHEN chars > 0 AND sum(w) OVER () > 0 THEN floor(w / (SELECT sum(w) FROM weighed) * {float(BUDGET)}::DOUBLE * (SELECT sum(chars) FROM weighed)::DOUBLE / chars * {UNIT})::BIGINT ELSE 0 END AS e,
    ('0x' || substr(md5('{SEED}:' || coalesce('=' || source, '')), 1, 12))::BIGINT % {UNIT} AS u FROM weighed),
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS rank FROM {table} d),
copied AS (SELECT r.*, (rank * e + u) // {UNIT} - ((rank - 1) * e + u) // {UNIT} AS copies FROM ranked r JOIN expected x ON r.source IS NOT DISTINCT FROM x.source)
SELECT {columns} FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM copied WHERE copies > 0)
"""
