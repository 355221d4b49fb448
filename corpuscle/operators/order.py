"""The order of a corpus across documents, without gathering it in one partition.

Documents follow one another by doc_id. Tables of one row a document are spread by ranges of doc_id and cut; windows within
a range, and one window over the ranges (one row each), carry sums and neighbours over the bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.plans.runtime import cut

#: Documents in a range, about.
RANGE_DOCS = 50_000


def ranged(docs: DataFrame) -> DataFrame:
    """docs (one row a document) with __range, numbers that rise with doc_id. It is cut, so that ranges stay as they are."""
    return cut(docs.repartitionByRange("doc_id").withColumn("__range", F.spark_partition_id()))


def offsets(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with before_<column>: the sum over all earlier documents."""
    r = ranged(docs)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = r.groupBy("__range").agg(*[F.sum(c).alias(c) for c in columns])
    base = total.select("__range", *[F.coalesce(F.sum(c).over(earlier(Window.orderBy("__range"))), F.lit(0)).alias(f"base_{c}") for c in columns])
    inner = earlier(Window.partitionBy("__range").orderBy("doc_id"))
    within = r.withColumns({f"in_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in columns})
    return within.join(F.broadcast(base), "__range").select(*docs.columns, *[(F.col(f"base_{c}") + F.col(f"in_{c}")).cast("long").alias(f"before_{c}") for c in columns])


def borders(edges: DataFrame, before: int, after: int) -> DataFrame:
    """(doc_id, previous, next) of edges (doc_id, head, tail: arrays of the document's first after and last before items).

    previous: the last before items of earlier documents, in order; next: the first after items of later ones. Each document
    has an item at least, so as many documents as items are looked at.
    """
    r = ranged(edges)
    own = Window.partitionBy("__range").orderBy("doc_id")
    last = lambda items, n: F.expr(f"slice({items}, greatest(size({items}) - {n} + 1, 1), {n})") if n else F.expr(f"slice({items}, 1, 0)")
    first = lambda items, n: F.expr(f"slice({items}, 1, {n})")
    n, p = max(after, 1), max(before, 1)
    ahead = F.flatten(F.collect_list("head").over(own.rowsBetween(1, n)))
    behind = F.flatten(F.collect_list("tail").over(own.rowsBetween(-p, -1)))
    within = r.withColumns({"ahead": ahead, "behind": behind})
    # Of each range, its first and last items, and thereby what follows and precedes the others.
    ranked = r.withColumns({"up": F.row_number().over(own), "down": F.row_number().over(Window.partitionBy("__range").orderBy(F.desc("doc_id")))})
    joined = lambda c, rank, descending: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(rank) <= (p if descending else n), F.struct("doc_id", c)))), lambda x: x[c]))
    ends = ranked.where(f"up <= {n} OR down <= {p}").groupBy("__range").agg(joined("head", "up", False).alias("first"), joined("tail", "down", True).alias("last"))
    over = Window.orderBy("__range")
    around = ends.select("__range", F.flatten(F.collect_list("first").over(over.rowsBetween(1, n))).alias("later"), F.flatten(F.collect_list("last").over(over.rowsBetween(-p, -1))).alias("earlier"))
    both = within.join(F.broadcast(around), "__range").select("doc_id", F.concat("earlier", "behind").alias("previous"), F.concat("ahead", "later").alias("next"))
    return both.select("doc_id", last("previous", before).alias("previous"), first("next", after).alias("next"))
