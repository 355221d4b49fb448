"""Units (tokens that are one by their id) as one array a document, and their neighbours: what most operators are made of.

A document's tokens are gathered in order once. Units, neighbours and runs of units are then slices of its array, without
windows over all tokens; what goes over the bounds of documents is made of the first and last units of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.order import borders
from corpuscle.schema import LAYERS

SIGNS = "^[\\p{Punct} ]+$"
#: White space as regular expressions have it.
SPACES = " \t\n\x0b\f\r"


def ordered(tokens: DataFrame) -> DataFrame:
    """tokens with tok_idx; a table without it is ordered by its ids within documents, which leaves parts of a unit in any order."""
    return tokens if "tok_idx" in tokens.columns else tokens.withColumn("tok_idx", F.monotonically_increasing_id())


def bare(token: Column) -> Column:
    return F.btrim(token, F.lit(SPACES))


def strip(token: Column) -> Column:
    return bare(F.lower(token))


def counts_as(layer: str, token: Column, tag: Column) -> Column:
    """What counts: on the pos layer all but punctuation, on the ds layer all but untagged signs."""
    return tag != "Y" if layer == "pos" else ~(tag.contains("Untagged") & token.rlike(SIGNS))


def is_word(layer: str, tag: str, token: str = "token") -> Column:
    return counts_as(layer, F.col(token), F.col(tag))


def units(tokens: DataFrame, layer: str, by_tag: bool = True, whole: bool = True) -> DataFrame:
    """(doc_id, units): for each document an array of (place, token, tag) in order.

    A unit is the tokens of one id, joined in order, or its first token if not whole; place is the first one's tok_idx. Tokens of
    an id with different tags are units of their own, unless not by_tag: then they are one, with the first tag.
    """
    tag, id_ = LAYERS[layer]
    item = F.struct("tok_idx", F.col(id_).alias("id"), F.col(tag).alias("tag"), "token")
    docs = ordered(tokens).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    other = F.transform("xs", lambda x, i: F.when((i == 0) | ~F.get("xs", i - 1)["id"].eqNullSafe(x["id"]), i))
    docs = docs.withColumn("starts", F.filter(other, lambda i: i.isNotNull()))

    def joined(own: Column) -> Column:
        token = F.array_join(F.transform(own, lambda x: x["token"]), "") if whole else own[0]["token"]
        return F.struct(own[0]["tok_idx"].alias("place"), token.alias("token"), own[0]["tag"].alias("tag"))

    def made(at: Column, k: Column) -> Column:
        n = F.coalesce(F.get("starts", k + 1), F.size("xs")) - at
        one = F.get("xs", at)
        alone = F.array(F.struct(one["tok_idx"].alias("place"), one["token"].alias("token"), one["tag"].alias("tag")))
        own = F.slice("xs", at + 1, n)
        if by_tag:
            several = F.transform(F.array_distinct(F.transform(own, lambda x: x["tag"])), lambda t: joined(F.filter(own, lambda x: x["tag"].eqNullSafe(t))))
        else:
            several = F.array(joined(own))
        return F.when(n == 1, alone).otherwise(several)

    return docs.select("doc_id", F.flatten(F.transform("starts", made)).alias("units"))


def words(tokens: DataFrame, layer: str) -> DataFrame:
    """(doc_id, units): arrays of (token, tag) of what counts, in lower case and stripped."""
    some = F.filter("units", lambda u: counts_as(layer, u["token"], u["tag"]))
    plain = F.transform(some, lambda u: F.struct(strip(u["token"]).alias("token"), u["tag"].alias("tag")))
    return units(tokens, layer).select("doc_id", plain.alias("units"))


def first_items(items: str, n: int) -> Column:
    return F.slice(items, 1, n)


def last_items(items: str, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def edges(docs: DataFrame, before: int, after: int) -> DataFrame:
    """(doc_id, previous, next) of docs (doc_id, head, tail): the units before and after each, over the bounds of documents."""
    return borders(docs.where("size(head) > 0").select("doc_id", "head", "tail"), before, after)


def hits(docs: DataFrame, before: int, after: int, hit, items: str = "units") -> DataFrame:
    """docs (doc_id, items, more) with hits: an array of (place, previous, node, next) of the items that hit(item) holds for, and
    head and tail, the first and last items, for what goes over the bounds of the document."""
    found = F.filter(F.transform(items, lambda u, i: F.when(hit(u), i)), lambda i: i.isNotNull())

    def context(i: Column) -> Column:
        start = F.greatest(i - before, F.lit(0))
        return F.struct(i.alias("place"), F.slice(items, start + 1, i - start).alias("previous"), F.get(items, i).alias("node"), F.slice(items, i + 2, after).alias("next"))

    return docs.withColumns({"hits": F.transform(found, context), "head": first_items(items, max(after, 1)), "tail": last_items(items, max(before, 1))})


def around(kept: DataFrame, before: int, after: int, within_doc: bool = False) -> DataFrame:
    """(doc_id, place, previous, node, next): the hits() of kept, which is read twice. Neighbours are in the order of the corpus, over
    the bounds of documents unless within_doc; at its ends there are fewer. Only hits near a bound are joined to others' units."""
    rows = kept.select("doc_id", F.inline("hits"))
    if within_doc or not (before or after):
        return rows
    inside = (F.size("previous") >= before) & (F.size("next") >= after)
    near = edges(kept, before, after).withColumnsRenamed({"previous": "earlier", "next": "later"})
    at_bound = rows.where(~inside).join(near, "doc_id")
    previous = F.concat("earlier", "previous")
    at_bound = at_bound.select("doc_id", "place", F.slice(previous, F.greatest(F.size(previous) - before + 1, F.lit(1)), before).alias("previous"), "node", F.slice(F.concat("next", "later"), 1, after).alias("next"))
    return rows.where(inside).unionByName(at_bound)
