"""N-grams and clusters: units in a row, over the whole corpus in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle import validation as check
from corpuscle.operators.groups import around, bare, counts_as, edges, first_items, hits, last_items, ordered, strip, units, words
from corpuscle.operators.texts import TOTAL, Collocates, Concordance, GramBuckets, Texts, gram_rows, heavy_buckets, with_near
from corpuscle.operators import texts as of_texts
from corpuscle.plans.runtime import cut
from corpuscle.schema import LAYERS

SEARCHES = ("fixed", "starts_with", "ends_with", "contains")


def matches(token: Column, node: str, search: str) -> Column:
    """contains takes the node as a regular expression."""
    check.one_of(search, SEARCHES, "search_type")
    return {"fixed": lambda: token == node, "starts_with": lambda: token.startswith(node), "ends_with": lambda: token.endswith(node), "contains": lambda: token.rlike(node)}[search]()


def _table(rows: DataFrame, total: DataFrame, span: int) -> DataFrame:
    """Token_1.., Tag_1.., AF, RF per million of total (one row: total), Range % of the documents in rows (doc_id, items)."""
    items = [F.get("items", F.lit(k)) for k in range(span)]
    flat = rows.select("doc_id", *[i["token"].alias(f"Token_{k + 1}") for k, i in enumerate(items)], *[i["tag"].alias(f"Tag_{k + 1}") for k, i in enumerate(items)])
    keys = flat.columns[1:]
    by_doc = flat.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    sums = by_doc.groupBy(*keys).agg(F.sum("n").alias("AF"), F.count("*").alias("docs"))
    return sums.crossJoin(F.broadcast(total)).select(*keys, "AF", (F.col("AF") / F.col("total") * 1e6).alias("RF"), (F.col("docs") / F.col("all_docs") * 100.0).alias("Range"))


def _summed(rows: DataFrame, span: int, min_frequency: float = 0) -> DataFrame:
    """_table of rows (Token_1.., Tag_1.., n, docs), sums of some documents each, with totals as Tag_1 = TOTAL."""
    keys = [f"{c}_{k + 1}" for c in ("Token", "Tag") for k in range(span)]
    sums = rows.groupBy(*keys).agg(F.sum("n").alias("AF"), F.sum("docs").alias("docs"), F.max(F.col("Tag_1") == TOTAL).alias("all"))
    total = sums.where(F.col("all")).select(F.col("AF").alias("total"), F.col("docs").alias("all_docs"))
    table = sums.where(~F.coalesce("all", F.lit(False))).crossJoin(F.broadcast(total)).select(*keys, "AF", (F.col("AF") / F.col("total") * 1e6).alias("RF"), (F.col("docs") / F.col("all_docs") * 100.0).alias("Range"))
    return _by_frequency(table.where(F.col("RF") >= min_frequency) if min_frequency > 0 else table, span)


def _ngrams_of_texts(texts: Texts, span: int, min_frequency: float, layer: str, within_doc: bool) -> DataFrame:
    """N-grams are counted by a hash first. Only those are counted one by one whose hash reaches min_frequency: none that reaches it
    itself is left out, and what goes through the shuffle is bounded by min_frequency, not by the corpus."""
    near = with_near(texts, "counted", layer, 0, span - 1, within_doc)
    near = near if near is None else cut(near)
    heavy = None
    if min_frequency > 0:
        heavy = heavy_buckets(texts.read(lambda: GramBuckets(layer, span), "part int, counts binary", near), min_frequency)
    return _summed(gram_rows(texts, layer, span, near, heavy=heavy), span, min_frequency)


def _by_frequency(table: DataFrame, span: int) -> DataFrame:
    return table.orderBy(F.desc("AF"), *[f"Token_{k + 1}" for k in range(span)], *[f"Tag_{k + 1}" for k in range(span)])


def ngrams(tokens: DataFrame | Texts, span: int = 2, min_frequency: float = 10, count_by: str = "pos", within_doc: bool = False) -> DataFrame:
    """N-grams by falling AF, then tokens. min_frequency is of RF, per million; the last units of the corpus begin none.

    An n-gram over the bound of documents counts for the one in which it begins; within_doc leaves these out.
    """
    check.layer(count_by)
    check.tokens(tokens)
    check.span(span)
    if isinstance(tokens, Texts):
        return _ngrams_of_texts(tokens, span, min_frequency, count_by, within_doc)
    docs = cut(words(tokens, count_by)).where("size(units) > 0")
    runs = lambda items, n: F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(items, i, span)))
    rows = docs.where(F.size("units") >= span).select("doc_id", runs("units", F.size("units") - span + 1).alias("items"))
    # Documents that begin an n-gram: all that are long enough, and shorter ones that enough units follow.
    total = docs.agg(F.sum(F.size("units")).alias("total"), F.sum(F.when(F.size("units") >= span, 1).otherwise(0)).alias("all_docs"))
    if not within_doc:
        ends = docs.select("doc_id", first_items("units", span - 1).alias("head"), last_items("units", span - 1).alias("tail"), (F.size("units") < span).alias("short"))
        over = edges(ends, 0, span - 1).join(ends, "doc_id").select("doc_id", "short", F.size("tail").alias("n"), F.concat("tail", "next").alias("items"))
        # Of those that begin in the last units, the ones that are whole.
        over = over.withColumn("n", F.least("n", F.size("items") - span + 1)).where("n > 0")
        rows = rows.unionByName(over.select("doc_id", runs("items", F.col("n")).alias("items")))
        total = total.crossJoin(F.broadcast(over.agg(F.count_if("short").alias("more")))).select("total", (F.col("all_docs") + F.col("more")).alias("all_docs"))
    table = _table(rows, total, span)
    return _by_frequency(table.where(F.col("RF") >= min_frequency), span)


def _clusters(tokens: DataFrame | Texts, layer: str, hit: Callable[[Column], Column], plain_hit: Callable[[str, str], bool] | None, position: int, span: int, within_doc: bool) -> DataFrame:
    """plain_hit is hit as plain code on (token, tag), where there is such."""
    before, after = position - 1, span - position
    if isinstance(tokens, Texts):
        if plain_hit is not None:
            near = with_near(tokens, "counted", layer, before, after, within_doc)
            return _summed(gram_rows(tokens, layer, span, near, before, plain_hit), span)
        tokens = tokens.tokens()
    found = hits(words(tokens, layer), before, after, hit)
    kept = cut(found.select("doc_id", "hits", "head", "tail", F.size("units").alias("n")))
    # Beyond the ends of the corpus there is null, so that the node keeps its place.
    nothing = F.array_repeat(F.lit(None).cast("struct<token: string, tag: string>"), F.lit(before) - F.size("previous"))
    rows = around(kept, before, after, within_doc).select("doc_id", F.concat(nothing, "previous", F.array("node"), "next").alias("items"))
    total = kept.agg(F.sum("n").alias("total"), F.sum(F.when(F.size("hits") > 0, 1)).alias("all_docs"))
    return _by_frequency(_table(rows, total, span), span)


def clusters_by_token(tokens: DataFrame | Texts, node_word: str, node_position: int = 1, span: int = 2, search_type: str = "fixed", count_by: str = "pos", within_doc: bool = False) -> DataFrame:
    """N-grams with a word like node_word at node_position; Range is of the documents that have one. No hits give no rows."""
    check.layer(count_by)
    check.tokens(tokens)
    check.span(span)
    check.one_of(search_type, SEARCHES, "search_type")
    hit = lambda u: matches(u["token"], node_word.lower(), search_type)
    plain = of_texts.search(node_word.lower(), search_type)
    return _clusters(tokens, count_by, hit, plain and (lambda token, _: plain(token)), check.position(node_position, span), span, within_doc)


def clusters_by_tag(tokens: DataFrame | Texts, tag: str, tag_position: int = 1, span: int = 2, count_by: str = "pos", within_doc: bool = False) -> DataFrame:
    """N-grams with this tag at tag_position."""
    check.layer(count_by)
    check.tokens(tokens)
    check.span(span)
    return _clusters(tokens, count_by, lambda u: u["tag"] == tag, lambda _, own: own == tag, check.position(tag_position, span), span, within_doc)


def kwic_center_node(tokens: DataFrame | Texts, node_word: str, ignore_case: bool = True, search_type: str = "fixed", within_doc: bool = False, words: int = 7) -> DataFrame:
    """(Doc ID, Pre-Node, Node, Post-Node): each hit with the words units before and after it, as they are written.

    As in the library that this follows, ends_with with case looks at the unit with its white space.
    """
    check.tokens(tokens)
    check.one_of(search_type, SEARCHES, "search_type")
    if isinstance(tokens, Texts):
        plain = of_texts.search(node_word.lower() if ignore_case else node_word, search_type)
        if plain is not None:
            if ignore_case:
                return _kwic_of_texts(tokens, plain, None, words, within_doc)
            # What is found as it is written is found in lower case; a pattern may not be.
            lower = (lambda token: True) if search_type == "contains" else of_texts.search(node_word.lower().rstrip(of_texts.SPACES), search_type)
            written = plain if search_type == "ends_with" else lambda token: plain(of_texts.bare(token))
            return _kwic_of_texts(tokens, lower, written, words, within_doc)
        tokens = tokens.tokens()

    def hit(u: Column) -> Column:
        if ignore_case:
            return matches(strip(u["token"]), node_word.lower(), search_type)
        return matches(u["token"] if search_type == "ends_with" else bare(u["token"]), node_word, search_type)

    docs = units(tokens, "pos", by_tag=False).withColumn("units", F.transform("units", lambda u: F.struct(u["token"].alias("token"))))
    kept = cut(hits(docs, words, words, hit).select("doc_id", "hits", "head", "tail"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["token"]), "")
    near = around(kept, words, words, within_doc)
    return near.select(F.col("doc_id").alias("Doc ID"), joined("previous").alias("Pre-Node"), F.col("node.token").alias("Node"), joined("next").alias("Post-Node"), "place").orderBy("Doc ID", "place").drop("place")


def _kwic_of_texts(texts: Texts, hit: Callable[[str], bool], written_hit: Callable[[str], bool] | None, words: int, within_doc: bool) -> DataFrame:
    near = with_near(texts, "written", "pos", words, words, within_doc)
    # Kept once found: the sort at the end reads them twice.
    rows = cut(texts.read(lambda: Concordance(words, hit, written_hit), "doc_id string, place long, previous string, node string, next string", near))
    return rows.orderBy("doc_id", "place").select(F.col("doc_id").alias("Doc ID"), F.col("previous").alias("Pre-Node"), F.col("node").alias("Node"), F.col("next").alias("Post-Node"))


def _coll_sums(texts: Texts, node: str, node_tag: str | None, preceding: int, following: int, layer: str, within_doc: bool) -> tuple[DataFrame, DataFrame]:
    """(Token, Tag, Freq Span, Freq Total) of what is near the node, and (total, node)."""
    near = with_near(texts, "letters", layer, preceding, following, within_doc)
    rows = texts.read(lambda: Collocates(layer, preceding, following, lambda token, tag: token == node and tag.startswith(node_tag or "")), "Token string, Tag string, span long, n long", near)
    sums = rows.groupBy("Token", "Tag").agg(F.sum("span").alias("Freq Span"), F.sum("n").alias("Freq Total"), F.max(F.col("Tag") == TOTAL).alias("all"))
    all_ = sums.where(F.col("all")).select(F.col("Freq Total").alias("total"), F.col("Freq Span").alias("node"))
    return sums.where(~F.col("all") & (F.col("Freq Span") > 0) & (F.col("Freq Total") > 0)).drop("all"), all_


def coll_table(tokens: DataFrame | Texts, node_word: str, preceding: int = 4, following: int = 4, statistic: str = "npmi", count_by: str = "pos", node_tag: str | None = None, within_doc: bool = False) -> DataFrame:
    """(Token, Tag, Freq Span, Freq Total, MI) of units with letters around the node, by falling MI, then Token.

    Neighbours are taken among units with a letter from a to z; totals among those that count on the layer. A node that doesn't occur gives
    no rows. node_tag is a prefix of the node's tag.
    """
    from corpuscle.functions.stats import mutual_information

    check.one_of(statistic, ("pmi", "npmi", "pmi2", "pmi3"), "statistic")
    check.layer(count_by)
    check.tokens(tokens)
    for n in (preceding, following):
        if not 0 <= n <= 9:
            raise check.ValidationFailed(f"preceding and following are from 0 to 9, not {n}")
    of = _coll_sums if isinstance(tokens, Texts) else _coll_of_tokens
    sums, all_ = of(tokens, node_word.lower(), node_tag, preceding, following, count_by, within_doc)
    both = sums.crossJoin(F.broadcast(all_)).where("node > 0")
    mi = mutual_information(statistic, F.col("Freq Span"), F.col("Freq Total"), F.col("node"), F.col("total"))
    return both.select("Token", "Tag", "Freq Span", "Freq Total", mi.alias("MI")).orderBy(F.desc("MI"), "Token", "Tag")


def _coll_of_tokens(tokens: DataFrame, node: str, node_tag: str | None, preceding: int, following: int, count_by: str, within_doc: bool) -> tuple[DataFrame, DataFrame]:
    """The same as _coll_sums of rows of tokens."""
    plain = F.transform("units", lambda u: F.struct(strip(u["token"]).alias("token"), u["tag"].alias("tag")))
    docs = units(tokens, count_by).select("doc_id", plain.alias("units"))
    docs = docs.select("doc_id", "units", F.filter("units", lambda u: u["token"].rlike("[a-z]")).alias("letters"))
    is_node = lambda token, tag: (token == node) & (tag.startswith(node_tag) if node_tag is not None else F.lit(True))
    found = hits(docs, preceding, following, lambda u: is_node(u["token"], u["tag"]), "letters")
    kept = cut(found.select("doc_id", "hits", "head", "tail", F.filter("units", lambda u: counts_as(count_by, u["token"], u["tag"])).alias("units")))
    bag = kept.select(F.inline("units"))
    totals = bag.groupBy(F.col("token").alias("Token"), F.col("tag").alias("Tag")).agg(F.count("*").alias("Freq Total"))
    all_ = bag.agg(F.count("*").alias("total"), F.sum(F.when(is_node(F.col("token"), F.col("tag")), 1)).alias("node"))
    near = around(kept, preceding, following, within_doc)
    span = near.select(F.explode(F.concat("previous", "next")).alias("x")).groupBy(F.col("x.token").alias("Token"), F.col("x.tag").alias("Tag")).agg(F.count("*").alias("Freq Span"))
    return span.join(totals, ["Token", "Tag"]), all_


def tag_ruler(tokens: DataFrame | Texts, doc_id: str | int, count_by: str = "pos") -> DataFrame:
    """(token, tag, tag_id) of one document in order, by id or by its index in the sorted ids."""
    check.layer(count_by)
    check.tokens(tokens)
    tag, id_ = LAYERS[count_by]
    tokens = tokens.tokens() if isinstance(tokens, Texts) else tokens
    if isinstance(doc_id, int) and not isinstance(doc_id, bool):
        first = tokens.select("doc_id").distinct().orderBy("doc_id").limit(max(doc_id, 0) + 1)
        at, n = first.agg(F.max("doc_id"), F.count("*")).first()
        if doc_id < 0 or n <= doc_id:
            raise check.ValidationFailed(f"there are {n} documents: the index exceeds the maximum {n - 1}" if doc_id >= 0 else "an index counts from 0")
        doc_id = at
    own = cut(ordered(tokens).where(F.col("doc_id") == doc_id))
    if own.isEmpty():
        raise check.ValidationFailed(f"there is no document {doc_id!r}")
    return own.orderBy("tok_idx").select("token", F.col(tag).alias("tag"), F.col(id_).alias("tag_id"))
