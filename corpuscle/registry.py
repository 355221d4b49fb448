"""The library's own queries by name, each over the driver's whole tables, and the DuckDB SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle import oracles as sql
from corpuscle.functions.chunk import chunked
from corpuscle.functions.clean import clean_corpus, split_its
from corpuscle.operators.dispersion import dispersions_table
from corpuscle.operators.frequency import frequency_table, tags_dtm, tags_table
from corpuscle.operators.keyness import keyness_table
from corpuscle.operators.matrices import dtm_simplify, dtm_to_coo, dtm_weight, freq_simplify, long_form, tags_simplify
from corpuscle.operators.sequences import clusters_by_tag, clusters_by_token, coll_table, kwic_center_node, ngrams, tag_ruler
from corpuscle.operators.tagger import DS_TAGS, POS_TAGS
from corpuscle.operators.texts import Texts, as_texts
from corpuscle.operators.tokens import parse
from corpuscle.plans.runtime import table
from corpuscle.sources.text import corpus_from_table
from corpuscle.streaming.counts import streamed_tag_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, Callable[[], str]] = {}


def _corpus(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return corpus_from_table(docs if where is None else docs.where(where))


def _tokens(spark: SparkSession, sf_dir: str, where: Column | None = None) -> Texts:
    """Texts do for all but the tokens table itself."""
    return as_texts(_corpus(spark, sf_dir, where))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null: engines add in different orders."""
    double = [c for c, kind in df.dtypes if kind == "double"]
    quoted = lambda c: F.col(f"`{c}`")
    return df.select(*[F.when(~F.isnan(quoted(c)), F.round(quoted(c), 9 if c == "PV" else digits)).alias(c) if c in double else quoted(c) for c in df.columns])


def _add(name: str, query: Query, oracle: Callable[[], str] | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        _ORACLES[name] = oracle


def _over(operator: Callable[..., DataFrame], *args, **how) -> Query:
    return lambda spark, d: _rounded(operator(_tokens(spark, d), *args, **how))


_add("clean_text", lambda s, d: clean_corpus(_corpus(s, d)), sql.cleaned)
_add("split_its", lambda s, d: _corpus(s, d).withColumn("text", split_its(F.col("text"))), lambda: "SELECT doc_id::VARCHAR AS doc_id, regexp_replace(text, '(?i)\\b(it)(s)\\b', '\\1 \\2', 'g') AS text FROM documents")
_add("chunks", lambda s, d: chunked(clean_corpus(_corpus(s, d))), sql.chunks)  # the SQL has texts of one chunk, as all of the test tables are
_add("chunks_2000", lambda s, d: chunked(clean_corpus(_corpus(s, d)), 2000))
_BOUNDS = {"af_min": 5, "af_max": 5000, "rf_max": 20000.5, "range_min": 0.55}
_add("frequency_bounds", _over(frequency_table, "pos", **_BOUNDS), lambda: f'SELECT * FROM ({sql.frequency("pos")}) WHERE "AF" BETWEEN 5 AND 5000 AND "RF" <= 20000.5 AND "Range" >= 0.55')


def _both(make: Callable[..., tuple[DataFrame, DataFrame]]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        pos, ds = make(_tokens(spark, d), "both")
        return _rounded(pos.withColumn("layer", F.lit("pos")).unionByName(ds.withColumn("layer", F.lit("ds"))))

    return query


_add("frequency_both", _both(frequency_table), lambda: f"SELECT *, 'pos' AS layer FROM ({sql.frequency('pos')}) UNION ALL SELECT *, 'ds' FROM ({sql.frequency('ds')})")
_add("tags_both", _both(tags_table), lambda: f"SELECT *, 'pos' AS layer FROM ({sql.tags('pos')}) UNION ALL SELECT *, 'ds' FROM ({sql.tags('ds')})")
_add("dtm_observed", lambda s, d: long_form(tags_dtm(_tokens(s, d), "pos")).where("n > 0").select("doc_id", "tag", F.col("n").cast("long").alias("n")), sql.observed)
_add("tokens_table", lambda s, d: parse(_corpus(s, d)).drop("tok_idx"), sql.tokens)
for _layer, _tags in (("pos", POS_TAGS), ("ds", DS_TAGS)):
    _add(f"frequency_{_layer}", _over(frequency_table, _layer), lambda layer=_layer: sql.frequency(layer))
    _add(f"tags_{_layer}", _over(tags_table, _layer), lambda layer=_layer: sql.tags(layer))
    _add(f"dtm_{_layer}", _over(tags_dtm, _layer, _tags), lambda layer=_layer: sql.dtm(layer))
    _add(f"dispersions_{_layer}", _over(dispersions_table, _layer), lambda layer=_layer: sql.dispersions(layer))
    _add(f"ngrams_2_{_layer}", _over(ngrams, 2, 10, _layer), lambda layer=_layer: sql.ngrams(2, layer))
for _n in (3, 4, 5):
    _add(f"ngrams_{_n}_pos", _over(ngrams, _n, 10, "pos"), lambda n=_n: sql.ngrams(n, "pos"))
for _search, _node, _hit in (("fixed", "that", "token = 'that'"), ("starts_with", "tha", "starts_with(token, 'tha')"), ("ends_with", "ther", "suffix(token, 'ther')"), ("contains", "t.*ing$", "regexp_matches(token, 't.*ing$')")):
    _add(f"clusters_token_{_search}", _over(clusters_by_token, _node, 2, 3, _search), lambda hit=_hit: sql.clusters(hit, 2, 3, "pos"))
_add("clusters_tag_pos", _over(clusters_by_tag, "IO", 1, 3), lambda: sql.clusters("tag = 'IO'", 1, 3, "pos"))
_add("clusters_tag_ds", _over(clusters_by_tag, "Future", 2, 2, "ds"), lambda: sql.clusters("tag = 'Future'", 2, 2, "ds"))
_PLAIN = "trim(raw)"
for _name, _args, _hit in (
    ("fixed", ("that",), "token = 'that'"),
    ("case", ("That", False), f"{_PLAIN} = 'That'"),
    ("starts", ("tha", True, "starts_with"), "starts_with(token, 'tha')"),
    ("ends", ("ther", True, "ends_with"), "suffix(token, 'ther')"),
    ("contains", ("th.*ng", True, "contains"), "regexp_matches(token, 'th.*ng')"),
):
    _add(f"kwic_{_name}", _over(kwic_center_node, *_args), lambda hit=_hit: sql.kwic(hit))
for _stat in ("pmi", "npmi", "pmi2", "pmi3"):
    _add(f"coll_{_stat}", _over(coll_table, "that", statistic=_stat), lambda stat=_stat: sql.collocations("that", stat, "pos"))


def _node_tag(spark: SparkSession, d: str) -> DataFrame:
    """The rules give a word one tag: each other that is retagged, for the node's tag to leave some out."""
    that = (F.lower(F.rtrim("token")) == "that") & (F.col("tok_idx") % 2 == 0) & (F.col("pos_tag") == "CST")
    tokens = parse(_corpus(spark, d), global_ids=False).withColumn("pos_tag", F.when(that, "DD1").otherwise(F.col("pos_tag")))
    return _rounded(coll_table(tokens, "that", node_tag="CS"))


_add("coll_node_tag", _node_tag, lambda: sql.collocations("that", "npmi", "pos", "CS", retagged=True))
_add("coll_ds", _over(coll_table, "and", 2, 3, "npmi", "ds"), lambda: sql.collocations("and", "npmi", "ds", before=2, after=3))


def _keyness(tags_only: bool = False, **how) -> Query:
    """English against the other documents."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        english = F.coalesce(F.col("lang") == "en", F.lit(False))
        make = tags_table if tags_only else frequency_table
        a, b = (make(_tokens(spark, d, x)) for x in (english, ~english))
        return _rounded(keyness_table(a, b, tags_only=tags_only, **how))

    return query


_add("keyness_default", _keyness(), lambda: sql.keyness())
_add("keyness_yates", _keyness(correct=True), lambda: sql.keyness(correct=True))
_add("keyness_tags", _keyness(tags_only=True), lambda: sql.keyness(tags_only=True))
_add("keyness_swap", _keyness(swap_target=True), lambda: sql.keyness(swap=True))
for _scheme in ("prop", "scale", "tfidf"):
    _add(f"dtm_{_scheme}", lambda s, d, scheme=_scheme: _rounded(dtm_weight(tags_dtm(_tokens(s, d), "pos", POS_TAGS), scheme)), lambda scheme=_scheme: sql.weighted(scheme))
_add("dtm_simplify", lambda s, d: dtm_simplify(tags_dtm(_tokens(s, d), "pos", POS_TAGS)), sql.simplified)
_add("freq_simplify", lambda s, d: _rounded(freq_simplify(frequency_table(_tokens(s, d)))), sql.freq_simplified)
_add("tags_simplify", lambda s, d: _rounded(tags_simplify(tags_dtm(_tokens(s, d), "pos", POS_TAGS))), sql.tags_simplified)
_add("dtm_coo", lambda s, d: dtm_to_coo(tags_dtm(_tokens(s, d), "pos", POS_TAGS))[0], sql.coo)
_add("dtm_coo_docs", lambda s, d: dtm_to_coo(tags_dtm(_tokens(s, d), "pos", POS_TAGS))[1], sql.coo_docs)
_add("dtm_coo_vocabulary", lambda s, d: dtm_to_coo(tags_dtm(_tokens(s, d), "pos", POS_TAGS))[2], sql.coo_vocabulary)
_add("tag_ruler", lambda s, d: tag_ruler(parse(_corpus(s, d)), 3, "pos"), lambda: sql.ruler(3, "pos"))
_add("streamed_tags", lambda s, d: _rounded(streamed_tag_counts(s, f"{d}/documents.parquet")), lambda: "SELECT \"Tag\", \"AF\" FROM (" + sql.tags("pos") + ")")


def oracles() -> dict[str, str]:
    return {name: make() for name, make in _ORACLES.items()}
