"""Texts in place of a tokens table: no rows of tokens are made, and results are those of the rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle import registry
from corpuscle.functions.clean import clean, clean_text
from corpuscle.operators import texts as t
from corpuscle.operators.dispersion import dispersions_table
from corpuscle.operators.sequences import clusters_by_token, coll_table, kwic_center_node, ngrams
from corpuscle.operators.tagger import POS_TAGS, RuleTagger
from tests.test_queries import TEXTS

#: Queries that failed or were to fail at size, as rows of tokens were sorted and windowed.
NAMED = [
    "dtm_coo_docs", "dtm_ds", "dtm_simplify", "dtm_tfidf", "tags_ds", "tags_simplify", "dtm_coo", "dtm_coo_vocabulary", "dtm_observed", "dtm_pos", "dtm_prop", "dtm_scale", "tags_both", "tags_pos",
    "frequency_both", "frequency_bounds", "freq_simplify", "frequency_pos", "keyness_yates", "keyness_default", "keyness_swap", "frequency_ds", "keyness_tags",
    "dispersions_ds", "dispersions_pos",
    "ngrams_4_pos", "ngrams_5_pos", "ngrams_3_pos", "ngrams_2_ds", "ngrams_2_pos",
    "clusters_token_ends_with", "clusters_token_contains", "clusters_tag_ds", "clusters_token_fixed", "clusters_token_starts_with", "clusters_tag_pos",
    "kwic_ends", "kwic_fixed", "kwic_case", "kwic_starts", "kwic_contains",
    "coll_pmi", "coll_npmi", "coll_pmi2", "coll_pmi3", "coll_ds",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("texts"))
    rows = [(i, x, "en" if i % 2 else "de", "src", len(x or "")) for i, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(f"d{i:02d}", x) for i, x in enumerate(TEXTS)], "doc_id string, text string")


@pytest.mark.parametrize("name", NAMED)
def test_no_rows_of_tokens(spark, folder, monkeypatch, name):
    def none(*_):
        raise AssertionError("tokens become rows")

    monkeypatch.setattr(RuleTagger, "tag", none)
    registry.QUERIES[name](spark, folder)


def test_cleaning(spark):
    some = random.Random(1)
    odd = ["".join(some.choice("itsITS _5.'  \t\n\x1c\x85\xa0 ‘”éﬁ½…汉𝐀\x00\x01¨ãÅ​́x") for _ in range(some.randint(0, 25))) for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in odd], "x string").select("x", clean(F.col("x")).alias("c")).collect()
    assert [clean_text(r["x"]) for r in got] == [r["c"] for r in got]


def batches(texts):
    return iter([pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(texts))]), pa.array(texts)], ["doc_id", "text"])])


def sums(make, texts, keys):
    found: dict = {}
    for b in t._worked(make, batches(texts)):
        for r in b.to_pylist():
            key = tuple(r[k] for k in keys)
            found[key] = [x + y for x, y in zip(found.get(key, [0] * 9), (r[k] for k in r if k not in keys))]
    return found


@pytest.mark.parametrize("make, keys", [(lambda: t.UnitSums("pos"), ["Token", "Tag"]), (lambda: t.TagCounts("pos", POS_TAGS, by_doc=False), ["Tag"]), (lambda: t.Grams("pos", 3), [f"{c}_{k}" for c in ("Token", "Tag") for k in (1, 2, 3)])])
def test_bounds_of_memory(monkeypatch, make, keys):
    """The same sums if slices, lexicons and n-grams are handed on early."""
    texts = [x for x in TEXTS if x is not None]
    whole = sums(make, texts, keys)
    for name, n in (("SLICE_CHARS", 50), ("MOST_PIECES", 10), ("MOST_GRAMS", 5)):
        monkeypatch.setattr(t, name, n)
    assert sums(make, texts, keys) == whole and len(whole) > 10


def test_rare_units_of_large_documents(monkeypatch):
    """Whether a unit is among the frequent ones or a cell of a large document: the same sum of size / total - v / f."""
    texts = ["a b c d e f g h a a a", "b c d e", "a", "h h h h h h h h b"]
    f = {("a", "AT1"): 5.0, ("h", "NN1"): 9.0}
    below = lambda r: r["below"] if r["below"] is not None else max(r["size"] / 25 - r["v"] / f[r["Token"], r["Tag"]], 0)

    def of(frequent):
        rows = [r for b in t._worked(lambda: t.Below("pos", frequent, 25.0), batches(texts)) for r in b.to_pylist() if (r["Token"], r["Tag"]) in f]
        return {key: sum(below(r) for r in rows if (r["Token"], r["Tag"]) == key) for key in f}

    wanted = {("a", "AT1"): 0.0, ("h", "NN1"): 11 / 25 - 1 / 9}
    assert all(abs(of(f)[k] - x) < 1e-12 for k, x in wanted.items())
    monkeypatch.setattr(t, "LARGE_DOC", 3)
    assert all(abs(of({("a", "AT1"): 5.0})[k] - x) < 1e-12 for k, x in wanted.items())


def test_long_texts_ends():
    """First and last units of long texts, from their ends alone, and from the whole where the ends hold signs."""
    for middle in ("word " * 500, "! " * 1000, "a" * 3000 + " "):
        text = f"such as it s {middle}in that case of the end"
        (batch,) = t._worked(lambda: t.Ends("counted", "pos", 3, 2), batches([text]))
        (r,) = batch.to_pylist()
        assert [(x["token"], x["tag"]) for x in r["head"]] == [("such as", "II"), ("it", "PPH1")] and [x["token"] for x in r["tail"]] == ["of", "the", "end"]


def same(a, b):
    a, b = (sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr) for df in (a, b))
    return a == b and len(a) > 0


@pytest.mark.parametrize(
    "operator, args",
    [(ngrams, (2, 3000)), (ngrams, (3, 0)), (clusters_by_token, ("(?i)TH.t", 2, 3, "contains")), (clusters_by_token, ("th[ae]", 1, 2, "contains", "ds")), (kwic_center_node, ("(?<=t)hat", True, "contains")), (kwic_center_node, ("That ", False, "ends_with")), (kwic_center_node, ("T.*t", False, "contains")), (coll_table, ("of", 0, 3)), (dispersions_table, ("ds",))],
)
def test_as_of_rows(corpus, operator, args):
    texts = t.as_texts(corpus)
    assert same(operator(texts, *args), operator(texts.tokens(), *args))
    if operator in (ngrams, clusters_by_token, kwic_center_node, coll_table):
        assert same(operator(texts, *args, within_doc=True), operator(texts.tokens(), *args, within_doc=True))


def test_no_documents(spark):
    none = t.as_texts(spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string"))
    assert ngrams(none, 2).count() == 0 and kwic_center_node(none, "x").count() == 0 and dispersions_table(none).count() == 0 and coll_table(none, "x").count() == 0


def test_buckets(spark, corpus):
    """No n-gram that is frequent enough is left out."""
    texts = t.as_texts(corpus)
    heavy = t.heavy_buckets(texts.read(lambda: t.GramBuckets("pos", 2), "part int, counts binary"), 3000)
    assert 0 < np.unpackbits(np.frombuffer(heavy, np.uint8)).sum() < 200
