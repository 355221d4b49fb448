"""Values worked out by hand, parameters that are wrong, and sources."""

import math

import pytest

import corpuscle as c
from corpuscle.errors import DuplicateDocuments, SchemaMismatch, SourceFailed, ValidationFailed
from corpuscle.functions.chunk import split_text
from corpuscle.functions.clean import clean
from corpuscle.functions.stats import chi2_tail
from corpuscle.plans.session import configured, is_large, joined, progress, timed
from pyspark.sql import functions as F

TOKENS = "doc_id string, token string, pos_tag string, ds_tag string, pos_id long, ds_id long"


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [
        ("a", "The ", "AT", "Untagged", 1, 1), ("a", "cat", "NN1", "Description", 2, 2), ("a", ". ", "Y", "Untagged", 3, 3), ("a", "the ", "AT", "Untagged", 4, 4), ("a", "dog ", "NN1", "Description", 5, 5),
        ("b", "The ", "AT", "Untagged", 6, 6), ("b", "cat ", "NN1", "Description", 7, 7), ("b", "sat ", "VVD", "Narrative", 8, 8),
    ]
    return spark.createDataFrame(rows, TOKENS)


def test_frequencies(tokens):
    got = {(r["Token"], r["Tag"]): (r["AF"], round(r["RF"]), r["Range"]) for r in c.frequency_table(tokens).collect()}
    assert got == {("the", "AT"): (3, 428571, 100.0), ("cat", "NN1"): (2, 285714, 100.0), ("dog", "NN1"): (1, 142857, 50.0), ("sat", "VVD"): (1, 142857, 50.0)}
    assert c.frequency_table(tokens, af_min=2, af_max=2).count() == 1 and len(c.frequency_table(tokens, "both")) == 2
    assert [tuple(r) for r in c.tags_dtm(tokens).orderBy("doc_id").select("doc_id", "AT", "NN1", "VVD").collect()] == [("a", 2, 2, 0), ("b", 1, 1, 1)]
    assert {r["Tag"]: r["AF"] for r in c.tags_table(tokens).collect()} == {"AT": 3, "NN1": 3, "VVD": 1}


def test_dispersion(tokens):
    r = {x["Token"]: x for x in c.dispersions_table(tokens).collect()}["cat"]
    s, v = [4 / 7, 3 / 7], [1, 1]
    assert r["AF"] == 2 and math.isclose(r["Carrolls_D2"], 1.0) and math.isclose(r["Rosengrens_S"], sum(math.sqrt(a * b) for a, b in zip(v, s)) ** 2 / 2)
    assert math.isclose(r["DP"], 0.5 * sum(abs(0.5 - x) for x in s)) and math.isclose(r["Lynes_D3"], 1.0) and math.isclose(r["DP_norm"], r["DP"] / (1 - 3 / 7))


def test_sequences(tokens):
    got = {(r["Token_1"], r["Token_2"]): r["AF"] for r in c.ngrams(tokens, 2).collect()}
    assert got == {("the", "cat"): 2, ("cat", "the"): 1, ("the", "dog"): 1, ("dog", "the"): 1, ("cat", "sat"): 1}
    assert ("dog", "the") not in {(r[0], r[1]) for r in c.ngrams(tokens, 2, within_doc=True).collect()}
    kwic = [tuple(r) for r in c.kwic_center_node(tokens, "cat").collect()]
    assert kwic == [("a", "The ", "cat", ". the dog The cat sat "), ("b", "The cat. the dog The ", "cat ", "sat ")]
    assert {(r["Token_1"], r["Token_2"]): r["AF"] for r in c.clusters_by_token(tokens, "cat", 2, 2).collect()} == {("the", "cat"): 2}
    assert c.clusters_by_tag(tokens, "VVD", 2, 2).first()["Token_1"] == "cat" and c.clusters_by_token(tokens, "zebra").count() == 0
    coll = {r["Token"]: r for r in c.coll_table(tokens, "cat", 1, 1, "pmi").collect()}
    assert coll["the"]["Freq Span"] == 3 and math.isclose(coll["the"]["MI"], math.log2(3 / 7) - math.log2(3 / 7 * 2 / 7))


def test_keyness(spark):
    of = lambda n: spark.createDataFrame([("x", "NN1", n, n * 100.0, 50.0), ("y", "NN1", 10000 - n, 1e6 - n * 100.0, 100.0)], "Token string, Tag string, AF long, RF double, Range double")
    r = c.keyness_table(of(50), of(10)).first()
    ll = 2 * (50 * math.log(50 / 30) + 10 * math.log(10 / 30))
    assert r["Token"] == "x" and math.isclose(r["LL"], ll) and math.isclose(r["LR"], math.log2(5)) and math.isclose(r["PV"], math.erfc(math.sqrt(ll / 2)), rel_tol=1e-9)


def test_chi2_tail(spark):
    xs = [0.0, 0.1, 1.0, 6.63, 12.4, 12.6, 50.0, 400.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(chi2_tail("x")).collect()]
    assert all(math.isclose(g, math.erfc(math.sqrt(x / 2)), rel_tol=1e-10) for g, x in zip(got, xs))


def test_parsing(spark):
    corpus = spark.createDataFrame([("d1", "It's such as that. In that case, its end."), ("d2", None), ("d3", "")], "doc_id string, text string")
    t = c.parse(corpus, validate=True).orderBy("tok_idx").collect()
    assert {r["doc_id"] for r in t} == {"d1"} and "".join(r["token"] for r in t) == "It's such as that. In that case, it s end."
    by = [(r["token"].strip(), r["pos_tag"], r["pos_id"]) for r in t]
    such = next(x for x in by if x[0] == "such")
    assert ("as", such[1], such[2]) in by and such[1] == "II" and ("s", "GE") in [x[:2] for x in by]
    chunks = c.parse(corpus, chunk_chars=12).orderBy("tok_idx")
    assert " ".join("".join(r["token"] for r in chunks.collect()).split()) == "It's such as that. In that case, it s end."
    with pytest.raises(DuplicateDocuments):
        c.parse(corpus.union(corpus), validate=True)
    with pytest.raises(SchemaMismatch):
        c.parse(corpus.withColumn("more", F.lit(1)))


def test_cleaning(spark):
    texts = ["  a \t b c ", "“x” ‘y’", "naïve ﬁ ½ …", "its ITS hits", "汉字 ok", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(clean(F.col("text"))).collect()]
    assert got == ["a b c", "\"x\" 'y'", "naive fi 12 ...", "it s IT S hits", "ok", None]


def test_chunks():
    text = "One day it rained. Then it was dry. " * 30
    parts = split_text(text, 4)
    assert "".join(parts) == text and len(parts) == 4 and all(p.endswith(".") for p in parts[:-1])  # the white space begins the next part
    assert "".join(split_text("x" * 100, 3)) == "x" * 100 and split_text("", 3) == [] and split_text("abc", 1) == ["abc"]


def test_taggers(spark):
    def make():
        return lambda texts: [[(w, " ", "NN1", "B-Reasoning") for w in t.split()] for t in texts]

    corpus = spark.createDataFrame([("a", "one two"), ("b", "three")], "doc_id string, text string")
    t = c.parse(corpus, c.FunctionTagger(make)).orderBy("pos_id").collect()
    assert [(r["doc_id"], r["token"], r["ds_tag"], r["pos_id"]) for r in t] == [("a", "one ", "Reasoning", 1), ("a", "two ", "Reasoning", 2), ("b", "three ", "Reasoning", 3)]
    tagged = spark.createDataFrame([("a", 0, "So", " ", "CS21", 3, "Reasoning"), ("a", 1, "that", " ", "CS22", 1, "Reasoning"), ("a", 2, "x", "", "NN1", 2, "")], "doc_id string, tok_idx long, token string, ws string, pos_tag string, iob int, label string")
    with pytest.warns(DeprecationWarning):
        own = c.convert_corpus(tagged)
    assert [(r["pos_id"], r["pos_tag"], r["ds_id"], r["ds_tag"]) for r in own.table.orderBy("tok_idx").collect()] == [(1, "CS", 1, "Reasoning"), (1, "CS", 1, "Reasoning"), (2, "NN1", 2, "Untagged")]
    with pytest.raises(TypeError):
        c.convert_corpus(tagged, tagged)


def test_matrices(spark):
    dtm = spark.createDataFrame([("a", 2, 2, 0), ("b", 1, 0, 1)], "doc_id string, NN1 long, VVD long, XX long")
    assert [tuple(round(x, 6) for x in r[1:]) for r in c.dtm_weight(dtm).orderBy("doc_id").collect()] == [(0.5, 0.5, 0.0), (0.5, 0.0, 0.5)]
    tfidf = c.dtm_weight(dtm, "tfidf").orderBy("doc_id").first()
    assert math.isclose(tfidf["VVD"], 0.5 * (math.log1p(3) - math.log1p(1)))
    scaled = c.dtm_weight(dtm, "scale").orderBy("doc_id").first()
    assert math.isnan(scaled["NN1"]) and math.isclose(scaled["VVD"], 0.25 / math.sqrt(0.125))
    assert c.dtm_simplify(dtm).columns == ["doc_id", "NounCommon", "VerbLex", "Other"]
    cells, docs, tags = c.dtm_to_coo(dtm)
    assert sorted(tuple(r) for r in cells.collect()) == [(0, 0, 2.0), (0, 1, 2.0), (1, 0, 1.0), (1, 2, 1.0)] and docs.count() == 2 and tags.count() == 3
    with pytest.raises(ValidationFailed):
        c.dtm_weight(dtm, "other")


@pytest.mark.parametrize("call", [lambda t: c.frequency_table(t, "token"), lambda t: c.ngrams(t, 6), lambda t: c.ngrams(t, 1), lambda t: c.clusters_by_token(t, "x", 0), lambda t: c.kwic_center_node(t, "x", search_type="like"), lambda t: c.coll_table(t, "x", 10), lambda t: c.coll_table(t, "x", statistic="t"), lambda t: c.frequency_table(t.drop("pos_id")), lambda t: c.tag_ruler(t, "none"), lambda t: c.tag_ruler(t, 9)])
def test_wrong_parameters(tokens, call):
    with pytest.raises(ValidationFailed):
        call(tokens)


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text(" second “text” \n", encoding="utf-8")
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "no.md").write_text("x")
    assert [tuple(r) for r in c.corpus_from_folder(spark, str(tmp_path)).orderBy("doc_id").collect()] == [("a.txt", "café"), ("b.txt", "second “text”")]
    paths = c.get_text_paths(spark, str(tmp_path))
    assert len(paths) == 2 and c.readtext(spark, paths).count() == 2
    with pytest.warns(c.validation.CorpusWarning):
        assert sorted(map(tuple, c.readtext(spark, [*paths, str(tmp_path / "gone.txt")]).collect())) == [("a.txt", "café"), ("b.txt", "second “text”"), ("gone.txt", "")]
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "c.txt").write_text("third")
    assert c.corpus_from_folder(spark, str(tmp_path), recursive=True).count() == 3 and c.corpus_from_folder(spark, str(tmp_path)).count() == 2
    (tmp_path / "more" / "a.txt").write_text("again")
    for twice in (lambda: c.corpus_from_folder(spark, str(tmp_path), recursive=True), lambda: c.readtext(spark, [*paths, str(tmp_path / "more" / "a.txt")])):
        with pytest.raises(DuplicateDocuments):
            twice()
    (tmp_path / "empty").mkdir()
    for bad in (str(tmp_path / "empty"), str(tmp_path / "none"), str(tmp_path / "a.txt")):
        with pytest.raises(SourceFailed):
            c.corpus_from_folder(spark, bad)
    spark.createDataFrame([(1, "x")], "id long, body string").write.parquet(str(tmp_path / "t.parquet"))
    assert [tuple(r) for r in c.corpus_from_file(spark, str(tmp_path / "t.parquet"), "id", "body").collect()] == [("1", "x")]
    assert c.sample_tokens(spark, 2).count() > 20


def test_classes(spark, tokens):
    t = c.Tokens(tokens).kept()
    assert t.frequencies().count() == 4 and t.clusters(node_word="cat").count() >= 1 and t.ruler("a").count() == 5 and t.ruler(1).count() == 3
    assert t.cached("frequencies") is t.cached("frequencies") and t.cached("ngrams", 2) is not t.cached("ngrams", 3)
    t.release()
    assert t.why_empty("kwic", t.kwic("zebra")) and t.why_empty("kwic", t.kwic("cat")) == []
    assert t.keyness(t).count() == 0 and t.kwic("dog").count() == 1
    with pytest.raises(ValueError):
        t.clusters()
    t.release()


def test_session_helpers(spark, tokens):
    assert not is_large(tokens, 8) and is_large(tokens, 7) and list(progress(range(3), 3)) == [0, 1, 2]
    assert joined(tokens, tokens.select("doc_id").distinct(), "doc_id", "left_semi").count() == 8
    with timed("nothing"):
        pass
    assert configured(type(spark).builder, spark__sql__shuffle__partitions="4") is not None
