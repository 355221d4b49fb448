"""A small corpus and formulas worked out by hand: values that no rule or expression of this library has made."""

import math
import re

import pytest
from pyspark.sql import functions as F

import corpuscle as c
from corpuscle.functions.chunk import chunked, split_text
from corpuscle.functions.clean import clean
from corpuscle.operators.tokens import finish
from corpuscle.schema import RAW_TOKENS

WORDS = {
    "d1": [("It", "", "PPH1", "O-"), ("s", " ", "PN1", "O-"), ("such", " ", "II21", "B-Reasoning"), ("as", " ", "II22", "I-Reasoning"), ("the", " ", "AT", "O-"), ("data", "", "NN2", "B-AcademicTerms"), (".", " ", "Y", "O-")],
    "d2": [("The", " ", "AT", "O-"), ("data", " ", "NN2", "B-AcademicTerms"), ("set", "", "VVD", "I-AcademicTerms"), (",", " ", "Y", "O-"), ("the", " ", "AT", "O-"), ("end", "", "NN1", "O-"), (".", " ", "Y", "O-")],
}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([(d, k, *t) for d, own in WORDS.items() for k, t in enumerate(own)], RAW_TOKENS).cache()


@pytest.fixture(scope="module")
def tokens(raw):
    return finish(raw).cache()


def near(a, b):
    return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-6)


def test_tokens(raw, tokens):
    rows = tokens.orderBy("doc_id", "tok_idx").collect()
    assert [r["pos_id"] for r in rows] == [1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    assert [r["ds_id"] for r in rows] == [1, 2, 3, 3, 4, 5, 6, 7, 8, 8, 9, 10, 11, 12]
    assert [r["pos_tag"] for r in rows][1:4] == ["GE", "II", "II"] and {r["ds_tag"] for r in rows} == {"Untagged", "Reasoning", "AcademicTerms"}
    apart = finish(raw, merge_multiword=False).orderBy("doc_id", "tok_idx").collect()
    assert [r["pos_id"] for r in apart] == list(range(1, 15)) and [r["pos_tag"] for r in apart][2:4] == ["II21", "II22"]


def test_frequencies(tokens):
    pos = {(r[0], r[1]): r[2:] for r in map(tuple, c.frequency_table(tokens).collect())}
    assert pos.pop(("the", "AT")) == (3, 300000.0, 100.0) and pos.pop(("data", "NN2")) == (2, 200000.0, 100.0)
    assert pos == {k: (1, 100000.0, 50.0) for k in (("such as", "II"), ("it", "PPH1"), ("s", "GE"), ("set", "VVD"), ("end", "NN1"))}
    ds = {(r["Token"], r["Tag"]): r["AF"] for r in c.frequency_table(tokens, "ds").collect()}
    assert ds == {("the", "Untagged"): 3, ("data", "AcademicTerms"): 1, ("data set", "AcademicTerms"): 1, ("such as", "Reasoning"): 1, ("it", "Untagged"): 1, ("s", "Untagged"): 1, ("end", "Untagged"): 1}
    tags = {r[0]: r[1:] for r in map(tuple, c.tags_table(tokens).collect())}
    assert tags.pop("AT") == (3, 30.0, 100.0) and tags.pop("NN2") == (2, 20.0, 100.0)
    assert tags == {t: (1, 10.0, 50.0) for t in ("II", "PPH1", "GE", "VVD", "NN1")}


def test_ngrams(tokens):
    got = {(r["Token_1"], r["Token_2"]): (r["AF"], r["RF"], r["Range"]) for r in c.ngrams(tokens, 2, 0).collect()}
    assert got.pop(("the", "data")) == (2, 200000.0, 100.0)
    over = ("data", "the")
    assert got == {k: (1, 100000.0, 50.0) for k in (("it", "s"), ("s", "such as"), ("such as", "the"), over, ("data", "set"), ("set", "the"), ("the", "end"))}
    assert {(r[0], r[1]) for r in c.ngrams(tokens, 2, 0, within_doc=True).collect()} == {*got, ("the", "data")} - {over}
    (end,) = c.clusters_by_token(tokens, "end", 1, 2).collect()
    assert (end["Token_1"], end["Token_2"], end["AF"], end["RF"], end["Range"]) == ("end", None, 1, 100000.0, 100.0)
    before = c.clusters_by_token(tokens, "it", 2, 3).first()
    assert (before["Token_1"], before["Token_2"], before["Token_3"]) == (None, "it", "s")


def test_ngrams_over_short_documents(spark):
    """Documents of one word, and one without any: n-grams go over several bounds, and the last begin none."""
    rows = [(d, 0, w, " ", "Y" if w == "." else "NN1", "O-") for d, w in (("a", "x"), ("b", "."), ("c", "y"), ("d", "z"))]
    table = c.ngrams(finish(spark.createDataFrame(rows, RAW_TOKENS)), 3, 0)
    assert [tuple(r) for r in table.collect()] == [("x", "y", "z", "NN1", "NN1", "NN1", 1, 1e6 / 3, 100.0)]


def test_kwic(tokens):
    assert [tuple(r) for r in c.kwic_center_node(tokens, "data").collect()] == [("d1", "Its such as the ", "data", ". The data set, the end"), ("d2", "Its such as the data. The ", "data ", "set, the end. ")]


def test_collocations(tokens):
    wanted = {"pmi": (2.321928, 2.321928), "npmi": (1.336773, 0.698970), "pmi2": (0.584963, -1.0), "pmi3": (-1.152003, -4.321928)}
    for statistic, (the, set_) in wanted.items():
        got = {(r["Token"], r["Tag"], r["Freq Span"], r["Freq Total"]): r["MI"] for r in c.coll_table(tokens, "data", 1, 1, statistic).collect()}
        assert set(got) == {("the", "AT", 3, 3), ("set", "VVD", 1, 1)}
        assert near(got["the", "AT", 3, 3], the) and near(got["set", "VVD", 1, 1], set_)
    retagged = tokens.withColumn("pos_tag", F.when((F.col("doc_id") == "d1") & (F.col("pos_tag") == "NN2"), "NP1").otherwise(F.col("pos_tag")))
    assert {(r["Token"], r["Freq Span"]) for r in c.coll_table(retagged, "data", 1, 1, node_tag="NN").collect()} == {("the", 1), ("set", 1)}


def test_ruler(tokens):
    rows = [tuple(r) for r in c.tag_ruler(tokens, "d1").collect()]
    assert len(rows) == 7 and [r[2] for r in rows] == [1, 2, 3, 3, 4, 5, 6] and rows[-1] == (". ", "Y", 6)
    with pytest.raises(ValueError, match="exceeds the maximum 1"):
        c.tag_ruler(tokens, 5)


def test_matrices(tokens):
    names = ["AT", "NN2", "VVD", "NN1", "PPH1", "GE", "II"]
    dtm = c.tags_dtm(tokens, "pos", names)
    get = lambda df: {r["doc_id"]: [r[n] for n in names] for r in df.collect()}
    assert get(dtm) == {"d1": [1, 1, 0, 0, 1, 1, 1], "d2": [2, 1, 1, 1, 0, 0, 0]} and set(c.tags_dtm(tokens).columns) == {"doc_id", *names}
    assert get(c.dtm_weight(dtm)) == {"d1": [0.2, 0.2, 0, 0, 0.2, 0.2, 0.2], "d2": [0.4, 0.2, 0.2, 0.2, 0, 0, 0]}
    h = 0.707107
    scaled = get(c.dtm_weight(dtm, "scale"))
    assert all(near(a, b) for a, b in zip(scaled["d1"], [-h, math.nan, -h, -h, h, h, h])) and all(near(a, b) for a, b in zip(scaled["d2"], [h, math.nan, h, h, -h, -h, -h]))
    tfidf = get(c.dtm_weight(dtm, "tfidf"))
    assert all(near(a, b) for a, b in zip(tfidf["d1"], [0.102165, 0.102165, 0, 0, 0.138629, 0.138629, 0.138629])) and all(near(a, b) for a, b in zip(tfidf["d2"], [0.204330, 0.102165, 0.138629, 0.138629, 0, 0, 0]))
    simple = {r["doc_id"]: r.asDict() for r in c.dtm_simplify(dtm).collect()}
    assert simple["d1"] == {"doc_id": "d1", "Other": 2, "NounCommon": 1, "VerbLex": 0, "Pronoun": 1, "Preposition": 1} and simple["d2"] == {"doc_id": "d2", "Other": 2, "NounCommon": 2, "VerbLex": 1, "Pronoun": 0, "Preposition": 0}


def test_dispersions(spark):
    rows, at = [], 0
    for d, (v, size) in enumerate(zip((3, 0, 5, 1, 0, 2), (10, 20, 30, 15, 5, 20))):
        for k in range(size):
            at += 1
            rows.append((f"d{d}", "x " if k < v else "y ", "NN1", "Untagged", at, at))
    table = spark.createDataFrame(rows, "doc_id string, token string, pos_tag string, ds_tag string, pos_id long, ds_id long")
    r = {x["Token"]: x for x in c.dispersions_table(table).collect()}["x"]
    wanted = {"RF": 110000, "Carrolls_D2": 0.6924390875, "Rosengrens_S": 0.7087727058, "Lynes_D3": 0.7665289256, "DC": 0.6171843363, "Juillands_D": 0.5577694413, "DP": 0.3272727273, "DP_norm": 0.3444976077}
    assert r["AF"] == 11 and all(math.isclose(r[k], v, rel_tol=1e-8) for k, v in wanted.items())


@pytest.mark.parametrize(
    "a, b, correct, ll, lr, pv",
    [(20, 5, False, 22.9790214509, 3.0, 1.637789e-06), (20, 5, True, 21.7485029611, 3.0, 3.108323e-06), (12, 0, False, 26.3666949280, 5.5849625007, 2.823676e-07), (12, 0, True, 22.4954939171, 5.5849625007, 2.106371e-06), (0, 30, False, -24.3279064865, -4.9068905956, 8.125334e-07), (0, 30, True, -19.9185598222, -4.9068905956, 8.081199e-06)],
)
def test_keyness(spark, a, b, correct, ll, lr, pv):
    def table(n, total):
        rows = [("x", "NN1", n, n * 1e6 / total, 50.0)] if n else []
        return spark.createDataFrame([*rows, ("y", "NN1", total - n, (total - n) * 1e6 / total, 100.0)], "Token string, Tag string, AF long, RF double, Range double")

    swap = ll < 0
    r = {x["Token"]: x for x in c.keyness_table(table(a, 1000), table(b, 2000), correct=correct, swap_target=swap).collect()}["x"]
    sign = -1 if swap else 1
    assert math.isclose(r["LL"], sign * ll, rel_tol=1e-9) and math.isclose(r["LR"], sign * lr, rel_tol=1e-9) and math.isclose(r["PV"], pv, rel_tol=1e-6)


def test_cleaning(spark):
    texts = ["its ITS Its bits it's", "café naïve", "\"He said  “hello”\n\tnow \"", "ﬁn ½ … ﬁn", "ＡＢ café its", "漢字 x 漢字 ﬀ"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(clean(F.col("t"))).collect()]
    assert got == ["it s IT S It s bits it's", "cafe naive", '"He said "hello" now "'.strip(), "fin 12 ... fin", "AB cafe it s", "x ff"]


def plain_split(text, n):
    """Chunks by a scan of single characters."""
    if n <= 1:
        return [text] if n else []
    marks = [math.ceil(k / n * len(text)) for k in range(1, n)]

    def sentence(m):
        for i in range(m + 1, len(text)):
            if text[i].isspace() and text[i - 1] in ".?!":
                initials = i - 4 >= m and re.fullmatch(r"\w\.\w.", text[i - 4 : i])
                short = i - 3 >= m and re.fullmatch(r"[A-Z][a-z]\.", text[i - 3 : i])
                if not initials and not short:
                    return i

    for at in ([sentence(m) for m in marks], [text.find(" ", m) for m in marks], marks):
        if all(x is not None and x >= 0 for x in at):
            return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def test_chunks_against_plain_code(spark):
    long = "Mr. Smith saw the U.S. embassy today. he saw i.e. nothing! Then Dr. No left, e.g. at 5 p.m. on foot. " * 6000
    texts = [long, "One. two? Three! " * 40, "no end of a sentence at all " * 30, "x" * 500, "", "Short.", "Mr. Mr. Mr. Mr. Mr. Mr. Mr. ", None]
    for t in texts[1:-1]:
        for n in (1, 2, 3, 4, 7):
            assert split_text(t, n) == plain_split(t, n) and "".join(split_text(t, n)) == t
    got = chunked(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")).orderBy("doc_id", "chunk_id").collect()
    wanted = [(str(i), k, part.strip() + " ") for i, t in enumerate(texts) if t for k, part in enumerate(plain_split(t, math.ceil(len(t) / 500_000)))]
    assert [tuple(r) for r in got] == wanted and sum(r["doc_id"] == "0" for r in got) == 2


def test_orders(tokens):
    """Tables come in the order that they state."""
    down = lambda rows, value, *keys: rows == sorted(rows, key=lambda r: (-r[value], *(r[k] for k in keys)))
    for layer in ("pos", "ds"):
        assert down(c.frequency_table(tokens, layer).collect(), "AF", "Token", "Tag") and down(c.tags_table(tokens, layer).collect(), "AF", "Tag")
        assert down(c.dispersions_table(tokens, layer).collect(), "AF", "Token", "Tag")
        assert down(c.ngrams(tokens, 2, 0, layer).collect(), "AF", "Token_1", "Token_2")
    assert down(c.clusters_by_token(tokens, "t", 1, 2, "contains").collect(), "AF", "Token_1", "Token_2")
    assert down(c.coll_table(tokens, "the", 2, 2).collect(), "MI", "Token", "Tag")
    rows = [r[0] for r in c.kwic_center_node(tokens, "the").collect()]
    assert rows == sorted(rows) and len(rows) == 3
    target, reference = (c.frequency_table(tokens.where(F.col("doc_id") == d)) for d in ("d1", "d2"))
    assert down(c.keyness_table(target, reference, threshold=1.1).collect(), "LL", "Token", "Tag")
