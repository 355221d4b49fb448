"""Scores against a plain count of all n-grams."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from corpuscle.llm import backoff


def words(t):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def plain(texts, alpha=0.4):
    docs = [words(t) for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [sum((grams(d, n) for d in docs), Counter()) for n in (1, 2, 3)]
    everything = sum(map(len, docs))
    out = []
    for d in docs:
        c = [total[n - 1] - grams(d, n) for n in (1, 2, 3)]
        score, tri, bi = 0.0, 0, 0
        for i, w in enumerate(d):
            if i > 1 and c[2][(d[i - 2], d[i - 1], w)] > 0:
                p, tri = c[2][(d[i - 2], d[i - 1], w)] / c[1][(d[i - 2], d[i - 1])], tri + 1
            elif i > 0 and c[1][(d[i - 1], w)] > 0:
                p, bi = (alpha if i > 1 else 1) * c[1][(d[i - 1], w)] / c[0][(d[i - 1],)], bi + 1
            else:
                p = (alpha if i > 1 else 1) * (alpha if i > 0 else 1) * max(c[0][(w,)], 1) / max(everything - len(d), 1)
            score += math.log10(p)
        out.append((len(d), tri, bi, score if d else None))
    return out


@pytest.mark.parametrize(("batch", "stable"), [(40, False), (40, True), (1_500_000, True)])
def test_against_plain_counts(spark, monkeypatch, batch, stable):
    monkeypatch.setattr(backoff, "BATCH_WORDS", batch)
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(list("abcdefgh"), int(r.integers(0, 60)))) for _ in range(60)]
    texts += [None, "", "!!", "unique words alone", texts[0], "Ä ä ß", "one", "one two"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in backoff.score_documents(df, stable=stable).collect()}
    assert len(got) == len(texts)
    for i, (n, tri, bi, score) in enumerate(plain(texts)):
        assert (got[i]["n_words"], got[i]["n_trigram"], got[i]["n_bigram"]) == (n, tri, bi)
        if score is None:
            assert got[i]["log10_score"] is None and got[i]["mean_log10"] is None
        else:
            assert abs(got[i]["log10_score"] - score) < 1e-3


def test_odd_rows(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "x " * 200_000)]
    got = backoff.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_trigram"]) for r in got) == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (2, 200_000, 0)]
    assert backoff.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
