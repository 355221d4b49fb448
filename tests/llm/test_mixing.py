"""Systematic sampling against a plain loop over each source."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from corpuscle.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long"


def plain(rows, weights, other, budget, seed):
    chars, out = defaultdict(int), defaultdict(int)
    for r in rows:
        chars[r[2]] += max(r[3] or 0, 0)
    w = {s: (weights.get(s, other) if chars[s] > 0 else 0.0) for s in chars}
    for s in chars:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        if not chars[s] or not sum(w.values()):
            continue
        e = int(np.floor(w[s] / sum(w.values()) * budget * sum(chars.values()) / chars[s] * mixing.UNIT))
        u = int(hashlib.md5(f"{seed}:{'' if s is None else '=' + s}".encode()).hexdigest()[:12], 16) % mixing.UNIT
        for k, r in enumerate(own, 1):
            n = (k * e + u) // mixing.UNIT - ((k - 1) * e + u) // mixing.UNIT
            if n:
                out[r[:3]] += n
    return dict(out)


def counted(df):
    out = defaultdict(int)
    for r in df.select("doc_id", "text", "source", "__copies", "__copy").collect():
        assert 1 <= r["__copy"] <= r["__copies"]
        out[tuple(r)[:3]] += 1
    return dict(out)


@pytest.mark.parametrize("range_rows, quantiles", [(30, 256), (20_000, 256), (2, 5), (30, 4)])
def test_against_a_plain_loop(spark, monkeypatch, range_rows, quantiles):
    monkeypatch.setattr(mixing, "QUANTILES", quantiles)
    r = np.random.default_rng(1)
    rows = [(int(i), f"t{i}", ["a", "b", "c", None][int(r.choice(4, p=[0.7, 0.2, 0.07, 0.03]))], int(r.integers(0, 500))) for i in r.permutation(700)]
    weights = {"a": 1.0, "b": 3.0, "zz": 9.0}
    df = spark.createDataFrame(rows, SCHEMA)
    got = counted(mixing.mix(df, weights, 0.5, 1.2, 7, range_rows))
    assert got == plain(rows, weights, 0.5, 1.2, 7)
    total = defaultdict(float)
    for (_, _, s), n in got.items():
        total[s] += n
    chars = {s: sum(x[3] for x in rows if x[2] == s) for s in ("a", "b", "c", None)}
    docs = {s: sum(x[2] == s for x in rows) for s in chars}
    w = {"a": 1.0, "b": 3.0, "c": 0.5, None: 0.5}
    for s in chars:
        assert abs(total[s] - docs[s] * w[s] / 5.0 * 1.2 * sum(chars.values()) / chars[s]) < 1.01


def test_odd_rows(spark):
    rows = [(None, None, "a", 10), (1, None, "a", None), (1, "x", "a", -5), (1, "x", "a", 10), (1, "x", "a", 10), (2, "", None, 30), (3, "z" * 300_000, "", 300_000), (4, "q", "none", 0)]
    df = spark.createDataFrame([(*r, 5, 1.5) for r in rows], SCHEMA + ", __copy int, extra double")
    out = mixing.mix(df, {}, 1.0, 1.0)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "extra", "__copies", "__copy"]
    assert counted(out) == plain(rows, {}, 1.0, 1.0, mixing.SEED)
    assert mixing.mix(df.where("false")).count() == 0
