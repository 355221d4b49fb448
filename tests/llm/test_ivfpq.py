"""Neighbours by inverted lists and product quantisation against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import ivfpq

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], SCHEMA)


def brute(x, k):
    x = x.astype(np.float32).astype(np.float64)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return {i: sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))}, np.sqrt(d)


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour_id"], r["distance"]))
    return out


def test_recall_against_all_distances(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(20, 16))[r.integers(0, 20, 600)] + 0.4 * r.normal(size=(600, 16))
    expected, d = brute(x, 10)
    got = found(ivfpq.neighbours(table(spark, x)))
    assert sorted(got) == list(range(600))
    hits = sum(len({n for _, n, _ in got[i]} & set(expected[i])) for i in expected)
    assert hits >= 0.9 * 6000
    for i, rows in got.items():
        assert [k for k, _, _ in rows] == list(range(1, 11))
        assert all(abs(dist - d[i, n]) < 1e-5 for _, n, dist in rows)
        assert [dist for *_, dist in rows] == sorted(dist for *_, dist in rows)


def test_exact_with_all_lists_and_candidates(spark):
    x = np.random.default_rng(2).normal(size=(150, 6))
    expected, _ = brute(x, 5)
    got = found(ivfpq.neighbours(table(spark, x), k=5, probes=1000, candidates=1000))
    assert {i: [n for _, n, _ in rows] for i, rows in got.items()} == expected


def test_ties_and_equal_vectors(spark):
    x = np.array([[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [1, 0, 0, 0]], float)
    got = found(ivfpq.neighbours(table(spark, x), k=2))
    assert got[2] == [(1, 0, 0.0), (2, 1, 0.0)] and got[3] == [(1, 0, 1.0), (2, 1, 1.0)]


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [None, 1.0]), (7, []), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA + ", distance string, rank int")
    assert found(ivfpq.neighbours(df)) == {1: [(1, 2, pytest.approx(2**0.5))], 2: [(1, 1, pytest.approx(2**0.5))]}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])]])
def test_too_few(spark, rows):
    df = ivfpq.neighbours(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["vec_id", "rank", "neighbour_id", "distance"] and df.count() == 0


def test_queries_are_a_part_and_all_rows_are_searched(spark):
    x = np.random.default_rng(6).normal(size=(400, 8))
    expected, d = brute(x, 10)
    got = found(ivfpq.neighbours(table(spark, x), F.col("vec_id") % 20 == 0))
    assert sorted(got) == list(range(0, 400, 20))
    assert sum(len({n for _, n, _ in got[i]} & set(expected[i])) for i in got) >= 0.9 * 10 * len(got)
    assert {n % 20 for rows in got.values() for _, n, _ in rows} > {0}
    assert all(abs(dist - d[i, n]) < 1e-5 for i, rows in got.items() for _, n, dist in rows)
