"""Lexical features against plain Python, trees against held-out labels."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuscle.llm import urltrees


def plain(url):
    begin = url.find("://")
    begin = begin + 3 if begin >= 0 else None
    rest = url[begin:] if begin is not None else ""
    host = rest[: next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))]
    counts = Counter(url)
    entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in counts.values())
    path = rest[len(host) :] if begin is not None else url
    longest = max((len(w) for w in "".join(c if c.isascii() and c.isalpha() else " " for c in url).split()), default=0)
    return {"length": len(url), "host_length": len(host), "depth": path.count("/"), "digit_ratio": sum(c.isdigit() for c in url) / len(url), "entropy": entropy, "parameters": path.count("?") + path.count("&"), "labels": host.count(".") + 1, "hyphens_in_host": host.count("-"), "digits_in_host": sum(c.isdigit() for c in host), "secure": float(url[4:5].lower() == "s"), "fragment": url.count("#"), "longest_word": longest}


URLS = ["https://a-b.example.org/x/y/z.html?p=1&q=22#top", "http://h0st.site.com", "https://www.site.co.uk/aaa/1234567890", "ftp://x.y/?a=b", "http://a.b.c.d/eee//f", "https://q.io/?x#y"]


def test_features():
    x = urltrees.lexical(pa.array(URLS))
    for row, url in zip(x, URLS):
        for name, value in plain(url).items():
            assert abs(row[urltrees.FEATURES.index(name)] - value) < 1e-9, (url, name)


def test_suffix_statistics_are_over_all_rows(spark):
    df = spark.createDataFrame(list(enumerate(URLS + URLS)), "page_id long, url string")
    for r in urltrees.features(df).collect():
        suffix, domain = r["host"].split(".")[-1], ".".join(r["host"].split(".")[-3:])
        hosts = [u.split("://")[1].split("/")[0].split("?")[0] for u in URLS + URLS]
        assert abs(r["suffix_urls"] - math.log1p(sum(h.split(".")[-1] == suffix for h in hosts))) < 1e-9
        assert abs(r["domain_urls"] - math.log1p(sum(".".join(h.split(".")[-3:]) == domain for h in hosts))) < 1e-9


def made(n, seed):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad = bool(r.integers(0, 2))
        path = "/".join("".join(r.choice(list("0123456789" if bad else "abcdefgh"), 8)) for _ in range(int(r.integers(1, 4))))
        rows.append((i, f"https://host{i % 50}.example.{'biz' if bad else 'org'}/{path}" + ("?a=1&b=2" if bad and i % 2 else ""), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(1200, 3)
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = df.where("page_id < 600").select("url", F.col("url").contains(".biz/").cast("int").alias("label"))
    got = {r["page_id"]: r["blocked"] for r in urltrees.filter_urls(df, labels).collect()}
    assert sum(got[i] == bool(y) for i, _, y in rows[600:]) >= 0.97 * 600


def test_trees_fit_an_interaction():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = urltrees.Trees.train(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93


def test_odd_rows(spark):
    rows = made(60, 5) + [(100, None, 0), (101, "", 0), (102, "no host", 0), (None, "https://x.biz/1", 0), (103, "https://x.biz/" + "9" * 300_000, 0), (104, "http://käse.de/ö", 0)]
    df = spark.createDataFrame([(*r[:2], "clash") for r in rows + rows[:5]], "page_id long, url string, score string")
    labels = df.where("page_id < 60").select("url", F.col("url").contains(".biz/").cast("int").alias("label"), F.lit(1).alias("page_id"))
    labels = labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1, 1), ("https://x.org", 7, 1)], labels.schema))
    got = urltrees.filter_urls(df, labels).collect()
    assert len(got) == len(rows) + 5
    by = {r["page_id"]: r for r in got}
    assert by[100]["score"] is None and not by[100]["blocked"]
    assert all(by[k]["score"] is not None for k in (101, 102, 103, 104, None))


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "https://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, label int")
    assert [tuple(r) for r in urltrees.filter_urls(df, none).collect()] == [(1, "https://a.org/x", None, False)]
    assert urltrees.filter_urls(df.where("false"), none).count() == 0


def test_statistics_and_signs_against_plain_code(spark):
    urls = URLS + ["no host/a/b", "", "http://q.io//a//b?c=d/e"]
    df = spark.createDataFrame(list(enumerate(urls + URLS)), "page_id long, url string")
    rows = {r["page_id"]: r for r in urltrees.features(df).collect()}
    hosts = lambda u: u.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0] if "://" in u else ""
    slashes = lambda u: (u.split("://", 1)[1] if "://" in u else u).count("/")
    for k, n in (("suffix", 1), ("domain", 3)):
        part = lambda u: ".".join(hosts(u).split(".")[-n:])
        for i, u in enumerate(urls + URLS):
            own = [slashes(x) for x in urls + URLS if part(x) == part(u)]
            assert abs(rows[i][f"{k}_depth"] - sum(own) / len(own)) < 1e-6 and abs(rows[i][f"{k}_urls"] - math.log1p(len(own))) < 1e-9
            assert rows[i]["depth"] == slashes(u)
            assert rows[i]["signs"] == sum(not (c.isascii() and c.isalnum()) and c not in "/?#.:" for c in u)


def plain_best(x, g, h, bins, ridge, least):
    """The best split of one node by trying all cuts of all features."""
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])):
            left = x[:, f] <= c
            if h[left].sum() < least or h[~left].sum() < least:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + ridge) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + ridge)
            if gain > best[0] + 1e-12:
                best = (gain, f, c)
    return best


def test_growing_and_scoring_against_plain_code():
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(400, 3)), 2)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float)
    one = urltrees.Trees.train(x, y, trees=1, depth=2, bins=16)
    p0 = y.mean()
    g, h = y - p0, np.full(len(y), p0 * (1 - p0))
    _, f, c = plain_best(x, g, h, 16, 1.0, 1.0)
    assert (one.feature[0, 0], one.cut[0, 0]) == (f, c)
    sides = [x[:, f] <= c, x[:, f] > c]
    scores = np.empty(len(x))
    for k, side in enumerate(sides):
        own = x[side]
        best, f2, c2 = None, None, np.inf
        gains = {}
        for f_ in range(3):
            for c_ in np.unique(np.quantile(x[:, f_], np.linspace(0, 1, 17)[1:-1])):
                left = own[:, f_] <= c_
                if h[side][left].sum() >= 1 and h[side][~left].sum() >= 1:
                    gains[f_, c_] = sum(g[side][m].sum() ** 2 / (h[side][m].sum() + 1) for m in (left, ~left)) - g[side].sum() ** 2 / (h[side].sum() + 1)
        at = one.feature[0, 1 + k], one.cut[0, 1 + k]
        assert abs(gains[at] - max(gains.values())) < 1e-9
        for m in (own[:, at[0]] <= at[1], own[:, at[0]] > at[1]):
            rows = np.flatnonzero(side)[m]
            scores[rows] = np.log(p0 / (1 - p0)) + 0.2 * g[rows].sum() / (h[rows].sum() + 1)
    assert np.allclose(one.score(x), 1 / (1 + np.exp(-scores)))
