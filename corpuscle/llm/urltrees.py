"""URL filters: gradient-boosted trees on lexical features.

Features are lengths, depth, shares of digits and signs, entropy, numbers of parameters and labels, and statistics of
the host's suffixes over all URLs (how many URLs and how long paths they have). The trees are trained here, on a
bounded sample of labelled URLs, with the logistic loss and Newton leaves on histograms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.kernels import blocks, raw, texts
from corpuscle.plans.runtime import ship

TRAIN_URLS = 20_000
THRESHOLD = 0.5
FEATURES = ["length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens_in_host", "digits_in_host", "signs", "secure", "fragment", "longest_word", "suffix_urls", "suffix_depth", "domain_urls", "domain_depth"]


class Trees:
    """Boosted trees of a fixed depth; nodes in heap order, leaves after them."""

    def __init__(self, bias: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.bias, self.feature, self.cut, self.leaf = bias, feature, cut, leaf

    @staticmethod
    def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> "Trees":
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        bias = float(np.log(p0 / (1 - p0)))
        margin = np.full(n, bias)
        inner, leaves = (1 << depth) - 1, 1 << depth
        feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for d in range(depth):
                first, count = (1 << d) - 1, 1 << d
                local = node - first
                best = np.full(count, 1e-9)
                total_g, total_h = np.bincount(local, g, count), np.bincount(local, h, count)
                for f in range(width):
                    if not len(cuts[f]):
                        continue
                    at = local * (bins + 1) + binned[:, f]
                    left_g = np.bincount(at, g, count * (bins + 1)).reshape(count, -1).cumsum(axis=1)[:, : len(cuts[f])]
                    left_h = np.bincount(at, h, count * (bins + 1)).reshape(count, -1).cumsum(axis=1)[:, : len(cuts[f])]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                    gain[(left_h < least) | (right_h < least)] = -1
                    k = gain.argmax(axis=1)
                    value = gain[np.arange(count), k]
                    better = value > best
                    best[better] = value[better]
                    feature[t, first : first + count][better] = f
                    cut[t, first : first + count][better] = cuts[f][k[better]]
                node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
            at = node - inner
            leaf[t] = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
            margin += leaf[t, at]
        return Trees(bias, feature, cut, leaf)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - inner]
        return 1 / (1 + np.exp(-margin))


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def lexical(urls: pa.Array) -> np.ndarray:
    """The first 13 features of each URL, from its bytes."""
    body, bounds = raw(urls)
    n, size = len(urls), np.diff(bounds).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    at = np.arange(len(body)) - bounds[:-1][row]
    count = lambda mask: np.bincount(row[mask], minlength=n).astype(np.float64)
    # The host begins after the first //, if that follows a colon, and ends before the next / ? or #.
    pair = np.zeros(len(body), bool)
    pair[2:] = (body[2:] == 47) & (body[1:-1] == 47) & (body[:-2] == 58) & (row[2:] == row[:-2])
    begin = np.full(n, 1 << 40, np.int64)
    np.minimum.at(begin, row[pair], at[pair] + 1)
    none = begin == 1 << 40
    begin[none] = 0
    stop = (body == 47) | (body == 63) | (body == 35)
    after = stop & (at >= begin[row])
    end = np.diff(bounds)
    np.minimum.at(end, row[after], at[after])
    end[none] = 0
    in_host = (at >= begin[row]) & (at < end[row])
    digit = (body >= 48) & (body <= 57)
    letter = ((body | 32) >= 97) & ((body | 32) <= 122)
    query = body == 63
    counts = np.bincount(row * 256 + body, minlength=n * 256).reshape(n, 256).astype(np.float64)
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    run = np.zeros(len(body) + 1, np.int64)
    breaks = ~letter | (at == 0)
    last = np.maximum.accumulate(np.where(breaks, np.arange(len(body)), 0)) if len(body) else np.zeros(0, np.int64)
    run = np.where(letter, np.arange(len(body)) - last + ((at == 0) | letter[last]), 0)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, run)
    secure = np.zeros(n)
    some = np.flatnonzero(size >= 5)
    secure[some] = (body[bounds[:-1][some] + 4] | 32) == ord("s")
    return np.column_stack(
        [size, end - begin, count(after & (body == 47)), count(digit) / np.maximum(size, 1), entropy, count((query | (body == 38)) & ~in_host), count(in_host & (body == 46)) + 1, count(in_host & (body == 45)), count(in_host & digit), count(~digit & ~letter & ~stop & (body != 46) & (body != 58)), secure, count(body == 35), longest]
    )


def _depth(url: Column) -> Column:
    """The slashes from the host on, as lexical() has them: statistics of suffixes need no Python."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(url)
    return (F.length(rest) - F.length(F.translate(rest, "/", ""))).cast("double")


#: What goes along with each URL to the features.
STATISTICS = FEATURES[13:]


def with_statistics(urls: DataFrame) -> DataFrame:
    """(page_id, url, host, STATISTICS) of urls (page_id, url): of the last label of the host, and of its last three (the domain),
    log1p of the number of URLs, and the mean depth of their paths, over all rows of urls."""
    x = urls.select("page_id", F.col("url").cast("string").alias("url"))
    x = x.withColumn("host", F.coalesce(host(F.col("url")), F.lit("")))
    x = x.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -3), "depth": _depth(F.coalesce("url", F.lit("")))})
    # Domains are summed once, and the few suffixes from their sums. Which side of a join is sent is for the planner, by sizes.
    domains = x.groupBy("suffix", "domain").agg(F.count("*").alias("n"), F.sum("depth").alias("slashes"))
    out = x.drop("depth")
    for name in ("suffix", "domain"):
        sums = domains.groupBy(name).agg(F.sum("n").cast("double").alias("n"), F.sum("slashes").alias("slashes"))
        out = out.join(sums.select(name, F.log1p("n").alias(f"{name}_urls"), F.round(F.col("slashes") / F.col("n"), 9).alias(f"{name}_depth")), name)
    return out.select("page_id", "url", "host", *STATISTICS)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """All features of the batch's rows."""
    x = lexical(texts(batch, "url"))
    return np.column_stack([x, *(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in STATISTICS)])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in blocks(texts(batch, "url"), 200_000):
            yield batch.slice(a, b - a)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        x = _matrix(batch)
        rest = [batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names if c not in STATISTICS]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=[*(c for c in batch.schema.names if c not in STATISTICS), *FEATURES])


def features(urls: DataFrame) -> DataFrame:
    """(page_id, url, host, FEATURES) for each row of urls; see with_statistics()."""
    ship(urls.sparkSession)
    return _featured(with_statistics(urls))


def _featured(x: DataFrame) -> DataFrame:
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([f for f in x.schema.fields if f.name not in STATISTICS])
    for name in FEATURES:
        schema = schema.add(name, DoubleType())
    return x.mapInArrow(_features, schema)


def sample(labels: DataFrame, train_urls: int = TRAIN_URLS) -> DataFrame:
    """At most train_urls rows of labels (url, label: 0 or 1), those of the least hashes: (url, __y), one row a URL. A URL with
    both labels counts as 1."""
    known = labels.select(F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("__y")).where("url IS NOT NULL AND __y IN (0, 1)")
    return known.groupBy("url").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("url"), "url").limit(train_urls)


def fit(x: DataFrame, labels: DataFrame, train_urls: int = TRAIN_URLS) -> Trees | None:
    """Trees from sample() of labels, with the statistics of x (with_statistics()); None without both labels.

    URLs that x doesn't have don't count. A URL that x has often is one row.
    """
    chosen = sample(labels, train_urls)  # at most train_urls rows: a bounded side to broadcast
    rows = x.drop("page_id").join(F.broadcast(chosen), "url").dropDuplicates(["url"])
    found = _featured(rows).orderBy(F.xxhash64("url"), "url").select(*FEATURES, "__y").toArrow()
    data = np.column_stack([found[c].to_numpy() for c in found.column_names]) if len(found) else np.zeros((0, len(FEATURES) + 1))
    if len(set(data[:, -1].tolist())) < 2:
        return None
    return Trees.train(data[:, :-1], data[:, -1])


def _apply(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in _pieces(batches):
            column = texts(batch, "url")
            score = np.full(batch.num_rows, np.nan) if trees is None else np.round(trees.score(_matrix(batch)), 6)
            blank = column.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("page_id")), column, pa.array(score, mask=blank | np.isnan(score))], names=["page_id", "url", "score"])

    return run


def filter_urls(pages: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_urls: int = TRAIN_URLS) -> DataFrame:
    """(page_id, url, score, blocked) for each row of pages (page_id, url): the score of the trees, blocked from threshold on.

    labels (url, label): 1 for URLs that are to be blocked, 0 for others; other labels and null URLs don't count, and of a URL with
    both 1 does. A null URL has a null score and isn't blocked; without URLs of both labels among pages no URL has a score. An
    empty URL, or one without a host, scores by what it has. Repeated rows score alike, and count each in the statistics of
    suffixes. An empty table gives no rows. Other columns of pages and labels don't matter, whatever their names.
    """
    spark = ship(pages.sparkSession)
    x = with_statistics(pages)
    trees = fit(x, labels, train_urls)
    page_id = pages.schema["page_id"].dataType.simpleString()
    scored = x.select("page_id", "url", *STATISTICS).mapInArrow(_apply(spark.sparkContext.broadcast(trees)), f"page_id {page_id}, url string, score double")
    return scored.withColumn("blocked", F.coalesce(F.col("score") >= threshold, F.lit(False)))
