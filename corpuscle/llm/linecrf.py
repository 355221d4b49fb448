"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Features of a line are shares of kinds of bytes, lengths and repetition, those of both
neighbours, and their squares; transitions are learnt. The field is trained by gradient ascent on lines of a bounded
sample of labelled documents, whose lines take the label of their document. A document's quality is the mean of its
lines' marginals of being good (forward-backward), weighted by their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.kernels import BASE, U, Words, blocks, mix, texts
from corpuscle.plans.runtime import ship

#: Labelled documents that the field is trained on, at most.
TRAIN_DOCS = 3000
THRESHOLD = 0.5

_KINDS = 9
_KIND = np.zeros((256, _KINDS), np.float32)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz"), 0] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1] = 1
_KIND[list(b"0123456789"), 2] = 1
_KIND[list(b" \t"), 3] = 1
_KIND[list(b".,;:"), 4] = 1
_KIND[list(b"!?"), 5] = 1
_KIND[list(b"|"), 6] = 1
_KIND[list(b"#$%&*+/<=>@[\\]^_`{}~"), 7] = 1
_KIND[128:, 8] = 1
_CODE = np.where(_KIND.any(axis=1), _KIND.argmax(axis=1), _KINDS).astype(np.uint8)


class Lines:
    """Lines of a block: their rows, lengths in bytes, and features. Lines of white space alone are left out."""

    def __init__(self, strings: pa.Array):
        found = Words(strings, lower=False)
        body, bounds = found.body, found.bounds
        n = len(body)
        breaks = np.flatnonzero(body == 10)
        starts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
        starts = starts[starts < n]
        ends = np.append(starts[1:], n)
        ends = ends - ((ends > starts) & (body[ends - 1] == 10)) if n else ends
        code = _CODE[body]
        size = (ends - starts).astype(np.float64)
        counts = np.empty((len(starts), _KINDS), np.float64)
        for k in range(_KINDS):
            total = np.concatenate([[0], np.cumsum(code == k, dtype=np.int64)])
            counts[:, k] = total[ends] - total[starts]
        keep = size - counts[:, 3] > 0
        starts, ends, size, counts = starts[keep], ends[keep], size[keep], counts[keep]
        self.row = np.searchsorted(bounds, starts, side="right") - 1
        self.size = size
        self.first = np.searchsorted(self.row, np.arange(len(bounds)))
        # Repetition: whether an earlier line of the document has the same words, and words that equal the one before.
        h = found.hashes()
        line = np.searchsorted(starts, found.starts, side="right") - 1
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        words = np.bincount(line, minlength=len(starts)).astype(np.float64)
        stutter = np.bincount(line, weights=again, minlength=len(starts)) / np.maximum(words, 1)
        with np.errstate(over="ignore"):
            place = (np.arange(len(h)) - np.searchsorted(line, line)).astype(np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + place * U(BASE)))])
            ends_ = np.cumsum(words).astype(np.int64)
            key = mix(sums[ends_] - sums[ends_ - words.astype(np.int64)] + self.row.astype(np.uint64) * U(BASE))
        repeated = (words > 0).astype(np.float64)
        repeated[np.unique(key, return_index=True)[1]] = 0
        words = np.maximum(words, 1)
        letters = counts[:, 0] + counts[:, 1] + counts[:, 8]
        share = counts / np.maximum(size, 1)[:, None]
        self.own = np.column_stack(
            [
                share,
                counts[:, 1] / np.maximum(letters, 1),
                np.minimum(np.log1p(size) / 8, 2),
                np.minimum(size / words / 12, 3),
                repeated,
                stutter,
                np.minimum((counts[:, 5] + counts[:, 6] + counts[:, 7]) / words, 3),
                np.minimum(counts[:, 4] / words, 2),
            ]
        )
        self.width = self.own.shape[1]

    def features(self) -> np.ndarray:
        """Own features and their squares, those of the lines before and after (0 beyond the document), and 1."""
        own = self.own
        before, after = np.zeros_like(own), np.zeros_like(own)
        if len(own) > 1:
            same = (self.row[1:] == self.row[:-1])[:, None]
            before[1:], after[:-1] = own[:-1] * same, own[1:] * same
        return np.column_stack([own, own * own, before, after, np.ones(len(own))])


def marginals(emission: np.ndarray, transition: np.ndarray, first: np.ndarray, count: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and, if count, the sum of expected transitions; emission: scores of good less bad."""
    n = len(emission)
    lengths = np.diff(first)
    docs = np.argsort(-lengths, kind="stable")
    docs = docs[lengths[docs] > 0]
    starts, lengths = first[:-1][docs], lengths[docs]
    e = np.column_stack([np.zeros(n), emission])
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    norm = lambda x: x - np.logaddexp(x[:, 0], x[:, 1])[:, None]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left") if longest else []
    step = lambda x, t: np.column_stack([np.logaddexp(x[:, 0] + t[0, k], x[:, 1] + t[1, k]) for k in (0, 1)])
    for t in range(longest):
        at = starts[: active[t]] + t
        alpha[at] = norm(e[at] if t == 0 else e[at] + step(alpha[at - 1], transition))
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = e[at + 1] + beta[at + 1]
        beta[at] = norm(step(ahead, transition.T))
        if not count:
            continue
        joint = alpha[at][:, :, None] + transition[None] + ahead[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = norm(alpha + beta)
    return np.exp(p[:, 1]), pairs


class LineField:
    """Weights of the features for good against bad, and scores of transitions."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray):
        self.weights, self.transition = weights, transition

    @staticmethod
    def train(strings: pa.Array, labels: np.ndarray, rounds: int = 80, rate: float = 0.3, ridge: float = 1e-4) -> "LineField":
        """Penalised maximum likelihood by full-batch Adam."""
        parts = [(a, Lines(strings.slice(a, b - a))) for a, b in blocks(strings)]
        row = np.concatenate([p.row + a for a, p in parts])
        first = np.searchsorted(row, np.arange(len(strings) + 1))
        x, y = np.concatenate([p.features() for _, p in parts]), labels[row].astype(np.float64)
        weights, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
        n = max(1, len(y))
        same = (row[1:] == row[:-1]) if n > 1 else np.zeros(0, bool)
        seen = np.zeros((2, 2))
        a, b = y[:-1][same].astype(int), y[1:][same].astype(int)
        np.add.at(seen, (a, b), 1)
        moment, square = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
        for r in range(1, rounds + 1):
            p, pairs = marginals(x @ weights, transition, first, True)
            slope = np.concatenate([x.T @ (y - p) / n - ridge * weights, (seen - pairs).ravel() / n - ridge * transition.ravel()])
            moment = 0.9 * moment + 0.1 * slope
            square = 0.99 * square + 0.01 * slope * slope
            move = rate * (moment / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.99**r)) + 1e-8) / (1 + r / 60)
            weights, transition = weights + move[:-4], transition + move[-4:].reshape(2, 2)
        return LineField(weights, transition)

    def score(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quality of each text (NaN without lines), its number of lines, and how many of them are good."""
        lines = Lines(strings)
        p, _ = marginals(lines.features() @ self.weights, self.transition, lines.first)
        first = lines.first
        total = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[first])
        n = np.diff(first)
        with np.errstate(invalid="ignore", divide="ignore"):
            quality = np.where(n > 0, total(p * lines.size) / total(lines.size), np.nan)
        return quality, n, np.rint(total(p >= 0.5)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> LineField | None:
    """A field from at most train_docs documents of quality 0 or 1; None if one of the labels has none among them.

    Those of the least hashes of doc_id are taken: the same ones at each run, from all parts of the table, and both
    labels in the proportion that they have.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__quality")).distinct()
    sample = known.orderBy(F.xxhash64("__id"), "__quality").limit(train_docs)
    some = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text")).join(F.broadcast(sample), "__id").where("length(__text) > 0")
    found = some.select("__text", "__quality").orderBy("__quality", F.xxhash64("__text")).toArrow()
    y = found["__quality"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    return LineField.train(found["__text"].combine_chunks(), y)


def _apply(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            column = texts(batch)
            for a, b in blocks(column):
                if field is None:
                    n = b - a
                    quality, lines, good = np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, np.int64)
                else:
                    quality, lines, good = field.score(column.slice(a, b - a))
                rest = batch.slice(a, b - a)
                extra = [pa.array(np.round(quality, 6), mask=np.isnan(quality)), pa.array(lines.astype(np.int64)), pa.array(good)]
                yield pa.RecordBatch.from_arrays([*rest.columns, *extra], names=[*rest.schema.names, "__quality", "__lines", "__good"])

    return run


def score(docs: DataFrame, field: LineField | None) -> DataFrame:
    """docs with __quality (0 to 1, null for a text without lines or without a field), __lines and __good (lines)."""
    spark = ship(docs.sparkSession)
    from pyspark.sql.types import DoubleType, LongType, StructType

    docs = docs.drop("__quality", "__lines", "__good")
    schema = StructType([*docs.schema.fields]).add("__quality", DoubleType()).add("__lines", LongType()).add("__good", LongType())
    return docs.mapInArrow(_apply(spark.sparkContext.broadcast(field)), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, quality, n_lines, n_good, keep) for each row of docs; keep: quality is threshold or more.

    A null, empty or blank text has a null quality and isn't kept. Without labelled documents of both kinds there is no
    field: quality is null and every text with a letter is kept. Repeated rows score alike; a null doc_id stays null; labels
    of ids that docs lacks are ignored, and a doc_id with both labels counts once for each. Other columns don't matter.
    """
    field = fit(docs, labels, train_docs)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), field)
    keep = F.coalesce(F.col("__quality") >= threshold, F.lit(False)) if field else F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))
    return scored.select("doc_id", F.col("__quality").alias("quality"), F.col("__lines").alias("n_lines"), F.col("__good").alias("n_good"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs that classify() keeps, with their own columns."""
    field = fit(docs, labels, train_docs)
    if field is None:
        return docs.where("length(trim(text)) > 0")
    return score(docs, field).where(F.col("__quality") >= threshold).drop("__quality", "__lines", "__good")
