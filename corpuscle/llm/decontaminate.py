"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton (over word hashes) is built on the driver. Training texts stream past it: the longest match that ends at
each word is tracked, and words of matches beyond a limit are removed. Only stretches in which every window of as
many words as the lowest limit occurs in some item can hold such a match; they are found by vectorised hashing, and
the automaton walks through them alone. Nothing is lost thereby, as each match beyond a limit lies in one such stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.kernels import Words, blocks, texts
from corpuscle.plans.runtime import cut, ship

#: A match of so many words is removed, or one of this part of an item's words, FLOOR at least.
LENGTH = 13
COVERAGE = 0.6
FLOOR = 6
#: Words of test items in one broadcast. More items are screened in several passes, each with a part of them.
BROADCAST_WORDS = 600_000
#: Words of test items in one automaton (about 400 bytes each); more make several automata, which texts pass in turn.
AUTOMATON_WORDS = 200_000


def limit(words: int, length: int = LENGTH, coverage: float = COVERAGE, floor: int = FLOOR) -> int:
    """Words that a match with an item of so many words must have to be removed."""
    return max(floor, min(length, int(np.ceil(round(coverage * words, 9)))))


class Automaton:
    """The suffix automaton of several sequences (Blumer et al.): next, link and length of each state.

    For each state, need is the least limit of the items that its strings occur in, and good the longest of the suffixes
    at its link or further on that reaches its own limit.
    """

    def __init__(self, items: list[tuple[list[int], int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.need = [-1], [0], [1 << 30]
        for words, need in items:
            last = 0
            for w in words:
                last = self._add(last, w)
                self.need[last] = min(self.need[last], need)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for v in reversed(order):
            self.need[self.link[v]] = min(self.need[self.link[v]], self.need[v])
        self.good = [0] * len(self.link)
        for v in order:
            self.good[v] = self.length[v] if self.length[v] >= self.need[v] else self.good[self.link[v]]

    def _new(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.need.append(1 << 30)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier item has this string
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word, the length of the longest match that ends there, and of the longest that is to be removed."""
        v = m = 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                m = self.length[v]
            to = self.next[v].get(w)
            v, m = (to, m + 1) if to is not None else (0, 0)
            yield m, (m if m >= self.need[v] else self.good[self.link[v]] if v else 0)


class Screen:
    """Automata over all test items, with the hashes of their windows of the least limit's length."""

    def __init__(self, items: pa.Array, length: int = LENGTH, coverage: float = COVERAGE, floor: int = FLOOR, window: int | None = None):
        """window: the least limit of all items, where these are a part of them."""
        w = Words(items)
        h = w.hashes()
        each = [(h[a:b].tolist(), limit(b - a, length, coverage, floor)) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()) if b - a >= floor]
        self.window = min((need for _, need in each), default=0) if window is None or not each else window
        g = w.grams(h, self.window) if self.window else h[:0]
        self.grams = np.unique(g[w.valid(self.window)]) if self.window else g
        self.automata, part, size = [], [], 0
        for words, need in each:
            if size + len(words) > AUTOMATON_WORDS and part:
                self.automata.append(Automaton(part))
                part, size = [], 0
            part.append((words, need))
            size += len(words)
        if part:
            self.automata.append(Automaton(part))
        # Most windows are rejected by one look into a table of 16 bits of their hashes.
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def removed(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of a block's words, which are removed, and the longest match (of the window's length at least) of each row."""
        gone, longest = np.zeros(len(w), bool), np.zeros(len(w.counts), np.int64)
        if not self.window or not len(w):
            return gone, longest
        h = w.hashes()
        g = w.grams(h, self.window)
        at = np.flatnonzero(self.table[(g >> np.uint64(42)).astype(np.int64)] & w.valid(self.window))
        at = at[np.isin(g[at], self.grams)]
        if not len(at):
            return gone, longest
        row = w.row[at]
        new = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0)) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(at)]):
            a, b = int(at[lo]), int(at[hi - 1]) + self.window
            words = h[a:b].tolist()
            for automaton in self.automata:
                for i, (m, cut) in enumerate(automaton.walk(words)):
                    if m >= self.window and m > longest[row[lo]]:
                        longest[row[lo]] = m
                    if cut:
                        gone[a + i + 1 - cut : a + i + 1] = True
        return gone, longest


def _without(part: pa.Array, gone: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without the words that are gone, and of each its spans and words that were removed."""
    n = len(part)
    spans, words = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not gone.any():
        return part, spans, words
    plain = Words(part, lower=False)  # as many words, but the bytes are those of the text itself
    out = {}
    for i in np.unique(plain.row[gone]).tolist():
        lo, hi = int(plain.first[i]), int(plain.first[i + 1])
        edge = np.diff(np.concatenate([[0], gone[lo:hi].astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo - 1
        spans[i], words[i] = len(begins), int(gone[lo:hi].sum())
        at, pieces = int(plain.bounds[i]), []
        for s, e in zip(plain.starts[begins].tolist(), plain.ends[ends].tolist()):
            pieces.append(plain.body[at:s].tobytes())
            at = e
        pieces.append(plain.body[at : int(plain.bounds[i + 1])].tobytes())
        out[i] = b"".join(pieces).decode()
    values = part.to_pylist()
    for i, t in out.items():
        values[i] = t
    return pa.array(values, pa.string()), spans, words


_ADDED = ("__spans", "__words", "__longest")


def _clean(screen, last: bool):
    """A pass of texts through a part of the items. Passes before the last hand on what is __gone (bits of a text's words) and
    the __longest match; the last removes the words of all passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = screen.value
        for batch in batches:
            column = texts(batch)
            names = [c for c in batch.schema.names if c not in ("__gone", "__longest")]
            earlier = batch.schema.get_field_index("__gone")
            for a, b in blocks(column):
                part, rest = column.slice(a, b - a), batch.slice(a, b - a)
                w = Words(part)
                gone, longest = items.removed(w)
                if earlier >= 0:
                    longest = np.maximum(longest, rest.column(rest.schema.get_field_index("__longest")).to_numpy())
                    for i, bits in enumerate(rest.column(earlier).to_pylist()):
                        if bits:
                            lo, hi = int(w.first[i]), int(w.first[i + 1])
                            gone[lo:hi] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
                columns = {c: rest.column(rest.schema.get_field_index(c)) for c in names}
                if last:
                    columns["text"], spans, words = _without(part, gone)
                    columns |= {"__spans": pa.array(spans), "__words": pa.array(words)}
                else:
                    rows = [gone[lo:hi] for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
                    columns["__gone"] = pa.array([np.packbits(x).tobytes() if x.any() else None for x in rows], pa.binary())
                columns["__longest"] = pa.array(longest)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _screens(spark: SparkSession, items: DataFrame, text: str, broadcast_words: int, **limits) -> Iterator:
    """Automata over all items, broadcast; parts of them by hash, where they have more words than one broadcast may hold (some 400
    bytes each). A part is made when it is asked for."""
    distinct = items.select(F.col(text).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    sized = distinct.select("t", F.regexp_count("t", F.lit("[A-Za-z0-9\\x{80}-\\x{10FFFF}]+")).alias("n")).where(F.col("n") >= limits.get("floor", FLOOR))
    words, least = sized.agg(F.sum("n"), F.min("n")).first()
    parts = max(1, -(-(words or 0) // broadcast_words))
    window = limit(least, **limits) if least else None
    for k in range(parts):
        own = sized.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k) if parts > 1 else sized
        yield spark.sparkContext.broadcast(Screen(pa.array([r["t"] for r in own.select("t").toLocalIterator()], pa.string()), window=window, **limits)), k + 1 == parts


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", broadcast_words: int = BROADCAST_WORDS, **limits) -> DataFrame:
    """All rows and columns of docs (with text: STRING), text without the words that match items, and three counts.

    __spans removed, the __words in them, and the __longest match in words (0 if it is shorter than any limit). Text is
    removed from the first letter of a span to the last; what is between words elsewhere stays. A match counts within
    one item; words are compared in lower case, without what is between them. An item of fewer than floor words never
    matches; null and repeated items don't matter. A null text stays null; empty texts and tables, repeated rows and null ids are
    fine. Columns of docs that are called __spans, __words, __longest or __gone are replaced or dropped.

    Items are counted first: up to broadcast_words words, they are one broadcast and texts pass once, in one stage. More are
    parted by hash, and texts pass each part in turn as they are; what any of them marks is removed by the last.
    """
    from pyspark.sql.types import BinaryType, LongType, StructType

    spark = ship(docs.sparkSession)
    docs = docs.drop(*_ADDED, "__gone")
    plain = StructType([*docs.schema.fields])
    for screen, last in _screens(spark, items, text, broadcast_words, **limits):
        if last:
            return docs.mapInArrow(_clean(screen, True), StructType([*plain.fields]).add("__spans", LongType()).add("__words", LongType()).add("__longest", LongType()))
        # Cut, so that no task holds the automata of two parts.
        docs = cut(docs.mapInArrow(_clean(screen, False), StructType([*plain.fields]).add("__gone", BinaryType()).add("__longest", LongType())))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_spans, n_removed, longest_match, text) for each row of docs; see decontaminate()."""
    return decontaminate(docs.select("doc_id", F.col("text").cast("string").alias("text")), items).select("doc_id", F.col("__spans").alias("n_spans"), F.col("__words").alias("n_removed"), F.col("__longest").alias("longest_match"), "text")
