"""A corpus that the built-in rules tag, kept as texts: operators read it in Python workers, and tokens never are rows.

Rows of tokens, sorted and windowed, take some hundred times the bytes of their texts. Here a worker turns slices of documents to
arrays of unit numbers (lexicon) and gives sums of many documents, or the few rows that are asked for. What it holds is bounded by a
slice, by the lexicon's MOST_PIECES and by MOST_GRAMS, whatever the size of the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuscle.functions.clean import clean_corpus, clean_text
from corpuscle.operators.lexicon import MOST_PIECES, SPACES, Docs, Lexicon, Run, Units, numbered
from corpuscle.operators.order import borders
from corpuscle.plans.runtime import ship
from corpuscle.validation import corpus as valid_corpus

#: The tag of rows that hold totals.
TOTAL = "\x00total"
#: Characters of the documents in a slice, about: one document at least.
SLICE_CHARS = 2_000_000
#: Different n-grams that a worker counts before it hands them on.
MOST_GRAMS = 200_000
#: N-grams are first counted by BUCKETS hashes of them, in PARTS rows a worker.
BUCKETS, PARTS = 1 << 21, 256
#: Of longer texts, so many characters at the beginning and the end are looked at for their first and last units.
END_CHARS = 400
#: Documents of more units have cells of their own in the second pass of dispersions.
LARGE_DOC = 100_000

ITEMS = "array<struct<token: string, tag: string>>"
_ITEM = pa.struct([("token", pa.string()), ("tag", pa.string())])


class Texts:
    """Texts (doc_id, text), spread by document and not yet clean. Operators take it in place of a tokens table; tokens() is that table."""

    def __init__(self, table: DataFrame):
        self.table = table

    def tokens(self) -> DataFrame:
        from corpuscle.operators.tagger import RuleTagger
        from corpuscle.operators.tokens import finish

        return finish(RuleTagger().tag(clean_corpus(self.table)), global_ids=False)

    def read(self, make: Callable[[], "Work"], schema: str, near: DataFrame | None = None) -> DataFrame:
        """What works give of all documents; with near (doc_id, previous, next), also the units beside each document."""
        ship(self.table.sparkSession)
        table = self.table if near is None else self.table.join(near.hint("shuffle_hash"), "doc_id", "left")
        return table.mapInArrow(lambda batches: _worked(make, batches), schema)

    def near(self, kind: str, layer: str, before: int, after: int) -> DataFrame:
        """(doc_id, previous, next): the units before and after each document that has any, over the bounds of documents.
        kind: those that count, those with letters, or all as they are written."""
        ends = self.read(lambda: Ends(kind, layer, max(before, 1), max(after, 1)), f"doc_id string, head {ITEMS}, tail {ITEMS}")
        return borders(ends, before, after)


def as_texts(corpus: DataFrame) -> Texts:
    """Corpus (doc_id, text) to Texts. Null texts go. Texts are spread by document, as a file may have few row groups."""
    valid_corpus(corpus, data=False)
    return Texts(corpus.where("text IS NOT NULL").repartition("doc_id"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", *(c for c in ("previous", "next") if c in batch.schema.names))]
        size, begin = 0, 0
        for k, text in enumerate(columns[1], 1):
            size += len(text)
            if size >= SLICE_CHARS or k == len(columns[1]):
                yield tuple(c[begin:k] for c in columns)
                size, begin = 0, k


def _worked(make: Callable[[], "Work"], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    work = make()
    for some in _slices(batches):
        yield from work.feed(work.read(*some))
        if len(work.lexicon) > MOST_PIECES:
            yield from work.flush()
            work = work.again()
    yield from work.flush()
    yield from work.last()


class Work:
    """What a worker does with slices of documents: feed() and flush() give rows. After flush() the lexicon may be another."""

    def __init__(self, layer: str, hit: Callable[[str, str], bool] | None = None, first_words: bool = False):
        self.how = (layer, hit, first_words)
        self.lexicon = Lexicon(*self.how)

    def again(self) -> "Work":
        self.lexicon = Lexicon(*self.how)
        self.begin()
        return self

    def begin(self) -> None:
        """Sums by unit number start anew."""

    def read(self, ids: list, texts: list, previous: list | None = None, next_: list | None = None) -> Docs:
        return self.lexicon.read(ids, texts, previous, next_)

    def feed(self, docs: Docs) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def flush(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    def last(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    @property
    def units(self) -> Units:
        return self.lexicon.units


class Sums:
    """Sums by number, of numbers that may grow."""

    def __init__(self, kind=np.int64):
        self.of = np.zeros(0, kind)

    def add(self, at: np.ndarray, weights: np.ndarray | None = None) -> None:
        more = np.bincount(at, weights, minlength=len(self.of))
        more[: len(self.of)] += self.of.astype(more.dtype)
        self.of = more.astype(self.of.dtype)

    def at(self, numbers: np.ndarray) -> np.ndarray:
        return self.of[numbers]


def _cells(run: Run, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, unit, how often) of each unit of each document."""
    codes, found = pd.factorize(run.docs() * n + run.units)
    return found // n, found % n, np.bincount(codes, minlength=len(found))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _strings(values: list, numbers: np.ndarray) -> pa.Array:
    """values[k] of each of numbers, null for -1."""
    return pa.array([values[k] if k >= 0 else None for k in numbers.tolist()], pa.string())


class UnitSums(Work):
    """(Token, Tag, n, docs): how often a unit that counts occurs, and in how many documents; a row with the tag TOTAL is of all."""

    def begin(self):
        self.n, self.docs, self.total, self.all = Sums(), Sums(), 0, 0

    def __init__(self, layer: str):
        super().__init__(layer)
        self.begin()

    def feed(self, docs):
        run = self.lexicon.run(docs)
        run = run.where(self.units.counts()[run.units])
        self.n.add(run.units)
        self.docs.add(_cells(run, len(self.units))[1])
        self.total += len(run.units)
        self.all += int((run.sizes() > 0).sum())
        return iter(())

    def flush(self):
        seen = np.flatnonzero(self.n.of)
        if len(seen):
            yield _batch(Token=_strings(self.units.token, seen), Tag=_strings(self.units.tag, seen), n=self.n.at(seen), docs=self.docs.at(seen))
            yield _batch(Token=pa.array([None], pa.string()), Tag=[TOTAL], n=[self.total], docs=[self.all])


class TagCounts(Work):
    """(doc_id, and a column for each of tags): units of each tag in each document that has any; or, if not by_doc, (Tag, n, docs) with
    a row for TOTAL, as of UnitSums."""

    def __init__(self, layer: str, tags: list[str], by_doc: bool = True):
        super().__init__(layer)
        self.tags, self.by_doc = tags, by_doc
        self.n, self.docs, self.total, self.all = np.zeros(len(tags), np.int64), np.zeros(len(tags), np.int64), 0, 0
        self.begin()

    def begin(self):
        self.number = {t: k for k, t in enumerate(self.tags)}
        self.codes: list[int] = []

    def feed(self, docs):
        run = self.lexicon.run(docs)
        run = run.where(self.units.counts()[run.units])
        self.codes += [self.number.get(t, len(self.tags)) for t in self.units.tag[len(self.codes) :]]
        width = len(self.tags) + 1  # the last one is of tags that aren't asked for
        at = run.docs() * width + np.array(self.codes, np.int64)[run.units]
        table = np.bincount(at, minlength=len(docs.ids) * width).reshape(-1, width)
        some = run.sizes() > 0
        if self.by_doc:
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([d for d, x in zip(docs.ids, some) if x], pa.string()), *[pa.array(table[some, k]) for k in range(width - 1)]], ["doc_id", *(f"n{k}" for k in range(width - 1))])
            return
        self.n += table[:, :-1].sum(0)
        self.docs += (table[:, :-1] > 0).sum(0)
        self.total += len(run.units)
        self.all += int(some.sum())

    def last(self):
        if not self.by_doc and self.all:
            seen = np.flatnonzero(self.n)
            yield _batch(Tag=pa.array([*(self.tags[k] for k in seen), TOTAL], pa.string()), n=[*self.n[seen].tolist(), self.total], docs=[*self.docs[seen].tolist(), self.all])


class Spread(Work):
    """Sums for dispersion of each unit over the documents that have it, of v (how often) and size (of the document); a unit is
    known by its first word. On the pos layer those that count, on the ds layer all. A row with the tag TOTAL has the sum of sizes as f,
    documents as ss, the least and the greatest size."""

    NAMES = ["f", "vlog", "root", "vv", "roots", "r1", "r2", "ss"]

    def __init__(self, layer: str):
        super().__init__(layer, first_words=True)
        self.begin()

    def begin(self):
        self.sums = [Sums(np.float64) for _ in self.NAMES]
        self.total, self.all, self.least, self.most = 0, 0, None, 0

    def run(self, docs: Docs) -> Run:
        run = self.lexicon.run(docs)
        return run.where(self.units.counts()[run.units]) if self.units.layer == "pos" else run

    def feed(self, docs):
        run = self.run(docs)
        sizes = run.sizes()
        doc, unit, times = _cells(run, len(self.units))
        v, size = times.astype(float), sizes[doc].astype(float)
        r = v / size
        for of, x in zip(self.sums, (v, v * np.log2(v), np.sqrt(v * size), v * v, np.sqrt(v), r, r * r, size)):
            of.add(unit, x)
        some = sizes[sizes > 0]
        if len(some):
            self.total, self.all = self.total + int(some.sum()), self.all + len(some)
            self.least = min(int(some.min()), self.least or int(some.min()))
            self.most = max(int(some.max()), self.most)
        return iter(())

    def flush(self):
        seen = np.flatnonzero(self.sums[0].of)
        if len(seen):
            none = pa.nulls(len(seen), pa.float64())
            yield _batch(Token=_strings(self.units.token, seen), Tag=_strings(self.units.tag, seen), **{n: of.at(seen) for n, of in zip(self.NAMES, self.sums)}, least=none, most=none)
            values = {**dict.fromkeys(self.NAMES, 0.0), "f": float(self.total), "ss": float(self.all), "least": float(self.least), "most": float(self.most)}
            yield _batch(Token=pa.array([None], pa.string()), Tag=[TOTAL], **{k: [x] for k, x in values.items()})


class Below(Spread):
    """(Token, Tag, below, v, size): for units of frequent, {(token, tag): f}, the sum of size / total - v / f over the documents where that
    is positive; for other units, v and size of each document of more than LARGE_DOC units, which alone can have it positive."""

    def __init__(self, layer: str, frequent: dict[tuple[str, str], float], total: float):
        self.frequent, self.of_all = frequent, total
        super().__init__(layer)

    def begin(self):
        self.f: list[float] = []
        self.below = Sums(np.float64)

    def feed(self, docs):
        run = self.run(docs)
        sizes = run.sizes()
        new = zip(self.units.token[len(self.f) :], self.units.tag[len(self.f) :])
        self.f += [self.frequent.get(key, 0.0) for key in new]
        f = np.array(self.f)
        large = sizes > LARGE_DOC
        known = run.where((f[run.units] > 0) | large[run.docs()])
        doc, unit, times = _cells(known, len(self.units))
        v, size, own = times.astype(float), sizes[doc].astype(float), f[unit]
        less = size / self.of_all - v / np.where(own > 0, own, 1.0)
        some = (own > 0) & (less > 0)
        self.below.add(unit[some], less[some])
        rest = own == 0
        if rest.any():
            yield _batch(Token=_strings(self.units.token, unit[rest]), Tag=_strings(self.units.tag, unit[rest]), below=pa.nulls(int(rest.sum()), pa.float64()), v=v[rest], size=size[rest])

    def flush(self):
        seen = np.flatnonzero(self.below.of)
        if len(seen):
            none = pa.nulls(len(seen), pa.float64())
            yield _batch(Token=_strings(self.units.token, seen), Tag=_strings(self.units.tag, seen), below=self.below.at(seen), v=none, size=none)


def _items(units: Units, numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    item = pa.StructArray.from_arrays([_strings(units.token, numbers), _strings(units.tag, numbers)], fields=list(_ITEM))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), item)


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1 and so on, sizes[k] of them, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


class Ends(Work):
    """(doc_id, head, tail): the first after and the last before units of each document that has any."""

    def __init__(self, kind: str, layer: str, before: int, after: int):
        super().__init__(layer)
        self.kind, self.before, self.after = kind, before, after

    def read(self, ids, texts):
        """Of each document two parts, its text or where that is long its ends; whole texts after all if these don't have enough."""
        texts = [clean_text(t) for t in texts]
        parts = []
        for t in texts:
            stop, begin = (t.rfind(" ", 0, END_CHARS), t.find(" ", len(t) - END_CHARS)) if len(t) > 2 * END_CHARS else (-1, -1)
            parts += [t, t] if stop < 0 or begin < 0 else [t[:stop], t[begin + 1 :]]
        docs = self.lexicon.read([d for d in ids for _ in range(2)], parts, clean=True)
        # What is beside the place of the cut may belong to one unit with what is beyond it.
        size = self.run(docs).sizes().reshape(-1, 2)
        few = (size[:, 0] <= self.after) | (size[:, 1] <= self.before)
        short = [k for k, x in enumerate(few.tolist()) if x and len(parts[2 * k]) < len(texts[k])]
        if short:
            for k in short:
                parts[2 * k] = parts[2 * k + 1] = texts[k]
            docs = self.lexicon.read(docs.ids, parts, clean=True)
        return docs

    def run(self, docs: Docs) -> Run:
        run = self.lexicon.run(docs)
        return run if self.kind == "written" else run.where((self.units.counts() if self.kind == "counted" else self.units.letters())[run.units])

    def feed(self, docs):
        run = self.run(docs)
        size, begin, end = run.sizes(), run.bounds[:-1], run.bounds[1:]
        some = size[::2] > 0
        if not some.any():
            return
        begin, first = begin[::2][some], np.minimum(size[::2][some], self.after)
        end, last = end[1::2][some], np.minimum(size[1::2][some], self.before)
        made = []
        for at, n in ((begin, first), (end - last, last)):
            where = _ranges(at, n)
            if self.kind == "written":
                stops = _stops(docs, run)
                tokens = pa.array([docs.written(a, b) for a, b in zip(run.starts[where].tolist(), stops[where].tolist())], pa.string())
                item = pa.StructArray.from_arrays([tokens, pa.nulls(len(where), pa.string())], fields=list(_ITEM))
                made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), item))
            else:
                made.append(_items(self.units, run.units[where], n))
        yield _batch(doc_id=pa.array([d for d, x in zip(docs.ids[::2], some) if x], pa.string()), head=made[0], tail=made[1])


def _stops(docs: Docs, run: Run) -> np.ndarray:
    """The piece after each unit, of a run of all units."""
    return np.append(run.starts[1:], len(docs.numbers))


class Sequence:
    """Units of documents with those before and after each, in one array: those of document k are at base[k] to end[k], its own first
    one at own[k]."""

    def __init__(self, lexicon: Lexicon, docs: Docs, run: Run):
        of = lexicon.unit
        n, none = len(docs.ids), [None] * len(docs.ids)
        before, after = ([[of(x["token"], x["tag"]) for x in near or ()] for near in side or none] for side in (docs.previous, docs.next))
        p, u, x = np.fromiter(map(len, before), np.int64, n), run.sizes(), np.fromiter(map(len, after), np.int64, n)
        self.end = np.cumsum(p + u + x)
        self.base = self.end - p - u - x
        self.own = self.base + p
        self.units = np.empty(int((p + u + x).sum()), np.int64)
        self.places = _ranges(self.own, u)  # of the documents' own units
        self.units[self.places] = run.units
        for at, sizes, side in ((self.base, p, before), (self.own + u, x, after)):
            self.units[_ranges(at, sizes)] = [k for own in side for k in own]
        self.docs = run.docs()

    def window(self, at: np.ndarray, doc: np.ndarray, shift: int) -> np.ndarray:
        """The unit shift places after each of the places at of documents doc; -1 beyond the corpus."""
        to = at + shift
        inside = (to >= self.base[doc]) & (to < self.end[doc])
        return np.where(inside, self.units[np.where(inside, to, 0)] if len(self.units) else -1, -1)


class Grams(Work):
    """(Token_1.., Tag_1.., n, docs): rows of span units, of documents in which they begin, and a row with TOTAL as Tag_1.

    Of n-grams all (begin is None), or those alone whose hash is in heavy; of clusters, those with a hit at position before + 1.
    """

    def __init__(self, layer: str, span: int, before: int | None = None, hit: Callable[[str, str], bool] | None = None, heavy: bytes | None = None):
        super().__init__(layer, hit)
        self.span, self.before = span, before
        self.heavy = None if heavy is None else np.unpackbits(np.frombuffer(heavy, np.uint8)).astype(bool)
        self.found: dict[tuple[int, ...], list[int]] = {}
        self.total, self.all = 0, 0
        self.begin()

    def begin(self):
        self.hashes = bytearray()

    def hashed(self) -> np.ndarray:
        new = zip(self.units.token[len(self.hashes) // 8 :], self.units.tag[len(self.hashes) // 8 :])
        self.hashes += b"".join([blake2b(f"{token}\0{tag}".encode(), digest_size=8).digest() for token, tag in new])
        return np.frombuffer(bytes(self.hashes), np.uint64)

    def windows(self, docs: Docs) -> tuple[Sequence, np.ndarray, np.ndarray]:
        """(units, and the places and documents where the rows begin) of docs."""
        run = self.lexicon.run(docs)
        run = run.where(self.units.counts()[run.units])
        s = Sequence(self.lexicon, docs, run)
        self.total += len(run.units)
        if self.before is None:
            some = s.places + self.span <= s.end[s.docs]
        else:
            some = self.units.hits()[run.units]
        at, doc = s.places[some], s.docs[some]
        self.all += len(np.unique(doc))
        return s, at, doc

    def buckets(self, s: Sequence, at: np.ndarray) -> np.ndarray:
        """The bucket of the n-gram that begins at each place."""
        h = self.hashed()[s.units]
        out = np.zeros(len(at), np.uint64)
        for k in range(self.span):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
        return ((out ^ (out >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)

    def feed(self, docs):
        s, at, doc = self.windows(docs)
        if self.heavy is not None and len(at):
            some = self.heavy[self.buckets(s, at)]
            at, doc = at[some], doc[some]
        if len(at):
            rows = np.stack([s.window(at, doc, k - (self.before or 0)) for k in range(self.span)], 1)
            # Equal rows get one number, column by column.
            number = rows[:, 0] + 1
            for k in range(1, self.span):
                number, different = numbered(number * (len(self.units) + 1) + rows[:, k] + 1)
            first = np.empty(different, np.int64)
            first[number[::-1]] = np.arange(len(number))[::-1]
            n = np.bincount(number)
            docs_of = np.bincount(pd.unique(number * len(docs.ids) + doc) // len(docs.ids), minlength=different)
            for key, times, of in zip(map(tuple, rows[first].tolist()), n.tolist(), docs_of.tolist()):
                known = self.found.get(key)
                if known is None:
                    self.found[key] = [times, of]
                else:
                    known[0] += times
                    known[1] += of
        if len(self.found) > MOST_GRAMS:
            yield from self.flush()

    def columns(self, keys: np.ndarray, **values) -> pa.RecordBatch:
        tokens = {f"Token_{k + 1}": _strings(self.units.token, keys[:, k]) for k in range(self.span)}
        return _batch(**tokens, **{f"Tag_{k + 1}": _strings(self.units.tag, keys[:, k]) for k in range(self.span)}, **values)

    def flush(self):
        if self.found:
            values = np.array(list(self.found.values()), np.int64)
            yield self.columns(np.array(list(self.found), np.int64), n=values[:, 0], docs=values[:, 1])
            self.found = {}

    def last(self):
        if self.total:
            none = {f"{c}_{k + 1}": pa.nulls(1, pa.string()) for c in ("Token", "Tag") for k in range(self.span)}
            yield _batch(**{**none, "Tag_1": pa.array([TOTAL])}, n=[self.total], docs=[self.all])


class GramBuckets(Grams):
    """(part, counts): how many n-grams a worker saw in each bucket, packed, in PARTS parts; a row with the part -1 has the units."""

    def __init__(self, layer: str, span: int):
        super().__init__(layer, span)
        self.counts = np.zeros(BUCKETS, np.int64)

    def feed(self, docs):
        s, at, _ = self.windows(docs)
        if len(at):
            self.counts += np.bincount(self.buckets(s, at), minlength=BUCKETS)
        return iter(())

    def flush(self):
        return iter(())

    def last(self):
        if self.total:
            yield _batch(part=pa.array([-1], pa.int32()), counts=pa.array([np.array([self.total]).tobytes()], pa.binary()))
            for k, part in enumerate(np.split(self.counts, PARTS)):
                yield _batch(part=pa.array([k], pa.int32()), counts=pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()))


def heavy_buckets(buckets: DataFrame, min_frequency: float) -> bytes:
    """Bits of the buckets whose n-grams may reach min_frequency, per million of units: a bucket has the counts of all in it."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(counts if part < 0 else zlib.decompress(counts), np.int64)
                sums[part] = sums[part] + own if part in sums else own
        for part, own in sums.items():
            yield _batch(part=pa.array([part], pa.int32()), counts=pa.array([own.tobytes() if part < 0 else zlib.compress(own.tobytes(), 1)], pa.binary()))

    rows = buckets.repartition("part").mapInArrow(summed, "part int, counts binary")
    bits = np.zeros((PARTS, BUCKETS // PARTS), bool)
    total, by_part = 0, {}
    for r in rows.toLocalIterator():
        if r["part"] < 0:
            total = int(np.frombuffer(r["counts"], np.int64)[0])
        else:
            by_part[r["part"]] = r["counts"]
    for part, counts in by_part.items():
        bits[part] = np.frombuffer(zlib.decompress(counts), np.int64) / max(total, 1) * 1e6 >= min_frequency
    return np.packbits(bits.ravel()).tobytes()


class Concordance(Work):
    """(doc_id, place, previous, node, next): each hit with the words units before and after it, as they are written."""

    def __init__(self, words: int, hit: Callable[[str], bool], written_hit: Callable[[str], bool] | None = None):
        """hit looks at the unit in lower case, stripped; of its hits those that written_hit holds for too, as they are written."""
        super().__init__("pos", lambda token, tag: hit(token))
        self.words, self.written_hit = words, written_hit

    def feed(self, docs):
        run = self.lexicon.run(docs)
        stops = _stops(docs, run)
        at = np.flatnonzero(self.units.hits()[run.units])
        if self.written_hit is not None:
            at = at[[self.written_hit(docs.written(a, b)) for a, b in zip(run.starts[at].tolist(), stops[at].tolist())]] if len(at) else at
        if not len(at):
            return
        doc = np.searchsorted(run.bounds, at, side="right") - 1
        first, last = np.maximum(at - self.words, run.bounds[doc]), np.minimum(at + self.words + 1, run.bounds[doc + 1])
        previous, node, next_ = [], [], []
        for k, d, a, b in zip(at.tolist(), doc.tolist(), first.tolist(), last.tolist()):
            before, after = self.words - (k - a), self.words - (b - 1 - k)
            earlier = "".join(x["token"] for x in (docs.previous[d] or ())[-before:]) if before and docs.previous else ""
            later = "".join(x["token"] for x in (docs.next[d] or ())[:after]) if after and docs.next else ""
            previous.append(earlier + docs.written(run.starts[a], run.starts[k]))
            node.append(docs.written(run.starts[k], stops[k]))
            next_.append(docs.written(stops[k], stops[b - 1]) + later)
        yield _batch(doc_id=pa.array([docs.ids[d] for d in doc], pa.string()), place=at - run.bounds[doc], previous=pa.array(previous, pa.string()), node=pa.array(node, pa.string()), next=pa.array(next_, pa.string()))


class Collocates(Work):
    """(Token, Tag, span, n): how often a unit is near the node, among units with letters, and how often it occurs, if it counts; a row
    with the tag TOTAL has the node's occurrences as span."""

    def __init__(self, layer: str, preceding: int, following: int, hit: Callable[[str, str], bool]):
        super().__init__(layer, hit)
        self.shifts = [*range(-preceding, 0), *range(1, following + 1)]
        self.begin()

    def begin(self):
        self.n, self.span, self.total, self.nodes = Sums(), Sums(), 0, 0

    def feed(self, docs):
        run = self.lexicon.run(docs)
        counted = run.units[self.units.counts()[run.units]]
        self.n.add(counted)
        self.total += len(counted)
        self.nodes += int(self.units.hits()[counted].sum())
        letters = run.where(self.units.letters()[run.units])
        s = Sequence(self.lexicon, docs, letters)
        some = self.units.hits()[letters.units]
        at, doc = s.places[some], s.docs[some]
        for shift in self.shifts:
            near = s.window(at, doc, shift)
            self.span.add(near[near >= 0])
        return iter(())

    def flush(self):
        n, span = (np.pad(x.of, (0, len(self.units) - len(x.of))) for x in (self.n, self.span))
        seen = np.flatnonzero(n + span)
        if len(seen):
            yield _batch(Token=_strings(self.units.token, seen), Tag=_strings(self.units.tag, seen), span=span[seen], n=n[seen])
            yield _batch(Token=pa.array([None], pa.string()), Tag=[TOTAL], span=[self.nodes], n=[self.total])


#: Patterns that mean the same in Python as in Spark: letters, digits, spaces, groups, classes of letters, and their repetitions.
_SAME = re.compile(r"(?:[A-Za-z0-9 '_,;:!^$|).-]|\((?!\?)|\[\^?(?:[A-Za-z0-9](?:-[A-Za-z0-9])?)+\]|[*+?](?![*+?{]))*")


def search(node: str, kind: str) -> Callable[[str], bool] | None:
    """The test of a token for a node; None where Spark's regular expressions have to do it."""
    if kind == "contains":
        if not _SAME.fullmatch(node):
            return None
        found = re.compile(node).search
        return lambda token: found(token) is not None
    return {"fixed": lambda token: token == node, "starts_with": lambda token: token.startswith(node), "ends_with": lambda token: token.endswith(node)}[kind]


def bare(token: str) -> str:
    return token.strip(SPACES)


def with_near(texts: Texts, kind: str, layer: str, before: int, after: int, within_doc: bool) -> DataFrame | None:
    """near() of texts, where anything goes over the bounds of documents."""
    return None if within_doc or not (before or after) else texts.near(kind, layer, before, after)


def gram_rows(texts: Texts, layer: str, span: int, near: DataFrame | None, before: int | None = None, hit=None, heavy: bytes | None = None) -> DataFrame:
    columns = ", ".join(f"{c}_{k + 1} string" for c in ("Token", "Tag") for k in range(span))
    return texts.read(lambda: Grams(layer, span, before, hit, heavy), f"{columns}, n long, docs long", near)
