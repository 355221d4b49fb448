"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the codebooks of residuals are fitted by Lloyd's rounds over all vectors, with partial sums made in the tasks
and added up by blocks of centroids. Each vector goes to the list of its nearest centroid with its residual's codes; each
query goes to its nearest lists. There, the points are ranked by asymmetric distances (a table of the query against the
codebooks, and a term of each point), and the best are reranked by their exact distance.

Lists that lie near one another share a partition, to which a query travels once for all of its lists there. How many lists a
query needs depends on the data: an audit searches some queries exhaustively, and takes as many lists, and candidates
to rerank, as find the wanted part of their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.plans.runtime import cut, ship

NEIGHBOURS = 10
CANDIDATES = 50  # best of each partition by asymmetric distance, reranked exactly; the audit can raise it
RECALL = 0.93  # of the audited queries' neighbours; MARGIN more of them are in the lists that are searched
MARGIN = 0.02
AUDITED = 256  # queries that are searched exhaustively as well
ROUNDS = 6
#: The centroids are broadcast: some 16 MB of them at most. Beyond 4 billion vectors lists get longer instead.
MOST_LISTS = 65_536
#: Points of a partition, about; a task holds some 350 bytes for each.
PARTITION_POINTS = 200_000
BLOCK = 1024  # centroids whose sums travel together
CODES = 256
SUB = 4  # dimensions of a subspace


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    values = batch.column(1)
    return ids, values.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), dim)


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, in order; of a tie the least."""
    out = np.empty((len(x), k), np.int64)
    norm = (centres.astype(np.float64) ** 2).sum(axis=1)
    step = max(1, 8_000_000 // len(centres))
    for i in range(0, len(x), step):
        d = norm - 2 * (x[i : i + step].astype(np.float64) @ centres.T.astype(np.float64))
        if k == 1:
            out[i : i + step, 0] = d.argmin(axis=1)
        else:
            some = np.argpartition(d, min(k, len(centres)) - 1, axis=1)[:, :k]
            some.sort(axis=1)
            out[i : i + step] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    return out


class Quantiser:
    """Coarse centroids (lists, dim), codebooks (dim / sub, codes, sub) of residuals."""

    def __init__(self, coarse: np.ndarray, books: np.ndarray | None = None):
        self.coarse, self.books = coarse, books

    def residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(x, self.coarse)[:, 0]
        return at, x - self.coarse[at]

    def codes(self, residual: np.ndarray) -> np.ndarray:
        sub = self.books.shape[2]
        return np.stack([nearest(residual[:, j * sub : (j + 1) * sub], b)[:, 0] for j, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def table(self, x: np.ndarray) -> np.ndarray:
        """-2 * products (queries, subspaces, codes) of queries with the codebooks.

        The distance of a query q to the point c + r is |q - c|^2 + (|r|^2 + 2 c.r) - 2 q.r: the first is one of query and list, the
        second one of the point alone, the last a sum of the table's entries by the point's codes.
        """
        return -2 * np.einsum("qjs,jcs->jqc", x.reshape(len(x), self.books.shape[0], -1), self.books).astype(np.float32)

    def terms(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        r = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return ((r + 2 * self.coarse[lists]) * r).sum(axis=1)


def grouped(centres: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centre: the sets of centres are halved at the median of their most spread dimension, again and again."""
    out = np.zeros(len(centres), np.int64)

    def halve(at: np.ndarray, first: int, n: int) -> None:
        if n == 1 or len(at) <= 1:
            out[at] = first
            return
        x = centres[at]
        order = at[np.argsort(x[:, x.var(axis=0).argmax()], kind="stable")]
        left = n // 2
        cut = len(at) * left // n
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, n - left)

    halve(np.arange(len(centres)), 0, groups)
    return out


def _partial(model, dim: int):
    """Of each task, sums and counts by centroid, in blocks: of the codebooks if the model has them, else of the coarse ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        q = model.value
        books = q.books is not None
        shape = q.books.shape if books else (1, *q.coarse.shape)
        sums, counts = np.zeros(shape), np.zeros(shape[:2])
        for batch in batches:
            _, x = _vectors(batch, dim)
            if books:
                _, x = q.residuals(x)
                at = q.codes(x).astype(np.int64)
            else:
                at = nearest(x, q.coarse)
            for j in range(shape[0]):
                np.add.at(sums[j], at[:, j], x[:, j * shape[2] : (j + 1) * shape[2]])
                counts[j] += np.bincount(at[:, j], minlength=shape[1])
        sums, counts = sums.reshape(-1, shape[2]), counts.ravel()
        starts = range(0, len(counts), BLOCK)
        n = len(starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([sums[i : i + BLOCK].tobytes() for i in starts], pa.binary()), pa.array([counts[i : i + BLOCK].tobytes() for i in starts], pa.binary())],
            names=["block", "part", "sums", "counts"],
        )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks added up in the order of their parts, so that a run gives the same floats as another."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = np.frombuffer(a), np.frombuffer(b)
            if block in total:
                total[block][0] += a
                total[block][1] += b
            else:
                total[block] = [a.copy(), b.copy()]
    if total:
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([total[x][c].tobytes() for x in keys], pa.binary()) for c in (0, 1))], names=["block", "sums", "counts"])


def _moved(vectors: DataFrame, q: Quantiser, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The centroids (or codebooks) moved to the means of their vectors, and how many each has."""
    sc = vectors.sparkSession.sparkContext
    old = q.coarse[None] if q.books is None else q.books
    blocks = -(-old.shape[0] * old.shape[1] // BLOCK)
    parts = vectors.mapInArrow(_partial(sc.broadcast(q), dim), "block int, part int, sums binary, counts binary")
    rows = parts.repartition(min(blocks, 64), "block").sortWithinPartitions("block", "part").mapInArrow(_added, "block int, sums binary, counts binary").collect()
    rows.sort(key=lambda r: r[0])
    sums = np.concatenate([np.frombuffer(r[1]) for r in rows]).reshape(old.shape)
    counts = np.concatenate([np.frombuffer(r[2]) for r in rows]).reshape(old.shape[:2])
    new = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], old).astype(np.float32)
    return (new[0], counts[0]) if q.books is None else (new, counts)


def fit(vectors: DataFrame, dim: int, n: int, rounds: int = ROUNDS) -> Quantiser:
    """About sqrt(n) lists. Starts are the vectors of the least hashes of vec_id: the same at each run."""
    lists = max(1, min(MOST_LISTS, int(round(n**0.5))))
    codes = max(1, min(CODES, n))
    start = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(lists, codes)).toArrow()
    _, x = _vectors(start.combine_chunks().to_batches()[0], dim)
    q = Quantiser(x[:lists].copy())
    for _ in range(rounds):
        q = Quantiser(_moved(vectors, q, dim)[0])
    _, residual = q.residuals(x[:codes])
    sub = SUB if dim % SUB == 0 else 1
    q.books = np.ascontiguousarray(residual.reshape(len(residual), -1, sub).transpose(1, 0, 2))
    for _ in range(rounds):
        q = Quantiser(q.coarse, _moved(vectors, q, dim)[0])
    return q


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    width = rows.itemsize * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


_PLACED = "part int, query int, id long, lists binary, vector binary, codes binary"


def _points(model, dim: int):
    """Each vector in the partition of its list, with its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, group = model.value
        for batch in batches:
            ids, x = _vectors(batch, dim)
            at, residual = q.residuals(x)
            yield pa.RecordBatch.from_arrays([pa.array(group[at], pa.int32()), pa.array(np.zeros(len(ids)), pa.int32()), pa.array(ids), _binary(at.astype(np.int32)[:, None]), _binary(x), _binary(q.codes(residual))], names=["part", "query", "id", "lists", "vector", "codes"])

    return run


def _queries(model, dim: int, probes: int):
    """Each vector once in each partition of its nearest lists, with those lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, group = model.value
        k = min(probes, len(q.coarse))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                ids, x = _vectors(batch.slice(i, 512), dim)
                near = np.sort(nearest(x, q.coarse, k), axis=1)
                order = np.argsort(group[near], axis=1, kind="stable")
                near = np.take_along_axis(near, order, 1)
                part = group[near].ravel()
                row = np.repeat(np.arange(len(ids)), k)
                heads = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])])) if len(part) else np.zeros(0, np.int64)
                offsets = (np.append(heads, len(part)) * 4).astype(np.int32)
                lists = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(near.astype(np.int32).tobytes())])
                own = row[heads]
                yield pa.RecordBatch.from_arrays([pa.array(part[heads], pa.int32()), pa.array(np.ones(len(heads)), pa.int32()), pa.array(ids[own]), lists, _binary(x).take(pa.array(own)), pa.nulls(len(heads), pa.binary())], names=["part", "query", "id", "lists", "vector", "codes"])

    return run


class Partition:
    """The points of a partition by list, ready for queries."""

    def __init__(self, q: Quantiser, parts: list[tuple[np.ndarray, ...]]):
        ids, lists, vectors, codes = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((ids, lists))
        self.q, self.ids, lists, self.vectors, codes = q, ids[order], lists[order], vectors[order], codes[order]
        self.terms = q.terms(lists, codes)
        self.codes = np.ascontiguousarray(codes.T.astype(np.int64))
        names, starts = np.unique(lists, return_index=True)
        self.bounds = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(lists)])))
        self.by_id = np.argsort(self.ids, kind="stable")

    def search(self, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, counts: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, distance) of the k nearest points of each query in its lists (counts of them for each query)."""
        n = len(self.ids)
        d = np.full((len(ids), n), np.inf, np.float32)
        table = self.q.table(x)
        row = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(lists, kind="stable")
        row, lists = row[order], lists[order]
        heads = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(lists)]):
            if lists[lo] not in self.bounds:
                continue
            a, b = self.bounds[int(lists[lo])]
            r = row[lo:hi]
            own = ((x[r] - self.q.coarse[lists[lo]]) ** 2).sum(axis=1)[:, None] + self.terms[None, a:b]
            for j in range(len(self.codes)):
                own += np.take(table[j, r], self.codes[j, a:b], axis=1)
            d[r, a:b] = own
        at = self.by_id[np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), n - 1)]
        same = np.flatnonzero(self.ids[at] == ids)
        d[same, at[same]] = np.inf
        best = np.argpartition(d, candidates - 1, axis=1)[:, :candidates] if n > candidates else np.tile(np.arange(n), (len(ids), 1))
        exact = ((self.vectors[best].astype(np.float64) - x[:, None].astype(np.float64)) ** 2).sum(axis=2)
        exact[np.isinf(np.take_along_axis(d, best, 1))] = np.inf
        order = np.lexsort((self.ids[best], exact), axis=1)[:, :k]
        best, exact = np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)
        fine = np.isfinite(exact)
        return np.repeat(ids, fine.sum(axis=1)), self.ids[best[fine]], np.sqrt(exact[fine])


def _search(model, dim: int, k: int, candidates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, _ = model.value
        at, points, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(query) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                if part[lo] != at:
                    at, points, ready = part[lo], [], None
                lists, vector, codes = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (3, 4, 5))
                x = np.frombuffer(b"".join(vector), np.float32).reshape(-1, dim)
                names = np.frombuffer(b"".join(lists), np.int32).astype(np.int64)
                if query[lo] == 0:
                    points.append((ids[lo:hi], names, x, np.frombuffer(b"".join(codes), np.uint8).reshape(hi - lo, -1)))
                    continue
                if ready is None:
                    if not points:
                        continue
                    ready, points = Partition(q, points), []
                counts = np.array([len(b) // 4 for b in lists])
                first = np.concatenate([[0], np.cumsum(counts)])
                step = max(1, min(256, 8_000_000 // len(ready.ids)))
                for i in range(0, hi - lo, step):
                    j = min(i + step, hi - lo)
                    a, b, d = ready.search(ids[lo + i : lo + j], x[i:j], names[first[i] : first[j]], counts[i:j], k, candidates)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["vec_id", "neighbour_id", "distance"])

    return run


def _nearest_lists(model, dim: int, k: int):
    """Of a task, the k nearest vectors of each audited query, and their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own, asked = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 16_384):
                ids, x = _vectors(batch.slice(i, 16_384), dim)
                at, _ = q.residuals(x)
                d = (asked.astype(np.float64) ** 2).sum(axis=1)[:, None] - 2 * asked.astype(np.float64) @ x.T.astype(np.float64) + (x.astype(np.float64) ** 2).sum(axis=1)
                d[own[:, None] == ids[None]] = np.inf
                best = np.argpartition(d, k - 1, axis=1)[:, :k] if len(ids) > k else np.tile(np.arange(len(ids)), (len(own), 1))
                exact = np.take_along_axis(d, best, 1)
                fine = np.isfinite(exact)
                row = np.repeat(np.arange(len(own)), fine.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(np.maximum(exact[fine], 0)), pa.array(ids[best[fine]]), pa.array(at[best[fine]], pa.int64())], names=["q", "d", "id", "list"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k).alias("best"))


def audit(vectors: DataFrame, points: DataFrame, model, dim: int, k: int, candidates: int, recall: float, parts: int) -> tuple[int, int]:
    """(probes, candidates) with which AUDITED queries, those of the least hashes of vec_id, find recall of their k nearest among
    all vectors; points are the vectors in their lists."""
    sc = vectors.sparkSession.sparkContext
    q, _ = model.value
    asked = cut(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(AUDITED).coalesce(1))
    own, x = _vectors(asked.toArrow().combine_chunks().to_batches()[0], dim)
    near = vectors.mapInArrow(_nearest_lists(sc.broadcast((q, own, x)), dim, k), "q int, d double, id long, list long")
    rows = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id", "list"))), 1, k).alias("best")).collect()
    if not rows:
        return 1, candidates
    order = nearest(x, q.coarse, len(q.coarse)).argsort(axis=1)
    ranks = np.sort([order[r["q"], b["list"]] for r in rows for b in r["best"]])
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil((recall + MARGIN) * len(ranks))))]) + 1
    wanted = {int(own[r["q"]]): {b["id"] for b in r["best"]} for r in rows}
    while True:
        placed = points.unionByName(asked.mapInArrow(_queries(model, dim, probes), _PLACED))
        found = _best(_searched(placed, model, dim, k, candidates, parts), k).collect()
        right = sum(b["neighbour_id"] in wanted.get(r["vec_id"], ()) for r in found for b in r["best"])
        if right >= recall * len(ranks) or (probes >= len(q.coarse) and candidates >= PARTITION_POINTS):
            return probes, candidates
        probes, candidates = min(len(q.coarse), probes + probes // 8 + 1), 2 * candidates


def _searched(placed: DataFrame, model, dim: int, k: int, candidates: int, parts: int) -> DataFrame:
    rows = placed.repartitionById(parts, "part").sortWithinPartitions("part", "query")
    return rows.mapInArrow(_search(model, dim, k, candidates), "vec_id long, neighbour_id long, distance double")


def neighbours(vectors: DataFrame, queries: Column | None = None, k: int = NEIGHBOURS, probes: int | None = None, candidates: int = CANDIDATES, recall: float = RECALL) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest other vectors of each query, Euclidean.

    vectors (vec_id, embedding) are all indexed and searched; queries is a condition on vec_id, by default all rows are queries.

    probes is the number of lists that a query goes to; without it an audit finds how many, and how many candidates, give recall.
    Ties go to the lesser neighbour_id; equal vectors are neighbours at distance 0. A row without vec_id, whose embedding is null or
    has a null or NaN in it, or another length than most have, is neither query nor neighbour. Rows with the same
    vec_id count as one (of the least embedding). Fewer than k others give fewer rows; an empty table gives none.
    """
    spark = ship(vectors.sparkSession)
    e = F.col("embedding").cast("array<float>")
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, v -> v IS NULL OR isnan(v))")
    sizes = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    dim = sizes["d"]
    sound = cut(sound.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    n = sound.count()
    quantiser = fit(sound, dim, n)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PARTITION_POINTS))
    parts = min(parts, len(quantiser.coarse))
    model = spark.sparkContext.broadcast((quantiser, grouped(quantiser.coarse, parts)))
    # Each vector in its list, by the index: made once, for the rounds of the audit and for the search.
    points = cut(sound.mapInArrow(_points(model, dim), _PLACED))
    if probes is None:
        probes, candidates = audit(sound, points, model, dim, k, candidates, recall, parts)
    asked = sound if queries is None else sound.where(queries)
    placed = points.unionByName(asked.mapInArrow(_queries(model, dim, probes), _PLACED))
    best = _best(_searched(placed, model, dim, k, candidates, parts), k)
    return best.select("vec_id", F.posexplode("best").alias("p", "b")).select("vec_id", (F.col("p") + 1).alias("rank"), "b.neighbour_id", "b.distance")
