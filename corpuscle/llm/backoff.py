"""Language-model scores by stupid backoff (Brants et al., 2007), computed relationally.

The count tables of uni-, bi- and trigrams are partitioned by hash. Documents are packed to batches of words; each batch
sends its distinct n-grams with their counts to the partitions of the tables, where they are added up, and gets the
totals of those n-grams back (a join of the count tables with the exploded n-grams, in which a batch's repeated n-grams
travel once). The batch then scores each word with the totals less the counts of the word's own document, so that
no document vouches for itself, and sums by document.

Nothing is broadcast or collected; a partition holds a bounded number of n-grams, as the number of partitions follows
the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.kernels import BASE, U, Words, blocks, mix, texts
from corpuscle.plans.runtime import cut, ship

ALPHA = 0.4
BATCH_WORDS = 1_500_000
#: Words of text for each partition of the count tables; about two n-grams a word travel.
PARTITION_WORDS = 2_500_000
BYTES_A_WORD = 6  # about; only the number of partitions depends on it

_CODEC = "zstd"


def _pack(a: np.ndarray) -> bytes:
    """Compressed by byte planes: small and sorted numbers have mostly equal high bytes."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
    return pa.compress(planes.tobytes(), _CODEC, asbytes=True) if len(a) else b""


def _unpack(b: bytes, n: int, dtype) -> np.ndarray:
    if n == 0:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(b, n * size, _CODEC, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype)[:, 0]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, ids, lengths, words, vocabulary, n_docs, n_words, n_vocabulary) of about BATCH_WORDS words each."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    ids, lengths, hashes, total = [], [], [], 0

    def out() -> pa.RecordBatch:
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        vocabulary, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        id_ = pa.concat_arrays(ids)
        n = np.concatenate(lengths).astype(np.int64)
        doc = np.array([x.as_py() if x.is_valid else 0 for x in []], np.int64) if not len(id_) else id_.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        null = id_.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + number]), *(pa.array([_pack(x)], pa.binary()) for x in (doc, null, n, rank[inverse], vocabulary[order])), pa.array([len(n)]), pa.array([len(h)]), pa.array([len(vocabulary)])],
            names=["batch", "ids", "nulls", "lengths", "words", "vocabulary", "n_docs", "n_words", "n_vocabulary"],
        )

    for batch in batches:
        column, id_ = texts(batch), batch.column(0)
        for a, b in blocks(column):
            w = Words(column.slice(a, b - a))
            ids.append(id_.slice(a, b - a).cast(pa.int64()))
            lengths.append(w.counts)
            hashes.append(w.hashes())
            total += len(w)
            if total >= BATCH_WORDS:
                yield out()
                ids, lengths, hashes, total, number = [], [], [], 0, number + 1
    if ids:
        yield out()


_BATCH = "batch long, ids binary, nulls binary, lengths binary, words binary, vocabulary binary, n_docs long, n_words long, n_vocabulary long"


def _grams(row: dict) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 1-, 2- and 3-grams that end at each word, whether there is one, lengths, row of each word."""
    n, docs = row["n_words"], row["n_docs"]
    h = _unpack(row["vocabulary"], row["n_vocabulary"], np.uint64)[_unpack(row["words"], n, np.uint32)] if n else np.zeros(0, np.uint64)
    lengths = _unpack(row["lengths"], docs, np.int64)
    doc = np.repeat(np.arange(docs), lengths)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams, there = [mix(h + U(1))], [np.ones(n, bool)]
    with np.errstate(over="ignore"):
        for k in (1, 2):
            before = np.zeros_like(h)
            before[k:] = h[:-k] if k < n else h[:0]
            grams.append(mix(grams[-1] * U(BASE) + before + U(k)))
            there.append(place >= k)
    return grams, there, lengths, doc


def _requests(partitions: int):
    """(partition, batch, hashes, counts, n): a batch's distinct n-grams of all orders, by partition, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, there, _, _ = _grams(row)
                for k in range(3):
                    h, count = np.unique(grams[k][there[k]], return_counts=True)
                    bounds = _bounds(h, partitions)
                    some = np.flatnonzero(np.diff(bounds))
                    parts = [(h[bounds[p] : bounds[p + 1]], count[bounds[p] : bounds[p + 1]].astype(np.uint32)) for p in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([k] * len(some), pa.int32()), pa.array([_sorted(a) for a, _ in parts], pa.binary()), pa.array([_pack(b) for _, b in parts], pa.binary()), pa.array([len(a) for a, _ in parts], pa.int64())],
                        names=["partition", "batch", "n_gram", "hashes", "counts", "n"],
                    )

    return run


def _bounds(h: np.ndarray, partitions: int) -> np.ndarray:
    """Where each partition's range of hashes begins in sorted h, and its end."""
    width = (1 << 64) // partitions + 1
    return np.concatenate([np.searchsorted(h, np.array([p * width for p in range(partitions)], np.uint64)), [len(h)]])


def _sorted(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, with the high bytes that are zero throughout compressed away."""
    return _pack(np.diff(h, prepend=U(0)))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, n_gram, partition, totals): of one partition of the tables, answers to all the batches that asked it."""

    def answer(at: int, rows: list) -> Iterator[pa.RecordBatch]:
        for k in (0, 1, 2):
            own = [r for r in rows if r[1] == k]
            if not own:
                continue
            h = np.concatenate([r[2] for r in own])
            counts = np.concatenate([r[3] for r in own])
            order = np.argsort(h, kind="stable")
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            group = np.cumsum(new) - 1
            sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
            total = np.empty(len(h), np.int64)
            total[order] = sums[group]
            ends = np.cumsum([len(r[2]) for r in own])
            for r, end in zip(own, ends):
                yield pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([_pack(total[end - len(r[2]) : end])], pa.binary()), pa.array([len(r[2])])], names=["batch", "n_gram", "partition", "totals", "n"])

    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["partition"] != at:
                yield from answer(at, rows)
                at, rows = row["partition"], []
            with np.errstate(over="ignore"):
                rows.append((row["batch"], row["n_gram"], np.cumsum(_unpack(row["hashes"], row["n"], np.uint64)), _unpack(row["counts"], row["n"], np.uint32)))
    yield from answer(at, rows)


def _own(gram: np.ndarray, there: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often the document of each position has the n-gram that ends there."""
    out = np.zeros(len(gram), np.int64)
    with np.errstate(over="ignore"):
        key = mix(gram[there] + doc[there].astype(np.uint64) * U(BASE))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    out[there] = count[inverse]
    return out


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words of each batch. As a function of whole rows, so that it reads the exchange that the others read, not a narrower one."""
    for batch in batches:
        yield batch.select(["n_words"])


def _score(alpha: float):
    def run(key, batch: pa.Table, answers: pa.Table) -> pa.Table:
        rows = batch.to_pylist()
        if not rows:
            return pa.table({k: pa.array([], t) for k, t in _SCORE})
        row = rows[0]
        grams, there, lengths, doc = _grams(row)
        answered = answers.select(["n_gram", "partition", "totals", "n", "corpus"]).sort_by([("n_gram", "ascending"), ("partition", "ascending")]).to_pylist()
        corpus = answered[0]["corpus"] if answered else 0
        rest = []
        for k in range(3):
            # Partitions are ranges of hashes, so their answers in a row are in the order of the sorted hashes.
            totals = np.concatenate([_unpack(r["totals"], r["n"], np.int64) for r in answered if r["n_gram"] == k] or [np.zeros(0, np.int64)])
            h, inverse = np.unique(grams[k][there[k]], return_inverse=True)
            assert len(h) == len(totals), "an answer is missing"
            r = np.zeros(len(doc), np.int64)
            r[there[k]] = totals[inverse]
            rest.append(r - _own(grams[k], there[k], doc))
        one, two, three = rest
        before_one, before_two = np.zeros_like(one), np.zeros_like(two)
        before_one[1:], before_two[1:] = one[:-1], two[:-1]
        words = corpus - lengths[doc]
        p = np.maximum(one, 1) / np.maximum(words, 1)
        seen_two, seen_three = two > 0, three > 0
        p = np.where(seen_two, two / np.maximum(before_one, 1), np.where(there[1], alpha, 1.0) * p)
        p = np.where(seen_three, three / np.maximum(before_two, 1), np.where(there[2], alpha, 1.0) * p)
        first = np.concatenate([[0], np.cumsum(lengths)])
        log = np.concatenate([[0.0], np.cumsum(np.log10(p))]) if len(doc) else np.zeros(1)
        # Sums of each document by itself: a running sum over the batch would lose digits.
        full = np.flatnonzero(lengths)
        score = np.zeros(len(lengths))
        if len(full):
            score[full] = np.add.reduceat(np.log10(p), first[full])
        del log
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
        none = lengths == 0
        return pa.table(
            {
                "doc_id": pa.array(_unpack(row["ids"], row["n_docs"], np.int64), mask=_unpack(row["nulls"], row["n_docs"], np.uint8) > 0),
                "n_words": pa.array(lengths, pa.int64()),
                "n_trigram": pa.array(count(seen_three & there[2]), pa.int64()),
                "n_bigram": pa.array(count(seen_two & ~(seen_three & there[2])), pa.int64()),
                "log10_score": pa.array(np.round(score, 4), mask=none),
                "mean_log10": pa.array(np.round(score / np.maximum(lengths, 1), 6), mask=none),
            }
        )

    return run


_SCORE = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_trigram", pa.int64()), ("n_bigram", pa.int64()), ("log10_score", pa.float64()), ("mean_log10", pa.float64())]


def score_documents(docs: DataFrame, alpha: float = ALPHA, stable: bool = False) -> DataFrame:
    """(doc_id, n_words, n_trigram, n_bigram, log10_score, mean_log10): one row for each row of docs (doc_id: BIGINT, text).

    A word after two others scores c(uvw)/c(uv) if c(uvw) > 0, else alpha*c(vw)/c(v) if c(vw) > 0, else alpha^2*c(w)/N; the
    first two words of a document lack the longer contexts and the factors for them. Counts are those of all rows but the
    scored one; a word that no other row has counts as 1. Words are those of kernels.Words.

    A null, empty or wordless text has n_words 0 and null scores. Repeated rows are documents of their own, that vouch
    for each other; a null doc_id stays null. An empty table gives no rows. Other columns of docs don't matter.

    stable: docs come in the same order whenever they are read, as the rows of a table of files do. Then batches can be made
    again after a loss, and are only shuffled, which saves their copy in the shared folder; else they are cut first.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(_batches, _BATCH)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if stable:
        words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_WORD
        # One exchange, that all that follows reads; a few batches to a task, however large the corpus is.
        packed = packed.repartition(max(least, -(-words // BATCH_WORDS)), "batch")
    else:
        packed = cut(packed)
        words = packed.agg(F.sum("n_words")).first()[0] or 0
        packed = packed.repartition(max(least, -(-words // BATCH_WORDS)), "batch")
    partitions = max(least, -(-words // PARTITION_WORDS))
    requests = packed.mapInArrow(_requests(partitions), "partition int, batch long, n_gram int, hashes binary, counts binary, n long")
    answers = requests.repartition(partitions, "partition").sortWithinPartitions("partition").mapInArrow(_totals, "batch long, n_gram int, partition int, totals binary, n long")
    answers = answers.crossJoin(F.broadcast(packed.mapInArrow(_lengths, "n_words long").agg(F.sum("n_words").alias("corpus"))))  # one row
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(alpha), "doc_id long, n_words long, n_trigram long, n_bigram long, log10_score double, mean_log10 double")


ORACLE = """
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM rows_),
grams AS (SELECT r, i, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM words WINDOW d AS (PARTITION BY r ORDER BY i)),
n1 AS (SELECT r, w, count(*) AS n FROM grams GROUP BY ALL),
n2 AS (SELECT r, v, w, count(*) AS n FROM grams WHERE v IS NOT NULL GROUP BY ALL),
n3 AS (SELECT r, u, v, w, count(*) AS n FROM grams WHERE u IS NOT NULL GROUP BY ALL),
o1 AS (SELECT *, sum(n) OVER (PARTITION BY w) - n AS c FROM n1),
o2 AS (SELECT *, sum(n) OVER (PARTITION BY v, w) - n AS c FROM n2),
o3 AS (SELECT *, sum(n) OVER (PARTITION BY u, v, w) - n AS c FROM n3),
total AS (SELECT count(*) AS n FROM words),
joined AS (
  SELECT g.r, g.i, a.c AS c1, b.c AS c2, t.c AS c3, pa.c AS p1, pb.c AS p2, total.n - len(d.w) AS others
  FROM grams g JOIN rows_ d ON d.r = g.r CROSS JOIN total
  JOIN o1 a ON a.r = g.r AND a.w = g.w
  LEFT JOIN o2 b ON b.r = g.r AND b.v = g.v AND b.w = g.w
  LEFT JOIN o3 t ON t.r = g.r AND t.u = g.u AND t.v = g.v AND t.w = g.w
  LEFT JOIN o1 pa ON pa.r = g.r AND pa.w = g.v
  LEFT JOIN o2 pb ON pb.r = g.r AND pb.v = g.u AND pb.w = g.v),
scored AS (
  SELECT r, coalesce(c3, 0) > 0 AS three, coalesce(c2, 0) > 0 AS two,
    log10(CASE WHEN c3 > 0 THEN c3 / p2
      WHEN c2 > 0 THEN (CASE WHEN i > 2 THEN 0.4::DOUBLE ELSE 1 END) * c2 / p1
      ELSE (CASE WHEN i > 2 THEN 0.4::DOUBLE ELSE 1 END) * (CASE WHEN i > 1 THEN 0.4::DOUBLE ELSE 1 END) * greatest(c1, 1) / greatest(others, 1) END) AS s
  FROM joined)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (three)::BIGINT AS n_trigram, count(*) FILTER (two AND NOT three)::BIGINT AS n_bigram,
  round(sum(s), 4) AS log10_score, round(avg(s), 6) AS mean_log10
FROM rows_ d LEFT JOIN scored USING (r) GROUP BY d.r, d.doc_id
"""
