"""Language identification of mixed-language text.

The script of a word, from the ranges of its characters, narrows the candidates: scripts of one language decide it, Latin
leaves the trained languages. Each word scores under each of them by a table of hashed character trigrams, trained from
labelled documents; Viterbi with a penalty for switching labels the words, and runs of one label are spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.kernels import Words, blocks, texts
from corpuscle.plans.runtime import ship

BUCKETS = 1 << 16
SWITCH = 12.0  # in nats: a word's worth of evidence is some 2 to 10
MOST = 20.0  # that a single Latin word can tell against a language: less than going there and back
TRAIN_DOCS = 2000  # labelled documents that the tables are trained on, at most
#: Scripts by their first characters' UTF-8 bytes, and the language that each decides.
SCRIPTS = {"el": "Greek", "ru": "Cyrillic", "he": "Hebrew", "ar": "Arabic", "hi": "Devanagari", "th": "Thai", "ja": "Kana", "zh": "Han", "ko": "Hangul"}
_OTHER = list(SCRIPTS)
LATIN = len(_OTHER)

# By the first two bytes of a character, the script: an index of _OTHER, LATIN, or -1 (no letter).
_TWO = np.full((256, 256), -1, np.int8)
for _b in (*range(65, 91), *range(97, 123)):
    _TWO[_b] = LATIN
for _first, _last, _script in ((0xC3, 0xCA, LATIN), (0xCD, 0xCF, 0), (0xD0, 0xD3, 1), (0xD6, 0xD7, 2), (0xD8, 0xDB, 3)):
    _TWO[_first : _last + 1] = _script
_TWO[0xE1, 0xB8:0xBC] = LATIN
_TWO[0xE1, 0xBC:0xC0] = 0
_TWO[0xE0, 0xA4:0xA6] = 4
_TWO[0xE0, 0xB8:0xBA] = 5
_TWO[0xE3, 0x81:0x84] = 6
_TWO[0xE3, 0x90:0xC0] = 7
_TWO[0xE4:0xEA] = 7
_TWO[0xEA, 0xB0:0xC0] = 8
_TWO[0xEB:0xED] = 8
_TWO[0xED, 0x80:0x9F] = 8


class Tables:
    """Log probabilities of hashed trigrams of bytes for each trained language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table.astype(np.float32)
        self.labels = [*_OTHER, *languages]

    @staticmethod
    def train(strings: pa.Array, labels: list[str]) -> "Tables":
        languages = sorted(set(labels))
        counts = np.full((BUCKETS, len(languages)), 0.5)
        which = np.array([languages.index(x) for x in labels])
        for a, b in blocks(strings):
            w = Words(strings.slice(a, b - a))
            bucket, word = _trigrams(w)
            for k in range(len(languages)):
                counts[:, k] += np.bincount(bucket[which[a:b][w.row[word]] == k], minlength=BUCKETS)
        return Tables(languages, np.log(counts / counts.sum(axis=0)))


def _trigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each word with its two edges, one for each of its bytes, and the words that they are of."""
    lengths = w.ends - w.starts
    word = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths - w.starts, lengths)
    padded = np.concatenate([[0], w.body, [0]]).astype(np.uint32)
    middle = padded[at + 1]
    before = np.where(at == w.starts[word], 1, padded[at])
    after = np.where(at == w.ends[word] - 1, 1, padded[at + 2])
    key = (before << np.uint32(16)) | (middle << np.uint32(8)) | after
    return (key * np.uint32(2654435761)) >> np.uint32(16), word


def _scripts(w: Words) -> np.ndarray:
    """The script of each word: that of its first letter that isn't Latin, else LATIN, or -1 without letters."""
    padded = np.concatenate([w.body, [0]])
    out = np.full(len(w), -1, np.int64)
    if not len(w):
        return out
    script = _TWO[padded[:-1], padded[1:]]
    # A byte within a character is none of its own: it would read as the first of another.
    script[(w.body & 0xC0) == 0x80] = -1
    latin = np.concatenate([[0], np.cumsum(script == LATIN)])
    out[latin[w.ends] > latin[w.starts]] = LATIN
    other = np.flatnonzero((script >= 0) & (script < LATIN))
    if len(other):
        first = np.searchsorted(other, w.starts)
        some = first < len(other)
        some[some] = other[first[some]] < w.ends[some]
        out[some] = script[other[first[some]]]
    # Han next to Kana is Japanese: a word of Han with any Kana in it.
    kana = np.concatenate([[0], np.cumsum(script == 6)])
    out[(out == 7) & (kana[w.ends] > kana[w.starts])] = 6
    return out


def scores(w: Words, tables: Tables) -> np.ndarray:
    """Of each word under each label: its sum of log probabilities less that of the best label; 0 for all without letters."""
    n, k = len(w), len(tables.labels)
    out = np.full((n, k), -1e4, np.float64)
    script = _scripts(w)
    bucket, word = _trigrams(w)
    latin = script == LATIN
    if tables.languages and latin.any():
        use = latin[word]
        bucket, word = bucket[use], word[use]
        each = np.empty((n, len(tables.languages)))
        for j in range(len(tables.languages)):
            each[:, j] = np.bincount(word, weights=tables.table[bucket, j], minlength=n)
        each -= each.max(axis=1, keepdims=True)
        out[latin, len(_OTHER) :] = np.maximum(each[latin], -MOST)
    single = (script >= 0) & (script < LATIN)
    out[np.flatnonzero(single), script[single]] = 0
    out[script < 0] = 0
    return out - out.max(axis=1, keepdims=True) if n else out


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The label of each word on the best path through its row; ties go to the least label, and to staying."""
    n, k = score.shape
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    starts, lengths = first[:-1][order], lengths[order]
    back = np.zeros((n, k), np.int8 if k < 128 else np.int16)
    path = np.zeros(n, np.int64)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest + 1), side="left")
    v = score[starts].copy()
    for t in range(1, longest):
        m = active[t]
        at = starts[:m] + t
        best = v[:m].argmax(axis=1)
        other = v[np.arange(m), best] - switch
        move = other[:, None] > v[:m]
        back[at] = np.where(move, best[:, None], np.arange(k))
        v[:m] = np.where(move, other[:, None], v[:m]) + score[at]
    last = v.argmax(axis=1) if len(v) else np.zeros(0, np.int64)
    label = last.copy()
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        path[at] = label[:m]
        label[:m] = back[at, label[:m]]
    return path


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Tables:
    """Tables from at most train_docs rows with a lang, of the least hashes of doc_id; without any, none for Latin."""
    known = docs.where("lang IS NOT NULL AND lang <> '' AND length(text) > 0")
    ids = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    if ids is None:
        return Tables([], np.zeros((BUCKETS, 0)))
    rows = known.where(F.xxhash64("doc_id") <= ids).select(F.col("text").cast("string"), F.col("lang").cast("string"), "doc_id").orderBy(F.xxhash64("doc_id"), "text", "lang").limit(train_docs).toArrow()
    return Tables.train(rows["text"].combine_chunks(), rows["lang"].to_pylist())


def _apply(model, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.value
        names = np.array([*tables.labels, "und"], dtype=object)
        for batch in batches:
            column, ids = texts(batch), batch.column(0)
            for a, b in blocks(column):
                w = Words(column.slice(a, b - a))
                n = b - a
                plain = Words(column.slice(a, b - a), lower=False)
                score = scores(w, tables)
                path = viterbi(score, w.first, switch)
                none = ~(np.diff(np.concatenate([[0], np.cumsum((score < 0).any(axis=1))])[w.first]) > 0)
                path[none[w.row]] = len(tables.labels)  # no word of the row has evidence
                head = np.ones(len(path), bool)
                head[1:] = (path[1:] != path[:-1]) | (w.row[1:] != w.row[:-1])
                at = np.flatnonzero(head)
                stop = np.append(at[1:], len(path))[: len(at)]
                row = w.row[at]
                # Characters, not bytes: those that don't go on a character.
                chars = np.concatenate([[0], np.cumsum((plain.body & 0xC0) != 0x80)])
                base = chars[plain.bounds[:-1]][row]
                begin, end = chars[plain.starts[at]] - base, chars[plain.ends[stop - 1]] - base
                spans = pa.StructArray.from_arrays([pa.array(names[path[at]], pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(stop - at, pa.int64())], names=["lang", "start", "end", "words"])
                offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                words = np.zeros((n, len(names)), np.int64)
                np.add.at(words, (row, path[at]), stop - at)
                main = names[words.argmax(axis=1)]
                main[w.counts == 0] = "und"
                yield pa.RecordBatch.from_arrays([ids.slice(a, n), pa.array(main, pa.string()), pa.array((words > 0).sum(axis=1), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["doc_id", "main_lang", "n_langs", "spans"])

    return run


def identify(docs: DataFrame, switch: float = SWITCH, train_docs: int = TRAIN_DOCS, tables: Tables | None = None) -> DataFrame:
    """(doc_id, main_lang, n_langs, spans) for each row of docs (doc_id, text, lang).

    spans: array of (lang, start, end, words), start and end in characters, end exclusive, over all words of the text in
    order. main_lang has the most words (of a tie the first label in SCRIPTS, then in the alphabet). A text without letters
    that tell languages apart, a null or empty one is und; the latter has no spans. lang labels the training rows alone and may be null.
    Repeated rows give equal results; an empty table gives no rows.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(tables or fit(docs, train_docs))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_apply(model, switch), f"doc_id {doc_id}, main_lang string, n_langs long, spans array<struct<lang: string, start: long, end: long, words: long>>")
