"""Secret scans by sliding-window Shannon entropy.

Candidates are the maximal runs of the bytes of base64 and its URL form, SHORTEST or more, that hold a digit; they are
found by vectorised comparison. For each class of characters, a window slides over the candidate's runs of that class; its
entropy is kept up by adding one character's count and subtracting another's. A run is a secret if a window reaches
the class's threshold and the run mixes kinds of characters, and no pattern of the allow-list is found in the candidate.
A run shorter than WINDOW is one window of its own length, and its threshold is less as the highest entropy is. Most of it
must be in parts between = / _ - that mix digits and letters, else dates and numbered headings would be secrets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.kernels import blocks, raw, texts
from corpuscle.plans.runtime import ship

WINDOW = 20
LEAST = WINDOW
SHORTEST = 12
#: class: (its runs, kinds of characters a run must have, threshold in bits of a window's entropy)
CLASSES = {
    "hex": (re.compile(rb"[0-9a-fA-F]{20,}"), (rb"[0-9]", rb"[a-fA-F]"), 2.8),
    "base64": (re.compile(rb"[A-Za-z0-9+/=_-]{20,}"), (rb"[0-9]", rb"[a-z]", rb"[A-Z]"), 3.6),
    "upper": (re.compile(rb"[A-Z0-9]{20,}"), (rb"[0-9]", rb"[A-Z]"), 3.4),
    "lower": (re.compile(rb"[a-z0-9]{20,}"), (rb"[0-9]", rb"[a-z]"), 3.5),
}
#: Identifiers that are public by nature, and stand-ins of documentation.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|placeholder|changeme|dummy|xxxxxxxx",
    "(?i)0123456789abcdef|abcdefghijklmnop",
    "^(sha1|sha256|sha384|sha512|md5)[-_=]",
)
MASK = "[SECRET]"

_ALLOWED = [re.compile(p.encode()) for p in ALLOWED]
_BYTE = np.zeros(256, bool)
_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
#: Maximal runs of SHORTEST bytes or more, of each class.
_RUNS = {name: re.compile(runs.pattern.replace(b"{20,}", b"{%d,}" % SHORTEST)) for name, (runs, _, _) in CLASSES.items()}
_UUID = re.compile(ALLOWED[0].strip("^$").encode())
_PARTS = re.compile(rb"[A-Za-z0-9+]+")
_N_LOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def highest_entropy(run: bytes, window: int = WINDOW) -> float:
    """The highest entropy, in bits, of the windows of run (of window bytes at least)."""
    counts = [0] * 256
    total = 0.0  # of n log n over the counts in the window
    least = None
    for i, c in enumerate(run):
        n = counts[c]
        counts[c] = n + 1
        total += _N_LOG[n + 1] - _N_LOG[n]
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += _N_LOG[n - 1] - _N_LOG[n]
        if i >= window - 1 and (least is None or total < least):
            least = total
    return math.log2(window) - least / window


def _mixed(run: bytes) -> bool:
    """Whether half of run or more is in parts that hold digits and letters."""
    return 2 * sum(len(p) for p in _PARTS.findall(run) if re.search(rb"[0-9]", p) and re.search(rb"[A-Za-z]", p)) >= len(run)


def judge(candidate: bytes) -> tuple[str, float] | None:
    """(class, entropy) if the candidate is a secret: of the first class in which a run of it is, the highest entropy.

    Runs of WINDOW or more come before shorter ones.
    """
    if any(p.search(candidate) for p in _ALLOWED):
        return None
    for name, (runs, kinds, threshold) in CLASSES.items():
        best = max((highest_entropy(r) for r in runs.findall(candidate) if all(re.search(k, r) for k in kinds)), default=0.0)
        if best >= threshold:
            return name, round(best, 6)
    rest = _UUID.sub(b" ", candidate)
    for name, (_, kinds, threshold) in CLASSES.items():
        best = 0.0
        for r in _RUNS[name].findall(rest):
            if len(r) < WINDOW and all(re.search(k, r) for k in kinds) and _mixed(r):
                e = highest_entropy(r, len(r))
                if e >= threshold * math.log2(len(r)) / math.log2(WINDOW):
                    best = max(best, e)
        if best:
            return name, round(best, 6)
    return None


def scan(strings: pa.Array) -> list[tuple[int, int, int, str, float, bytes]]:
    """(row, from, to, class, entropy, candidate) of each secret in the texts; from and to are bytes of the block."""
    body, bounds = raw(strings)
    n = len(body)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = _BYTE[body]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[body], dtype=np.int64)])
    some = digits[ends] > digits[starts]
    found = []
    memo: dict[bytes, tuple[str, float] | None] = {}
    rows = np.searchsorted(bounds, starts[some], side="right") - 1
    for row, a, b in zip(rows.tolist(), starts[some].tolist(), ends[some].tolist()):
        # A run that goes on into the next rows is cut where they begin.
        while a < b:
            stop = min(b, int(bounds[row + 1]))
            if stop - a >= SHORTEST:
                candidate = body[a:stop].tobytes()
                if _DIGIT[body[a:stop]].any():
                    if candidate not in memo:
                        memo[candidate] = judge(candidate)
                    if memo[candidate]:
                        found.append((row, a, stop, *memo[candidate], candidate))
            a, row = stop, row + 1
            while a < b and bounds[row + 1] <= a:
                row += 1
    return found


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "kind", "length", "entropy", "fingerprint"]
    for batch in batches:
        column, ids = texts(batch), batch.column(0)
        for a, b in blocks(column):
            found = scan(column.slice(a, b - a))
            own = ids.slice(a, b - a).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array([x[3] for x in found], pa.string()), pa.array([x[2] - x[1] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.float64()), pa.array([hashlib.md5(x[5]).hexdigest() for x in found], pa.string())], names=names)


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, length, entropy, fingerprint): a row for each secret in each row of docs (doc_id: BIGINT, text).

    kind is the class that found it, entropy its highest window's, fingerprint the MD5 of the secret, which itself is
    not in the result. A secret that occurs twice gives two rows, and so does a repeated document. Null and empty
    texts give none; a null doc_id stays null. Other columns of docs don't matter.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_findings, "doc_id long, kind string, length long, entropy double, fingerprint string")


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = texts(batch)
        place = batch.schema.get_field_index("text")
        for a, b in blocks(column):
            part = column.slice(a, b - a)
            found = scan(part)
            counts = np.zeros(b - a, np.int64)
            text = part
            if found:
                body, bounds = raw(part)
                spans: dict[int, list[tuple[int, int]]] = {}
                for row, lo, hi, *_ in found:
                    spans.setdefault(row, []).append((lo, hi))
                values = part.to_pylist()
                for row, own in spans.items():
                    counts[row] = len(own)
                    at, pieces = int(bounds[row]), []
                    for lo, hi in own:
                        pieces += [body[at:lo].tobytes(), MASK.encode()]
                        at = hi
                    pieces.append(body[at : int(bounds[row + 1])].tobytes())
                    values[row] = b"".join(pieces).decode()
                text = pa.array(values, pa.string())
            rest = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*(text if k == place else rest.column(k) for k in range(rest.num_columns)), pa.array(counts)], names=[*rest.schema.names, "__secrets"])


def mask(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs (with text: STRING), each secret in text replaced by MASK, and their number as __secrets."""
    from pyspark.sql.types import LongType, StructType

    ship(docs.sparkSession)
    docs = docs.drop("__secrets")
    return docs.mapInArrow(_mask, StructType([*docs.schema.fields]).add("__secrets", LongType()))


#: The classes hex and base64 in runs of WINDOW or more: no capitals or small letters with digits alone, no shorter runs.
ORACLE = f"""
WITH found AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{{LEAST},}}')) AS c FROM documents),
allowed AS (SELECT row_number() OVER () AS k, * FROM found WHERE regexp_matches(c, '[0-9]') AND NOT ({' OR '.join(f"regexp_matches(c, '{p}')" for p in ALLOWED)})),
runs AS (
  SELECT k, 'hex' AS kind, unnest(regexp_extract_all(c, '[0-9a-fA-F]{{20,}}')) AS run FROM allowed
  UNION ALL SELECT k, 'base64', unnest(regexp_extract_all(c, '[A-Za-z0-9+/=_-]{{20,}}')) FROM allowed),
mixed AS (
  SELECT row_number() OVER () AS j, * FROM runs
  WHERE CASE kind WHEN 'hex' THEN regexp_matches(run, '[0-9]') AND regexp_matches(run, '[a-fA-F]')
    ELSE regexp_matches(run, '[0-9]') AND regexp_matches(run, '[a-z]') AND regexp_matches(run, '[A-Z]') END),
windows AS (SELECT j, k, kind, s, substr(run, s, {WINDOW}) AS w FROM (SELECT *, unnest(range(1, length(run) - {WINDOW} + 2)) AS s FROM mixed)),
chars AS (SELECT j, k, kind, s, unnest(string_split(w, '')) AS ch FROM windows),
counts AS (SELECT j, k, kind, s, ch, count(*)::DOUBLE AS n FROM chars GROUP BY ALL),
entropy AS (SELECT k, kind, s, -sum(n / {WINDOW} * log2(n / {WINDOW})) AS e FROM counts GROUP BY j, k, kind, s),
best AS (SELECT k, kind, max(e) AS e FROM entropy GROUP BY k, kind),
chosen AS (SELECT k, min_by(kind, kind = 'base64') AS kind, min_by(e, kind = 'base64') AS e FROM best WHERE e >= CASE kind WHEN 'hex' THEN 2.8 ELSE 3.6 END GROUP BY k)
SELECT doc_id, kind, length(c)::BIGINT AS length, round(e, 6) AS entropy, md5(c) AS fingerprint FROM chosen JOIN allowed USING (k)
"""
