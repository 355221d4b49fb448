"""Vectorised text kernels shared by the operators of this subpackage.

Every operator that reads running text works on the UTF-8 bytes of an Arrow string array: classes of bytes, word
bounds, hashes and per-row sums are numpy expressions over whole blocks of documents, with no Python loop per word.
Blocks are bounded in bytes (a single longer text makes a block of its own), so memory doesn't grow with a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2_000_000

U = np.uint64
_mult = 0x9E3779B97F4A7C15
#: An odd multiplier for position powers, and its inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)

#: Bytes of words: ASCII letters and digits, and all of a character beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
WORD_BYTE[128:] = True

#: The same words as a regular expression, as RE2 has it in DuckDB.
WORD_RE2 = "[a-z0-9\\x{80}-\\x{10FFFF}]+"

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse for positions 0 to n-1."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            step = np.full(size, U(BASE))
            step[0] = 1
            _powers = np.cumprod(step)
            step[:] = U(BASE_INV)
            step[0] = 1
            _inverse = np.cumprod(step)
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n+1 bounds of its rows within them; a null row is empty."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    if strings.null_count:
        strings = pc.fill_null(strings, "")
    if pa.types.is_large_string(strings.type):
        kind = np.int64
    else:
        strings, kind = strings.cast(pa.string()), np.int32
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    bounds = np.frombuffer(offsets, kind, n + 1, strings.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(bounds[-1] - bounds[0])
    body = np.frombuffer(data, np.uint8, size, int(bounds[0])) if size else np.zeros(0, np.uint8)
    return body, bounds - bounds[0]


def blocks(strings: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of rows of about limit bytes each, one row at least."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    lengths = pc.fill_null(pc.binary_length(strings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


class Words:
    """Words of a block: starts and ends within body, row of each, first word of each row.

    A word is a maximal run of ASCII letters and digits and of characters beyond ASCII, of the text in lower case.
    """

    def __init__(self, strings: pa.Array, lower: bool = True):
        if lower:
            strings = pc.utf8_lower(strings)
        self.body, self.bounds = raw(strings)
        n = len(self.body)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = WORD_BYTE[self.body]
        flips = inside[1:] != inside[:-1]
        # A word ends with its row, also where the next row starts with a word.
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
        edges = np.flatnonzero(flips)
        if len(cuts):
            edges = np.sort(np.concatenate([edges, cuts, cuts]))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words' bytes, equal for equal words anywhere."""
        n = len(self.body)
        power, inverse = _grown(n + 1)
        with np.errstate(over="ignore"):
            prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(BYTE_CODE[self.body] * power[:n], out=prefix[1:])
            h = (prefix[self.ends] - prefix[self.starts]) * inverse[self.starts]
            return mix(h + (self.ends - self.starts).astype(np.uint64) * U(_mult))

    def grams(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each position on; positions with fewer left in their row count as well, see valid()."""
        out = h.copy()
        with np.errstate(over="ignore"):
            for k in range(1, n):
                shifted = np.zeros_like(h)
                shifted[: len(h) - k] = h[k:] if k < len(h) else 0
                out = mix(out * U(BASE) + shifted + U(k))
        return out

    def valid(self, n: int) -> np.ndarray:
        """Whether n words are left in the row from each position on."""
        left = self.first[1:][self.row] - np.arange(len(self.starts))
        return left >= n


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over rows [first[i], first[i+1]); values may have columns."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())
