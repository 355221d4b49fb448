"""The built-in rules over texts as arrays of numbers, for Python workers: pieces of text, and the units of both layers.

Texts are cleaned and looked at as bytes: a piece is a word of letters, a number or a sign. Pieces are numbered by a lexicon, which
applies the rules to each different one. Units are then numbers too, and counts and neighbours are operations on arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd

from corpuscle.functions.clean import clean_text
from corpuscle.operators.tagger import DS_SUFFIXES, DS_UNITS, DS_WORDS, POS_SUFFIXES, POS_UNITS, POS_WORDS

#: Kinds of ASCII characters: 0 space (and what stands between documents), 1 letter, 2 digit, 3 sign.
KIND = np.array([0 if chr(c) in " \n" else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(128)], np.uint8)
LOWER = np.array([ord(chr(c).lower()) for c in range(128)], np.uint8)
#: The first bytes of a word of eight, by their number.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SIGNS = re.compile("[!-/:-@\\[-`{-~ ]+")
#: White space as regular expressions have it.
SPACES = " \t\n\x0b\f\r"
#: Different pieces that a lexicon holds; with more it begins anew.
MOST_PIECES = 300_000

_WORDS = {"pos": {w: t for t, some in POS_WORDS.items() for w in some.split()}, "ds": {w: t for t, some in DS_WORDS.items() for w in some.split()}}
_SUFFIXES = {"pos": POS_SUFFIXES, "ds": DS_SUFFIXES}
_NUMBER = {"pos": "MC", "ds": "InformationExposition"}
_SIGN = {"pos": "Y", "ds": "Untagged"}
_ELSE = {"pos": "NN1", "ds": "Untagged"}
_PAIRS = {"pos": POS_UNITS, "ds": DS_UNITS}
#: Words that a rule looks for beside others, by numbers from 1.
_CODES = {w: k for k, w in enumerate(sorted({"it", "s", *(w for pairs in _PAIRS.values() for pair in pairs for w in pair)}), 1)}
_BASE = len(_CODES) + 1


def _endings(layer: str) -> dict[str, tuple[str, str]]:
    """(suffix, tag) by the last two letters, of suffixes of more than one."""
    found = {s[-2:]: (s, t) for s, t in _SUFFIXES[layer] if len(s) > 1}
    assert len(found) == sum(len(s) > 1 for s, _ in _SUFFIXES[layer])
    return found


_ENDINGS = {layer: _endings(layer) for layer in _SUFFIXES}
_LAST = {layer: {s: t for s, t in some if len(s) == 1} for layer, some in _SUFFIXES.items()}


def tag_of(word: str, layer: str) -> str:
    """The tag of a word in lower case that is in no unit of several words."""
    tag = _WORDS[layer].get(word)
    if tag is not None:
        return tag
    first = word[:1]
    if not "a" <= first <= "z":
        return _NUMBER[layer] if "0" <= first <= "9" else _SIGN[layer]
    suffix, tag = _ENDINGS[layer].get(word[-2:], ("", ""))
    if suffix and len(word) > len(suffix) and word.endswith(suffix):
        return tag
    return _LAST[layer].get(word[-1], _ELSE[layer]) if len(word) > 1 else _ELSE[layer]


class Units:
    """The units of a layer by number: token (lower case, stripped), tag, and whether it counts, has letters, and is a hit."""

    def __init__(self, layer: str, hit: Callable[[str, str], bool] | None = None):
        self.layer, self.is_hit = layer, hit
        self.token: list[str] = []
        self.tag: list[str] = []
        self._counts, self._letters, self._hit = bytearray(), bytearray(), bytearray()

    def __len__(self) -> int:
        return len(self.token)

    def add(self, token: str, tag: str) -> int:
        self.token.append(token)
        self.tag.append(tag)
        self._counts.append(tag != "Y" if self.layer == "pos" else tag != "Untagged" or SIGNS.fullmatch(token) is None)
        self._letters.append("a" <= token[0] <= "z")
        self._hit.append(self.is_hit is not None and bool(self.is_hit(token, tag)))
        return len(self.token) - 1

    def counts(self) -> np.ndarray:
        return np.frombuffer(bytes(self._counts), bool)

    def letters(self) -> np.ndarray:
        return np.frombuffer(bytes(self._letters), bool)

    def hits(self) -> np.ndarray:
        return np.frombuffer(bytes(self._hit), bool)


@dataclass
class Docs:
    """Documents as the numbers of their pieces: those of document k are at bounds[k] to bounds[k + 1]; begins and ends are places in
    text, all documents' in a row."""

    ids: list[str]
    text: str
    begins: np.ndarray
    ends: np.ndarray
    numbers: np.ndarray
    bounds: np.ndarray
    previous: list[list[dict]]
    next: list[list[dict]]

    def written(self, first: int, stop: int) -> str:
        """Pieces of one document from first up to stop as they are written, with the space after them."""
        if first >= stop:
            return ""
        end = int(self.ends[stop - 1])
        return self.text[self.begins[first] : end + (self.text[end] == " ")]


@dataclass
class Run:
    """Units of documents: unit k begins at the piece starts[k]; those of a document are at bounds[k] to bounds[k + 1]."""

    units: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray

    def where(self, keep: np.ndarray) -> "Run":
        return Run(self.units[keep], self.starts[keep], np.concatenate([[0], np.cumsum(keep)])[self.bounds])

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.sizes())


def numbered(words: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 of equal values, and how many there are."""
    codes, different = pd.factorize(words)
    return codes, len(different)


class Lexicon(dict):
    """Numbers of pieces in lower case, and what the rules say of each on one layer."""

    def __init__(self, layer: str, hit: Callable[[str, str], bool] | None = None, first_words: bool = False):
        """first_words: a unit of several words is known by the first one."""
        super().__init__()
        self.layer, self.units = layer, Units(layer, hit)
        #: Units that aren't a piece with its own tag come first; the unit of piece k has the number k + len(others).
        self.others: dict[tuple[str, str], int] = {}
        self._pairs: dict[int, int] = {}
        for (a, b), tag in _PAIRS[layer].items():
            self._pairs[_CODES[a] * _BASE + _CODES[b]] = self._other(a if first_words else f"{a} {b}", tag)
        self._possessive = self._other("s", "GE") if layer == "pos" else None
        self._code = bytearray()

    def _other(self, token: str, tag: str) -> int:
        assert tag_of(token, self.layer) != tag
        self.others[token, tag] = k = self.units.add(token, tag)
        return k

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        self.units.add(piece, tag_of(piece, self.layer))
        self._code.append(_CODES.get(piece, 0))
        return k

    def unit(self, token: str, tag: str) -> int:
        """The number of a unit that a lexicon of the same layer has given."""
        k = self.others.get((token, tag))
        return self[token] + len(self.others) if k is None else k

    def read(self, ids: list[str], texts: list[str], previous: list | None = None, next_: list | None = None, clean: bool = False) -> Docs:
        """clean: the texts are clean already."""
        texts = texts if clean else [clean_text(t) for t in texts]
        text = "\n".join(texts) + "\n"
        data = np.zeros(len(text) + 8, np.uint8)
        data[:-8] = np.frombuffer(text.encode("ascii"), np.uint8)
        kind, data = KIND[data[:-8]], LOWER[data]
        begins = kind > 0
        begins[1:] &= (kind[1:] == 3) | (kind[1:] != kind[:-1])
        stops = kind > 0
        stops[:-1] &= begins[1:] | (kind[1:] == 0)
        begins, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        size = ends - begins
        at = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))  # eight bytes from each place on
        numbers = np.empty(len(begins), np.int64)
        lower = data[:-8].tobytes().decode("ascii")
        for low, high in ((0, 8), (8, 16)):
            some = np.flatnonzero((size > low) & (size <= high))
            if len(some):
                codes, n = numbered(at[begins[some]] & MASK[np.minimum(size[some], 8)])
                if low:
                    more, m = numbered(at[begins[some] + 8] & MASK[size[some] - 8])
                    codes, n = numbered(codes * m + more)
                first = np.empty(n, np.int64)
                first[codes[::-1]] = some[::-1]
                numbers[some] = np.array([self[lower[a:b]] for a, b in zip(begins[first].tolist(), ends[first].tolist())], np.int64)[codes]
        some = np.flatnonzero(size > 16)
        numbers[some] = [self[lower[a:b]] for a, b in zip(begins[some].tolist(), ends[some].tolist())]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return Docs(ids, text, begins, ends, numbers, np.searchsorted(begins, starts), previous or [], next_ or [])

    def run(self, docs: Docs) -> Run:
        """All units of docs."""
        units = docs.numbers + len(self.others)
        code = np.frombuffer(bytes(self._code), np.uint8)[docs.numbers]
        keep = np.ones(len(units), bool)
        beside = np.zeros(len(units), bool)
        beside[:-1] = (code[:-1] > 0) & (code[1:] > 0)
        sizes = np.diff(docs.bounds)
        beside[docs.bounds[1:][sizes > 0] - 1] = False  # a document's last piece has none after it
        at = np.flatnonzero(beside)
        pair = code[at].astype(np.int64) * _BASE + code[at + 1]
        for key, unit in self._pairs.items():
            own = at[pair == key]
            units[own] = unit
            keep[own + 1] = False
        if self._possessive is not None:
            units[at[pair == _CODES["it"] * _BASE + _CODES["s"]] + 1] = self._possessive
        return Run(units, np.arange(len(units)), docs.bounds).where(keep)
