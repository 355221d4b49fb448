"""Removed words against all substrings of all items."""

import re

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import decontaminate as d
from corpuscle.llm.kernels import Words


def words(t):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def plain(text, items, **limits):
    """Which words of text go: those of a stretch that lies within one item and reaches its limit; the longest stretch of limits' least length."""
    t = words(text)
    gone, longest = [False] * len(t), 0
    floor = limits.get("floor", d.FLOOR)
    own = [(words(i), d.limit(len(words(i)), **limits)) for i in items if len(words(i)) >= floor]
    least = min((n for _, n in own), default=0)
    for item, need in own:
        for i in range(len(t)):
            for j in range(len(item)):
                n = 0
                while i + n < len(t) and j + n < len(item) and t[i + n] == item[j + n]:
                    n += 1
                if n >= least:
                    longest = max(longest, n)
                if n >= need:
                    gone[i : i + n] = [True] * n
    return gone, longest


@pytest.mark.parametrize("size", [200_000, 25])
def test_against_all_substrings(monkeypatch, size):
    monkeypatch.setattr(d, "AUTOMATON_WORDS", size)
    r = np.random.default_rng(1)
    limits = {"length": 5, "coverage": 0.5, "floor": 3}
    for _ in range(25):
        letters = list("abc") if r.integers(0, 2) else list("abcdefgh")
        items = [" ".join(r.choice(letters, int(r.integers(1, 14)))) for _ in range(6)]
        texts = [" ".join(r.choice(letters, int(r.integers(0, 40)))) for _ in range(8)] + [f"x y {items[0]} z"]
        screen = d.Screen(pa.array(items), **limits)
        w = Words(pa.array(texts))
        gone, longest = screen.removed(w)
        for i, t in enumerate(texts):
            expected, most = plain(t, items, **limits)
            assert gone[w.first[i] : w.first[i + 1]].tolist() == expected, (items, t)
            assert longest[i] == most, (items, t)


ITEM = "What is the name of the tallest mountain on the southern continent, and who climbed it first of all?"
SHORT = "Name seven rivers of the old world"
CLEAN = "The mountain is tall, and the name of the river is not known to anybody on the continent."


def test_documents(spark):
    items = spark.createDataFrame([(1, ITEM), (2, SHORT), (3, None), (4, ITEM), (5, "two words")], "item_id long, text string")
    rows = [(1, f"Before. {ITEM.upper()} After."), (2, CLEAN), (3, None), (4, ""), (5, SHORT), (6, "ü " * 150_000 + ITEM), (None, "See: name seven   rivers,of the old and so on"), (2, CLEAN), (7, "two words")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, __words int")
    out = {r["doc_id"]: r for r in d.decontaminate(df, items).collect()}
    assert out[1]["text"] == "Before. ? After." and out[1]["__spans"] == 1 and out[1]["__words"] == len(words(ITEM)) == out[1]["__longest"]
    assert out[2]["text"] == CLEAN and out[2]["__words"] == 0 and out[7]["text"] == "two words"
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == ""
    assert out[6]["text"] == "ü " * 150_000 + "?"
    assert out[None]["text"] == "See:  and so on" and out[None]["__words"] == 6
    for i, t in rows:
        gone, longest = plain(t, [ITEM, SHORT]) if len(t or "") < 1000 else ([True] * len(words(ITEM)), len(words(ITEM)))
        assert (out[i]["__words"], out[i]["__longest"]) == (sum(gone), longest)
    assert d.decontaminate(df.where("false"), items).count() == 0
    assert [r["__words"] for r in d.decontaminate(df.drop("__words"), items.where("false")).collect()] == [0] * len(rows)


def test_items_of_several_broadcasts(spark):
    r = np.random.default_rng(3)
    limits = {"length": 5, "coverage": 0.5, "floor": 3}
    items = [" ".join(r.choice(list("abcdef"), int(r.integers(1, 14)))) for _ in range(12)]
    texts = [" ".join(r.choice(list("abcdef"), int(r.integers(0, 60)))) for _ in range(30)] + [None, "", items[0] + " x " + items[1]]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, __gone binary")
    table = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    one, several = (sorted(map(tuple, d.decontaminate(docs, table, broadcast_words=n, **limits).collect())) for n in (10**6, 20))
    assert one == several and sum(x[3] for x in one) > 0
    for (i, text, _, removed, longest), t in zip(one, texts):
        gone, most = plain(t, items, **limits)
        assert (removed, longest) == (sum(gone), most)
        assert words(text) == [w for w, g in zip(words(t), gone) if not g]
