"""Forward-backward against all labellings, decisions against held-out labels."""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from corpuscle.llm import linecrf

DATA = "/root/testdata/sf0.01"


def brute(emission, transition):
    n = len(emission)
    weight, pairs, good = 0.0, np.zeros((2, 2)), np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(emission[i] * y[i] for i in range(n)) + sum(transition[a, b] for a, b in zip(y, y[1:])))
        weight += w
        good += w * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w
    return good / weight, pairs / weight


def test_marginals():
    r = np.random.default_rng(1)
    lengths = [3, 0, 1, 6, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    emission, transition = r.normal(size=first[-1]), r.normal(size=(2, 2))
    p, pairs = linecrf.marginals(emission, transition, first, True)
    expected = [brute(emission[a:b], transition) for a, b in zip(first, first[1:]) if b > a]
    assert np.allclose(p, np.concatenate([e for e, _ in expected]))
    assert np.allclose(pairs, sum(e for _, e in expected))


def test_lines_of_rows():
    lines = linecrf.Lines(pa.array(["one\ntwo words\n\n  \nthree", None, "", "\n\n", "last\n"]))
    assert lines.row.tolist() == [0, 0, 0, 4] and lines.size.tolist() == [3, 9, 5, 4]
    assert lines.first.tolist() == [0, 3, 3, 3, 3, 4]


def test_held_out_accuracy():
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    labels = pq.read_table(f"{DATA}/labels.parquet", columns=["doc_id", "quality"]).to_pandas().dropna()
    both = docs.merge(labels, on="doc_id")
    y = both["quality"].to_numpy(int)
    train = np.arange(len(both)) % 2 == 0
    field = linecrf.LineField.train(pa.array(both["text"][train]), y[train])
    quality, _, _ = field.score(pa.array(both["text"][~train]))
    decided = np.nan_to_num(quality) >= linecrf.THRESHOLD
    assert (decided == y[~train]).mean() >= 0.9
    assert decided[y[~train] == 1].mean() >= 0.95


GOOD = "The river rose slowly in the spring, and the town waited for it.\nNobody spoke of the old bridge any more."
BAD = "BUY NOW!!! $$$ CLICK CLICK CLICK\n|||| 99 | 99 | 99 ||||\n### FREE FREE FREE !!!"


def test_quality_is_weighted_by_length(spark):
    rows = [(i, (GOOD if i % 2 else BAD) + f"\nline {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(999, 1), (None, 1)], "doc_id long, quality int")
    odd = [(100, None), (101, ""), (102, " \n\t\n"), (None, GOOD), (1, rows[1][1]), (103, (GOOD + "\n") * 3000), (104, "ünïcode ☃ " * 20)]
    docs = spark.createDataFrame([(*r, "c") for r in rows + odd], "doc_id long, text string, quality string")
    out = linecrf.classify(docs, labels).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["keep"] == bool(i % 2) for i in range(40))
    assert all(by[i]["quality"] is None and not by[i]["keep"] and by[i]["n_lines"] == 0 for i in (100, 101, 102))
    assert by[None]["keep"] and by[103]["keep"] and by[103]["n_lines"] == 6000
    field = linecrf.fit(docs, labels)
    text = rows[3][1]
    lines = linecrf.Lines(pa.array([text]))
    p, _ = brute(lines.features() @ field.weights, field.transition)
    assert abs(by[3]["quality"] - (p * lines.size).sum() / lines.size.sum()) < 1e-6
    kept = linecrf.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in out if r["keep"])


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None), (3, " ")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["doc_id"]: r["keep"] for r in linecrf.classify(docs, none).collect()} == {1: True, 2: False, 3: False}
    assert linecrf.classify(docs.where("false"), none).count() == 0


KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", ".,;:", "!?", "|", "#$%&*+/<=>@[\\]^_`{}~"]


def plain_own(text):
    """A line's own features by loops over its bytes and words."""
    out, seen = [], set()
    for line in (text or "").split("\n"):
        data = line.encode()
        counts = [sum(chr(b) in kind for b in data) for kind in KINDS] + [sum(b >= 128 for b in data)]
        if len(data) == counts[3]:
            continue
        words, now = [], b""
        for b in [*data, 32]:
            if b >= 128 or chr(b).isalnum():
                now += bytes([b])
            elif now:
                words, now = [*words, now], b""
        key, n = tuple(words), max(len(words), 1)
        repeated = bool(words) and key in seen
        seen.add(key)
        letters = counts[0] + counts[1] + counts[8]
        out.append(
            [c / len(data) for c in counts]
            + [counts[1] / max(letters, 1), min(np.log1p(len(data)) / 8, 2), min(len(data) / n / 12, 3), float(repeated), sum(a == b for a, b in zip(words, words[1:])) / n, min((counts[5] + counts[6] + counts[7]) / n, 3), min(counts[4] / n, 2)]
        )
    return out


def test_features_against_plain_code():
    r = np.random.default_rng(9)
    made = ["\n".join(" ".join(r.choice(["a", "B", "käse", "12", "#|!", "x.y", "", "Foo?", "\t"], int(r.integers(0, 9)))) for _ in range(int(r.integers(0, 7)))) for _ in range(60)]
    strings = ["same line\nsame line\nother the the\n\n !? \nsame line", None, "", "one", "\n\n", *made]
    lines = linecrf.Lines(pa.array(strings))
    x = lines.features()
    at = 0
    for i, t in enumerate(strings):
        own = np.array(plain_own(t)).reshape(-1, lines.width)
        zero = np.zeros((1, lines.width))
        n = len(own)
        assert lines.row[at : at + n].tolist() == [i] * n
        before, after = np.concatenate([zero, own])[:n], np.concatenate([own, zero])[1 : n + 1]
        assert np.allclose(x[at : at + n], np.column_stack([own, own * own, before, after, np.ones(n)]), atol=1e-6), t
        at += n
    assert at == len(x)


def test_training_climbs_the_likelihood_and_ties_are_kept():
    good, bad = GOOD, BAD
    strings, y = pa.array([good, bad] * 10), np.array([1, 0] * 10)
    field = linecrf.LineField.train(strings, y)

    def likelihood(weights, transition):
        total = 0.0
        for t, label in ((good, 1), (bad, 0)):
            e = linecrf.Lines(pa.array([t])).features() @ weights
            scores = [sum(e[i] * z[i] for i in range(len(e))) + sum(transition[a, b] for a, b in zip(z, z[1:])) for z in itertools.product((0, 1), repeat=len(e))]
            own = sum(e) * label + transition[label, label] * (len(e) - 1)
            total += own - np.logaddexp.reduce(scores)
        return total

    assert likelihood(field.weights, field.transition) > likelihood(np.zeros_like(field.weights), np.zeros((2, 2))) + 1
    none = linecrf.LineField(np.zeros_like(field.weights), np.zeros((2, 2)))
    quality, _, n = none.score(pa.array([good]))
    assert quality[0] == linecrf.THRESHOLD and n[0] == good.count("\n") + 1  # a tie is kept
