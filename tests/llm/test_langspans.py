"""Best paths against all labellings, spans against mixed texts, languages against held-out documents."""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from corpuscle.llm import langspans
from corpuscle.llm.kernels import Words

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_viterbi_against_all_labellings():
    r = np.random.default_rng(1)
    lengths = [4, 0, 1, 5]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score = r.normal(size=(first[-1], 3)) * 5
    path = langspans.viterbi(score, first, 4.0)
    value = lambda s, y: sum(s[i, k] for i, k in enumerate(y)) - 4.0 * sum(a != b for a, b in zip(y, y[1:]))
    for a, b in zip(first, first[1:]):
        s = score[a:b]
        best = max(value(s, y) for y in itertools.product(range(3), repeat=b - a))
        assert abs(value(s, path[a:b]) - best) < 1e-9


def test_scripts():
    words = "hello Привет γειά שלום مرحبا नमस्ते สวัสดี こんにちは 漢字 漢字かな 한국어 123 élan"
    got = langspans._scripts(Words(pa.array([words])))
    names = [*langspans.SCRIPTS, "latin"]
    assert [names[k] if k >= 0 else None for k in got] == ["latin", "ru", "el", "he", "ar", "hi", "th", "ja", "zh", "ja", "ko", None, "latin"]


def held_out():
    docs = pq.read_table(DATA, columns=["doc_id", "text", "lang"]).to_pandas()
    docs = docs[docs["text"].fillna("").str.split().str.len() >= 20]
    half = np.arange(len(docs)) % 2 == 0
    return docs[half], docs[~half]


def test_held_out_accuracy_and_mixed_texts(spark):
    train, test = held_out()
    tables = langspans.Tables.train(pa.array(train["text"]), train["lang"].tolist())
    some = test[["doc_id", "text", "lang"]]
    df = spark.createDataFrame([(int(a), b, c) for a, b, c in some.itertuples(index=False)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langspans.identify(df, tables=tables).collect()}
    right = [got[int(i)]["main_lang"] == lang for i, _, lang in some.itertuples(index=False)]
    assert np.mean(right) >= 0.95
    by = {lang: " ".join(part["text"].iloc[0].split()[:40]) for lang, part in test.groupby("lang")}
    a, b = sorted(by)[:2]
    mixed = by[a] + " " + by[b] + " Привет мир " + by[a]
    row = langspans.identify(spark.createDataFrame([(1, mixed, None)], df.schema), tables=tables).first()
    assert [s["lang"] for s in row["spans"]] == [a, b, "ru", a] and row["n_langs"] == 3 and row["main_lang"] == a
    cut = len(by[a])
    assert row["spans"][0]["start"] <= 3 and abs(row["spans"][0]["end"] - cut) <= 40
    assert mixed[row["spans"][2]["start"] : row["spans"][2]["end"]] == "Привет мир"


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 456 !!", None), (4, "Привет", None), (None, "the house and the garden", "en"), (4, "Привет", None), (5, "the house and the tree " * 20_000, "en"), (6, "das haus und der garten", "de"), (7, "!!", "de")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, main_lang string")
    got = langspans.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["main_lang"] == "und" for i in (1, 2, 3, 7)) and by[1]["spans"] == [] and by[3]["n_langs"] == 1
    assert by[4]["main_lang"] == "ru" and by[5]["main_lang"] == "en" and by[6]["main_lang"] == "de" and by[None]["main_lang"] == "en"
    assert sum(s["words"] for s in by[5]["spans"]) == 100_000
    assert langspans.identify(df.where("false")).count() == 0
    assert langspans.identify(df.withColumn("lang", df.lang.substr(9, 1))).count() == len(rows)  # no labels


def bucket(before, middle, after):
    key = (before << 16 | middle << 8 | after) & 0xFFFFFFFF
    return (key * 2654435761 & 0xFFFFFFFF) >> 16


def trigrams(word):
    data = [1, *word.encode(), 1]
    return [bucket(*data[i : i + 3]) for i in range(len(data) - 2)]


def test_training_and_scores_against_plain_code():
    texts, labels = ["the house and the garden", "das Haus und der Garten", "la casa y el jardín", "the tree"], ["en", "de", "es", "en"]
    tables = langspans.Tables.train(pa.array(texts), labels)
    counts = {lang: {} for lang in set(labels)}
    for t, lang in zip(texts, labels):
        for w in t.lower().split():
            for b in trigrams(w):
                counts[lang][b] = counts[lang].get(b, 0) + 1
    log = lambda lang, b: np.log((counts[lang].get(b, 0) + 0.5) / (sum(counts[lang].values()) + 0.5 * langspans.BUCKETS))
    text = "The garden und la Käse 12 Привет casa thehousegarden " + "the" * 40
    w = Words(pa.array([text]))
    got = langspans.scores(w, tables)
    for k, word in enumerate(text.lower().split()):
        script = langspans._scripts(Words(pa.array([word])))[0]
        if script == langspans.LATIN:
            each = {lang: sum(log(lang, b) for b in trigrams(word)) for lang in tables.languages}
            best = max(each.values())
            wanted = [-1e4] * langspans.LATIN + [max(each[lang] - best, -langspans.MOST) for lang in tables.languages]
        elif script < 0:
            wanted = [0] * len(tables.labels)
        else:
            wanted = [0 if j == script else -1e4 for j in range(len(tables.labels))]
        assert np.allclose(got[k], wanted, atol=2e-3), word


def test_ties_go_to_the_first_label_and_to_staying():
    score = np.array([[0.0, 0, -1], [0, 0, 0], [-3, 0, 0], [0, 0, 0]])
    assert langspans.viterbi(score, np.array([0, 4]), 3.0).tolist() == [1, 1, 1, 1]
    assert langspans.viterbi(np.zeros((3, 4)), np.array([0, 3]), 1.0).tolist() == [0, 0, 0]
    many = np.zeros((5, 300))
    many[:, 250] = 1
    assert langspans.viterbi(many, np.array([0, 5]), 1.0).tolist() == [250] * 5
