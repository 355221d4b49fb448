"""Each stage of the pipeline against what plain code makes of its input, and run() against the stages in a row."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpuscle.llm import linecrf, mixing, secrets, simhash
from tests.llm import test_decontaminate, test_mixing, test_secrets, test_simhash

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = test_secrets.KEY


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    r = np.random.default_rng(1)
    prose = lambda n: ".\n".join(" ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in r.integers(0, 676, 12)) for _ in range(n))
    junk = lambda n: "\n".join("".join(r.choice(list("#$%|<>!=@&*0123456789"), 40)) for _ in range(n))
    texts = [prose(int(r.integers(4, 12))) if i % 3 else junk(6) for i in range(120)]
    texts += [texts[1], texts[2] + " end", texts[4] + "\n" + test_decontaminate.ITEM, prose(5) + " token " + KEY, test_decontaminate.SHORT, None, "", " "]
    rows = [(i, t, "en", ["src0", "src1", "other", None][i % 4], len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, test_decontaminate.ITEM), (2, test_decontaminate.SHORT)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, data):
    folder, rows = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, steps[-1], folder)
        if k < 4:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/step{k}.parquet")
        steps.append(spark.read.parquet(f"{folder}/step{k}.parquet"))
    start, good, single, clean, masked, mixed = map(held, steps)

    field = linecrf.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    quality, _, _ = field.score(pa.array([r[1] for r in start]))
    assert good == [r for r, q in zip(start, quality) if q >= linecrf.THRESHOLD]
    assert {r[0] for r in good} >= {i for i in range(120) if i % 3} and not {r[0] for r in good} & {i for i in range(120) if not i % 3}

    ids = [r[0] for r in good]
    f, _ = simhash.fingerprints(pa.array([r[1] for r in good]))
    near = [(ids[i], ids[j]) for i, j in itertools.combinations(range(len(good)), 2) if simhash.distances(f[i], f[j]) <= simhash.RADIUS]
    assert near
    root = test_simhash.components(max(ids) + 1, near)
    assert single == [r for r in good if root[r[0]] == r[0]]

    expected = {}
    for r in single:
        gone, _ = test_decontaminate.plain(r[1], [test_decontaminate.ITEM, test_decontaminate.SHORT])
        expected[r[0]] = [w for w, g in zip(test_decontaminate.words(r[1]), gone) if not g]
    assert {r[0]: test_decontaminate.words(r[1]) for r in clean} == {i: w for i, w in expected.items() if w}
    assert all(r[4] == len(r[1]) for r in clean)

    found = {r[0]: test_secrets.plain(r[1]) for r in clean}
    assert sum(map(len, found.values())) >= 1
    assert [r[0] for r in masked] == [r[0] for r in clean]
    for a, b in zip(clean, masked):
        assert b[1].count(secrets.MASK) == len(found[a[0]]) and (found[a[0]] or a == b) and KEY not in b[1] and b[4] == len(b[1])

    copies = test_mixing.plain([(r[0], r[1], r[3], r[4]) for r in masked], mixing.WEIGHTS, mixing.OTHER, mixing.BUDGET, mixing.SEED)
    got = {}
    for r in mixed:
        got[(r[0], r[1], r[3])] = got.get((r[0], r[1], r[3]), 0) + 1
    assert got == copies
    assert held(corpus_pipeline.run(spark, folder)) == mixed


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_odd_rows_of_each_stage(spark, data, stage):
    folder, _ = data
    text = "word one two three four five six seven eight nine ten.\nAnd more words of plain prose follow here.\n" * 3
    rows = [(1, text), (1, text), (None, text + "a null id"), (2, None), (3, ""), (4, "x " * 60_000), (5, text.upper()), (5, "zz " * 40)]
    odd = [(i, t, None if k % 2 else "en", None if k % 3 == 0 else "src1", None if k == 6 else len(t or ""), "c", "d", 7) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(odd, DOCUMENTS + ", __quality string, __source string, copy int")
    out = stage(spark, docs, folder)
    expected = ["doc_id", "text", "lang", "source", "n_chars"] + (["copy"] if stage is corpus_pipeline.STAGES[-1][1] else [])
    assert out.columns == expected
    found = out.collect()
    ids = [r["doc_id"] for r in found]
    name = stage.__name__
    if name == "quality":
        assert 2 not in ids and 3 not in ids and ids.count(1) in (0, 2)
    elif name == "near_duplicates":
        assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4] and ids.count(None) == 1  # 5 has a text of 1's, in capitals
    elif name in ("decontamination", "secret_scan"):
        assert sorted(map(str, ids)) == sorted(str(i) for i, _ in rows) and [r["text"] for r in found if r["doc_id"] in (2, 3)] in ([None, ""], ["", None])
    empty = stage(spark, docs.where("false"), folder)
    assert empty.columns == expected and empty.count() == 0


def test_a_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from corpuscle.plans import runtime

    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda _: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))
