"""Every registered query of the library against its SQL in DuckDB, over a small table with odd rows."""

import math
from decimal import Decimal

import duckdb
import pytest

from corpuscle import registry

TEXTS = [
    "It's clear that the state law, in that case, shall be read as such as it is. Its authors said that of the end.",
    "They will not say that there is one; the nation’s “very” long list of findings is growing quickly and slowly.",
    "We have seen 12 rivers and 3 mountains. That was the end of the road, and the road went on.", None, "", "!!! ...", "That that that.",
    "naïve café ﬁne ½ done…  in   that\tcase\nthe data of the study may be used to be sure that others thank them rather than that thing on.",
    "of", "the study of the state was so that we might go, but it s not being done on the road of the town.",
] * 3


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en" if i % 2 else None if i % 5 == 0 else "de", "src", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{out}/documents.parquet")
    return out


def comparable(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(found, names):
    at = [found[0].index(n) for n in names]
    return sorted((tuple(comparable(r[i]) for i in at) for r in found[1]), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, name):
    if name == "chunks_2000":  # tests/test_fixtures.py has chunks against plain code
        assert registry.QUERIES[name](spark, folder).count() == sum(bool(t) for t in TEXTS)
        return
    got = registry.QUERIES[name](spark, folder)
    expected = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet'); " + registry.oracles()[name])
    names = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(names)
    mine, theirs = rows((got.columns, got.collect()), names), rows((names, expected.fetchall()), names)
    if name != "dtm_coo":
        assert mine or name in ("keyness_yates", "keyness_tags", "keyness_default", "keyness_swap", "frequency_bounds")
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5) for x, y in zip(a, b)), (a, b)
