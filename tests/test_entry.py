"""The driver's contract, with and without the llm folders."""

import subprocess
import sys
from pathlib import Path
from shutil import copytree, ignore_patterns

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and all(map(callable, names.values())) and all(isinstance(s, str) and s.strip() for s in sql.values())
    assert len(names) >= 47


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["Token", "Tag", "AF", "RF", "Range"]


def test_without_the_llm_folders(tmp_path):
    copytree(ROOT, tmp_path / "repo", ignore=ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'pipeline' not in n and not any(x.startswith('op') for x in n) and e.oracle_sql() and len(n) >= 47"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
