import datetime
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from wayglass.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else value.isoformat() if isinstance(value, datetime.datetime) else str(value)


def same_as_oracle(spark, name, sf_dir=SF):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    answer = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in answer.fetchall())
    assert found == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_duckdb(spark, name):
    same_as_oracle(spark, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_core_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copy(entry.__file__, tmp_path)
    shutil.copytree(f"{root}/wayglass", tmp_path / "wayglass", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), 'op2_simhash' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    for leftover in (False, True):
        if leftover:  # a folder without modules
            (tmp_path / "wayglass/llm/__pycache__").mkdir(parents=True)
        said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert said.stdout.split() == [str(len(registry.QUERIES)), "False", "True"], said.stderr


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(f"{root}/wayglass"):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for name in names:
                if name.endswith(".py"):
                    with open(f"{folder}/{name}") as f:
                        assert "llm" not in f.read(), name
