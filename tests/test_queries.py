import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessitura.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def value(x):
    return round(x, 6) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    own = tables.execute(SQL[name])
    names = [d[0] for d in own.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted(str([value(dict(zip(names, r, strict=True))[c]) for c in order]) for r in own.fetchall())
    assert sorted(str([value(r[c]) for c in order]) for r in got.collect()) == want and want


def test_density_is_not_vacuous(spark):
    flags = [r.ok for r in QUERIES["density_flag_7"](spark, SF).collect()]
    assert any(flags) and not all(flags)


def test_without_the_corpus_part(tmp_path):
    """The rest works where tessitura/llm is gone, with and without corpus_pipeline.py."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "tessitura", tmp_path / "tessitura", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) == int(__import__('sys').argv[1])"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code, str(len(QUERIES))], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
        shutil.copy(root / "corpus_pipeline.py", tmp_path) if (root / "corpus_pipeline.py").exists() else None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
