"""Every catalogue query against its SQL on the smallest tables, and the entry points without the llm parts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from hybridmail.plans.catalogue import ORACLE_SQL, QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test data here")


def clean(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(SF_DIR))
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    db = duckdb.connect()
    for p in SF_DIR.glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    wanted = db.sql(ORACLE_SQL[name])
    columns = sorted(wanted.columns)
    assert columns == sorted(df.columns)
    ours = sorted((tuple(clean(r[c]) for c in columns) for r in rows), key=str)
    theirs = sorted((tuple(clean(dict(zip(wanted.columns, r, strict=True))[c]) for c in columns) for r in wanted.fetchall()), key=str)
    assert ours == theirs


def test_entry_without_llm(tmp_path):
    for p in ("__spark_entry__.py", "hybridmail"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else __import__("shutil").copytree(ROOT / p, tmp_path / p, ignore=lambda d, names: [n for n in names if n == "llm" or n == "__pycache__"])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'h1_hybrid_rrf' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
