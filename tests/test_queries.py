"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from branchline.plans.queries import ORACLES, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def said(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_all_have_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert said(tuple(r[c] for c in columns) for r in df.collect()) == said(found.fetchall())


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_entry_module():
    import __spark_entry__ as e

    assert QUERIES.keys() <= e.queries().keys() and e.oracle_sql().keys() <= e.queries().keys()


def test_nothing_imports_the_optional_operators():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "branchline"
    outside = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert outside and not any(re.search(r"import.*\bllm\b|\.llm\b", p.read_text()) for p in outside)
