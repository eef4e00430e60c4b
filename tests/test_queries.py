"""Every query with SQL against DuckDB on the smallest tables."""

import os
import re

import pytest

from framewise.plans import registry

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda x: "" if x is None else f"{x:.9g}" if isinstance(x, float) else str(int(x)) if type(x).__name__ == "Decimal" else str(x)
    return sorted(names), sorted([shown(r[i]) for i in order] for r in table)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_captions_are_grounded_whole(spark):
    """Beyond the first 200 characters too: by Python's regular expressions, over texts that are longer."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r["clip_id"]: r["grounded"] for r in registry.queries()["caption_grounding"](spark, DIR).collect()}
    assert got == {i: re.sub(r"\bthe\b", "the, a blue thing", t) for i, t in texts.items()}
    assert any(re.search(r"\bthe\b", t[200:]) for t in texts.values())
