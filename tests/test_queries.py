"""Every query of the core gives the rows of its SQL on the smallest tables; the rest of the library needs no subpackage for training data."""

import os
import re
from pathlib import Path

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


def rows(pdf):
    import pandas as pd

    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return "-"
        return f"{x:.5g}" if isinstance(x, float) else str(x)

    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="module")
def other():
    import duckdb

    if not Path(DATA).exists():
        pytest.skip("no tables here")
    db = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        db.sql(f"create view {f.stem} as select * from '{f}'")
    return db


def test_queries_are_those_of_their_sql(spark, other):
    from evimem.plans import registry

    sql = registry.oracle_sql()
    for name, query in registry.queries().items():
        got = query(spark, DATA).toPandas()
        if name in sql:
            want = other.sql(sql[name]).df()
            assert sorted(got.columns) == sorted(want.columns), name
            assert rows(got) == rows(want), name


def test_core_does_not_import_the_subpackage():
    for f in (ROOT / "evimem").rglob("*.py"):
        if f.parent.name != "llm":
            assert not re.search(r"evimem\.llm|from \.+llm", f.read_text()), f
