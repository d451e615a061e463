"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

#: The moment that stands for "now" in every query.
AS_OF = "2026-07-01 00:00:00"


def registrar(queries: dict, sql: dict[str, str]) -> Callable:
    """A decorator `query(name, sql)` that fills both dicts."""

    def query(name: str, text: str | None = None):
        def add(f):
            def run(spark, folder):
                # days as text, which every engine writes alike
                df = f(spark, folder)
                return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

            queries[name] = run
            if text:
                sql[name] = text
            return f

        return add

    return query
