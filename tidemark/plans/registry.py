"""Queries by name, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, dates: tuple[str, ...] = ("date",)) -> Callable[[Query], Query]:
    """Add a query under ``name``; ``oracle`` is the SQL that gives the same rows.

    Both sides return the columns in ``dates`` as text, if there are any.
    """

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(query)
        def as_text(spark: SparkSession, folder: str) -> DataFrame:
            df = query(spark, folder)
            return df.withColumns({c: df[c].cast("string") for c in dates if c in df.columns})

        QUERIES[name] = as_text
        if oracle:
            columns = f" replace ({', '.join(f'cast("{c}" as varchar) as "{c}"' for c in dates)})" if dates else ""
            ORACLES[name] = f"select *{columns} from ({oracle})"
        return query

    return add
