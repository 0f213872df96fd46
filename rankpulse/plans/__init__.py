"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *decimals: str):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL. Decimal columns leave both sides as doubles."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("double") for c, t in out.dtypes if t.startswith("decimal")})

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in decimals)}) from ({sql})" if decimals else sql
        return f

    return add


from . import chart_queries, news_queries, report_queries, scalar_queries, stream_queries  # noqa: E402

ALL = (chart_queries, scalar_queries, news_queries, report_queries, stream_queries)
