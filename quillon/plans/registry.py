"""Names of all relational queries, with their DuckDB oracles.

"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: {name} stands for a table; doubled braces are text.
_TABLE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame and, where SQL can express it, its DuckDB SQL."""

    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query in Spark SQL; {orders} stands for that table. Without an oracle of its own, DuckDB runs the same text."""
    tables = sorted(set(_TABLE.findall(text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})

    query(name, oracle or _TABLE.sub(r"\1", text))(run)


def _load() -> None:
    from . import aggregates, beyond, extra, grading, graphs, joins, ordering, scalars, scans, streams, windows  # noqa: F401


_load()
