"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..functions.shared import shared_folder

_RUN = uuid.uuid4().hex
_CLEANED: set[str] = set()
#: Open scopes, the innermost last: (subfolder, names of its bucketed tables).
_SCOPES: list[tuple[str, list[str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """A subfolder of this process in the folder that driver and executors share."""
    root = f"{shared_folder(spark)}/quillon-{_RUN}"
    if root not in _CLEANED:
        _CLEANED.add(root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has gone already; the folder is left to the cluster's own cleaning
        pass


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is written within is deleted at the end, but for tables that are written to stay."""
    _SCOPES.append((f"scope-{uuid.uuid4().hex[:12]}", []))
    try:
        yield
    finally:
        folder, tables = _SCOPES.pop()
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        _remove(spark, f"{shared_dir(spark)}/{folder}")


def fresh_path(spark: SparkSession, name: str, stays: bool = False) -> str:
    inner = f"/{_SCOPES[-1][0]}" if _SCOPES and not stays else ""
    return f"{shared_dir(spark)}{inner}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read back.

    Later plans read the files, so the loss of an executor never replays what came before. stays: a scope leaves the table.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name, stays)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """The rows of df as a table in n buckets of `column`, one file each: joins on that column need not move them again."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1][1].append(table)
    df.repartition(n, column).write.bucketBy(n, column).option("path", fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)
