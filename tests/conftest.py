import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="quillon-test-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    return con


def rows(frame, columns):
    """Rows as sorted text, with missing values alike."""
    import pandas as pd

    values = frame[columns].astype(object).values.tolist()
    return sorted(repr([None if not isinstance(v, (list, tuple)) and pd.isna(v) else v for v in r]) for r in values)


@pytest.fixture
def folder(tmp_path: Path) -> str:
    return str(tmp_path)
