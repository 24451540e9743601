"""A local session, and DuckDB as an independent engine."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.codegen.wholeStage", os.environ.get("TEST_CODEGEN", "false"))
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def _plain(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.fixture(scope="session")
def matches(sf_dir):
    """Compares a DataFrame with DuckDB's rows for a query, columns by name and rows in any order."""
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def check(df, sql):
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        own = sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
        place = [names.index(c) for c in sorted(names)]
        other = sorted((tuple(_plain(r[i]) for i in place) for r in result.fetchall()), key=str)
        assert own == other

    return check
