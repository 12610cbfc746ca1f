"""One local Spark session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    tmp = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp / "warehouse")).config("spark.checkpoint.dir", f"file://{tmp / 'shared'}")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


def same(rows: list[tuple], others: list[tuple]) -> bool:
    """Equal as multisets, whatever the order."""
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(rows, key=key) == sorted(others, key=key)


def against(spark, duck, sf_dir, make, sql: str) -> None:
    """A query's rows are those of its SQL, columns by name."""
    df = make(spark, sf_dir)
    relation = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    want = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({sql})").fetchall()
    assert same([tuple(r) for r in df.select(*columns).collect()], want)
