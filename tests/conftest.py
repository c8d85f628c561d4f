import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split():
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def _plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def agree(spark, sf, duck):
    """Run a registered query and its SQL and compare all rows."""

    def check(query, sql):
        df = query(spark, sf)
        columns = sorted(df.columns)
        mine = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
        found = duck.sql(sql)
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        theirs = sorted(tuple(_plain(r[i]) for i in order) for r in found.fetchall())
        assert mine == theirs

    return check
