import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(session.conf.get("spark.checkpoint.dir"))
    yield session
    session.stop()


def same_as_duckdb(spark, name, query, sql, sf=SF):
    """Rows and column names of a Spark query against its SQL in DuckDB."""
    import duckdb

    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = query(spark, sf)
    columns = sorted(found.columns)
    theirs = base.sql(sql)
    assert sorted(theirs.columns) == columns, name
    order = [theirs.columns.index(c) for c in columns]
    ours = sorted(repr(tuple(str(r[c]) for c in columns)) for r in found.collect())
    assert ours == sorted(repr(tuple(str(r[i]) for i in order)) for r in theirs.fetchall()), name
