import glob
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.local.dir", scratch).config("spark.sql.warehouse.dir", f"{scratch}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[:-8]
        connection.execute(f"create view {name} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return connection


def canonical(columns, rows):
    """Rows as sorted tuples of text, columns by name; floats to six digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def shown(value):
        if isinstance(value, float):
            return None if value != value else round(value, 6)
        return value.isoformat() if hasattr(value, "isoformat") else value

    return [columns[i] for i in order], sorted(tuple(str(shown(row[i])) for i in order) for row in rows)


def compare(spark, duck, sf_dir, function, sql):
    df = function(spark, sf_dir)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(sql)
    theirs = canonical([c[0] for c in result.description], result.fetchall())
    assert mine == theirs
