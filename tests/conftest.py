import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf_dir):
    """Checks that a query and its SQL give the same columns and rows, floats to six digits."""
    def plain(v):
        if pd.isna(v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return f"{v:.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    def rows(frame):
        own = frame[sorted(frame.columns)].astype(object)
        return sorted((tuple(plain(v) for v in r) for r in own.itertuples(index=False, name=None)), key=repr)

    def check(query, sql):
        a, b = query(spark, sf_dir).toPandas(), duck.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
