import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_duckdb(spark, sf_dir):
    """Compare a query with its SQL: the same columns, and the same rows whatever their order."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")

    def value(v):
        if v is None or isinstance(v, float) and v != v:
            return None
        return float(f"{v:.9g}") if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    def check(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        got = sorted(repr([value(r[c]) for c in columns]) for r in df.collect())
        rel = con.sql(sql)
        assert sorted(rel.columns) == columns
        place = [rel.columns.index(c) for c in columns]
        assert sorted(repr([value(r[i]) for i in place]) for r in rel.fetchall()) == got

    return check
