import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def same(spark_df, sql: str) -> bool:
    """Whether a DataFrame's rows equal those of DuckDB's SQL on the smallest tables, in any order."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    cut = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    names = sorted(spark_df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    mine = sorted(repr([cut(r[c]) for c in names]) for r in spark_df.collect())
    return mine == sorted(repr([cut(r[i]) for i in at]) for r in rel.fetchall())
