"""Each registered query of the session operators against its SQL in DuckDB."""

import duckdb
import pytest

from traceloom.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "events", "documents", "pages", "labels", "nation"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    want = sorted(map(repr, con.sql(ORACLE_SQL[name]).select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()))
    assert got == want


def test_file_names(spark):
    from pyspark.sql import functions as F

    from traceloom.functions import text as T

    rows = spark.createDataFrame([("foo/../bar.md",), ("x" * 500,), ("",)], "s string").select(T.file_name(F.col("s"), "f")).collect()
    assert [r[0] for r in rows] == ["foo----bar-md", "x" * 100, "f"]
