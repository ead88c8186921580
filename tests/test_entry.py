"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
OWN = sorted(entry.own.queries())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    x = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in x.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in x.fetchall())
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("rows", [150, 0])
def test_auto_delimiter_with_empty_tasks(spark, tmp_path, rows):
    """One row group over several tasks leaves the first without rows; Spark writes an empty file for it."""
    import os

    import pyarrow.parquet as pq

    from delimir.queries import customer

    table = pq.read_table(f"{SF}/customer.parquet")
    assert table.num_rows == 150
    pq.write_table(table.slice(0, rows), tmp_path / "customer.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        written = customer(spark, str(tmp_path), delimiter="~").removeprefix("file://")
        assert 0 in [os.path.getsize(f"{written}/{x}") for x in os.listdir(written) if x.startswith("part-0")]
        got = entry.queries()["auto_delimiter"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet')")
    assert sorted(tuple(r) for r in got) == sorted(con.execute(entry.oracle_sql()["auto_delimiter"]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["orderkey", "returnflag", "shipdate"]
