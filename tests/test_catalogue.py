"""Every registered query of the relational part against DuckDB on the driver's smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from loomspark.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 5) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, con, name):
    got = __spark_entry__.queries()[name](spark, DIR)
    want = con.sql(catalogue.ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).columns == ["doc_id", "item_id", "char_start", "char_end", "quote_sha256"]


@pytest.mark.parametrize("name, size", [("current_edges", 1), ("edges_among", 2), ("expansion", 17), ("graph_query", 2)])
def test_edges_that_share_an_id(spark, tmp_path, name, size):
    """src * 100000 + dst is one number for two edges from 599998 nodes on: (600000, 300000) and (600001, 200000), say."""
    near = [*range(599990, 600020), *range(1199990, 1200030)]
    keys = sorted({k // (2**a * 3**b) for k in near for a in range(21) for b in range(13)})  # with all they derive from
    c = duckdb.connect()
    c.execute("CREATE TABLE part AS SELECT unnest(?::BIGINT[]) AS p_partkey, ?::INTEGER AS p_size, 'x' AS p_name", [keys, size])
    c.sql(f"COPY part TO '{tmp_path}/part.parquet'")
    assert c.sql(f"WITH {catalogue.DAG_SQL.strip()} SELECT count(*) - count(DISTINCT src * 100000 + dst) FROM dag").fetchall()[0][0] > 6
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = c.sql(catalogue.ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
