"""Every registered query against its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

from driftline import queries

DATA = os.environ.get("DRIFTLINE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    try:
        return float(x)
    except (TypeError, ValueError):
        return str(x)


def _rows(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = duck.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect(), sorted(columns)) == _rows(columns, found.fetchall(), sorted(columns))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_lines_of_an_event_are_apart(spark):
    rows = queries.QUERIES["ransac_mask"](spark, DATA)
    assert rows.count() == rows.select("run", "event_id", "hit_id").distinct().count()
    lines = queries.QUERIES["extract_lines"](spark, DATA).collect()
    assert all(r.n_hits >= 20 and abs(r.dx**2 + r.dy**2 + r.dz**2 - 1) < 1e-3 and r.dz >= 0 for r in lines)


@pytest.mark.parametrize("name", ["pad_distance_classes", "pad_neighbors", "pad_directions", "pad_pairs"])
def test_pad_maps_do_not_pass_the_driver(spark, tmp_path, name):
    """Of 5000 pads, which Spark takes for less than they are, no table over 2 MB is broadcast."""
    spark.range(5000).selectExpr("id AS p_partkey", "CAST(id * 7 % 50 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    limits = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.maxBroadcastTableSize": "2m"}
    kept = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        df = queries.QUERIES[name](spark, str(tmp_path))
        got = df.collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    con = duckdb.connect()
    for table in ("embeddings", "labels", "region", "supplier", "lineitem"):  # named by the bindings, not read
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    found = con.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert _rows(df.columns, got, sorted(columns)) == _rows(columns, found.fetchall(), sorted(columns))
