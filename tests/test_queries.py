"""Every registered query with SQL gives the rows of DuckDB."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnfield.plans.queries import ORACLES, QUERIES


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.7g}")
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(norm(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in sorted(columns)) for r in rows), key=repr) == want


def test_entry_imports_without_llm():
    import __spark_entry__

    assert "climatology" in __spark_entry__.queries() and "climatology" in __spark_entry__.oracle_sql()


def test_spatial_nn_fill_against_brute_force(spark, sf):
    from cairnfield.plans.queries import frame

    cube = {(r["lat_idx"], r["m"]): r["value"] for r in frame(spark, sf).select("lat_idx", "m", "value").collect()}
    valid = [k for k, v in cube.items() if v is not None]
    want = {k: v if v is not None else cube[min(valid, key=lambda o: ((o[0] - k[0]) ** 2 + (o[1] - k[1]) ** 2, o))] for k, v in cube.items()}
    assert len({m for _, m in want}) > 80 and len(valid) < len(cube)
    got = QUERIES["spatial_nn_fill"](spark, sf).collect()
    assert len(got) == len(want) and {(r["lat_idx"], r["m"]): r["filled"] for r in got} == want


def test_spans_cover_all_order_dates(spark, sf):
    months = {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").selectExpr("cast(year(o_orderdate) * 12 + month(o_orderdate) - 1 as int)").distinct().collect()}
    for name in ("longest_run", "longest_run_chained", "dry_day_counts", "monthly_daily_hybrid"):
        assert {r["m"] for r in QUERIES[name](spark, sf).select("m").collect()} == months


@pytest.mark.parametrize("name", ["merge_intervals", "interval_anti_join"])
def test_intervals_of_nulls(spark, sf, tmp_path, name):
    """One order of each customer and day: the SQL's two windows may put equal intervals in different orders."""
    con = duckdb.connect()
    key = "CASE WHEN o_orderkey % 7 <> 3 THEN o_custkey END AS o_custkey"
    day = "CASE WHEN o_orderkey % 5 <> 2 AND o_custkey % 11 <> 4 THEN o_orderdate END AS o_orderdate"
    con.execute(f"create table orders as select distinct on (o_custkey, o_orderdate) * from (select * replace ({key}, {day}) from '{sf}/orders.parquet') order by o_custkey, o_orderdate, o_orderkey")
    con.execute(f"create table lineitem as select * replace (CASE WHEN l_orderkey % 13 <> 1 THEN l_shipdate END AS l_shipdate) from '{sf}/lineitem.parquet'")
    for table in ("orders", "lineitem"):
        con.execute(f"copy {table} to '{tmp_path}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(norm(v) for v in r) for r in found.fetchall()), key=repr)
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert len(want) > 100 and sorted((tuple(norm(v) for v in r) for r in got), key=repr) == want


def test_intervals_of_repeated_orders(spark, sf, tmp_path):
    """Repeated orders change no interval, and merged intervals of a customer never touch."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    for i in (1, 3):
        again = orders.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(i)))).withColumn("o_orderkey", F.col("o_orderkey") + F.col("i") * 1_000_000)
        again.drop("i").write.parquet(f"{tmp_path}/{i}/orders.parquet")
    once, thrice = (sorted(tuple(r) for r in QUERIES["merge_intervals"](spark, f"{tmp_path}/{i}").collect()) for i in (1, 3))
    assert once == thrice and all(a[0] != b[0] or a[2] < b[1] for a, b in zip(once, once[1:]))


def test_fingerprint_tasks_are_of_a_bounded_size(spark, tmp_path):
    rows = spark.range(2_000_000).select(F.col("id").alias("l_orderkey"), F.lit(1.0).alias("l_quantity"), F.lit(0.0).alias("l_tax"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["content_fingerprint"](spark, str(tmp_path))
    assert "RoundRobinPartitioning(10)" in found._jdf.queryExecution().toString()


def test_lag_pipeline_reads_its_grid_once(spark, sf):
    """The returned plan has no scan of lineitem left: the cubes and their shifts read the written grid."""
    assert not any("lineitem" in f for f in QUERIES["lag_pipeline"](spark, sf).inputFiles())
