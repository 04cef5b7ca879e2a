"""The registered queries on the driver's tables, each with the SQL that must give the same rows.

Derived inputs: ``grid`` is a monthly cube (month key m, lat_idx from the supplier's nation) of mean prices (in another
currency), masked where a cell has a multiple of three line items; the other inputs are described where they are made.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..model import full_frame, month_key, month_start, reorder_axis, synthetic_cube
from ..operators import calendars, features, gapfill, masks, models, ordered, polygons, products, spatial, stats, temporal
from ..sources import ascii as ascii_
from ..tables import materialize, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- derived inputs
GRID = """grid AS (
  SELECT s_nationkey AS lat_idx, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS m,
         CASE WHEN count(*) % 3 = 0 THEN NULL ELSE round(avg(l_extendedprice) * 0.123457, 6) END AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
frame AS (SELECT c.lat_idx, t.m, g.value FROM (SELECT DISTINCT lat_idx FROM grid) c CROSS JOIN (SELECT DISTINCT m FROM grid) t
  LEFT JOIN grid g ON g.lat_idx = c.lat_idx AND g.m = t.m)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """(lat_idx, time, m, value)."""
    sup = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("lat_idx"))
    rows = read(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", month_key(F.col("l_shipdate")).alias("m")).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    value = F.when(F.count(F.lit(1)) % 3 != 0, F.round(F.avg("l_extendedprice") * 0.123457, 6))
    return rows.groupBy("lat_idx", "m").agg(value.alias("value")).withColumn("time", month_start(F.col("m")))


def frame(spark: SparkSession, d: str) -> DataFrame:
    return full_frame(grid(spark, d), "m", ["lat_idx"]).withColumn("time", month_start(F.col("m")))


# ---------------------------------------------------------------- temporal
@query(f"WITH {GRID} SELECT lat_idx, round(avg(value), 3) AS value FROM frame GROUP BY lat_idx")
def mean_map(spark, d):
    return temporal.mean_over_time(grid(spark, d), ["lat_idx"]).select("lat_idx", F.round("value", 3).alias("value"))


@query(f"WITH {GRID} SELECT lat_idx, CAST(m % 12 + 1 AS INTEGER) AS month, round(avg(value), 3) AS value FROM frame WHERE m BETWEEN 23953 AND 24000 GROUP BY 1, 2")
def climatology(spark, d):
    return temporal.climatology(grid(spark, d), ["lat_idx"], 23953, 24000).select("lat_idx", "month", F.round("value", 3).alias("value"))


@query(f"WITH {GRID} SELECT lat_idx, m, value FROM grid WHERE m > 23953 AND m <= 23960")
def monthly_filter_open_closed(spark, d):
    return temporal.select_monthly(grid(spark, d), 23953, 23960, inclusive_lower=False).select("lat_idx", "m", "value")


@query(
    f"""WITH {GRID} SELECT 'monthly' AS kind, lat_idx, m, value FROM grid WHERE m BETWEEN 23953 AND 23990
    UNION ALL SELECT 'yearly', lat_idx, m, value FROM grid WHERE m % 12 = 0 AND m // 12 BETWEEN 23953 // 12 AND 23990 // 12 + 1
    UNION ALL SELECT 'static', lat_idx, m, value FROM grid WHERE m = 23950"""
)
def limit_months(spark, d):
    cube, out = grid(spark, d), None
    for kind, rows in (("monthly", cube), ("yearly", cube.where("m % 12 = 0")), ("static", cube.where("m = 23950"))):
        part = temporal.limit_months(rows, 23953, 23990, kind).select(F.lit(kind).alias("kind"), "lat_idx", "m", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT CAST(o_custkey % 20 AS INTEGER) AS cell, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2")
def submonthly_mean(spark, d):
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 20).cast("int").alias("cell"), F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"))
    return temporal.monthly_mean(rows, ["cell"]).select("cell", month_key(F.col("time")).alias("m"), F.round("value", 4).alias("value"))


@query("SELECT n_nationkey, n_regionkey, CAST(m AS INTEGER) AS m FROM nation CROSS JOIN (SELECT unnest(range(24000, 24012)) AS m)")
def static_broadcast(spark, d):
    return temporal.broadcast_static(read(spark, d, "nation").select("n_nationkey", "n_regionkey"), 24000, 24011).select("n_nationkey", "n_regionkey", "m")


@query(f"WITH {GRID}, clim AS (SELECT lat_idx, m % 12 + 1 AS month, round(avg(value), 3) AS value FROM grid GROUP BY 1, 2) SELECT lat_idx, CAST(t.m AS INTEGER) AS m, value FROM clim JOIN (SELECT unnest(range(24000, 24018)) AS m) t ON t.m % 12 + 1 = clim.month")
def climatology_broadcast(spark, d):
    clim = temporal.climatology(grid(spark, d), ["lat_idx"])
    return temporal.broadcast_climatology(clim, 24000, 24017).select("lat_idx", "m", F.round("value", 3).alias("value"))


YEARLY = "yearly AS (SELECT CAST(o_custkey % 10 AS INTEGER) AS cell, CAST(year(o_orderdate) AS INTEGER) AS y, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2)"


def yearly(spark, d):
    rows = read(spark, d, "orders")
    return rows.groupBy((F.col("o_custkey") % 10).cast("int").alias("cell"), F.year("o_orderdate").cast("int").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


@query(
    f"""WITH {YEARLY}, seg AS (SELECT *, lead(y) OVER w AS y2, lead(value) OVER w AS v2, row_number() OVER w AS k, lead(y, 2) OVER w AS y3 FROM yearly WINDOW w AS (PARTITION BY cell ORDER BY y)),
    months AS (SELECT unnest(range(23940, 24024)) AS m),
    raw AS (SELECT cell, m, value + (v2 - value) * date_diff('day', make_date(y, 1, 1), make_date(m // 12, m % 12 + 1, 1)) / date_diff('day', make_date(y, 1, 1), make_date(y2, 1, 1)) AS v
      FROM seg JOIN months ON (m >= y * 12 OR k = 1) AND (m < y2 * 12 OR y3 IS NULL) WHERE y2 IS NOT NULL),
    lim AS (SELECT min(value) AS lo, max(value) AS hi FROM yearly)
    SELECT cell, CAST(m AS INTEGER) AS m, CASE WHEN v BETWEEN lo AND hi THEN round(v, 4) END AS value FROM raw, lim"""
)
def yearly_lerp(spark, d):
    return temporal.interpolate_yearly(yearly(spark, d), ["cell"], 23940, 24023).select("cell", "m", F.round("value", 4).alias("value"))


@query(f"WITH {GRID} SELECT lat_idx, CAST(m + 1 AS INTEGER) AS m, 'price -1 Month' AS variable, value FROM grid")
def temporal_shift(spark, d):
    cube = grid(spark, d).withColumn("variable", F.lit("price"))
    return temporal.shift_months(cube, -1).select("lat_idx", month_key(F.col("time")).alias("m"), "variable", "value")


@query(f"WITH {GRID} SELECT g.lat_idx, g.m, g.value, a.value AS value_lag1, b.value AS value_lag3, c.value AS value_lag12 FROM grid g LEFT JOIN grid a ON a.lat_idx = g.lat_idx AND a.m = g.m - 1 LEFT JOIN grid b ON b.lat_idx = g.lat_idx AND b.m = g.m - 3 LEFT JOIN grid c ON c.lat_idx = g.lat_idx AND c.m = g.m - 12")
def lag_features(spark, d):
    return temporal.lag_features(grid(spark, d), ["lat_idx"], [1, 3, 12]).select("lat_idx", "m", "value", "value_lag1", "value_lag3", "value_lag12")


SPANS = """meta AS (SELECT 'lineitem' AS dataset, CAST(min(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS INTEGER) AS lo, CAST(max(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS INTEGER) AS hi, 'monthly' AS frequency FROM lineitem
  UNION ALL SELECT 'orders', CAST(min(year(o_orderdate) * 12 + month(o_orderdate) - 1) AS INTEGER), CAST(max(year(o_orderdate) * 12 + month(o_orderdate) - 1) AS INTEGER), 'monthly' FROM orders UNION ALL SELECT 'nation', NULL, NULL, 'static')"""


@query(f"WITH {SPANS} SELECT dataset, lo AS min_month, hi AS max_month, frequency FROM meta UNION ALL SELECT 'Overall', max(lo), min(hi), NULL FROM meta WHERE frequency = 'monthly'")
def time_span_table(spark, d):
    def span(name, time):
        return read(spark, d, name).agg(F.min(month_key(F.col(time))).alias("min_month"), F.max(month_key(F.col(time))).alias("max_month")).select(F.lit(name).alias("dataset"), "min_month", "max_month", F.lit("monthly").alias("frequency"))

    static = spark.createDataFrame([("nation", None, None, "static")], "dataset string, min_month int, max_month int, frequency string")
    return temporal.time_spans(span("lineitem", "l_shipdate").unionByName(span("orders", "o_orderdate")).unionByName(static))


@query("WITH x AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS cell, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders), y AS (SELECT cell, m, m - lag(m) OVER (PARTITION BY cell ORDER BY m) AS gap FROM x) SELECT cell, CAST(m AS INTEGER) AS m, CAST(gap AS INTEGER) AS gap FROM y WHERE gap <> 1")
def month_gaps(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("cell"), month_start(month_key(F.col("o_orderdate"))).alias("time")).distinct()
    return temporal.month_gaps(rows, ["cell"]).select("cell", month_key(F.col("time")).alias("m"), "gap")


# ---------------------------------------------------------------- masks
@query(f"WITH {GRID} SELECT lat_idx, CAST(m % 12 + 1 AS INTEGER) AS month, round(avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END), 9) < 0.7 AS mask FROM frame GROUP BY 1, 2")
def observed_mask(spark, d):
    observed = frame(spark, d).groupBy("lat_idx", F.month("time").alias("month")).agg(F.round(F.avg(F.col("value").isNotNull().cast("double")), 9).alias("value"))
    return masks.observed_mask(observed, ["lat_idx", "month"], 0.7)


@query("SELECT l_suppkey, bool_and(abs(CASE WHEN l_discount < 0.02 THEN 0 ELSE l_discount END) <= 1e-8) AS mask FROM lineitem GROUP BY l_suppkey")
def no_fire_mask(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_discount") < 0.02, 0.0).otherwise(F.col("l_discount")).alias("value"))
    return masks.no_fire_mask(rows, ["l_suppkey"])


@query(f"WITH {GRID} SELECT lat_idx, m, CASE WHEN lat_idx % 5 = 0 OR (m % 12 = 0 AND lat_idx < 10) THEN NULL ELSE value END AS value FROM grid")
def applied_masks(spark, d):
    cube = grid(spark, d)
    static = cube.select("lat_idx").distinct().withColumn("mask", F.col("lat_idx") % 5 == 0)
    moving = cube.select("lat_idx", "m").withColumn("mask", (F.col("m") % 12 == 0) & (F.col("lat_idx") < 10))
    return masks.apply_masks(cube, static, moving, keys=["lat_idx", "m"]).select("lat_idx", "m", "value")


@query(f"WITH {GRID} SELECT lat_idx, m, value FROM grid WHERE -84 + 7 * lat_idx + 3.5 > -30 AND -84 + 7 * lat_idx - 3.5 < 20")
def lat_box(spark, d):
    cube = grid(spark, d).withColumn("lat", -84.0 + 7 * F.col("lat_idx"))
    return masks.select_box(cube, (-30, 20), None, 3.5, 0).select("lat_idx", "m", "value")


POINTS = "points AS (SELECT s_suppkey AS id, CAST(-60 + (s_suppkey * 37) % 120 AS DOUBLE) AS lat, CAST(-180 + (s_suppkey * 71) % 360 AS DOUBLE) AS lon, s_acctbal AS x FROM supplier)"


def points(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("id"), (-60 + (k * 37) % 120).cast("double").alias("lat"), (-180 + (k * 71) % 360).cast("double").alias("lon"), F.col("s_acctbal").alias("x"))


@query(f"WITH {POINTS} SELECT id, lat BETWEEN -20 AND 40 AND lon BETWEEN -100 AND 60 AS in_box, lat > -50 AND lat <= 50 AND lon < 100 AND lon >= -100 + (lat + 50) AS in_polygon FROM points")
def box_and_polygon_masks(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return points(spark, d).select("id", masks.box(lat, lon, (-20, 40), (-100, 60)).alias("in_box"), (masks.polygon(lat, lon, [(-100, -50), (100, -50), (100, 50), (0, 50)]) & (lat > -50)).alias("in_polygon"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity >= 10 AND l_quantity < 20 AND l_discount >= 0.05) OR (l_tax < 0.01)")
def dnf_constraints(spark, d):
    rows = read(spark, d, "lineitem")
    test = masks.match_constraints([{"l_quantity": (10, 20), "l_discount": (0.05, None)}, {"l_tax": (None, 0.01)}], rows.columns)
    return rows.where(test).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 256 > 100 OR ((l_orderkey % 256) & 215) <> 0 THEN NULL ELSE l_partkey % 256 END AS value FROM lineitem")
def qc_bitmask(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", masks.quality_mask(F.col("l_partkey") % 256, F.col("l_orderkey") % 256).alias("value"))


@query("SELECT event_id, CASE WHEN value >= 1 AND value <= 50 THEN value END AS value FROM events")
def valid_range(spark, d):
    return read(spark, d, "events").select("event_id", masks.valid_range(F.col("value"), 1, 50).alias("value"))


@query(f"WITH {GRID} SELECT lat_idx, min(m) AS first, max(m) AS last FROM grid WHERE value IS NOT NULL AND m % 12 BETWEEN 3 AND 9 GROUP BY lat_idx")
def valid_extent(spark, d):
    cube = grid(spark, d).withColumn("value", F.when((F.col("m") % 12).between(3, 9), F.col("value")))
    return masks.valid_extent(cube, "m", keys=["lat_idx"])


@query(
    """WITH v AS (SELECT DISTINCT CAST(c_custkey % 97 AS INTEGER) AS i FROM customer WHERE c_acctbal > 4000 AND NOT (c_custkey % 97 BETWEEN 30 AND 44)),
    arcs AS (SELECT i AS before, coalesce(lead(i) OVER (ORDER BY i), (SELECT min(i) FROM v) + 97) AS after FROM v),
    cut AS (SELECT * FROM arcs ORDER BY after - before DESC, after > 96 DESC, before LIMIT 1)
    SELECT CAST(after % 97 AS INTEGER) AS first, CAST(before AS INTEGER) AS last, CAST((before - after % 97 + 97) % 97 + 1 AS INTEGER) AS size FROM cut"""
)
def valid_extent_circular(spark, d):
    cube = read(spark, d, "customer").select((F.col("c_custkey") % 97).cast("int").alias("lon_idx"), F.col("c_acctbal").alias("x"))
    cube = cube.withColumn("value", F.when((F.col("x") > 4000) & ~F.col("lon_idx").between(30, 44), F.col("x")))
    return masks.valid_extent_circular(cube, "lon_idx", 97).select(F.col("first").cast("int"), F.col("last").cast("int"), F.col("size").cast("int"))


# ---------------------------------------------------------------- ordered
DAILY = """day AS (SELECT CAST(o_custkey % 20 AS INTEGER) AS cell, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders GROUP BY 1, 2),
span AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM (SELECT min(d) AS a, max(d) AS b FROM day)),
daily AS (SELECT c.cell, s.d, CAST(year(s.d) * 12 + month(s.d) - 1 AS INTEGER) AS m, CAST(day(s.d) - 1 AS INTEGER) AS t, coalesce(day.v, 0) < 300000 AS dry
  FROM (SELECT DISTINCT cell FROM day) c CROSS JOIN span s LEFT JOIN day ON day.cell = c.cell AND day.d = s.d),
hits AS (SELECT *, t - row_number() OVER (PARTITION BY cell, m ORDER BY t) AS island FROM daily WHERE dry),
isl AS (SELECT cell, m, min(t) AS a, max(t) AS b, count(*) AS n FROM hits GROUP BY cell, m, island),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell, m ORDER BY n DESC, a) AS k FROM isl) WHERE k = 1),
lens AS (SELECT cell, m, min(t) AS lo, max(t) AS hi FROM daily GROUP BY 1, 2),
longest AS (SELECT lens.cell, lens.m, coalesce(n, 0) AS length, coalesce(a = lo, FALSE) AS at_start, coalesce(b = hi, FALSE) AS at_end FROM lens LEFT JOIN best USING (cell, m))"""


def daily(spark, d):
    """Days from the least to the greatest order date."""
    cell = (F.col("o_custkey") % 20).cast("int")
    day = read(spark, d, "orders").groupBy(cell.alias("cell"), F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("v"))
    span = read(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("d"))
    every = read(spark, d, "orders").select(cell.alias("cell")).distinct().crossJoin(F.broadcast(span))
    return every.join(day, ["cell", "d"], "left").select("cell", month_key(F.col("d")).alias("m"), (F.dayofmonth("d") - 1).alias("t"), F.coalesce("v", F.lit(0.0)).alias("v"))


@query(f"WITH {DAILY} SELECT cell, m, length, at_start, at_end FROM longest")
def longest_run(spark, d):
    return ordered.longest_run(daily(spark, d), ["cell", "m"], "t", F.col("v") < 300000)


@query(f"WITH {DAILY}, c AS (SELECT *, sum(CASE WHEN at_start AND coalesce(prev, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY m) AS chain FROM (SELECT *, lag(at_end) OVER (PARTITION BY cell ORDER BY m) AS prev FROM longest)) SELECT cell, m, length, CAST(sum(length) OVER (PARTITION BY cell, chain ORDER BY m) AS BIGINT) AS chained FROM c")
def longest_run_chained(spark, d):
    longest = ordered.longest_run(daily(spark, d), ["cell", "m"], "t", F.col("v") < 300000)
    return ordered.chained_run(longest, ["cell"], "m").select("cell", "m", "length", "chained")


@query(
    f"""WITH {GRID}, clim AS (SELECT lat_idx, CAST(m % 12 AS INTEGER) AS t, CASE WHEN lat_idx % 8 = 5 THEN 0 ELSE count(value) END AS v FROM frame GROUP BY 1, 2),
    sig AS (SELECT *, t - row_number() OVER (PARTITION BY lat_idx ORDER BY t) AS island FROM (SELECT *, v / nullif(max(v) OVER (PARTITION BY lat_idx), 0) AS r FROM clim) WHERE r > 0.7),
    isl AS (SELECT lat_idx, min(t) AS a, max(t) AS b, count(*) AS n FROM sig GROUP BY lat_idx, island),
    r AS (SELECT *, row_number() OVER (PARTITION BY lat_idx ORDER BY n DESC, a) AS k, count(*) OVER w AS cnt, sum(n) OVER w AS total,
      max(CASE WHEN a = 0 THEN n END) OVER w AS n0, max(CASE WHEN b = 11 THEN n END) OVER w AS n1, max(CASE WHEN b = 11 THEN a END) OVER w AS a1, max(CASE WHEN a = 0 THEN b END) OVER w AS b0 FROM isl WINDOW w AS (PARTITION BY lat_idx)),
    j AS (SELECT *, CASE WHEN cnt > 1 THEN n0 + n1 END AS both_ends FROM r WHERE k = 1)
    SELECT lat_idx, CASE WHEN both_ends > n THEN a1 ELSE a END AS start, CASE WHEN both_ends > n THEN b0 ELSE b END AS "end", CASE WHEN both_ends > n THEN both_ends ELSE n END AS size,
      round((CASE WHEN both_ends > n THEN both_ends ELSE n END) / total, 9) AS fraction FROM j WHERE both_ends IS NULL OR both_ends <> n"""
)
def fire_season(spark, d):
    clim = frame(spark, d).groupBy("lat_idx", (F.col("m") % 12).cast("int").alias("t")).agg(F.count("value").alias("v")).withColumn("v", F.when(F.col("lat_idx") % 8 == 5, 0).otherwise(F.col("v")))
    return ordered.fire_season(clim, ["lat_idx"], "t", "v", 0.7).withColumn("fraction", F.round("fraction", 9))


@query("WITH x AS (SELECT user_id, event_id, value, sign(value - coalesce(lag(value) OVER w, value)) AS b, sign(coalesce(lead(value) OVER w, value) - value) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, a - b < 0 AS is_max, a - b > 0 AS is_min FROM x")
def local_extrema(spark, d):
    return ordered.local_extrema(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id").select("user_id", "event_id", "is_max", "is_min")


@query(
    """WITH e AS (SELECT user_id, event_id, value - 30 AS v FROM events),
    x AS (SELECT *, sign(v - coalesce(lag(v) OVER w, v)) AS b, sign(coalesce(lead(v) OVER w, v) - v) AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    y AS (SELECT *, CASE WHEN a - b < 0 THEN v END AS hi, CASE WHEN a - b > 0 THEN v END AS lo FROM x),
    z AS (SELECT *, last_value(lo IGNORE NULLS) OVER p AS lo1, last_value(hi IGNORE NULLS) OVER p AS hi1, first_value(lo IGNORE NULLS) OVER q AS lo2, first_value(hi IGNORE NULLS) OVER q AS hi2 FROM y
      WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    s AS (SELECT *, CASE WHEN v > 0 THEN lo1 ELSE hi1 END AS t1, CASE WHEN v > 0 THEN lo2 ELSE hi2 END AS t2 FROM z),
    h AS (SELECT *, coalesce(greatest(CASE WHEN t1 IS NOT NULL THEN least(abs(v), abs(v - t1)) END, CASE WHEN t2 IS NOT NULL THEN least(abs(v), abs(v - t2)) END), abs(v)) AS hh FROM s WHERE (hi IS NOT NULL AND v > 0) OR (lo IS NOT NULL AND v < 0))
    SELECT user_id, event_id, round(hh / m, 6) AS height, CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(v) DESC, event_id) AS INTEGER) AS rank FROM (SELECT *, max(hh) OVER (PARTITION BY user_id) AS m FROM h) WHERE hh / m >= 0.5"""
)
def significant_peaks(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", (F.col("value") - 30).alias("value"))
    return ordered.significant_peaks(rows, ["user_id"], "event_id").select("user_id", "event_id", F.round("height", 6).alias("height"), "rank")


INTERVALS = """iv AS (SELECT o_custkey AS k, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS b FROM orders),
mark AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY k ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS fresh FROM iv),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM mark),
merged AS (SELECT k, min(a) AS a, max(b) AS b FROM grp GROUP BY k, g)"""


def intervals(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("end"))


@query(f"WITH {INTERVALS} SELECT k, CAST(a AS DATE) AS start, CAST(b AS DATE) AS \"end\" FROM merged")
def merge_intervals(spark, d):
    return ordered.merge_intervals(intervals(spark, d), ["k"]).select("k", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


SHIPPED = "SELECT l_orderkey, l_linenumber, o_custkey AS k, l_shipdate AS at_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"WITH {INTERVALS}, p AS ({SHIPPED}) SELECT l_orderkey, l_linenumber FROM p WHERE NOT EXISTS (SELECT 1 FROM merged WHERE merged.k = p.k AND p.at_time >= merged.a AND p.at_time < merged.b)")
def interval_anti_join(spark, d):
    at = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("k"), F.col("l_shipdate").alias("at_time"))
    return ordered.outside_intervals(at, intervals(spark, d), ["k"], "at_time").select("l_orderkey", "l_linenumber")


@query("SELECT n_nationkey, CAST(CASE WHEN n_nationkey < 25 * 1 // 4 THEN 0 WHEN n_nationkey < 25 * 2 // 4 THEN 1 WHEN n_nationkey < 25 * 3 // 4 THEN 2 ELSE 3 END AS INTEGER) AS batch FROM nation")
def contiguous_batches(spark, d):
    return ordered.batches(read(spark, d, "nation"), "n_nationkey", 25, 4).select("n_nationkey", "batch")


@query("SELECT a.n_nationkey, (a.n_nationkey + b.n_nationkey) / 2.0 AS centre FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
def centres(spark, d):
    rows = read(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("double").alias("v"), F.lit(0).alias("k"))
    return ordered.centres(rows, ["k"], "n_nationkey", "v").select("n_nationkey", "centre")


# ---------------------------------------------------------------- gap filling
NEIGHBOURS = ", ".join(f"lag(value, {i}) OVER w AS p{i}, lead(value, {i}) OVER w AS n{i}" for i in (1, 2, 3))
CHOICES = ", ".join(f"CASE WHEN p{i} IS NOT NULL AND n{i} IS NOT NULL THEN (p{i} + n{i}) / 2 ELSE coalesce(p{i}, n{i}) END" for i in (1, 2, 3))


@query(f"WITH {GRID}, x AS (SELECT lat_idx, m, value, {NEIGHBOURS}, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY lat_idx, m % 12) AS missing FROM frame WINDOW w AS (PARTITION BY lat_idx ORDER BY m)) SELECT lat_idx, m, round(CASE WHEN value IS NULL AND missing > 0.2 THEN coalesce({CHOICES}) ELSE value END, 6) AS filled FROM x")
def temporal_nn_fill(spark, d):
    return gapfill.temporal_neighbours(frame(spark, d), ["lat_idx"], "m", 3, 0.2).select("lat_idx", "m", F.round("filled", 6).alias("filled"))


@query(f"WITH {GRID}, x AS (SELECT *, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY lat_idx, m % 12) AS missing, min(value) OVER (PARTITION BY lat_idx) AS least FROM frame) SELECT lat_idx, m, CASE WHEN value IS NULL AND missing + 1e-5 >= 0.5 THEN least ELSE value END AS filled FROM x")
def persistent_fill(spark, d):
    return gapfill.persistent(frame(spark, d), ["lat_idx"], "m", 50).select("lat_idx", "m", "filled")


@query(f"WITH {GRID} SELECT lat_idx, m, coalesce(value, min(value) OVER (PARTITION BY lat_idx)) AS filled FROM frame")
def minimum_fill(spark, d):
    return gapfill.minimum(frame(spark, d), ["lat_idx"]).select("lat_idx", "m", "filled")


@query(
    f"""WITH {GRID}, x AS (SELECT *, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY lat_idx, m % 12) AS missing, min(value) OVER (PARTITION BY lat_idx) AS least FROM frame),
    p AS (SELECT lat_idx, m, CASE WHEN value IS NULL AND missing + 1e-5 >= 0.5 THEN least ELSE value END AS value FROM x),
    {gapfill.season_sql("p", "lat_idx", "m").replace("SELECT lat_idx, m, coalesce(y, fit) AS filled FROM", "SELECT lat_idx, m, round(coalesce(y, fit), 2) AS filled FROM")}"""
)
def season_trend_fill(spark, d):
    return gapfill.persistent_season_trend(frame(spark, d).drop("time"), ["lat_idx"], "m").select("lat_idx", "m", F.round("filled", 2).alias("filled"))


NEAREST = """near AS (SELECT h.lat_idx, h.m, v.value, row_number() OVER (PARTITION BY h.m, h.lat_idx ORDER BY (h.lat_idx - v.lat_idx) * (h.lat_idx - v.lat_idx) + (h.m - v.m) * (h.m - v.m), v.lat_idx, v.m) AS k
      FROM frame h JOIN frame v ON h.value IS NULL AND v.value IS NOT NULL)"""


@query(f"WITH {GRID}, {NEAREST} SELECT f.lat_idx, f.m, coalesce(f.value, near.value) AS filled FROM frame f LEFT JOIN near ON near.lat_idx = f.lat_idx AND near.m = f.m AND k = 1")
def spatial_nn_fill(spark, d):
    return gapfill.nearest_cell(frame(spark, d).select("lat_idx", "m", "value"), ["lat_idx", "m"]).select("lat_idx", "m", "filled")


# ---------------------------------------------------------------- spatial
WORLD = "world AS (SELECT CAST(l_suppkey % 12 AS INTEGER) AS lat_idx, CAST(l_partkey % 24 AS INTEGER) AS lon_idx, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE round(avg(l_quantity), 4) END AS value FROM lineitem GROUP BY 1, 2)"
SOURCE_LAT, SOURCE_LON = [-82.5 + 15 * i for i in range(12)], [-172.5 + 15 * i for i in range(24)]
TARGET_LAT, TARGET_LON = [-75.0 + 30 * i for i in range(6)], [-150.0 + 60 * i for i in range(6)]


def world(spark, d):
    value = F.when(F.count(F.lit(1)) % 5 != 0, F.round(F.avg("l_quantity"), 4))
    return read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 12).cast("int").alias("lat_idx"), (F.col("l_partkey") % 24).cast("int").alias("lon_idx")).agg(value.alias("value"))


@query(f"WITH {WORLD} SELECT CAST(lat_idx // 2 AS INTEGER) AS lat_idx, CAST(lon_idx // 4 AS INTEGER) AS lon_idx, value FROM world WHERE lat_idx % 2 = 0 AND lon_idx % 4 = 1")
def regrid_nearest(spark, d):
    return spatial.regrid_to(world(spark, d), SOURCE_LAT, SOURCE_LON, TARGET_LAT, TARGET_LON, [], "nearest")


@query(f"WITH {WORLD}, w AS (SELECT *, sin(radians(-75 + 15 * lat_idx)) - sin(radians(-90 + 15 * lat_idx)) AS w FROM world) SELECT CAST(lat_idx // 2 AS INTEGER) AS lat_idx, CAST(lon_idx // 4 AS INTEGER) AS lon_idx, CASE WHEN sum(CASE WHEN value IS NULL THEN w ELSE 0 END) / sum(w) <= 0.4 + 1e-12 THEN round(sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) END AS value FROM w GROUP BY 1, 2")
def regrid_conservative(spark, d):
    out = spatial.regrid_to(world(spark, d), SOURCE_LAT, SOURCE_LON, TARGET_LAT, TARGET_LON, [], "conservative", 0.4)
    return out.select("lat_idx", "lon_idx", F.round("value", 6).alias("value"))


@query(f"WITH {WORLD}, p AS (SELECT lat_idx // 2 AS a, lon_idx // 4 AS b, sum(value) AS s, count(value) AS n FROM world WHERE lon_idx % 4 IN (1, 2) GROUP BY 1, 2), lim AS (SELECT min(value) AS lo, max(value) AS hi FROM world) SELECT CAST(a AS INTEGER) AS lat_idx, CAST(b AS INTEGER) AS lon_idx, CASE WHEN n = 4 AND s / 4 BETWEEN 2 * lo - hi AND 2 * hi - lo THEN round(s / 4, 6) END AS value FROM p, lim")
def regrid_bilinear(spark, d):
    out = spatial.regrid_to(world(spark, d), SOURCE_LAT, SOURCE_LON, TARGET_LAT, TARGET_LON, [], "bilinear")
    return out.select("lat_idx", "lon_idx", F.round("value", 6).alias("value"))


CONVERSION = [(c, p, x) for c in range(1, 41) for p, x in (("crop", c % 7 * 10), ("shrub", 20), ("tree", 80 - c % 7 * 10))]
CONVERSION_SQL = "conv AS (SELECT c AS category, p AS pft, CASE p WHEN 'crop' THEN c % 7 * 10 WHEN 'shrub' THEN 20 ELSE 80 - c % 7 * 10 END AS pct FROM (SELECT unnest(range(1, 41)) AS c) CROSS JOIN (SELECT unnest(['crop', 'shrub', 'tree']) AS p))"


@query(f"WITH {CONVERSION_SQL}, names AS (SELECT DISTINCT pft FROM conv) SELECT p_partkey, n.pft, CAST(coalesce(pct, 0) AS INTEGER) AS pct FROM part CROSS JOIN names n LEFT JOIN conv ON conv.category = p_size AND conv.pft = n.pft")
def category_to_fractions(spark, d):
    cells = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("category"))
    return spatial.category_fractions(cells, spark.createDataFrame(CONVERSION, "category int, pft string, pct int"), ["p_partkey"])


@query(f"WITH {CONVERSION_SQL} SELECT p_partkey, round((coalesce(max(CASE WHEN pft = 'tree' THEN pct END), 0) + coalesce(max(CASE WHEN pft = 'shrub' THEN pct END), 0)) * CAST(0.01 AS DOUBLE), 6) AS woody, round(coalesce(max(CASE WHEN pft = 'crop' THEN pct END), 0) * CAST(0.01 AS DOUBLE), 6) AS herb FROM part LEFT JOIN conv ON conv.category = p_size GROUP BY p_partkey")
def fraction_sums(spark, d):
    wide = category_to_fractions(spark, d).groupBy("p_partkey").pivot("pft", ["crop", "shrub", "tree"]).agg(F.first("pct"))
    out = spatial.sums_of_fractions(wide, {"woody": ["tree", "shrub"], "herb": ["crop"]})
    return out.select("p_partkey", F.round("woody", 6).alias("woody"), F.round("herb", 6).alias("herb"))


@query("WITH px AS (SELECT CAST(l_orderkey % 4 AS INTEGER) AS date, CAST(l_linenumber AS INTEGER) AS h, CAST(l_suppkey % 5 AS INTEGER) AS v, CAST(l_partkey % 3 AS INTEGER) AS i, CAST(l_quantity AS INTEGER) % 3 AS j, l_quantity AS value FROM lineitem WHERE l_orderkey % 4 <> 3 OR l_suppkey % 5 = 0), ok AS (SELECT date FROM px GROUP BY date HAVING count(DISTINCT h * 100 + v) >= 20) SELECT date, \"row\", col, count(*) AS n, max(value) AS value FROM (SELECT px.date, CAST(14 - (v * 3 + i) AS INTEGER) AS \"row\", CAST(h * 3 + j AS INTEGER) AS col, value FROM px JOIN ok ON px.date = ok.date) GROUP BY 1, 2, 3")
def tile_mosaic(spark, d):
    rows = read(spark, d, "lineitem").where("l_orderkey % 4 <> 3 or l_suppkey % 5 = 0")
    px = rows.select((F.col("l_orderkey") % 4).cast("int").alias("date"), F.col("l_linenumber").cast("int").alias("h"), (F.col("l_suppkey") % 5).cast("int").alias("v"), (F.col("l_partkey") % 3).cast("int").alias("i"), (F.col("l_quantity").cast("int") % 3).alias("j"), F.col("l_quantity").alias("value"))
    return spatial.mosaic(px, 3, 5, 20).groupBy("date", "row", "col").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))


@query(f"WITH {POINTS} SELECT id, ((lon + 180) % 360 + 360) % 360 - 180 AS lon180, (lon % 360 + 360) % 360 AS lon360 FROM points")
def lon_rebase(spark, d):
    return points(spark, d).select("id", fn.lon_to_180(F.col("lon")).alias("lon180"), fn.lon_to_360(F.col("lon")).alias("lon360"))


@query("SELECT n_nationkey, round(6367470.0 * 6367470.0 * radians(15.0) * (sin(radians(-84 + 7 * n_nationkey + 3.5)) - sin(radians(-84 + 7 * n_nationkey - 3.5))) / 1e6, 3) AS km2 FROM nation WHERE n_nationkey < 25")
def cell_areas(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.round(spatial.cell_area(-84.0 + 7 * F.col("n_nationkey"), 7.0, 15.0) / 1e6, 3).alias("km2"))


#: The names that the codes stand for.
REGION_NAMES = ["Ocean", "Boreal North America", "Temperate North America", "Central America", "Northern Hemisphere South America", "Southern Hemisphere South America", "Europe", "Middle East", "Northern Hemisphere Africa", "Southern Hemisphere Africa", "Boreal Asia", "Central Asia", "Southeast Asia", "Equatorial Asia", "Australia and New Zealand"]


@query(f"SELECT CAST(r AS INTEGER) AS region, {REGION_NAMES}[r + 1] AS name, count(*) AS n FROM (SELECT o_orderkey % 20 AS r FROM orders) WHERE r BETWEEN 0 AND 14 GROUP BY r")
def region_lookup(spark, d):
    rows = read(spark, d, "orders").select((F.col("o_orderkey") % 20).cast("int").alias("region"))
    return rows.join(F.broadcast(spatial.region_table(spark)), "region").groupBy("region", "name").agg(F.count("code").alias("n"))


# ---------------------------------------------------------------- statistics and features
@query(
    f"""WITH {POINTS}, pr AS (SELECT 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) AS d, a.x - b.x AS dx FROM points a JOIN points b ON a.id > b.id AND abs(a.lat - b.lat) < 20),
    g AS (SELECT CAST(floor(d / 200.0) AS INTEGER) AS bin, count(*) AS n, var_pop(dx) / 2 AS s FROM pr WHERE d < 2000 GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(s, 0), 3) AS semivariance FROM (SELECT unnest(range(0, 10)) AS i) LEFT JOIN g ON bin = i"""
)
def variogram(spark, d):
    out = stats.variogram(points(spark, d), "id", "lat", "lon", "x", 10, 2000.0)
    return out.select("bin", "n", F.round("semivariance", 3).alias("semivariance"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS var FROM lineitem GROUP BY l_returnflag")
def merged_statistics(spark, d):
    parts = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"), F.var_pop("l_quantity").alias("var"))
    return stats.merge_stats(parts, ["l_returnflag"]).select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query("WITH h AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 70 AS w, count(*) AS n FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) / w), 69) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (any_value(h.n) * any_value(w)), 12) AS density FROM lineitem, h GROUP BY 1")
def histogram70(spark, d):
    return stats.histogram(read(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice").select("bin", "n", F.round("density", 12).alias("density"))


@query("SELECT round(1 / (1 - regr_r2(l_extendedprice, l_quantity)), 6) AS vif FROM lineitem")
def vif2(spark, d):
    return read(spark, d, "lineitem").agg(F.round(stats.vif_pair(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("vif"))


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]))
def corr_matrix(spark, d):
    return stats.correlations(read(spark, d, "lineitem"), COLUMNS).withColumn("r", F.round("r", 9))


@query("WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS l, quantile_cont(l_extendedprice, 0.9) AS h FROM lineitem GROUP BY 1) SELECT round(min(l), 6) AS vmin, round(max(h), 6) AS vmax FROM q")
def percentile_limits(spark, d):
    return stats.percentile_limits(read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 5, 90).select(F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


@query("WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem) SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 9) AS r2, round(avg((y - p) * (y - p)), 2) AS mse FROM p")
def r2_mse(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return stats.scores(rows, "y", "p").select(F.round("r2", 9).alias("r2"), F.round("mse", 2).alias("mse"))


@query(f"WITH {GRID} SELECT m, round(sum(cos(radians(-84 + 7 * lat_idx)) * value) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(-84 + 7 * lat_idx)) END), 6) AS value FROM grid GROUP BY m")
def area_weighted_mean(spark, d):
    cube = grid(spark, d).withColumn("lat", -84.0 + 7 * F.col("lat_idx"))
    return stats.area_weighted_mean(cube, ["m"]).select("m", F.round("value", 6).alias("value"))


LONG = "long AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus AS variable, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2, 3)"


def long_cube(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("int").alias("y"), F.col("o_orderstatus").alias("variable")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


@query(f"WITH {LONG} SELECT a.k, a.y, a.value AS \"F\", b.value AS \"O\" FROM long a JOIN long b ON a.k = b.k AND a.y = b.y AND a.variable = 'F' AND b.variable = 'O'")
def master_mask_features(spark, d):
    return features.feature_matrix(long_cube(spark, d), ["k", "y"], ["F", "O"])


@query(f"WITH {LONG} SELECT a.k, a.y, round(ln(a.value + 0.01), 6) AS \"log F\", round(sqrt(b.value), 6) AS \"sqrt O\", round(sign(a.value - b.value) * ln(1 + abs(a.value - b.value)), 6) AS diff FROM long a JOIN long b ON a.k = b.k AND a.y = b.y AND a.variable = 'F' AND b.variable = 'O' WHERE a.k % 7 <> 0")
def feature_pipeline(spark, d):
    cubes = long_cube(spark, d)
    hidden = cubes.select("k").distinct().withColumn("mask", F.col("k") % 7 == 0)
    out = features.data_processing(cubes, ["k", "y"], "F", ["O"], {"diff": fn.log_modulus(F.col("F") - F.col("O"))}, [], ["F"], ["O"], [hidden])
    return out.select("k", "y", *[F.round(f"`{c}`", 6).alias(c) for c in ("log F", "sqrt O", "diff")])


@query("SELECT o_orderkey, CAST(CASE WHEN r < e * (s + 1) THEN r // (s + 1) ELSE e + (r - e * (s + 1)) // s END AS INTEGER) AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () // 7 AS s, count(*) OVER () % 7 AS e FROM orders)")
def kfold_assignment(spark, d):
    return models.folds(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("WITH s AS (SELECT p_brand AS params, p_size % 5 AS split, avg(p_retailprice) AS test FROM part GROUP BY 1, 2) SELECT params, round(avg(test), 6) AS score FROM s GROUP BY params HAVING count(*) = 5 ORDER BY avg(test) DESC, params LIMIT 1")
def best_parameters(spark, d):
    rows = read(spark, d, "part").groupBy(F.col("p_brand").alias("params"), (F.col("p_size") % 5).alias("split")).agg(F.avg("p_retailprice").alias("test"))
    return models.best_parameters(rows, 5).select("params", F.round("score", 6).alias("score"))


#: A name for each pattern of short names, and what it becomes.
LONG_NAMES = {"LAI -3 - 0 Month": "LAI Δ3M", "FAPAR -12 Month": "FAPAR 12M", "VOD 6 M": "VOD 6M", "VOD Ku-band": "VOD", "Diurnal Temp Range": "DTR", "Dry Day Period -1 Month": "DD 1M", "SWI(1)": "SWI", "lightning": "Lightning", "Max Temp": "MaxT", "AGB Tree": "AGB", "ShrubAll": "SHRUB", "TreeAll": "TREE", "pftCrop": "CROP", "pftHerb": "HERB", "popd": "POPD", "CAPE": "CAPE"}


@query(f"SELECT o_orderkey, {list(LONG_NAMES)}[o_orderkey % {len(LONG_NAMES)} + 1] AS long_name, {list(LONG_NAMES.values())}[o_orderkey % {len(LONG_NAMES)} + 1] AS short_name FROM orders")
def name_shorten(spark, d):
    name = F.get(F.array(*[F.lit(n) for n in LONG_NAMES]), (F.col("o_orderkey") % len(LONG_NAMES)).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", name.alias("long_name"), fn.shorten(name).alias("short_name"))


@query("SELECT count(*) AS n, CAST(2 AS BIGINT) AS n_content, CAST(3 AS BIGINT) AS n_tables FROM lineitem")
def content_fingerprint(spark, d):
    rows = read(spark, d, "lineitem")
    dealt = rows.repartition(max(5, rows.count() // 200_000))  # tasks of a bounded size
    a, b = stats.fingerprint(rows), stats.fingerprint(dealt.select(*rows.columns[::-1]))
    other = stats.fingerprint(rows.withColumn("l_tax", F.when(F.col("l_quantity") == 1, F.col("l_tax") + 1).otherwise(F.col("l_tax"))))
    return a.unionByName(b).unionByName(other).groupBy("n").agg(F.count_distinct("total", "mix").alias("n_content"), F.count(F.lit(1)).alias("n_tables"))


@query("SELECT o_orderkey, CAST(o_orderkey % 100 * 3600 + o_custkey % 60 * 60 + o_orderkey % 60 AS INTEGER) AS seconds FROM orders")
def walltimes(spark, d):
    text = F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(":"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    return read(spark, d, "orders").select("o_orderkey", fn.walltime_seconds(text).alias("seconds"))


@query("SELECT event_id, make_date(2000 + CAST(event_id % 20 AS INTEGER), 1, 1) + CAST(event_id % 365 AS INTEGER) AS day FROM events")
def year_day_dates(spark, d):
    return read(spark, d, "events").select("event_id", fn.date_of_year_day((2000 + F.col("event_id") % 20).cast("int"), (F.col("event_id") % 365 + 1).cast("int")).alias("day"))


@query(
    """WITH sizes AS (SELECT (SELECT count(*) FROM region) AS a, (SELECT count(*) FROM nation) AS o, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS t)
    SELECT CAST(t AS INTEGER) AS t, CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx, round(-90 + (i + 0.5) * 180.0 / a, 9) AS lat, round(-180 + (j + 0.5) * 360.0 / o, 9) AS lon, CAST(t * 10000 + i * 100 + j AS DOUBLE) AS value
    FROM (SELECT a, o, unnest(range(0, t)) AS t FROM sizes), (SELECT unnest(range(0, a)) AS i FROM sizes), (SELECT unnest(range(0, o)) AS j FROM sizes)"""
)
def synthetic_grid(spark, d):
    """As many latitudes as regions, longitudes as nations and months as market segments."""
    segments = read(spark, d, "customer").select("c_mktsegment").distinct().count()
    cube = synthetic_cube(spark, read(spark, d, "region").count(), read(spark, d, "nation").count(), segments, F.col("t") * 10000 + F.col("lat_idx") * 100 + F.col("lon_idx"))
    return cube.select((month_key(F.col("time")) - 1970 * 12).alias("t"), "lat_idx", "lon_idx", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "value")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def outstanding_work(spark, d):
    return read(spark, d, "orders").select("o_orderkey").join(read(spark, d, "lineitem").where("l_linenumber > 3"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


# ---------------------------------------------------------------- scans and scalar functions
@query(f"WITH {DAILY} SELECT cell, m, CAST(sum(CASE WHEN dry THEN 1 ELSE 0 END) AS BIGINT) AS dry_days, count(*) AS days FROM daily GROUP BY 1, 2")
def dry_day_counts(spark, d):
    return daily(spark, d).groupBy("cell", "m").agg(F.sum((F.col("v") < 300000).cast("long")).alias("dry_days"), F.count(F.lit(1)).alias("days"))


@query(
    """WITH mo AS (SELECT CAST(o_custkey % 5 AS INTEGER) AS cell, date_trunc('month', o_orderdate) AS a, avg(o_totalprice) AS v FROM orders WHERE month(o_orderdate) % 2 = 0 GROUP BY 1, 2),
    da AS (SELECT CAST(o_custkey % 5 AS INTEGER) AS cell, date_trunc('month', o_orderdate) AS a, o_totalprice AS v FROM orders WHERE month(o_orderdate) % 2 = 1),
    al AS (SELECT * FROM mo UNION ALL SELECT cell, a, avg(v) FROM da WHERE NOT EXISTS (SELECT 1 FROM mo WHERE mo.cell = da.cell AND mo.a = da.a) GROUP BY 1, 2)
    SELECT cell, CAST(year(a) * 12 + month(a) - 1 AS INTEGER) AS m, round(v, 4) AS value FROM al"""
)
def monthly_daily_hybrid(spark, d):
    from ..sources import monthly_and_daily

    rows = read(spark, d, "orders").select((F.col("o_custkey") % 5).cast("int").alias("cell"), F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"))
    months = temporal.monthly_mean(rows.where("month(time) % 2 = 0"), ["cell"]).select("cell", F.col("time").alias("start"), (F.col("time") + F.expr("INTERVAL 1 MONTH")).alias("end"), "value")
    return monthly_and_daily(months, rows, ["cell"]).select("cell", month_key(F.col("time")).alias("m"), F.round("value", 4).alias("value"))


@query("SELECT CAST(x.h AS INTEGER) AS h, CAST(x.v AS INTEGER) AS v, count(*) AS n FROM (SELECT l_orderkey % 36 AS h, l_partkey % 18 AS v FROM lineitem) x GROUP BY 1, 2")
def tile_positions(spark, d):
    from ..sources import tile_position

    name = F.format_string("MOD.A2000001.h%02dv%02d.hdf", F.col("l_orderkey") % 36, F.col("l_partkey") % 18)
    h, v = tile_position(F.col("name"))
    return read(spark, d, "lineitem").select(name.alias("name")).groupBy(h.alias("h"), v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name AS label FROM nation")
def char_decode(spark, d):
    codes = F.transform(F.split(F.concat(F.col("n_name"), F.lit("   ")), ""), lambda c: F.ascii(c))
    return read(spark, d, "nation").select("n_nationkey", fn.decode_chars(F.filter(codes, lambda c: c > 0)).alias("label"))


@query(f"WITH {POINTS} SELECT id, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(10.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin((radians(20.0) - radians(lon)) / 2), 2)))), 6) AS km FROM points")
def distances(spark, d):
    return points(spark, d).select("id", F.round(fn.haversine_km(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 6).alias("km"))


@query("SELECT n_nationkey, round(1.5 + 0.25 * n_nationkey + 2 * sin(2 * pi() * n_nationkey / 12 + 0.3) + 0.5 * sin(4 * pi() * n_nationkey / 12 - 1), 9) AS value FROM nation")
def harmonics(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.round(fn.harmonic(F.col("n_nationkey"), 1.5, 0.25, [(2.0, 0.3), (0.5, -1.0)]), 9).alias("value"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN round((l_tax - l_discount) / l_tax, 9) END AS difference, abs(l_tax - l_discount) <= 1e-8 + 1e-5 * abs(l_discount) AS close FROM lineitem")
def relative_differences(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(fn.relative_difference(F.col("l_tax"), F.col("l_discount")), 9).alias("difference"), fn.is_close(F.col("l_tax"), F.col("l_discount")).alias("close"))


@query("WITH x AS (SELECT o_orderkey, (o_orderkey % 1000 - 500) * 10000.0 AS x, (o_custkey % 1000 - 500) * 10000.0 AS y FROM orders) SELECT o_orderkey, round(degrees(y / 6371007.181), 9) AS lat, round(degrees(x / (6371007.181 * cos(y / 6371007.181))), 9) AS lon FROM x")
def sinusoidal_inverse(spark, d):
    lat, lon = fn.sinusoidal_to_lat_lon((F.col("o_orderkey") % 1000 - 500) * 10000.0, (F.col("o_custkey") % 1000 - 500) * 10000.0)
    return read(spark, d, "orders").select("o_orderkey", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("WITH x AS (SELECT p_partkey, p_size % 30 / 3.0 * 5 - 70 AS lat, p_partkey % 100 - 50 AS lon, p_retailprice AS v FROM part) SELECT CAST(floor((lat + 90) / 10) AS BIGINT) AS lat_idx, CAST(floor((lon + 180) / 10) AS BIGINT) AS lon_idx, round(avg(v) * 0.01, 6) AS value FROM x GROUP BY 1, 2")
def coarsened_pixels(spark, d):
    lat, lon = F.col("p_size") % 30 / 3.0 * 5 - 70, (F.col("p_partkey") % 100 - 50).cast("double")
    out = spatial.coarsen(read(spark, d, "part").withColumn("value", F.col("p_retailprice")), [], lat, lon, 10.0, 0.01)
    return out.select("lat_idx", "lon_idx", F.round("value", 6).alias("value"))


@query("SELECT 'F' AS dataset, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS variables FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'O', array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') FROM orders WHERE o_orderstatus = 'O'")
def collection_state(spark, d):
    from ..operators.algebra import Dataset, Datasets

    def part(status):
        cube = read(spark, d, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderpriority").alias("variable"), F.col("o_totalprice").alias("value"))
        return Dataset(status, cube, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))

    both = Datasets([part("O"), part("F"), part("P")]).remove_datasets(["P"])
    return both.cube().groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_set("variable")), ",").alias("variables"))


@query("SELECT p_type AS value FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part)")
def shared_attributes(spark, d):
    from ..operators.algebra import shared_attributes as shared

    return shared(read(spark, d, "part").select(F.col("p_brand").alias("cube"), F.lit("type").alias("key"), F.col("p_type").alias("value"))).select("value")


@query(f"WITH {GRID} SELECT lat_idx, m, value * 2 AS predicted FROM frame")
def scattered_predictions(spark, d):
    whole = frame(spark, d).select("lat_idx", "m", "value")
    values = masks.unmasked(whole).select("lat_idx", "m", (F.col("value") * 2).alias("predicted"))
    return masks.scatter(values, whole, ["lat_idx", "m"]).select("lat_idx", "m", "predicted")


@query()
def forest_partial_dependence(spark, d):
    rows = read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    dealt = rows.repartition(max(1, rows.count() // 200_000))  # the fit holds each partition's points as one block
    model = models.forest(["l_quantity", "l_discount"], "l_extendedprice", numTrees=5, maxDepth=5).fit(dealt)
    return models.partial_dependence(rows, model, "l_quantity", models.pdp_grid(rows, "l_quantity", 5))


# ---------------------------------------------------------------- plans of several operators
TWO_YEARLY = """two AS (SELECT 'a' AS variable, CAST(o_custkey % 10 AS INTEGER) AS cell, CAST(year(o_orderdate) AS INTEGER) AS y, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 2, 3
  UNION ALL SELECT 'b', CAST(o_custkey % 10 AS INTEGER), CAST(year(o_orderdate) AS INTEGER), round(avg(o_totalprice) * 100, 4) FROM orders GROUP BY 2, 3)"""


@query(
    f"""WITH {TWO_YEARLY}, seg AS (SELECT *, lead(y) OVER w AS y2, lead(value) OVER w AS v2, row_number() OVER w AS k, lead(y, 2) OVER w AS y3 FROM two WINDOW w AS (PARTITION BY variable, cell ORDER BY y)),
    months AS (SELECT unnest(range(23940, 24024)) AS m),
    raw AS (SELECT variable, cell, m, value + (v2 - value) * date_diff('day', make_date(y, 1, 1), make_date(m // 12, m % 12 + 1, 1)) / date_diff('day', make_date(y, 1, 1), make_date(y2, 1, 1)) AS v
      FROM seg JOIN months ON (m >= y * 12 OR k = 1) AND (m < y2 * 12 OR y3 IS NULL) WHERE y2 IS NOT NULL),
    lim AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM two GROUP BY variable)
    SELECT raw.variable, cell, CAST(m AS INTEGER) AS m, CASE WHEN v BETWEEN lo AND hi THEN round(v, 4) END AS value FROM raw JOIN lim ON raw.variable = lim.variable"""
)
def yearly_lerp_by_variable(spark, d):
    a = yearly(spark, d).withColumn("variable", F.lit("a"))
    b = read(spark, d, "orders").groupBy((F.col("o_custkey") % 10).cast("int").alias("cell"), F.year("o_orderdate").cast("int").alias("year")).agg(F.round(F.avg("o_totalprice") * 100, 4).alias("value")).withColumn("variable", F.lit("b"))
    return temporal.interpolate_yearly(a.unionByName(b), ["variable", "cell"], 23940, 24023).select("variable", "cell", "m", F.round("value", 4).alias("value"))


@query("SELECT 0 AS zero, CAST(35 AS INTEGER) AS bin, count(*) AS n, CAST(70.0 AS DOUBLE) AS density, CAST(0 AS DOUBLE) AS r2, round(avg(l_tax * l_tax), 9) AS mse, CAST('inf' AS DOUBLE) AS vif FROM lineitem")
def constant_columns(spark, d):
    """Histogram, scores and variance inflation where a column is constant or follows from another."""
    rows = read(spark, d, "lineitem").select(F.lit(3.0).alias("c"), (F.col("l_tax") + 3).alias("p"), F.col("l_quantity"), (F.col("l_quantity") * 2).alias("q"))
    hist = stats.histogram(rows, "c").select("bin", "n", F.round("density", 6).alias("density"))
    score = stats.scores(rows, "c", "p").select("r2", F.round("mse", 9).alias("mse"))
    inflated = rows.agg(stats.vif_pair(F.col("l_quantity"), F.col("q")).alias("vif")).select(F.when(F.col("vif") > 1e9, float("inf")).otherwise(F.col("vif")).alias("vif"))
    return hist.crossJoin(score).crossJoin(inflated).select(F.lit(0).alias("zero"), "bin", "n", "density", "r2", "mse", "vif")


@query(
    f"""WITH {GRID}, s AS (SELECT lat_idx, m, value FROM frame WHERE m BETWEEN 23955 - 3 AND 24002 + 3), x AS (SELECT lat_idx, m, value, {NEIGHBOURS}, avg(CASE WHEN m BETWEEN 23955 AND 24002 THEN CASE WHEN value IS NULL AND lat_idx <> 4 THEN 1.0 ELSE 0.0 END END) OVER (PARTITION BY lat_idx, m % 12) AS missing FROM s WINDOW w AS (PARTITION BY lat_idx ORDER BY m))
    SELECT lat_idx, m, round(CASE WHEN value IS NULL AND missing > 0.2 THEN coalesce({CHOICES}) ELSE value END, 6) AS filled FROM x WHERE m BETWEEN 23955 AND 24002"""
)
def temporal_nn_span(spark, d):
    out = gapfill.temporal_neighbours_span(frame(spark, d), ["lat_idx"], "m", 3, 23955, 24002, 0.2, land=F.col("lat_idx") != 4)
    return out.select("lat_idx", "m", F.round("filled", 6).alias("filled"))


@query(f"WITH {GRID}, seen AS (SELECT lat_idx, m, count(*) / 40.0 AS f FROM grid GROUP BY 1, 2), c AS (SELECT 'burned area' AS variable, lat_idx, m, value FROM grid UNION ALL SELECT 'other', lat_idx, m, value FROM grid) SELECT 'GFED_burned_area__thres_0.650' AS name, variable, lat_idx, m, CASE WHEN variable = 'burned area' AND (lat_idx * 7 + m) % 100 / 100.0 < 0.65 THEN NULL ELSE value END AS value FROM c")
def observed_masked(spark, d):
    cube = grid(spark, d).select("lat_idx", "m", "value")
    both = cube.withColumn("variable", F.lit("burned area")).unionByName(cube.withColumn("variable", F.lit("other")))
    fraction = cube.select("lat_idx", "m", ((F.col("lat_idx") * 7 + F.col("m")) % 100 / 100.0).alias("value"))
    name, out = masks.observed_masked(both, fraction, ["lat_idx", "m"], ["burned area"], "GFED", 0.65)
    return out.select(F.lit(name).alias("name"), "variable", "lat_idx", "m", "value")


@query(
    f"""WITH {GRID}, {NEAREST}
    SELECT 'A' AS dataset, 'price' AS variable, f.lat_idx, f.m, CASE WHEN f.lat_idx % 6 <> 0 THEN coalesce(f.value, near.value) END AS value FROM frame f LEFT JOIN near ON near.lat_idx = f.lat_idx AND near.m = f.m AND k = 1
    UNION ALL SELECT 'B', 'burned area', lat_idx, m, CASE WHEN lat_idx % 6 <> 0 THEN CAST(lat_idx AS DOUBLE) END FROM frame"""
)
def filled_collection(spark, d):
    """The reference variable is masked where lat_idx is a multiple of 6: these cells are hidden in all variables, others are filled over cells and months."""
    from ..operators.algebra import Dataset, Datasets

    cube = frame(spark, d).select("lat_idx", "m", "value")
    a = Dataset("A", cube.withColumn("variable", F.lit("price")), ("price",))
    b = Dataset("B", cube.select("lat_idx", "m", F.lit("burned area").alias("variable"), F.when(F.col("lat_idx") % 6 != 0, F.col("lat_idx").cast("double")).alias("value")), ("burned area",))
    return Datasets([a, b]).fill(["lat_idx", "m"]).cube().select("dataset", "variable", "lat_idx", "m", "value")


LAG_SQL = f"""cells AS (SELECT 'LAI' AS variable, lat_idx, m, value FROM grid UNION ALL SELECT 'BA', lat_idx, m, value * 2 FROM grid UNION ALL SELECT 'Max', lat_idx, m, value + 10 FROM grid UNION ALL SELECT 'Min', lat_idx, m, value FROM grid),
moved AS (SELECT * FROM cells UNION ALL SELECT 'LAI -1 Month', lat_idx, m + 1, value FROM cells WHERE variable = 'LAI' UNION ALL SELECT 'LAI -3 Month', lat_idx, m + 3, value FROM cells WHERE variable = 'LAI'),
clim AS (SELECT variable, lat_idx, CAST(m % 12 + 1 AS INTEGER) AS month, avg(value) AS v FROM moved WHERE m BETWEEN 23953 AND 24000 GROUP BY 1, 2, 3),
wide AS (SELECT lat_idx, month, max(CASE WHEN variable = 'BA' THEN v END) AS ba, max(CASE WHEN variable = 'LAI' THEN v END) AS l0, max(CASE WHEN variable = 'LAI -1 Month' THEN v END) AS l1, max(CASE WHEN variable = 'LAI -3 Month' THEN v END) AS l3, max(CASE WHEN variable = 'Max' THEN v END) AS hi, max(CASE WHEN variable = 'Min' THEN v END) AS lo FROM clim GROUP BY 1, 2)"""


@query(f"WITH {GRID}, {LAG_SQL} SELECT lat_idx, month, round(ba, 5) AS ba, round(l0, 5) AS lai, round(l1, 5) AS lai1, round(l3, 5) AS lai3, round(hi - lo, 5) AS temp_range FROM wide WHERE ba IS NOT NULL AND l0 IS NOT NULL AND l1 IS NOT NULL AND l3 IS NOT NULL AND hi IS NOT NULL AND lo IS NOT NULL")
def lag_pipeline(spark, d):
    g = materialize(grid(spark, d).select("lat_idx", "time", "value"), "grid")  # the cubes and their shifts share one scan
    parts = {"LAI": F.col("value"), "BA": F.col("value") * 2, "Max": F.col("value") + 10, "Min": F.col("value")}
    cubes = None
    for name, value in parts.items():
        part = g.select(F.lit(name).alias("variable"), "lat_idx", "time", value.alias("value"))
        cubes = part if cubes is None else cubes.unionByName(part)
    out = features.lag_pipeline(cubes, ["lat_idx"], "BA", ["LAI", "Max", "Min"], ["LAI"], [1, 3], (23953, 24000), transformations={"Temp Range": F.col("Max") - F.col("Min")}, deletions=["Max", "Min"])
    return out.select("lat_idx", "month", F.round("BA", 5).alias("ba"), F.round("LAI", 5).alias("lai"), F.round("`LAI -1 Month`", 5).alias("lai1"), F.round("`LAI -3 Month`", 5).alias("lai3"), F.round("`Temp Range`", 5).alias("temp_range"))


@query(f"WITH {GRID}, lim AS (SELECT greatest((SELECT min(m) FROM grid), (SELECT min(m) FROM grid WHERE m > 23960)) AS a, least((SELECT max(m) FROM grid), (SELECT max(m) FROM grid WHERE m > 23960)) AS b) SELECT 'x' AS variable, lat_idx, m, value FROM grid, lim WHERE m BETWEEN a AND b UNION ALL SELECT 'y', lat_idx, m, value * 3 FROM grid, lim WHERE m > 23960 AND m BETWEEN a AND b UNION ALL SELECT 'z', CAST(n_nationkey AS INTEGER), CAST(t.m AS INTEGER), CAST(n_regionkey AS DOUBLE) FROM nation, (SELECT unnest(range(a, b + 1)) AS m FROM lim) t")
def prepare_selection_default_span(spark, d):
    from ..operators.algebra import Dataset, Datasets
    from . import prepare_selection

    g = grid(spark, d).select("lat_idx", "time", "m", "value")
    x = Dataset("X", g.drop("m").withColumn("variable", F.lit("x")), ("x",))
    y = Dataset("Y", g.where("m > 23960").drop("m").withColumn("value", F.col("value") * 3).withColumn("variable", F.lit("y")), ("y",))
    z = Dataset("Z", read(spark, d, "nation").select(F.lit("z").alias("variable"), F.col("n_nationkey").cast("int").alias("lat_idx"), F.col("n_regionkey").cast("double").alias("value")), ("z",))
    return prepare_selection(Datasets([x, y, z]), {"X": "monthly", "Y": "monthly", "Z": "static"}, ["lat_idx"], which="monthly").select("variable", "lat_idx", "m", "value")


@query("WITH y AS (SELECT CAST(o_custkey % 10 AS INTEGER) AS cell, year(o_orderdate) AS y, month(o_orderdate) AS mo, max(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3), c AS (SELECT DISTINCT cell, y FROM y) SELECT c.cell, CAST(c.y * 12 + t.mo - 1 AS INTEGER) AS m, y.v AS value FROM c CROSS JOIN (SELECT unnest(range(1, 13)) AS mo) t LEFT JOIN y ON y.cell = c.cell AND y.y = c.y AND y.mo = t.mo")
def grouped_years(spark, d):
    """One file a year, with twelve groups."""
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 10).cast("int").alias("cell"), F.format_string("GFED4.0_MQ_%04d.hdf5", F.year("o_orderdate")).alias("file"), F.month("o_orderdate").alias("mo"), "o_totalprice")
    wide = rows.groupBy("cell", "file").pivot("mo", list(range(1, 13))).agg(F.max("o_totalprice"))
    wide = wide.select("cell", "file", *[F.col(str(i)).alias(f"g{i:02d}") for i in range(1, 13)])
    return temporal.year_groups(wide, {i: f"g{i:02d}" for i in range(1, 13)}).select("cell", "m", "value")


@query("SELECT p_partkey, CAST([2000, 2005, 2010, 2015, 2020][p_size % 8 + 1] AS INTEGER) AS year, p_retailprice AS value FROM part WHERE p_size % 8 < 5")
def raster_slabs(spark, d):
    rows = read(spark, d, "part").select("p_partkey", (F.col("p_size") % 8 + 1).cast("int").alias("raster"), F.col("p_retailprice").alias("value"))
    return temporal.slabs(rows, [2000, 2005, 2010, 2015, 2020]).select("p_partkey", F.col("year").cast("int").alias("year"), "value")


@query("SELECT CAST(1992 + year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders) AS INTEGER) AS year, o_orderpriority AS variable, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2")
def yearly_landcover_files(spark, d):
    rows = read(spark, d, "orders").select(F.format_string("lc_%04d.nc", F.year("o_orderdate")).alias("file"), F.col("o_orderpriority").alias("variable"), "o_totalprice")
    table = rows.groupBy("file", "variable").agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return temporal.yearly_files(table, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).select("year", "variable", "value")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'burned_area' ELSE 'number of patches' END AS variable, n_name AS label, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 250.0 ELSE o_totalprice END, 6) AS value FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30")
def burned_by_class(spark, d):
    from ..sources import burned_by_class as by_class

    padded = F.rpad("n_name", 20, " ")
    codes = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("vegetation_class"), F.transform(F.split(padded, ""), lambda c: F.ascii(c)).alias("codes"))
    codes = codes.withColumn("codes", F.filter("codes", lambda c: c > 0))
    rows = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "burned_area").otherwise("number of patches").alias("variable"), (F.col("o_custkey") % 30).cast("long").alias("vegetation_class"), F.col("o_totalprice").alias("value"))
    return by_class(rows, codes, F.lit(250.0)).select("o_orderkey", "variable", "label", F.round("value", 6).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS variable, CASE WHEN event_id % 7 = 0 OR value < 1 THEN NULL WHEN event_id % 3 = 0 THEN round(value * 2 * 0.01, 9) ELSE round(value * 2, 9) END AS value FROM events")
def scaled_by_variable(spark, d):
    """Infinite values are masked, one variable has a scale of its own."""
    from ..sources import Loader

    rows = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "a").otherwise("b").alias("variable"), F.when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value")).alias("value"))
    return Loader("x", scale=2.0, low=1.0, scales={"a": 0.01}).read(rows).select("event_id", "variable", F.round("value", 9).alias("value"))


@query(f"WITH {POINTS} SELECT id, (lat > -50 AND lat <= 0 AND lon >= -100 AND lon < 0) OR (lat > 10 AND lat <= 50 AND lon >= 50 AND lon < 120) AS land FROM points")
def land_mask(spark, d):
    def square(a, b, c, e):
        return [(a, b), (c, b), (c, e), (a, e)]

    shapes = [square(-100, -50, 0, 0), square(-180, -60, 180, 60), square(50, 10, 120, 50)]
    return points(spark, d).select("id", masks.land(F.col("lat"), F.col("lon"), shapes, (1,)).alias("land"))


@query(
    f"""WITH {CONVERSION_SQL},
    full_ AS (SELECT p_partkey % 40 AS cell, y AS year, n.pft AS pft, coalesce(c.pct, 0) AS pct FROM part CROSS JOIN (SELECT unnest([1992, 1993]) AS y) CROSS JOIN (SELECT DISTINCT pft FROM conv) n LEFT JOIN conv c ON c.category = p_size + y - 1992 AND c.pft = n.pft)
    SELECT CAST(cell AS INTEGER) AS cell, CAST(year AS INTEGER) AS year, round(avg(CASE WHEN pft = 'tree' THEN pct END) * CAST(0.01 AS DOUBLE) + avg(CASE WHEN pft = 'shrub' THEN pct END) * CAST(0.01 AS DOUBLE), 6) AS woody, round(avg(CASE WHEN pft = 'crop' THEN pct END) * CAST(0.01 AS DOUBLE), 6) AS herb FROM full_ GROUP BY 1, 2"""
)
def landcover_product(spark, d):
    """Categories of fine pixels and years to fractions, these averaged to coarse cells, and summed to woody and herb shares."""
    years = spark.createDataFrame([(1992,), (1993,)], "year int")
    px = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 40).cast("int").alias("cell"), "p_size").crossJoin(F.broadcast(years))
    cells = px.select("p_partkey", "cell", "year", (F.col("p_size") + F.col("year") - 1992).cast("int").alias("category"))
    parts = spatial.category_fractions(cells, spark.createDataFrame(CONVERSION, "category int, pft string, pct int"), ["p_partkey", "cell", "year"])
    wide = parts.groupBy("cell", "year").pivot("pft", ["crop", "shrub", "tree"]).agg(F.avg("pct"))
    out = spatial.sums_of_fractions(wide, {"woody": ["tree", "shrub"], "herb": ["crop"]})
    return out.select("cell", "year", F.round("woody", 6).alias("woody"), F.round("herb", 6).alias("herb"))


# ---------------------------------------------------------------- coastlines, trees, footprints, calendars, files
@query(" UNION ALL ".join(f"SELECT l_suppkey, CAST({x} AS DOUBLE) AS share, round(quantile_cont(l_extendedprice, {x}), 4) AS v FROM lineitem GROUP BY l_suppkey" for x in (0.05, 0.5, 0.9)))
def percentiles_by_supplier(spark, d):
    """Percentiles of many small groups."""
    found = stats.exact_percentiles(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", [0.05, 0.5, 0.9])
    return found.select("l_suppkey", "share", F.round("percentile", 4).alias("v"))


RINGS = """vertices AS (SELECT o_custkey % 6 AS polygon, r AS ring, o_orderkey AS place, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey % 6, r) AS n, round((8 + o_totalprice % 20) / (1 + r), 6) AS radius
      FROM orders CROSS JOIN (SELECT unnest([0, 1]) AS r) WHERE o_custkey % 6 < 4 WINDOW w AS (PARTITION BY o_custkey % 6, r ORDER BY o_orderkey)),
    corners AS (SELECT polygon, ring, k, n, -150 + 80 * polygon + round(radius * cos(2 * pi() * k / n), 6) AS x, round(radius * sin(2 * pi() * k / n), 6) AS y FROM vertices),
    edges AS (SELECT a.polygon, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corners a JOIN corners b ON a.polygon = b.polygon AND a.ring = b.ring AND b.k = a.k % a.n + 1)"""


@query(
    f"""WITH {RINGS}, places AS (SELECT c_custkey, -40 + (c_custkey * 7 % 97) * 0.83 AS lat, -180 + (c_custkey * 31 % 359) * 1.003 AS lon FROM customer),
    hits AS (SELECT c_custkey, polygon, count(*) AS n FROM places JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 WHERE polygon <> 2 GROUP BY 1, 2)
    SELECT c_custkey, c_custkey IN (SELECT c_custkey FROM hits WHERE n % 2 = 1) AS land FROM places"""
)
def polygon_edges(spark, d):
    """Four ragged coastlines, each with a hole, made of the orders; the third is ignored. Points are the customers'."""
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 6).alias("polygon"), F.col("o_orderkey").alias("place"), (8 + F.col("o_totalprice") % 20).alias("radius"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ring")).where("polygon < 4")
    by = Window.partitionBy("polygon", "ring")
    turn = 2 * math.pi * F.row_number().over(by.orderBy("place")) / F.count(F.lit(1)).over(by)
    rows = rows.withColumns({"turn": turn, "radius": F.round(F.col("radius") / (1 + F.col("ring")), 6)})
    vertices = rows.select("polygon", "ring", "place", (-150 + 80 * F.col("polygon") + F.round(F.col("radius") * F.cos("turn"), 6)).alias("lon"), F.round(F.col("radius") * F.sin("turn"), 6).alias("lat"))
    k = F.col("c_custkey")
    places = read(spark, d, "customer").select("c_custkey", (-40 + (k * 7 % 97) * 0.83).alias("lat"), (-180 + (k * 31 % 359) * 1.003).alias("lon"))
    return polygons.inside(places, polygons.edges(vertices), ignore=[2], name="land").select("c_custkey", "land")


LEAVES = "leaves AS (SELECT l_returnflag AS f, CASE WHEN l_quantity <= 25 THEN CASE WHEN l_discount <= 0.05 THEN 3 ELSE 4 END ELSE CASE WHEN l_quantity <= 40 THEN 5 ELSE 6 END END AS id, count(*) AS n, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2)"


@query(
    f"""WITH {LEAVES}, t AS (SELECT f, max(CASE WHEN id = 3 THEN p END) AS p3, max(CASE WHEN id = 4 THEN p END) AS p4, max(CASE WHEN id = 5 THEN p END) AS p5, max(CASE WHEN id = 6 THEN p END) AS p6, max(CASE WHEN id = 3 THEN n END) AS n3, max(CASE WHEN id = 4 THEN n END) AS n4, max(CASE WHEN id = 5 THEN n END) AS n5, max(CASE WHEN id = 6 THEN n END) AS n6 FROM leaves GROUP BY f)
    SELECT 'quantity' AS feature, CAST(v AS DOUBLE) AS value, round(avg(CASE WHEN v <= 25 THEN (n3 * p3 + n4 * p4) / (n3 + n4) WHEN v <= 40 THEN p5 ELSE p6 END), 5) AS mean FROM t, (SELECT unnest([1, 25, 26, 40, 50]) AS v) GROUP BY v
    UNION ALL SELECT 'discount', CAST(v AS DOUBLE), round(avg(((n3 + n4) * CASE WHEN v <= 0.05 THEN p3 ELSE p4 END + n5 * p5 + n6 * p6) / (n3 + n4 + n5 + n6)), 5) FROM t, (SELECT unnest([CAST(0.0 AS DOUBLE), 0.05, 0.06, 0.1]) AS v) GROUP BY v"""
)
def path_dependence(spark, d):
    """Partial dependence of a forest whose trees (one for each return flag) split at given places, by walking them."""
    leaf = F.when(F.col("l_quantity") <= 25, F.when(F.col("l_discount") <= 0.05, 3).otherwise(4)).otherwise(F.when(F.col("l_quantity") <= 40, 5).otherwise(6))
    leaves = read(spark, d, "lineitem").groupBy("l_returnflag", leaf.alias("id")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("l_extendedprice").alias("prediction"))
    inner = leaves.withColumn("id", F.explode(F.array(F.lit(0), F.floor((F.col("id") - 1) / 2).cast("int")))).groupBy("l_returnflag", "id").agg(F.sum("n").alias("n"), F.lit(0.0).alias("prediction"))
    every = inner.unionByName(leaves.select("l_returnflag", "id", "n", "prediction"))
    splits = F.col("id") < 3
    nodes = every.select(
        F.ascii("l_returnflag").alias("tree"), "id", F.when(splits, F.col("id") * 2 + 1).otherwise(-1).cast("int").alias("left"), F.when(splits, F.col("id") * 2 + 2).otherwise(-1).cast("int").alias("right"),
        F.when(splits, F.when(F.col("id") == 1, 1).otherwise(0)).cast("int").alias("feature"), F.when(splits, F.element_at(F.array(F.lit(25.0), F.lit(0.05), F.lit(40.0)), F.least(F.col("id"), F.lit(2)) + 1)).alias("threshold"), "n", "prediction",
    )
    parts = [models.path_dependence(nodes, i, at).select(F.lit(name).alias("feature"), "value", F.round("mean", 5).alias("mean")) for i, (name, at) in enumerate({"quantity": [1, 25, 26, 40, 50], "discount": [0.0, 0.05, 0.06, 0.1]}.items())]
    return parts[0].unionByName(parts[1])


@query(
    """WITH px AS (SELECT c_nationkey % 3 AS date, c_custkey % 36 AS h, (c_custkey // 36) % 18 AS v, c_custkey % 120 AS val, (c_custkey * 7) % 2 AS i, (c_custkey * 3) % 2 AS j, c_custkey % 256 AS qc FROM customer),
    enough AS (SELECT date FROM px GROUP BY date HAVING count(DISTINCT h * 100 + v) >= 10),
    good AS (SELECT date, CAST(val AS DOUBLE) AS val, 90.0 - (v * 2 + i) * 5.0 - 5 AS s, -180.0 + (h * 2 + j) * 5.0 AS w FROM px WHERE val <= 100 AND (qc & 215) = 0 AND date IN (SELECT date FROM enough)),
    strips AS (SELECT date, val, w, lat_idx, cos(radians(lat_idx * 2.5 - 90 + 1.25)) AS c FROM (SELECT *, unnest([CAST((s + 90) / 2.5 AS INTEGER), CAST((s + 90) / 2.5 AS INTEGER) + 1]) AS lat_idx FROM good)),
    spans AS (SELECT date, val, lat_idx, c, greatest(-180.0, w / c) AS a, least(180.0, (w + 5) / c) AS b FROM strips),
    cells AS (SELECT date, val, lat_idx, lon_idx, (least(b, (lon_idx + 1) * 2.5 - 180) - greatest(a, lon_idx * 2.5 - 180)) * c / 5 * 0.5 AS share FROM spans, (SELECT unnest(range(144)) AS lon_idx) WHERE b > a)
    SELECT date, CAST(lat_idx AS INTEGER) AS lat_idx, CAST(lon_idx AS INTEGER) AS lon_idx, round(sum(share * val) / sum(share) * 0.01, 6) AS value FROM cells WHERE share > 1e-9 GROUP BY 1, 2, 3"""
)
def tile_fractions(spark, d):
    """Tiles of 2 x 2 pixels through quality mask, tile count and footprints to cells of 2.5 degrees."""
    k = F.col("c_custkey")
    px = read(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("date"), (k % 36).alias("h"), (F.floor(k / 36) % 18).alias("v"), ((k * 7) % 2).alias("i"), ((k * 3) % 2).alias("j"), (k % 120).alias("value"), (k % 256).alias("qc"))
    out = spatial.tile_product(px, 2, 2.5, least_tiles=10)
    return out.select("date", "lat_idx", "lon_idx", F.round("value", 6).alias("value"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, o_custkey % 5000 AS days, (o_orderkey % 50000) * 6 + 3 AS hours FROM orders),
    c360 AS (SELECT k, (2001 - 1970) * 360 + days AS n FROM x), c365 AS (SELECT k, (2000 - 1970) * 365 + 59 + (hours + 6) / 24.0 AS n FROM x), std AS (SELECT k, epoch(make_timestamp(1850, 1, 1, 0, 0, 0)) / 86400 + hours / 24.0 AS n FROM x),
    d365 AS (SELECT k, n, CAST(floor(n) AS BIGINT) AS f FROM c365), m365 AS (SELECT *, f % 365 AS r, len(list_filter([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334], lambda b: b <= f % 365)) AS mo FROM d365)
    SELECT '360_day' AS calendar, k, CAST(n AS DOUBLE) AS days, CAST(1970 + n // 360 AS INTEGER) AS year, CAST(n % 360 // 30 + 1 AS INTEGER) AS month, CAST(n % 30 + 1 AS INTEGER) AS day, 0 AS second, CAST(n // 30 * 30 + 15 AS DOUBLE) AS middle FROM c360
    UNION ALL SELECT 'noleap', k, round(n, 6), CAST(1970 + f // 365 AS INTEGER), CAST(mo AS INTEGER), CAST(r - [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][mo] + 1 AS INTEGER), CAST(round((n - f) * 86400) AS INTEGER), f - r + [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][mo] + [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][mo] / 2.0 FROM m365
    UNION ALL SELECT 'standard', k, round(n, 6), CAST(year(t) AS INTEGER), CAST(month(t) AS INTEGER), CAST(day(t) AS INTEGER), CAST(epoch(t) - epoch(date_trunc('day', t)) AS INTEGER), epoch(date_trunc('month', t)) / 86400 + date_diff('day', date_trunc('month', t), date_trunc('month', t) + INTERVAL 1 MONTH) / 2.0 FROM (SELECT k, n, make_timestamp(1850, 1, 1, 0, 0, 0) + to_hours(CAST(hours AS INTEGER)) AS t FROM std JOIN x USING (k))"""
)
def calendar_times(spark, d):
    """Times in three calendars and units, brought to days since 1970, with their dates and the middles of their months."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5000).alias("days"), ((F.col("o_orderkey") % 50000) * 6 + 3).alias("hours"))
    out = None
    for calendar, units, number in (("360_day", "days since 2001-1-1", "days"), ("noleap", "hours since 2000-03-01 06:00", "hours"), ("standard", "hours since 1850-01-01 00:00:00", "hours")):
        cube = calendars.homogenise_time({calendar: (rows.select("k", F.col(number).alias("time")), units, calendar)})[calendar]
        cube = calendars.with_dates(cube, "days since 1970-01-01", calendar).withColumnRenamed("time", "days")
        part = calendars.mid_months(cube, calendar, name="middle").select(F.lit(calendar).alias("calendar"), "k", F.round("days", 6).alias("days"), "year", "month", "day", "second", "middle")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH cells AS (SELECT l_orderkey % 12 AS lat_idx, l_partkey % 24 AS lon_idx, CASE WHEN count(*) % 5 <> 0 THEN round(avg(l_quantity), 4) END AS value FROM lineitem GROUP BY 1, 2),
    w AS (SELECT lat_idx // 2 AS lat, lon_idx // 3 AS lon, value, sin(radians(lat_idx * 15 - 75)) - sin(radians(lat_idx * 15 - 90)) AS w FROM cells)
    SELECT CAST(lat AS INTEGER) AS lat_idx, CAST(lon AS INTEGER) AS lon_idx, round(sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) AS value FROM w GROUP BY 1, 2"""
)
def ascii_regridded(spark, d):
    """A grid made of the line items, written as an ESRI ASCII file, read in splits and averaged by area to cells of 30 x 45 degrees."""
    value = F.when(F.count(F.lit(1)) % 5 != 0, F.round(F.avg("l_quantity"), 4))
    cells = read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 12).cast("int").alias("lat_idx"), (F.col("l_partkey") % 24).cast("int").alias("lon_idx")).agg(value.alias("value"))
    path = f"{shared_dir(spark)}/grid"
    ascii_.write(cells, path, -180.0, -90.0, 15.0)
    out = ascii_.regridded(spark, path, [-75.0 + 30 * i for i in range(6)], [-157.5 + 45 * i for i in range(8)])
    return out.select("lat_idx", "lon_idx", F.round("value", 6).alias("value"))


@query()
def lagged_search(spark, d):
    """Best parameters of forests over unlagged features, and over these and lagged ones."""
    by = Window.partitionBy("lat_idx").orderBy("m")
    rows = frame(spark, d).select("lat_idx", "m", "value", (F.col("m") % 12).alias("month"), *[F.lag("value", n).over(by).alias(f"value_lag{n}") for n in (1, 3)])
    plain = ["lat_idx", "month"]
    scores, best = models.feature_set_search(rows.withColumn("id", F.col("lat_idx") * 100_000 + F.col("m")), {"no shift": plain, "shift": [*plain, "value_lag1", "value_lag3"]}, "value", models.parameter_sets({"numTrees": [4], "maxDepth": [2, 4]}), f"{shared_dir(spark)}/scores", k=2, order="id")
    wanted = spark.createDataFrame([(name, float(b["score"])) for name, b in best.items()], "features string, score double")
    return scores.groupBy("features", "params").agg(F.count(F.lit(1)).alias("splits"), F.avg("test").alias("mean")).join(F.broadcast(wanted), "features").select("features", "params", "splits", (F.abs(F.col("mean") - F.col("score")) < 1e-12).alias("best"))


# ---------------------------------------------------------------- whole products
@query(
    f"""WITH {CONVERSION_SQL}, px AS (SELECT CAST(1992 + l_suppkey % 2 AS INTEGER) AS year, l_orderkey % 12 AS lat_idx, l_partkey % 24 AS lon_idx, CAST(max(l_quantity) AS INTEGER) AS category FROM lineitem GROUP BY 1, 2, 3),
    w AS (SELECT year, lat_idx // 2 AS lat, lon_idx // 3 AS lon, category, sin(radians(lat_idx * 15 - 75)) - sin(radians(lat_idx * 15 - 90)) AS w FROM px),
    p AS (SELECT year, lat, lon, w, n.pft, coalesce(c.pct, 0) AS pct FROM w CROSS JOIN (SELECT DISTINCT pft FROM conv) n LEFT JOIN conv c ON c.category = w.category AND c.pft = n.pft),
    f AS (SELECT year, lat, lon, sum(CASE WHEN pft = 'crop' THEN w * pct END) / sum(CASE WHEN pft = 'crop' THEN w END) / 100 AS crop, sum(CASE WHEN pft = 'shrub' THEN w * pct END) / sum(CASE WHEN pft = 'crop' THEN w END) / 100 AS shrub, sum(CASE WHEN pft = 'tree' THEN w * pct END) / sum(CASE WHEN pft = 'crop' THEN w END) / 100 AS tree FROM p GROUP BY 1, 2, 3)
    SELECT year, CAST(lat AS INTEGER) AS lat_idx, CAST(lon AS INTEGER) AS lon_idx, round(crop, 6) AS crop, round(shrub, 6) AS shrub, round(tree, 6) AS tree, round(tree + shrub, 6) AS woody FROM f"""
)
def landcover_regridded(spark, d):
    """Category pixels of two years to fractions on cells of 30 x 45 degrees, averaged by area, with a sum of types."""
    px = read(spark, d, "lineitem").groupBy((1992 + F.col("l_suppkey") % 2).cast("int").alias("year"), (F.col("l_orderkey") % 12).cast("int").alias("lat_idx"), (F.col("l_partkey") % 24).cast("int").alias("lon_idx")).agg(F.max("l_quantity").cast("int").alias("category"))
    lat, lon = [-82.5 + 15 * i for i in range(12)], [-172.5 + 15 * i for i in range(24)]
    out = products.landcover(px, spark.createDataFrame(CONVERSION, "category int, pft string, pct int"), lat, lon, [-75.0 + 30 * i for i in range(6)], [-157.5 + 45 * i for i in range(8)], sums={"woody": ("pfttree", "pftshrub")})
    return out.select("year", "lat_idx", "lon_idx", F.round("pftcrop", 6).alias("crop"), F.round("pftshrub", 6).alias("shrub"), F.round("pfttree", 6).alias("tree"), F.round("woody", 6).alias("woody"))


@query(
    """WITH a AS (SELECT o_orderpriority AS file, 'title' AS key, 'p ' || o_orderstatus AS value FROM orders UNION ALL SELECT o_orderpriority, 'id', o_orderstatus FROM orders UNION ALL SELECT o_orderpriority, 'units', '1' FROM orders UNION ALL SELECT o_orderpriority, 'flag_values', o_orderstatus FROM orders)
    SELECT key, string_agg(DISTINCT value, ';' ORDER BY value) AS value FROM a WHERE key <> 'flag_values' GROUP BY key
    UNION ALL SELECT 'time_coverages', string_agg(s, ';' ORDER BY file) FROM (SELECT o_orderpriority AS file, strftime(min(o_orderdate), '%Y%m%d') || '-' || strftime(max(o_orderdate), '%Y%m%d') AS s FROM orders GROUP BY 1)"""
)
def folded_attributes(spark, d):
    o = read(spark, d, "orders")
    spans = o.groupBy(F.col("o_orderpriority").alias("file")).agg(F.date_format(F.min("o_orderdate"), "yyyyMMdd").alias("a"), F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("b"))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    status = F.col("o_orderstatus")
    rows = o.select(F.col("o_orderpriority").alias("file"), F.inline(F.array(pair("title", F.concat(F.lit("p "), status)), pair("id", status), pair("units", F.lit("1")), pair("flag_values", status))))
    rows = rows.unionByName(spans.select("file", F.inline(F.array(pair("time_coverage_start", F.col("a")), pair("time_coverage_end", F.col("b"))))))
    return products.fold_attributes(rows).select("key", F.array_join("values", ";").alias("value"))


def _by_product(spark, d):
    base = frame(spark, d).groupBy("lat_idx", (F.col("m") % 12).cast("int").alias("month")).agg(F.count("value").alias("a"), F.sum(F.when(F.col("value") > 6000, 1).otherwise(0)).alias("b"))
    return base.select("lat_idx", "month", F.inline(F.array(F.struct(F.lit("count").alias("product"), F.col("a").alias("value")), F.struct(F.lit("high").alias("product"), F.col("b").alias("value")))))


@query(
    f"""WITH {GRID}, base AS (SELECT lat_idx, CAST(m % 12 AS INTEGER) AS t, count(value) AS a, sum(CASE WHEN value > 6000 THEN 1 ELSE 0 END) AS b FROM frame GROUP BY 1, 2),
    clim AS (SELECT 'count' AS product, lat_idx, t, a AS v FROM base UNION ALL SELECT 'high', lat_idx, t, b FROM base),
    sig AS (SELECT *, t - row_number() OVER (PARTITION BY product, lat_idx ORDER BY t) AS island FROM (SELECT *, v / nullif(max(v) OVER (PARTITION BY product, lat_idx), 0) AS r FROM clim) WHERE r > 0.7),
    isl AS (SELECT product, lat_idx, min(t) AS a, max(t) AS b, count(*) AS n FROM sig GROUP BY product, lat_idx, island),
    r AS (SELECT *, row_number() OVER (PARTITION BY product, lat_idx ORDER BY n DESC, a) AS k, count(*) OVER w AS cnt, sum(n) OVER w AS total,
      max(CASE WHEN a = 0 THEN n END) OVER w AS n0, max(CASE WHEN b = 11 THEN n END) OVER w AS n1, max(CASE WHEN b = 11 THEN a END) OVER w AS a1, max(CASE WHEN a = 0 THEN b END) OVER w AS b0 FROM isl WINDOW w AS (PARTITION BY product, lat_idx)),
    j AS (SELECT *, CASE WHEN cnt > 1 THEN n0 + n1 END AS both_ends FROM r WHERE k = 1),
    s AS (SELECT product, lat_idx, CASE WHEN both_ends > n THEN a1 ELSE a END AS a, CASE WHEN both_ends > n THEN b0 ELSE b END AS b, CASE WHEN both_ends > n THEN both_ends ELSE n END AS size, total FROM j WHERE both_ends IS NULL OR both_ends <> n)
    SELECT s.product, s.lat_idx, a AS start, b AS "end", size, round(size / total, 9) AS fraction, CAST(t AS INTEGER) AS month FROM s, (SELECT unnest(range(12)) AS t) WHERE (t - a + 12) % 12 <= (b - a + 12) % 12"""
)
def fire_seasons_by_product(spark, d):
    """Seasons of two products in one call, with the months of each."""
    season, months = products.fire_seasons(_by_product(spark, d), ["lat_idx"], 0.7)
    return season.join(months, ["product", "lat_idx"]).select("product", "lat_idx", "start", "end", "size", F.round("fraction", 9).alias("fraction"), "month")


@query(
    """WITH px AS (SELECT event_id, make_date(1998 + CAST(event_id % 4 AS INTEGER), 1, 1) + CAST((event_id // 4) % 46 * 8 AS INTEGER) AS start, (event_id % 97) / 97.0 AS v FROM events)
    SELECT CAST(year(start + INTERVAL 4 DAY - INTERVAL 1 SECOND) * 12 + month(start + INTERVAL 4 DAY - INTERVAL 1 SECOND) - 1 AS INTEGER) AS m, count(*) AS n, round(avg(v), 9) AS value FROM px WHERE start <> DATE '1999-07-04' GROUP BY 1"""
)
def composite_months(spark, d):
    """Eight-day composites named by year and day of year, one of them ignored, to months by their middles."""
    k = F.col("event_id")
    day = (F.floor(k / 4) % 46 * 8 + 1).cast("int")
    rows = read(spark, d, "events").select(F.format_string("Fpar_500m_%04d%03d_0d25.nc", (1998 + k % 4).cast("int"), day).alias("file"), ((k % 97) / 97.0).alias("value"))
    out = products.composites(rows, ignore=("1999185",), expected_missing=(date(1999, 7, 4),))
    return out.groupBy(month_key(F.col("time")).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("value"))


@query(
    """WITH x AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'Vegetation Optical Depth' ELSE 'flags' END AS name, CASE WHEN event_id % 2 = 0 THEN 'Ku-band' ELSE 'X-band' END AS band, user_id % 5 AS cell, ts, value FROM events)
    SELECT name || ' ' || band AS variable, cell, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS m, round(avg(value), 6) AS value FROM x WHERE name <> 'flags' GROUP BY 1, 2, 3"""
)
def banded_daily_months(spark, d):
    k = F.col("event_id")
    rows = read(spark, d, "events").select(F.concat(F.lit("/daily/x/"), F.year("ts").cast("string"), F.lit("/a.nc")).alias("path"), F.when(k % 3 == 0, "Vegetation Optical Depth").otherwise("flags").alias("name"), F.when(k % 2 == 0, "Ku-band").otherwise("X-band").alias("band"), (F.col("user_id") % 5).alias("cell"), F.col("ts").alias("time"), "value")
    return products.banded_months(rows, ["cell"]).select("variable", "cell", "m", F.round("value", 6).alias("value"))


@query("SELECT DISTINCT p_type AS name, (lower(p_type) LIKE '%steel%' OR replace(lower(p_type), '_', ' ') LIKE '%small plated%') AND lower(p_type) NOT LIKE '%log%' AS log FROM part")
def log_names(spark, d):
    """Which names are shown on a log scale, for other names than the fixed ones."""
    return read(spark, d, "part").select(F.col("p_type").alias("name")).distinct().withColumn("log", products.log_scale(F.col("name"), ("steel", "small plated")))


CELLS = "cells AS (SELECT CAST(l_orderkey % 12 AS INTEGER) AS lat_idx, CAST(l_partkey % 24 AS INTEGER) AS lon_idx, avg(l_quantity) AS q, avg(l_discount) AS dis FROM lineitem GROUP BY 1, 2)"


def cells(spark, d):
    return read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 12).cast("int").alias("lat_idx"), (F.col("l_partkey") % 24).cast("int").alias("lon_idx")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("dis"))


@query(
    f"""WITH {CELLS} SELECT lat_idx, lon_idx, CAST(lat_idx * 15 - 82.5 AS DOUBLE) AS lat, round(CASE WHEN ((q >= 20 AND q < 26 AND dis >= 0.04) OR dis < 0.05) AND lat_idx * 15 - 82.5 >= -60 AND lat_idx * 15 - 82.5 > -50 AND lat_idx * 15 - 82.5 <= 60 AND lon_idx * 15 - 172.5 >= -100 AND lon_idx * 15 - 172.5 < 120 THEN q END, 9) AS value FROM cells"""
)
def constrained_map(spark, d):
    """Cells that meet either constraint, on land and north of -60 degrees."""
    rows = cells(spark, d).withColumns({"lat": F.col("lat_idx") * 15 - 82.5, "lon": F.col("lon_idx") * 15 - 172.5})
    land = rows.select("lat_idx", "lon_idx", masks.land(F.col("lat"), F.col("lon"), [[(-100, -50), (120, -50), (120, 60), (-100, 60)]]).alias("land"))
    out = masks.constrained_map(rows, rows, ["lat_idx", "lon_idx"], [{"q": (20, 26), "dis": (0.04, None)}, {"dis": (None, 0.05)}], "q", land)
    return out.select("lat_idx", "lon_idx", "lat", F.round("value", 9).alias("value"))


@query(f"WITH {CELLS} SELECT lat_idx, CAST((lon_idx + 12) % 24 AS INTEGER) AS lon_idx, CAST(((lon_idx + 12) % 24) * 15 + 7.5 AS DOUBLE) AS lon, round(q, 9) AS q FROM cells")
def reordered_axis(spark, d):
    """Longitudes from -180..180 to 0..360, both halves exchanged."""
    out = reorder_axis(cells(spark, d), [(i + 12) % 24 for i in range(24)], "lon", [15 * i + 7.5 for i in range(24)])
    return out.select("lat_idx", "lon_idx", "lon", F.round("q", 9).alias("q"))


# ---------------------------------------------------------------- stores, collections, axes
@query("SELECT 'region-' || n_regionkey AS part, count(*) AS n, sum(n_nationkey) AS total FROM nation WHERE n_regionkey < 3 GROUP BY n_regionkey")
def first_files(spark, d):
    """The first three of the files that hold the nations of a region each."""
    from ..sources import load_files

    path, nations = f"{shared_dir(spark)}/files", read(spark, d, "nation")
    keys = sorted(r[0] for r in nations.select("n_regionkey").distinct().collect())
    for k in keys:
        nations.where(F.col("n_regionkey") == k).coalesce(1).write.parquet(f"{path}/region-{k}")
    rows = load_files(spark, [f"{path}/region-{k}" for k in reversed(keys)], 3)
    return rows.groupBy(F.element_at(F.split("file", "/"), -2).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("total"))


@query(f"WITH {GRID} SELECT lat_idx, m, round(value, 6) AS value, 'first' AS built FROM grid")
def stored_table(spark, d):
    """A table built and stored at the first read, and read from the store at the second, whose builder would give other rows."""
    from ..sources import read_through

    path = f"{shared_dir(spark)}/stored"
    make = lambda name: lambda: grid(spark, d).select("lat_idx", "m", F.round("value", 6).alias("value"), F.lit(name).alias("built"))
    read_through(spark, path, make("first"), "v1")
    return read_through(spark, path, make("second"), "v1")


@query(f"WITH {GRID} SELECT lat_idx, round(avg(value), 3) AS value, 1 AS runs FROM frame GROUP BY lat_idx")
def memoised_table(spark, d):
    """A memoised mean, asked for twice with its arguments passed in two ways: the function runs once."""
    from ..cache import Memory, version

    runs = []

    @version(1)
    def mean(cube, digits):
        runs.append(1)
        return temporal.mean_over_time(cube, ["lat_idx"]).select("lat_idx", F.round("value", digits).alias("value"))

    memo, cube = Memory(spark, f"{shared_dir(spark)}/memo").cache()(mean), grid(spark, d)
    memo(cube, 3)
    return memo(digits=3, cube=cube).withColumn("runs", F.lit(len(runs)))


@query(
    """SELECT 'A' AS dataset, 'F' AS variable, o_orderkey % 10 AS cell, round(avg(o_totalprice), 4) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 3
    UNION ALL SELECT 'C', 'O', o_orderkey % 10, round(max(o_totalprice), 4) FROM orders WHERE o_orderstatus = 'O' GROUP BY 3"""
)
def collection_algebra(spark, d):
    """Union of collections, a dataset removed, one variable removed and others selected, by raw and pretty names."""
    from ..operators.algebra import Dataset, Datasets

    def dataset(name, how):
        cube = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("variable"), (F.col("o_orderkey") % 10).alias("cell")).agg(F.round(how("o_totalprice"), 4).alias("value"))
        return Dataset(name, cube.where("variable in ('F', 'O', 'P')"), ("F", "O", "P"), f"Pretty {name}", {v: f"{v} of {name}" for v in ("F", "O", "P")})

    every = Datasets([dataset("B", F.min), dataset("A", F.avg)]) + dataset("C", F.max)
    left = every.remove_datasets(["Pretty B"]).remove_variables(["P", "O of A"]).select_variables(["F of A", "O"])
    return left.cube().select("dataset", "variable", "cell", "value")


@query(
    """WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS src, (SELECT CAST(count(*) AS DOUBLE) FROM region) AS tgt FROM nation),
    b AS (SELECT i, j, greatest(-90 + i * 180 / src, -90 + j * 180 / tgt) AS a, least(-90 + (i + 1) * 180 / src, -90 + (j + 1) * 180 / tgt) AS b FROM n, (SELECT unnest(range(25)) AS i), (SELECT unnest(range(5)) AS j))
    SELECT 'conservative' AS scheme, CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lat_tgt, round(sin(radians(b)) - sin(radians(a)), 9) AS lat_w FROM b WHERE b > a + 1e-9
    UNION ALL SELECT 'nearest', CAST(5 * j + 2 AS INTEGER), CAST(j AS INTEGER), 1.0 FROM (SELECT unnest(range(5)) AS j)"""
)
def axis_weights(spark, d):
    """Regrid weights from as many latitudes as nations to as many as regions (25 and 5)."""
    axis = lambda n: [-90 + (i + 0.5) * 180 / n for i in range(n)]
    src, tgt = axis(read(spark, d, "nation").count()), axis(read(spark, d, "region").count())
    parts = [spatial.weight_table(spark, w, "lat").select(F.lit(n).alias("scheme"), "lat_idx", "lat_tgt", F.round("lat_w", 9).alias("lat_w")) for n, w in (("conservative", spatial.conservative_weights(src, tgt, True)), ("nearest", spatial.nearest_weights(src, tgt)))]
    return parts[0].unionByName(parts[1])


@query(
    """WITH f AS (SELECT DISTINCT o_orderdate::DATE AS day, o_custkey % 3 AS h FROM orders)
    SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, string_agg(printf('x/T.A%04d%03d.h%02dv00.hdf', year(day), dayofyear(day), h), ';' ORDER BY h) AS files FROM f WHERE day >= DATE '1996-01-01' AND day < DATE '1997-01-01' GROUP BY day"""
)
def tile_days(spark, d):
    """Tiles by the day in their names, over a half-open span; names of another form go."""
    from ..sources import tile_files

    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 3).cast("int").alias("h")).distinct()
    names = o.select(F.format_string("x/T.A%04d%03d.h%02dv00.hdf", F.year("day"), F.dayofyear("day"), F.col("h")).alias("path"))
    out = tile_files(names.unionByName(names.limit(1).select(F.lit("x/T.other.h00v00.hdf").alias("path"))), "1996-01-01", "1997-01-01")
    return out.select(F.col("day").cast("string").alias("day"), F.size("files").cast("long").alias("n"), F.array_join("files", ";").alias("files"))


@query("WITH m AS (SELECT o_custkey % 20 AS cell, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, avg((o_totalprice % 100) / 100) AS f FROM orders GROUP BY 1, 2) SELECT cell, m, f < 0.4512345 AS mask FROM m")
def observed_mask_monthly(spark, d):
    """The observed fraction averaged over months before it is compared."""
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("cell"), F.col("o_orderdate").alias("time"), ((F.col("o_totalprice") % 100) / 100).alias("value"))
    return masks.observed_mask(rows, ["cell", "time"], 0.4512345, "monthly").select("cell", "m", "mask")


@query("WITH x AS (SELECT DISTINCT l_partkey % 36 AS j FROM lineitem), e AS (SELECT j, (j * 10 + 5 + 180) % 360 - 180 AS lon FROM x) SELECT j, CAST(lon AS DOUBLE) AS lon, CAST(row_number() OVER (ORDER BY lon) - 1 AS INTEGER) AS lon_idx FROM e")
def repaired_axes(spark, d):
    """Longitudes of 0..360 brought to -180..180 and numbered anew."""
    from ..model import repair_axes

    j = F.col("l_partkey") % 36
    cube = read(spark, d, "lineitem").select(j.alias("j")).distinct().select("j", F.lit("x").alias("variable"), F.lit(None).cast("timestamp_ntz").alias("time"), F.lit(0).alias("lat_idx"), F.col("j").cast("int").alias("lon_idx"), F.lit(0.0).alias("lat"), (F.col("j") * 10 + 5).cast("double").alias("lon"), F.col("j").cast("double").alias("value"))
    return repair_axes(cube.drop("j")).select(F.col("value").cast("long").alias("j"), "lon", "lon_idx")


@query(f"WITH {GRID} SELECT lat_idx, m, round(value, 6) AS value FROM frame WHERE value IS NOT NULL")
def unmasked_values(spark, d):
    return masks.unmasked(frame(spark, d)).select("lat_idx", "m", F.round("value", 6).alias("value"))


@query(
    f"""WITH {GRID} SELECT 'monthly' AS kind, lat_idx, m, round(value, 6) AS value FROM grid WHERE m BETWEEN 23955 AND 23970
    UNION ALL SELECT 'static', lat_idx, CAST(t.m AS INTEGER), round(value, 6) FROM grid, (SELECT unnest(range(23955, 23971)) AS m) t WHERE grid.m = 23955
    UNION ALL SELECT 'daily', lat_idx, m, round(value, 6) FROM grid WHERE m BETWEEN 23955 AND 23970"""
)
def dispatched_months(spark, d):
    """Monthly data of three kinds of dataset by what their time axis is."""
    cube, out = grid(spark, d), None
    for kind, rows in (("monthly", cube), ("static", cube.where("m = 23955").select("lat_idx", "value")), ("daily", cube.select("lat_idx", "time", "value"))):
        part = temporal.dispatch_monthly(rows, kind, 23955, 23970, ["lat_idx"])
        part = part.select(F.lit(kind).alias("kind"), "lat_idx", (F.col("m") if "m" in part.columns else month_key(F.col("time"))).cast("int").alias("m"), F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
