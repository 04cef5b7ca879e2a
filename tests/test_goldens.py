"""Small cases worked out by hand or by NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield import functions as fn
from cairnfield import model, sources
from cairnfield.cache import Memory, NotCachedError, UnmarkedDependencyError, version
from cairnfield.operators import features, gapfill, masks, models, ordered, spatial, stats, temporal
from cairnfield.operators.algebra import Dataset, Datasets, shared_attributes
from cairnfield.plans import prepare_selection


def series(spark, values, key=0):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "cell int, t int, value double")


def test_fire_season_triples(spark):
    cells = {0: [0, 11], 1: [10, 11], 2: [0, 1], 3: [0], 4: list(range(12)), 5: [11], 6: [4, 5, 6], 7: [4, 5, 6, 8], 8: [0, 1, 5, 6, 7, 11]}
    rows = [(c, t, 1.0 if t in on else 0.0) for c, on in cells.items() for t in range(12)]
    out = ordered.fire_season(spark.createDataFrame(rows, "cell int, t int, v double"), ["cell"], "t", "v", 0.5).collect()
    got = {r["cell"]: (r["start"], r["end"], r["size"]) for r in out}
    assert got == {0: (11, 0, 2), 1: (10, 11, 2), 2: (0, 1, 2), 3: (0, 0, 1), 4: (0, 11, 12), 5: (11, 11, 1), 6: (4, 6, 3), 7: (4, 6, 3)}
    season = ordered.season_mask(spark.createDataFrame([(0, 11, 1)], "cell int, start int, end int"), ["cell"])
    assert sorted(r["month"] for r in season.collect()) == [0, 1, 11]


def test_longest_run_against_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(c, p, t, bool(rng.random() < 0.6)) for c in range(6) for p in range(5) for t in range(7)]
    longest = ordered.longest_run(spark.createDataFrame(rows, "cell int, p int, t int, dry boolean"), ["cell", "p"], "t", F.col("dry"))
    got = {(r["cell"], r["p"]): r["chained"] for r in ordered.chained_run(longest, ["cell"], "p").collect()}
    dry = {(c, p): [x[3] for x in rows if x[:2] == (c, p)] for c in range(6) for p in range(5)}
    for c in range(6):
        total, ended = 0, False
        for p in range(5):
            best, run, start = (0, None, None), 0, 0
            for t, x in enumerate([*dry[c, p], False]):
                if x:
                    start = t if run == 0 else start
                    run += 1
                else:
                    if run > best[0]:
                        best = (run, start, t - 1)
                    run = 0
            total = best[0] + (total if best[1] == 0 and ended else 0)
            ended = best[2] == 6
            assert got[c, p] == total


def test_extrema_peaks_intervals(spark):
    got = ordered.local_extrema(series(spark, [1, 3, 3, 2, 2, 5]), ["cell"], "t").orderBy("t").collect()
    assert [r["is_max"] for r in got] == [False, True, True, False, False, True]
    assert [r["is_min"] for r in got] == [True, False, False, True, True, False]
    peaks = ordered.significant_peaks(series(spark, [0, 5, 1, 2, 1, -4, 0]), ["cell"], "t", difference=0.5).orderBy("t").collect()
    assert [r["t"] for r in peaks] == [1, 5]
    rows = spark.createDataFrame([(0, 1, 3), (0, 3, 5), (0, 7, 9), (0, 8, 8), (1, 1, 2)], "k int, start int, end int")
    assert sorted(tuple(r) for r in ordered.merge_intervals(rows, ["k"]).collect()) == [(0, 1, 5), (0, 7, 9), (1, 1, 2)]
    at = spark.createDataFrame([(0, i) for i in range(10)] + [(2, 1)], "k int, x int")
    assert sorted(tuple(r) for r in ordered.outside_intervals(at, rows, ["k"], "x").collect()) == [(0, 0), (0, 5), (0, 6), (0, 9), (2, 1)]
    assert [b - a for a, b in ordered.batch_bounds(10, 3)] == [3, 3, 4]


def test_season_fill(spark):
    year = [0, 0, 0, 1, 2, 3, 4, 3, 2, 1, 0, 0]
    values = [None if v == 0 and i else float(v) for i, v in enumerate(year * 3)]
    got = {r["t"]: r["filled"] for r in gapfill.season_trend(series(spark, values), ["cell"], "t", 4).collect()}
    ok = np.array([v is not None for v in values])
    x = gapfill.season_design(np.arange(36), 4)
    beta = np.linalg.lstsq(x[ok], np.array([v for v in values if v is not None]), rcond=None)[0]
    assert all(abs(got[i] - (values[i] if ok[i] else x[i] @ beta)) < 1e-9 for i in range(36))
    none = gapfill.season_trend(series(spark, [None] * 12), ["cell"], "t", 4).where("filled is not null and not isnan(filled)")
    assert none.count() == 0
    with pytest.raises(ValueError):
        gapfill.persistent_season_trend(series(spark, values), ["cell"], "t", 50.0)


def test_fills(spark):
    got = [r["filled"] for r in gapfill.temporal_neighbours(series(spark, [1, None, None, None, 5, None]), ["cell"], "t", 1).orderBy("t").collect()]
    assert got == [1.0, 1.0, None, 5.0, 5.0, 5.0]
    grid = spark.createDataFrame([(i, j, None if (i, j) != (0, 0) and (i, j) != (5, 5) else float(i)) for i in range(6) for j in range(6)], "a int, b int, value double")
    got = {(r["a"], r["b"]): r["filled"] for r in gapfill.nearest_cell(grid, ["a", "b"]).collect()}
    for (a, b), v in got.items():
        assert v == min(((a - x) ** 2 + (b - x) ** 2, x, float(x)) for x in (0, 5))[2]


def test_conservative_and_bilinear(spark):
    source = np.arange(12.0).reshape(4, 3)
    cube = spark.createDataFrame([(i, j, float(source[i, j])) for i in range(4) for j in range(3)], "lat_idx int, lon_idx int, value double")
    lat, lon = [-67.5, -22.5, 22.5, 67.5], [-120.0, 0.0, 120.0]
    got = {(r["lat_idx"], r["lon_idx"]): r["value"] for r in spatial.regrid_to(cube, lat, lon, [-45.0, 45.0], lon, [], "conservative").collect()}
    s = np.sin(np.radians([-90, -45, 0, 45, 90]))
    w = np.diff(s)
    for k in range(2):
        for j in range(3):
            want = (w[2 * k : 2 * k + 2] * source[2 * k : 2 * k + 2, j]).sum() / w[2 * k : 2 * k + 2].sum()
            assert abs(got[k, j] - want) < 1e-12
    masked = cube.withColumn("value", F.when(~((F.col("lat_idx") == 0) & (F.col("lon_idx") == 0)), F.col("value")))
    got = {(r["lat_idx"], r["lon_idx"]): r["value"] for r in spatial.regrid_to(masked, lat, lon, [-45.0, 45.0], lon, [], "bilinear").collect()}
    assert got[0, 0] is None and abs(got[0, 1] - 2.5) < 1e-12
    with pytest.raises(ValueError):
        spatial.overlaps([(0, 1)], [(5, 6)])
    with pytest.raises(ValueError):
        spatial.regrid_to(cube, lat, lon, lat[:2], lon, [], "cubic")


def test_constraints_and_masks(spark):
    rows = spark.createDataFrame([(1, 3), (2, 4), (3, 5), (4, 10), (5, 20)], "A int, B int")
    pick = lambda c: [r["A"] for r in rows.where(masks.match_constraints(c, rows.columns)).orderBy("A").collect()]
    assert pick([{"A": (2, 4)}]) == [2, 3] and pick([{"A": (None, 2)}, {"B": (10, None)}]) == [1, 4, 5]
    with pytest.raises(masks.VariableNotFoundError):
        pick([{"C": (0, 1)}])
    assert masks.constraints_title([{"A": (1, 2), "B": (None, 2)}]) == "1 < A < 2 & B < 2"
    assert masks.constraints_title([{"A": (1, None)}, {"B": (None, 2)}]) == "(1 < A) | (B < 2)"
    ring = spark.createDataFrame([(i, 1.0 if i in (0, 1, 9) else None) for i in range(10)], "x int, value double")
    assert tuple(masks.valid_extent_circular(ring, "x", 10).first()) == (9, 1, 3)
    with pytest.raises(ValueError):
        masks.observed_mask(rows, ["A"], 1.5)


def test_bin_edges():
    near = lambda a, b: len(a) == len(b) and np.allclose(a, b)
    assert near(fn.bin_edges(0, 100, 2), [0, 50, 100])
    assert near(fn.bin_edges(1, 100, 2, True), [1, 10, 100])
    assert near(fn.bin_edges(-100, 100, None, True), [-100, -10, -1, 0, 1, 10, 100])
    assert near(fn.bin_edges(-150, 150, None, True), [-150, -100, -10, -1, 0, 1, 10, 100, 150])
    assert near(fn.bin_edges(-1000, 100, 7, True), [-1000, -100, -10, -1, 0, 1, 10, 100])
    assert near(fn.bin_edges(-100, 1000, None, True), [-100, -10, -1, 0, 1, 10, 100, 1000])
    assert near(fn.bin_edges(0, 100, 3, True), [0, 1, 10, 100])
    assert near(fn.bin_edges(0, 1000, 4, True), [0, 1, 10, 100, 1000])
    assert near(fn.bin_edges(0, 100, 2, True, 10), [0, 10, 100])
    assert near(fn.bin_edges(-20, 80, 5), [-20, 0, 20, 40, 60, 80])
    assert near(fn.bin_edges(-20, 77, 9, simple=True), np.linspace(-20, 77, 10))
    assert near(fn.bin_edges(-20, 77, 9), [-20, -10, 0, 11, 22, 33, 44, 55, 66, 77])
    assert fn.scientific(1234.5) == "1.2e3" and fn.shorten_py("Dry Day Period -3 Month") == "DD 3M" and fn.shorten_py("VOD Ku-band -18 - -6 Month") == "VOD Δ18M"
    assert fn.in_360_system([0, 200]) and not fn.in_360_system([-10, 20])
    with pytest.raises(ValueError):
        fn.in_360_system([-10, 200])


def test_variogram_and_merge(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(a), float(b), float(x)) for i, (a, b, x) in enumerate(zip(rng.random(30), rng.random(30), rng.random(30)))]
    got = stats.variogram(spark.createDataFrame(pts, "id int, lat double, lon double, x double"), "id", "lat", "lon", "x", 3, 150.0).orderBy("bin").collect()
    bins = [[] for _ in range(3)]
    for i, a, b, x in pts:
        for j, c, d, y in pts:
            if i > j:
                p, q = math.radians(a), math.radians(c)
                s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
                dist = 2 * 6371.0 * math.asin(math.sqrt(s))
                if dist < 150:
                    bins[int(dist / 50)].append(x - y)
    for r, values in zip(got, bins, strict=True):
        assert r["n"] == len(values) and abs(r["semivariance"] - (np.var(values) / 2 if values else 0)) < 1e-9
    x = rng.random(100)
    parts = spark.createDataFrame([(len(p), float(p.mean()), float(p.var())) for p in (x[:30], x[30:60], x[60:])], "n long, mean double, var double")
    n, mean, var = stats.merge_stats(parts, []).select("n", "mean", "var").first()
    assert n == 100 and abs(mean - x.mean()) < 1e-12 and abs(var - x.var()) < 1e-12


def test_vif(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    x[:, 2] += x[:, 0]
    got = stats.vif(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"), ["a", "b", "c"])
    for i, name in enumerate("abc"):
        others = np.column_stack([np.ones(200), np.delete(x, i, 1)])
        rest = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert abs(got[name] - 1 / (rest.var() / x[:, i].var())) < 1e-6


def test_temporal_helpers(spark):
    cube = model.synthetic_cube(spark, 2, 4, 14, F.col("t"))
    assert temporal.frequency(cube) == "monthly" and temporal.frequency(model.synthetic_cube(spark, 2, 4)) == "static"
    assert tuple(model.validate_cube(cube).first()) == (0, 0, 0, 0)
    moved = temporal.shift_months(cube, -1)
    assert moved.agg(F.min("time")).first()[0].month == 2 and moved.first()["variable"] == "dummy -1 Month"
    with pytest.raises(ValueError):
        temporal.shift_months(cube, 1.5)
    with pytest.raises(AssertionError):
        temporal.date_order_check(5, 4)
    shifted = cube.withColumn("lon", F.col("lon") + 360)
    assert model.repair_axes(shifted).agg(F.max("lon")).first()[0] < 180
    lerp = temporal.interpolate_yearly(spark.createDataFrame([(0, 2000, 0.0), (0, 2001, 366.0)], "k int, year int, value double"), ["k"], 24000, 24014).orderBy("m").collect()
    assert [round(r["value"]) for r in lerp[:3]] == [0, 31, 60] and lerp[12]["value"] == 366.0 and lerp[13]["value"] is None


def test_collections(spark):
    cube = model.synthetic_cube(spark, 1, 2)
    a = Dataset("A", cube, ("x", "y"), "A pretty", {"x": "X"})
    b = Dataset("B", cube.withColumn("variable", F.lit("z")), ("z",))
    both = Datasets([b]) + a
    assert both.state() == {"A": ["x", "y"], "B": ["z"]} and "A pretty" in both and both["A pretty"].name == "A"
    assert both.select_variables(["X", "z"]).state() == {"A": ["x"], "B": ["z"]}
    assert both.remove_variables(["z"]).state() == {"A": ["x", "y"]} and both.remove_datasets(["A"]).state() == {"B": ["z"]}
    with pytest.raises(ValueError):
        both + Dataset("A pretty", cube, ("q",))
    with pytest.raises(KeyError):
        both.select_variables(["nothing"])
    attrs = spark.createDataFrame([("a", "k", "1"), ("b", "k", "1"), ("a", "u", "m"), ("b", "u", "n")], "cube string, key string, value string")
    assert [tuple(r) for r in shared_attributes(attrs).collect()] == [("k", "1")]


def test_prepare_selection(spark):
    monthly = model.synthetic_cube(spark, 2, 2, 24, F.col("t"), "a", start=24000)
    static = model.synthetic_cube(spark, 2, 2, 0, F.lit(7.0), "b").drop("time")
    both = Datasets([Dataset("M", monthly, ("a",)), Dataset("S", static, ("b",))])
    out = prepare_selection(both, {"M": "monthly", "S": "static"}, ["lat_idx", "lon_idx"], 24000, 24011)
    assert out["monthly"].count() == 96 and out["mean"].where("variable = 'a'").first()["value"] == 5.5
    assert out["climatology"].count() == 96
    with pytest.raises(ValueError):
        prepare_selection(both, {}, [], 0, 1, "median")


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 2))
    rows = spark.createDataFrame([(i, float(a), float(b), float(3 * a + 0.1 * b)) for i, (a, b) in enumerate(x)], "id int, a double, b double, y double")
    model_, weights, fit, test = models.fit_forest(rows, ["a", "b"], "y", numTrees=10, maxDepth=6)
    assert weights[0][0] == "a" and fit > 0.9 and test > 0.85
    scores = models.cross_validate(rows, ["a", "b"], "y", models.parameter_sets({"numTrees": [5], "maxDepth": [1, 5]}), 2, "id")
    assert models.best_parameters(scores, 2).first()["params"] == "maxDepth=5, numTrees=5"
    again = models.cross_validate(rows, ["a", "b"], "y", models.parameter_sets({"numTrees": [5], "maxDepth": [1, 5]}), 2, "id", known=scores)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scores.collect()))
    pdp = models.partial_dependence(rows, model_, "a", models.pdp_grid(rows, "a", 3)).orderBy("value").collect()
    assert pdp[0]["mean"] < pdp[1]["mean"] < pdp[2]["mean"]
    loss = models.leave_one_out(rows, ["a", "b"], "y", numTrees=5, maxDepth=5)
    assert loss["a"] > loss[""]
    share = rows.withColumn("y", F.col("y") / 4)
    assert models.binomial(["a", "b"], "y").fit(share).stages[-1].coefficients.toArray()[0] > 0
    sizes = sorted(r["count"] for r in models.folds(rows.limit(10), "id", 3).groupBy("fold").count().collect())
    assert sizes == [3, 3, 4]


def test_store_and_memory(spark, tmp_path):
    df = spark.range(3)
    path = f"file://{tmp_path}/a"
    assert sources.read_through(spark, path, lambda: df, "v1").count() == 3
    assert sources.read_through(spark, path, lambda: 1 / 0, "v1").count() == 3
    df.withColumn("commit", F.lit("v2")).write.mode("append").parquet(path)
    with pytest.raises(sources.CommitMatchError):
        sources.read_stored(spark, path)
    memory, calls = Memory(spark, f"file://{tmp_path}/m"), []

    @version(1)
    def helper():
        pass

    @memory.cache(dependencies=(helper,))
    @version(1)
    def make(n, m=2):
        calls.append(n)
        return spark.range(n * m)

    with pytest.raises(NotCachedError):
        make.stored(2)
    assert make(2).count() == make(n=2, m=2).count() == 4 and calls == [2] and make.stored(2)

    @memory.cache(dependencies=(lambda: 0,))
    @version(1)
    def bad():
        return spark.range(1)

    with pytest.raises(UnmarkedDependencyError):
        bad()


def test_sources(spark, tmp_path):
    (tmp_path / "grid_1999AD.asc").write_text("\n".join(["h"] * 6 + ["1 -9999 3", "4 5 6"]))
    rows = sources.ascii_grid(spark, f"file://{tmp_path}").select("lat_idx", "lon_idx", "value", sources.year_in_name(F.col("file")).alias("y"))
    got = {(r["lat_idx"], r["lon_idx"]): (r["value"], r["y"]) for r in rows.collect()}
    assert got[1, 0] == (1.0, 1999) and got[1, 1] == (None, 1999) and got[0, 2] == (6.0, 1999) and len(got) == 6
    files = spark.createDataFrame([(f"/x/M.A20000{d:02d}.h01v{d:02d}.hdf",) for d in (1, 9, 17)] + [("/x/M.bad.h01v01.hdf",)], "path string")
    got = [str(r["day"]) for r in sources.tile_files(files, "2000-01-01", "2000-01-17").orderBy("day").collect()]
    assert got == ["2000-01-01", "2000-01-09"]
    names = spark.createDataFrame([("p_2001_05_x.tif",), ("a200105.nc",), ("none",)], "n string")
    assert [r[0] for r in names.select(sources.month_in_name(F.col("n"))).collect()] == [2001 * 12 + 4, 2001 * 12 + 4, None]
    cube = sources.CATALOGUE["GlobFluo_SIF"].read(spark.createDataFrame([(25.0,), (3.0,)], "value double"))
    assert [r["value"] for r in cube.collect()] == [None, 3.0]
    monthly = spark.sql("SELECT 0 AS c, timestamp_ntz'2000-01-01' AS start, timestamp_ntz'2000-02-01' AS end, 1.0D AS value")
    daily = spark.sql("SELECT 0 AS c, explode(sequence(timestamp_ntz'2000-01-30', timestamp_ntz'2000-02-03', interval 1 day)) AS time, 4.0D AS value")
    got = sorted((str(r["time"])[:10], r["value"]) for r in sources.monthly_and_daily(monthly, daily, ["c"]).collect())
    assert got == [("2000-01-01", 1.0), ("2000-02-01", 4.0)]


def test_fingerprint_sees_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    other = spark.createDataFrame([(1, None), (2, "a")], "x int, y string")
    assert stats.fingerprint(df).first() == stats.fingerprint(df.orderBy(F.desc("x")).select("y", "x")).first() != stats.fingerprint(other).first()


def test_search_resumes(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), "id").withColumn("y", F.col("a") * 2)
    sets = models.parameter_sets({"numTrees": [3], "maxDepth": [1, 4]})
    at = f"file://{tmp_path}/scores"
    scores, best, model = models.search(rows, ["a", "b"], "y", sets, at, 2, "id", seconds=-1.0)
    assert scores.count() == 0 and best is None and model is None
    scores, best, model = models.search(rows, ["a", "b"], "y", sets, at, 2, "id")
    assert scores.count() == 4 and best == sets[1] and model.transform(rows).count() == 60
    again, best, _ = models.search(rows, ["a", "b"], "y", sets, at, 2, "id", seconds=-1.0)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scores.collect())) and best == sets[1]


def test_first_of_equal_parameters(spark):
    table = spark.createDataFrame([(0, "z", 0, 0.0, 1.0), (1, "a", 0, 0.0, 1.0)], "number int, params string, split int, train double, test double")
    assert models.best_parameters(table, 1).first()["params"] == "z" and models.best_parameters(table.drop("number"), 1).first()["params"] == "a"


def test_missing_months_of_a_span(spark):
    cube = spark.range(24000, 24020).where("id <> 24005").selectExpr("0 as cell", "cast(id as int) as m", "1.0 as value")
    assert gapfill.temporal_neighbours_span(cube, ["cell"], "m", 2, 24008, 24015).count() == 8
    for start, end in ((24004, 24010), (24006, 24010)):
        with pytest.raises(RuntimeError):
            gapfill.temporal_neighbours_span(cube, ["cell"], "m", 2, start, end)


def test_nearest_cell_within_and_without_rows(spark):
    cube = spark.createDataFrame([(0, 0, 0, 1.0), (0, 3, 3, None), (0, 0, 3, None), (1, 0, 0, None), (1, 5, 5, 2.0)], "m int, a int, b int, value double")
    got = {(r["m"], r["a"], r["b"]): r["filled"] for r in gapfill.nearest_cell(cube, ["a", "b"], within=["m"]).collect()}
    assert got == {(0, 0, 0): 1.0, (0, 3, 3): 1.0, (0, 0, 3): 1.0, (1, 0, 0): 2.0, (1, 5, 5): 2.0}
    empty = cube.withColumn("value", F.lit(None).cast("double"))
    assert {r["filled"] for r in gapfill.nearest_cell(empty, ["a", "b"], within=["m"]).collect()} == {None}


def test_exact_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=3000), np.zeros(4000), [5.0]])
    rows = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "k int, v double").unionByName(spark.createDataFrame([(0, None), (2, 7.0)], "k int, v double"))
    shares = [0.0, 0.05, 0.5, 0.731, 1.0]
    got = {(r["k"], r["share"]): r["percentile"] for r in stats.exact_percentiles(rows, ["k"], "v", shares, accuracy=100).collect()}
    assert len(got) == 15
    for k in (0, 1):
        assert np.allclose([got[k, s] for s in shares], np.quantile(values[k::2], shares))
    assert {got[2, s] for s in shares} == {7.0}


def test_observed_masked_digits(spark):
    cube = spark.createDataFrame([("x y", 0, 1.0)], "variable string, cell int, value double")
    fraction = spark.createDataFrame([(0, 0.1)], "cell int, value double")
    assert masks.observed_masked(cube, fraction, ["cell"], ["x y"], "D", 0.5)[0] == "D_x_y__thres_0.500"
    with pytest.raises(AssertionError):
        masks.observed_masked(cube, fraction, ["cell"], ["x y"], "D", 0.12345)


def test_small_helpers(spark):
    from cairnfield import functions as fn
    from cairnfield.sources import CATALOGUE, loaders

    assert fn.map_names(["a", "b"], {"a": "x"}) == ["x", "b"] and [fn.float_format(x) for x in (123.4, 10, 9.96, 1.5, 1, 0.25, 0.012, 0)] == ["123", "10", "10.0", "1.5", "1.0", "0.25", "0.012", "0"] and fn.float_format(123.4, 1) == "123.4"
    tree = fn.nested_update({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4})
    assert tree == {"a": {"b": 3, "c": 2}, "d": 4} and list(fn.nested_items(tree)) == [(("a", "b"), 3), (("a", "c"), 2), (("d",), 4)]
    assert set(loaders()) == set(CATALOGUE) and "CRU" not in loaders(ignore=("CRU",)) and set(loaders(match="ERA5.*")) == {n for n in CATALOGUE if n.startswith("ERA5")}
    data = Dataset("D", spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "lat_idx int, lon_idx int"), ("v",))
    even = Dataset("E", spark.createDataFrame([(x, 1.0) for x in (10.0, 7.5, 5.0, 5.0)] + [(None, 2.5)], "lat double, lon double"), ("v",))
    assert even.grid() == 2.5 and even.grid("lon") == 1.5 and even.grid("depth") == "N/A"
    assert Dataset("F", even.cube.union(spark.createDataFrame([(0.0, 9.0)], "lat double, lon double")), ("v",)).grid() == "N/A"
    assert Datasets([data]).get_index("D") == 0 and masks.has_columns(data.cube, "lat_idx") and not masks.has_columns(data.cube, "time")
    with pytest.raises(Exception, match="other variables"):
        temporal.yearly_files(spark.createDataFrame([("a", "x"), ("b", "y")], "file string, variable string"), ["x"]).collect()


def test_hash_memo(spark, tmp_path):
    """One evaluation a call, counted by an accumulator in the source's task."""
    from cairnfield.cache import HashMismatchError, Memory, NotCachedError, version

    read, change = spark.sparkContext.accumulator(0), [0]

    @version(1)
    def made(n):
        def rows(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return spark.range(n).repartition(2).mapInArrow(rows, "id long").selectExpr("id", f"id * 2 + {change[0]} as twice")

    memo = Memory(spark, f"file://{tmp_path}/memo").cache_hash()(made)
    with pytest.raises(NotCachedError):
        memo.stored(30)
    assert memo(30).count() == 30 and read.value == 30
    with memo.checked(30) as out:
        out.write.parquet(f"file://{tmp_path}/used")
    assert read.value == 60 and spark.read.parquet(f"file://{tmp_path}/used").count() == 30 and memo.stored(n=30) == memo.path(30)
    change[0] = 1
    with pytest.raises(HashMismatchError):
        memo(30)
    assert read.value == 90


def test_data_processing_switches(spark):
    rows = [(v, i, j, float(20 * i - 30), float(i * j) if v == "t" else 1.0) for v in ("t", "f") for i in range(4) for j in range(3)]
    cubes = spark.createDataFrame(rows, "variable string, lat_idx int, lon_idx int, lat double, value double")
    keys = ["lat_idx", "lon_idx"]
    land = spark.createDataFrame([(3, 2, True)], "lat_idx int, lon_idx int, mask boolean")
    out = features.processed(cubes, keys, "t", ["f"], lat_limits=(-20, 40), fire_mask=True, land=land)
    assert {(r["lat_idx"], r["lon_idx"]) for r in out["rows"].collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)}
    assert out["master_mask"].where("mask").count() == 7 and out["filled"].count() == len(rows)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_percentiles_of_groups_of_every_size(spark, share):
    rng = np.random.default_rng(int(share * 100))
    sizes = [*range(1, 60), *range(60, 2001, 97), 777, 1530, 2000]
    groups = {n: rng.integers(0, 50, n) / 7 if n % 2 else rng.normal(size=n) for n in sizes}
    rows = spark.createDataFrame([(n, float(x)) for n, v in groups.items() for x in v], "k int, v double")
    for accuracy in (10_000, 100):
        got = {r["k"]: r["percentile"] for r in stats.exact_percentiles(rows, ["k"], "v", [share], accuracy).collect()}
        assert got.keys() == groups.keys()
        assert all(abs(got[n] - np.quantile(v, share)) < 1e-9 for n, v in groups.items())
    ten = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert models.pdp_grid(ten, "v", 3, 0.0, 1.0) == [0.0, 4.5, 9.0]
    assert stats.exact_percentiles(ten.limit(0), [], "v", [share]).collect() == []


def test_weights_of_long_axes():
    import time

    began = time.monotonic()
    source = [-180 + (i + 0.5) * 360 / 100_000 for i in range(100_000)]
    target = [-180 + (i + 0.5) * 0.25 for i in range(1440)]
    found = spatial.conservative_weights(source, target, False)
    near, line = spatial.nearest_weights(source, target), spatial.linear_weights(source, target, 360.0)
    assert time.monotonic() - began < 1 and len(near) == 1440 and len(line) <= 2880
    assert abs(sum(w for _, _, w in found) - 360) < 1e-6 and len(found) >= 100_000


def test_weights_against_plain_loops():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = rng.integers(2, 12, 2)
        s, t = np.sort(rng.uniform(-50, 50, 2)), np.sort(rng.uniform(-60, 60, 2))
        source, target = np.linspace(*s, n), np.linspace(*t, m)
        if rng.random() < 0.5:
            source, target = np.round(source), np.round(target)
            if len(set(source)) < n or len(set(target)) < m:
                continue
        down = rng.random() < 0.4
        src, tgt = (source[::-1] if down else source).tolist(), target.tolist()
        want = [(int(min(range(n), key=lambda i, x=x: (abs(src[i] - x), i))), j, 1.0) for j, x in enumerate(tgt)]
        assert spatial.nearest_weights(src, tgt) == want
        sb, tb = [tuple(sorted(b)) for b in spatial.bounds(src)], spatial.bounds(tgt)
        hits = [[i for i, b in enumerate(sb) if b[0] < c[1] - 1e-9 and b[1] > c[0] + 1e-9] for c in tb]
        if any(hits):
            assert spatial.overlaps(sb, tb) == hits


def test_polygon_edges(spark):
    from cairnfield.operators import polygons

    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    hole = [(3, 3), (3, 6), (6, 6), (6, 3)]
    far = [(50, 0), (60, 0), (60, 10), (50, 10)]
    rows = [(0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(square)] + [(0, 1, i, float(x), float(y)) for i, (x, y) in enumerate(hole)] + [(1, 0, i, float(x), float(y)) for i, (x, y) in enumerate(far)] + [(2, 0, 0, None, 1.0)]
    table = polygons.edges(spark.createDataFrame(rows, "polygon int, ring int, place int, lon double, lat double"))
    points = spark.createDataFrame([(1.0, 1.0), (4.5, 4.5), (55.0, 5.0), (-1.0, 5.0), (None, 5.0), (5.0, None), (1.0, 1.0)], "lon double, lat double")
    got = sorted(map(tuple, polygons.inside(points, table).collect()), key=repr)
    assert got == sorted([(1.0, 1.0, True), (4.5, 4.5, False), (55.0, 5.0, True), (-1.0, 5.0, False), (None, 5.0, False), (5.0, None, False), (1.0, 1.0, True)], key=repr)
    assert polygons.inside(points, table, ignore=[1]).where("inside").count() == 2
    assert polygons.inside(points.limit(0), table).count() == 0 and polygons.inside(points, table.limit(0)).where("inside").count() == 0
    land = polygons.grid_mask(spark, table, 72)
    assert land.count() == 72 * 36 and {(r["lon"], r["lat"]) for r in land.where("land").collect()} == {(x + 2.5, y + 2.5) for x in (0, 5, 50, 55) for y in (0, 5)}
    with pytest.raises(ValueError):
        polygons.grid_mask(spark, table, 7)


def test_polygons_of_many_edges(spark):
    """10^5 edges around a disc: the mask is the disc's, to the width of an edge."""
    from pyspark.sql import functions as F

    from cairnfield.operators import polygons

    n = 100_000
    ring = spark.range(n).select(F.lit(0).alias("polygon"), F.lit(0).alias("ring"), F.col("id").alias("place"), (60 * F.cos(F.col("id") * 2 * np.pi / n)).alias("lon"), (60 * F.sin(F.col("id") * 2 * np.pi / n)).alias("lat"))
    land = polygons.grid_mask(spark, polygons.edges(ring), 180)
    assert land.where(F.col("land") != (F.col("lat") * F.col("lat") + F.col("lon") * F.col("lon") < 3600)).count() == 0


def test_polygons_of_many_crossings_on_a_latitude(spark):
    """Combs of many teeth and overlapping boxes, against the count of crossings east of each point; no row holds a latitude's crossings."""
    from pyspark.sql import functions as F

    from cairnfield.operators import polygons

    rng = np.random.default_rng(3)
    rings = {(p, 0): [(x, y) for i, x in enumerate(np.sort(rng.uniform(-170, 170, 400)).round(1).tolist()) for y in (10.0 * (-1) ** i,)] for p in range(3)}
    rings |= {(3 + p, r): [(float(a), -5.0), (float(a + w), -5.0), (float(a + w), 5.0), (float(a), 5.0)] for p, a, w in ((0, -700, 600), (1, -20, 130), (2, 30, 900)) for r in (0, 1) if r == 0 or not p}
    vertices = [(p, r, i, x, y) for (p, r), ring in rings.items() for i, (x, y) in enumerate(ring)]
    table = polygons.edges(spark.createDataFrame(vertices, "polygon int, ring int, place int, lon double, lat double")).cache()
    edges = [tuple(r) for r in table.collect()]
    places = [(float(x), float(y)) for y in (0.0, 3.0, -9.5) for x in [*rng.uniform(-180, 180, 100).round(1), -20.0, 110.0, -900.0, 900.0, float("inf"), float("nan")]]
    places += [(edges[5][1], edges[5][2]), (0.0, float("nan"))]

    def counted(lon, lat):
        odd = {}
        for p, x1, y1, x2, y2 in edges:
            if (y1 > lat) != (y2 > lat) and (x2 - x1) * (lat - y1) / (y2 - y1) + x1 > lon:
                odd[p] = not odd.get(p, False)
        return any(odd.values())

    got = polygons.inside(spark.createDataFrame(places, "lon double, lat double"), table)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((x, y, counted(x, y))) for x, y in places)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    cut = table.where("polygon <> 4 or x1 <> x2 or x1 > 0")  # an edge is missing: the box is open to the west
    far = polygons.inside(spark.createDataFrame([(-999.0, 0.0), (105.0, 0.0), (115.0, 0.0)], "lon double, lat double"), cut.where("polygon = 4"))
    assert sorted((r["lon"], r["inside"]) for r in far.select("lon", F.col("inside")).collect()) == [(-999.0, True), (105.0, True), (115.0, False)]


def test_season_fill_with_few_samples(spark):
    """Cells whose samples leave terms open get the least norm, others the least squares; null cells are cells."""
    rng = np.random.default_rng(1)
    months = np.arange(23990, 24050)
    rows, want = [], {}
    for cell, share in ((0, 0.9), (1, 0.5), (2, 0.1), (None, 0.8), (3, 0.03)):
        ok = rng.random(len(months)) < share
        ok[0] = True
        y = rng.normal(size=len(months)) * 100
        rows += [(cell, int(t), float(v) if o else None) for t, v, o in zip(months, y, ok, strict=True)]
        x = gapfill.season_design(months, 4)
        beta = np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
        want |= {(cell, int(t)): (v if o else p) for t, v, o, p in zip(months, y, ok, x @ beta, strict=True)}
    got = {(r["cell"], r["t"]): r["filled"] for r in gapfill.season_trend(spark.createDataFrame(rows, "cell int, t int, value double"), ["cell"], "t", 4).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_partial_dependence_by_paths(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(float(a), float(b), float(np.sin(3 * a) + b)) for a, b in rng.random((300, 2))], "a double, b double, y double")
    model = models.forest(["a", "b"], "y", numTrees=4, maxDepth=5).fit(rows)
    nodes = models.forest_nodes(model, spark)
    grid = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]

    def walk(tree, i, v, feature):
        r = tree[i]
        if r["left"] < 0:
            return r["prediction"]
        if r["feature"] == feature:
            return walk(tree, r["left"] if v <= r["threshold"] else r["right"], v, feature)
        a, b = tree[r["left"]]["n"], tree[r["right"]]["n"]
        return (a * walk(tree, r["left"], v, feature) + b * walk(tree, r["right"], v, feature)) / (a + b)

    trees = {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    assert len(trees) == 4
    for feature in (0, 1):
        got = {r["value"]: r["mean"] for r in models.path_dependence(nodes, feature, grid).collect()}
        assert all(abs(got[v] - np.mean([walk(t, 0, v, feature) for t in trees.values()])) < 1e-9 for v in grid)
    found = {r["value"]: r for r in models.partial_dependence(rows, model, "a", grid).collect()}
    lines = models.sampled_lines(rows, model, "a", grid, 1.0)
    for v in grid:
        each = [r["prediction"] for r in lines.where(lines["value"] == v).collect()]
        assert len(each) == 300 and abs(np.mean(each) - found[v]["mean"]) < 1e-9 and min(each) == found[v]["low"] and max(each) == found[v]["high"]
    part = models.partial_dependence(rows, model, "a", grid, coverage=0.2).collect()
    assert len(part) == len(grid) and models.sampled_lines(rows, model, "a", [0.5], 0.2).count() < 150
    with pytest.raises(ValueError):
        models.partial_dependence(rows, model, "a", grid, coverage=0)


def test_search_over_two_sets_of_features(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.random((200, 3))
    rows = spark.createDataFrame([(i, float(a), float(b), float(c) if i % 20 else None, float(a + 4 * c)) for i, (a, b, c) in enumerate(x)], "id int, a double, b double, c double, y double")
    sets, store = models.parameter_sets({"numTrees": [3], "maxDepth": [1, 4]}), f"file://{tmp_path}/scores"
    which = {"plain": ["a", "b"], "lagged": ["a", "b", "c"]}
    scores, best = models.feature_set_search(rows, which, "y", sets, store, 2, "id", seconds=-1)
    assert scores.count() == 0 and best == {}
    scores, best = models.feature_set_search(rows, which, "y", sets, store, 2, "id")
    assert scores.count() == 8 and best["lagged"]["score"] > best["plain"]["score"] and best["lagged"]["importances"][0][0] == "c" and best["lagged"]["r2_test"] > 0.5
    again, best_ = models.feature_set_search(rows, which, "y", sets, store, 2, "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scores.collect())) and best_["plain"]["params"] == best["plain"]["params"]
    assert spark.read.parquet(store).count() == 8


def test_calendars(spark):
    from cairnfield.operators import calendars

    hours = [spark.createDataFrame([(float(24 * d),) for d in days], "time double") for days in ([0, 31, 366], [0, 30, 365])]
    cubes = {"a": (hours[0], "hours since 2000-01-01", "standard"), "b": (hours[1], "hours since 2001-01-01", "gregorian")}
    out = {n: sorted(r["time"] for r in c.collect()) for n, c in calendars.homogenise_time(cubes).items()}
    assert out == {"a": [10957.0, 10988.0, 11323.0], "b": [11323.0, 11353.0, 11688.0]}
    with pytest.raises(calendars.CalendarError):
        calendars.homogenise_time(cubes | {"c": (hours[0], "days since 2000-01-01", "360_day")})
    with pytest.raises(calendars.CalendarError):
        calendars.homogenise_time({"a": (hours[0], None, "standard")})
    for text in ("months since 2014-1-1", "days after 2000-01-01"):
        with pytest.raises(calendars.CalendarError):
            calendars.parse_units(text)
    year = spark.createDataFrame([(2014, m) for m in range(1, 13)], "year int, month int")
    middle = {c: [r["time"] for r in calendars.mid_months(year, c, to="days since 2014-01-01").orderBy("month").collect()] for c in ("gregorian", "noleap", "360_day")}
    assert middle["gregorian"] == middle["noleap"] == [15.5, 45.0, 74.5, 105.0, 135.5, 166.0, 196.5, 227.5, 258.0, 288.5, 319.0, 349.5] and middle["360_day"] == [15.0 + 30 * i for i in range(12)]
    dates = calendars.with_dates(spark.createDataFrame([(59.0,), (59.25,), (None,), (-1.0,)], "time double"), "days since 2000-01-01", "360_day").collect()
    assert [tuple(r)[1:] for r in dates] == [(2000, 2, 30, 0), (2000, 2, 30, 21600), (None, None, None, None), (1999, 12, 30, 0)]


def test_ascii_grids(spark, tmp_path):
    from cairnfield.sources import ascii as ascii_

    (tmp_path / "a.asc").write_text("NCOLS 3\nNROWS 2\nXLLCENTER 0.5\nYLLCORNER 10\nCELLSIZE 1\nNODATA_value -1\n 1 2 3 \n-1\t5 6\n")
    got = sorted(tuple(r)[1:] for r in ascii_.grids(spark, f"file://{tmp_path}/a.asc").collect())
    assert got == [(0, 0, 10.5, 0.5, None), (0, 1, 10.5, 1.5, 5.0), (0, 2, 10.5, 2.5, 6.0), (1, 0, 11.5, 0.5, 1.0), (1, 1, 11.5, 1.5, 2.0), (1, 2, 11.5, 2.5, 3.0)]
    part = ascii_.grids(spark, f"file://{tmp_path}/a.asc", lats=(11, 12), lons=(1, 2)).collect()
    assert [tuple(r)[1:] for r in part] == [(1, 1, 11.5, 1.5, 2.0)]
    (tmp_path / "b.asc").write_text("NCOLS 3\nNROWS 1\n1 2 3\n")
    with pytest.raises(Exception, match="header"):
        ascii_.grids(spark, f"file://{tmp_path}/b.asc").collect()


def test_ascii_grids_in_splits(spark, tmp_path):
    """A file of many blocks: each line finds its place."""
    from cairnfield.sources import ascii as ascii_

    rows = 3000
    (tmp_path / "big.asc").write_text("ncols 20\nnrows 3000\nxllcorner -180\nyllcorner -90\ncellsize 0.05\nNODATA_value -9999\n" + "".join(" ".join(str(i * 20 + j) for j in range(20)) + "\n" for i in range(rows)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        cells = ascii_.grids(spark, f"file://{tmp_path}/big.asc")
        assert cells.rdd.getNumPartitions() > 10
        assert cells.where("value != (2999 - lat_idx) * 20 + lon_idx").count() == 0 and cells.count() == rows * 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_footprints(spark):
    rows = [(h, v, i, j, 7.0) for h, v in ((18, 9), (18, 0), (3, 4), (0, 9), (35, 17), (20, 2)) for i in range(3) for j in range(3)]
    px = spark.createDataFrame(rows, "h int, v int, i int, j int, value double")
    shares = spatial.footprint_shares(px, 3, 0.7)
    total = {(r["h"], r["v"], r["i"], r["j"]): r["s"] for r in shares.groupBy("h", "v", "i", "j").agg({"share": "sum"}).withColumnRenamed("sum(share)", "s").collect()}
    inner = [k for k in total if k[:2] in ((18, 9), (20, 2))]
    assert len(inner) == 18 and all(abs(total[k] - 1) < 1e-6 for k in inner) and all(s < 1 + 1e-9 for s in total.values())
    mean = spatial.footprint_average(px.withColumn("date", px["h"] * 0), 3, 0.7, scale=0.01).collect()
    assert mean and all(abs(r["value"] - 0.07) < 1e-12 for r in mean)


def test_collection_fill(spark):
    from cairnfield.operators.algebra import Dataset, Datasets

    rows = [("t", m, i, None if (m, i) in ((0, 0), (1, 1)) else float(10 * m + i)) for m in range(3) for i in range(3)]
    ba = [("burned area", m, i, None if (m, i) in ((0, 0), (2, 2)) else 1.0) for m in range(3) for i in range(3)]
    make = lambda name, r: Dataset(name, spark.createDataFrame(r, "variable string, m int, lat_idx int, value double"), (r[0][0],))
    both, keys = Datasets([make("A", rows), make("B", ba)]), ["m", "lat_idx"]
    got = {(r["variable"], r["m"], r["lat_idx"]): r["value"] for r in both.fill(keys).cube().collect()}
    want = {("t", m, i): float(10 * m + i) for m in range(3) for i in range(3)} | {("t", 0, 0): None, ("t", 2, 2): None, ("t", 1, 1): 1.0} | {r[:3]: r[3] for r in ba}
    assert got == want
    hidden = spark.createDataFrame([(0, True)], "lat_idx int, mask boolean")
    none = {(r["m"], r["lat_idx"]): r["value"] for r in both.fill(keys, hidden, reference=None)["A"].cube.collect()}
    assert {k for k, v in none.items() if v is None} == {(m, 0) for m in range(3)} and none[1, 1] == 1.0
    with pytest.raises(ValueError):
        both.fill(keys, reference="x")


def F_(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_products(spark):
    from datetime import date

    from cairnfield import functions as fn
    from cairnfield.operators import products

    names = ["Burned_Area", "log burned area", "POPD", "Dry Day Period -3 Month", "rain"]
    shown = spark.createDataFrame([(n,) for n in names], "n string").select("n", products.log_scale(F_("n")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in shown} == dict(zip(names, (True, False, True, True, False), strict=True))
    assert fn.pack_input("a", 3) == ("a", "a", "a") and fn.pack_input(["a", "b"], 3, None) == ("a", "b", None) and fn.pack_input(["a", "b"], 4, (1, 0)) == ("a", "b", "b", "a")
    with pytest.raises(ValueError):
        fn.pack_input(["a", "b", "c"], 2)
    rows = [(f"Fpar_500m_2000{d:03d}_0d25.nc", 0.5) for d in (1, 9, 25)]
    table = spark.createDataFrame(rows, "file string, value double")
    with pytest.raises(ValueError):
        products.composites(table)
    out = products.composites(table, expected_missing=(date(2000, 1, 17),)).orderBy("start").first()
    assert str(out["time"]) == "2000-01-04 23:59:59"
    with pytest.raises(Exception, match="outside"):
        products.composites(table.withColumn("value", table["value"] * 4), expected_missing=(date(2000, 1, 17),)).collect()
    attributes = spark.createDataFrame([("a", "units", "1"), ("b", "units", "2")], "file string, key string, value string")
    with pytest.raises(Exception, match="differ"):
        products.fold_attributes(attributes).collect()
    with pytest.raises(Exception, match="not a year"):
        products.banded_months(spark.createDataFrame([("/daily/x/99/a.nc", "Vegetation Optical Depth", "X", 1, 1.0)], "path string, name string, band string, cell int, value double").selectExpr("path", "name", "band", "cell", "value", "timestamp '1999-01-01' as time"), ["cell"]).collect()
    cube = spark.createDataFrame([(0,), (2,)], "lat_idx int")
    assert sorted(r[0] for r in products.flip_latitude(cube, 3).collect()) == [0, 2]


def test_variogram_of_crowded_cells(spark):
    """All points in one place: slices, however small, leave every pair in."""
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float(x)) for i, (a, b, x) in enumerate(rng.random((120, 3)))]
    points = spark.createDataFrame(rows, "id int, lat double, lon double, x double")
    found = {n: [tuple(r) for r in stats.variogram(points, "id", "lat", "lon", "x", 3, 90.0, per_slice=n).orderBy("bin").collect()] for n in (7, 2048)}
    assert [(r[0], r[3]) for r in found[7]] == [(r[0], r[3]) for r in found[2048]] and all(abs(a[4] - b[4]) < 1e-12 for a, b in zip(found[7], found[2048], strict=True))
    assert sum(r[3] for r in found[7]) > 5000 and stats.variogram(points.limit(0), "id", "lat", "lon", "x", 3, 90.0).count() == 3


def test_first_files(spark, tmp_path):
    from cairnfield.sources import load_files

    for name, n in (("b", 2), ("a", 1), ("c", 3)):
        spark.range(n).write.parquet(f"file://{tmp_path}/{name}")
    two = load_files(spark, [f"file://{tmp_path}/{n}" for n in "cab"], 2)
    assert two.count() == 3 and two.columns == ["id", "file"]
    with pytest.raises(FileNotFoundError):
        load_files(spark, [])


def test_axes_and_maps(spark):
    from cairnfield.model import reorder_axis, replace_axis

    cube = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 2.0)], "lat_idx int, lat double, value double")
    points = spark.createDataFrame([(0, -5.0), (1, 5.0)], "lat_idx int, point double")
    assert sorted((r["lat"], r["value"]) for r in replace_axis(cube, points, "lat").collect()) == [(-5.0, 1.0), (5.0, 2.0)]
    with pytest.raises(Exception, match="no point"):
        replace_axis(cube, points.limit(1), "lat").collect()
    for order, new in (([0, 0], None), ([1, 0], [1.0])):
        with pytest.raises(ValueError):
            reorder_axis(cube, order, "lat", new)
    with pytest.raises(TypeError):
        masks.constrained_map(cube, cube, ["lat_idx"], {"value": 3})
    with pytest.raises(masks.VariableNotFoundError):
        masks.constrained_map(cube, cube, ["lat_idx"], {"value": (0, 1)}, "other")
    assert [r["value"] for r in masks.constrained_map(cube, cube, ["lat_idx"], {"value": (0, 2)}).orderBy("lat_idx").collect()] == [1.0, None]


def test_percentiles_of_small_keys_need_no_brackets(spark, monkeypatch):
    """Keys of few rows are put in order without sketches, null keys among them; a large key beside them is bracketed."""
    made = []

    def named(df, name="table", real=stats.materialize):
        made.append(name)
        return real(df, name)

    monkeypatch.setattr(stats, "materialize", named)
    rows = spark.createDataFrame([(k, float(i)) for k in (None, 1, 2) for i in range(10)], "k int, v double")
    want = {(k, s): 9 * s for k in (None, 1, 2) for s in (0.05, 0.5)}
    got = lambda df: {(r["k"], r["share"]): round(r["percentile"], 9) for r in stats.exact_percentiles(df, ["k"], "v", [0.05, 0.5], 10).collect()}
    assert got(rows) == want and "brackets" not in made
    large = spark.createDataFrame([(3, float(i)) for i in range(101)], "k int, v double")
    assert got(rows.unionByName(large)) == want | {(3, 0.05): 5.0, (3, 0.5): 50.0} and "brackets" in made
