"""Modelling with MLlib: forests, binomial regression, searches, and what they show of features."""

from __future__ import annotations

import bisect
import itertools
import random
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import exists, materialize, shared_dir
from .stats import exact_percentiles


def folds(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Add fold 0..k-1: contiguous and unshuffled, the first n % k folds one row longer.

    Rows are dealt by range and written, so that ranges stay as they are; numbers within the ranges and the ranges' sizes (one row a range on the
    driver) give each row's place, so no task orders more than a range.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    n, before, total = 0, [], 0
    for p, c in sorted(dealt.groupBy("_part").count().collect()):
        before.append((p, total))
        total += c
    n = total
    starts = spark.createDataFrame(before, "_part int, _before long")
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    size, extra = divmod(n, k)
    edge = extra * (size + 1)
    fold = F.when(F.col("_at") < edge, F.floor(F.col("_at") / (size + 1))).otherwise(extra + F.floor((F.col("_at") - edge) / max(1, size)))
    return dealt.join(F.broadcast(starts), "_part").withColumn("_at", at).withColumn("fold", fold.cast("int")).drop("_part", "_before", "_at")


def _regressor(label: str, params: dict) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", labelCol=label, **({"numTrees": 100, "maxDepth": 15, "seed": 1, "cacheNodeIds": True} | params))


def forest(features: list[str], label: str, **params) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), _regressor(label, params)])


def binomial(features: list[str], label: str) -> Pipeline:
    """Logit regression of fractions in [0, 1], without an intercept."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GeneralizedLinearRegression(featuresCol="features", labelCol=label, family="binomial", link="logit", fitIntercept=False)])


def r2(predicted: DataFrame, label: str) -> float:
    return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="r2").evaluate(predicted)


def fit_forest(rows: DataFrame, features: list[str], label: str, test_share: float = 0.3, seed: int = 1, **params):
    """(model, importances by falling weight, R2 on training rows, R2 on the rest)."""
    train, test = rows.randomSplit([1 - test_share, test_share], seed)
    train = train.persist()
    model = forest(features, label, **params).fit(train)
    weights = model.stages[-1].featureImportances.toArray()
    out = model, sorted(zip(features, weights.tolist(), strict=True), key=lambda x: -x[1]), r2(model.transform(train), label), r2(model.transform(test), label)
    train.unpersist()
    return out


def parameter_sets(grid: dict[str, list], n: int | None = None, seed: int = 0) -> list[dict]:
    """All combinations, or n of them in a seeded order."""
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    if n is None:
        return every
    random.Random(seed).shuffle(every)
    return every[:n]


def cross_validate(rows: DataFrame, features: list[str], label: str, sets: list[dict], k: int = 5, order: str | None = None, known: DataFrame | None = None, parallelism: int = 4, seconds: float | None = None) -> DataFrame:
    """(number, params, split, train, test) with R2 scores for every set and fold, up to ``parallelism`` fits at a time.

    Pairs in ``known`` are not fitted again; after ``seconds`` no further fit starts, and the pairs left over are
    missing in the table, so a later call with it as ``known`` goes on there.
    """
    spark: SparkSession = rows.sparkSession
    # the vectors are assembled once for all fits
    dealt = VectorAssembler(inputCols=features, outputCol="features").transform(folds(rows, order or features[0], k)).select("features", label, "fold").persist()
    done = {(r["params"], r["split"]): r for r in known.collect()} if known is not None else {}
    until = None if seconds is None else time.monotonic() + seconds

    def one(number: int, params: dict, split: int):
        name = ", ".join(f"{k_}={v}" for k_, v in sorted(params.items()))
        if (name, split) in done:
            return number, name, split, done[name, split]["train"], done[name, split]["test"]
        if until is not None and time.monotonic() > until:
            return None
        train, test = dealt.where(F.col("fold") != split), dealt.where(F.col("fold") == split)
        model = _regressor(label, params).fit(train)
        return number, name, split, r2(model.transform(train), label), r2(model.transform(test), label)

    work = [(i, params, split) for i, params in enumerate(sets) for split in range(k)]
    with ThreadPoolExecutor(parallelism) as pool:
        out = list(pool.map(inheritable_thread_target(spark)(lambda w: one(*w)), work))
    dealt.unpersist()
    return spark.createDataFrame([x for x in out if x is not None], "number int, params string, split int, train double, test double")


def best_parameters(scores: DataFrame, k: int) -> DataFrame:
    """The set with the greatest mean test score of those with all k splits; of equal ones the first number, or name without numbers."""
    first = F.min("number") if "number" in scores.columns else F.lit(0)
    mean = scores.groupBy("params").agg(F.avg("test").alias("score"), F.count(F.lit(1)).alias("n"), first.alias("first")).where(F.col("n") == k)
    return mean.orderBy(F.desc("score"), "first", "params").limit(1).select("params", "score")


def search(rows: DataFrame, features: list[str], label: str, sets: list[dict], store: str, k: int = 5, order: str | None = None, seconds: float | None = None, parallelism: int = 4):
    """Search whose score table lives at ``store`` and is resumed from there: (scores, best parameters, the model refitted on all rows).

    Best parameters and model are None while no set has all its splits.
    """
    spark = rows.sparkSession
    newest = spark.read.parquet(store).agg(F.max("run")).first()[0] if exists(spark, store) else None
    known = None if newest is None else spark.read.parquet(store).where(F.col("run") == newest).drop("run")
    run = 0 if newest is None else newest + 1
    scores = cross_validate(rows, features, label, sets, k, order, known, parallelism, seconds)
    scores.withColumn("run", F.lit(run)).write.mode("append").parquet(store)
    best = best_parameters(scores, k).first()
    if best is None:
        return scores, None, None
    number = scores.where(F.col("params") == best["params"]).first()["number"]
    return scores, sets[number], forest(features, label, **sets[number]).fit(rows)


def leave_one_out(rows: DataFrame, features: list[str], label: str, seed: int = 1, **params) -> dict[str, float]:
    """Test MSE without each feature; '' is the whole set."""
    train, test = rows.randomSplit([0.7, 0.3], seed)
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mse")
    return {gone: ev.evaluate(forest([f for f in features if f != gone], label, **params).fit(train).transform(test)) for gone in ["", *features]}


def combinations(rows: DataFrame, subsets: list[list[str]], label: str, params: dict, k: int = 5, order: str | None = None) -> dict[tuple[str, ...], float]:
    """Mean test R2 of each subset of features."""
    return {tuple(s): cross_validate(rows, s, label, [params], k, order).agg(F.avg("test")).first()[0] for s in subsets}


#: Columns of a table of a forest's nodes; leaves have no feature, children -1.
NODES = "tree int, id int, left int, right int, feature int, threshold double, n double, prediction double"


def forest_nodes(model, spark: SparkSession) -> DataFrame:
    """The nodes of a fitted forest (or pipeline that ends in one): tree, id, left, right, feature, threshold, n, prediction.

    n counts the samples of the bag that reached a node. The model is written and read back, so nodes are rows, not driver objects.
    """
    forest_ = model.stages[-1] if hasattr(model, "stages") else model
    path = f"{shared_dir(spark)}/forest"
    forest_.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData")
    inner = node["leftChild"] >= 0
    return saved.select(
        F.col("treeID").cast("int").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        F.when(inner, node["split"]["featureIndex"]).alias("feature"), F.when(inner, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.get(node["impurityStats"], F.lit(0)).alias("n"), node["prediction"].alias("prediction"),
    )


def path_dependence(nodes: DataFrame, feature: int, grid: list[float]) -> DataFrame:
    """(value, mean): partial dependence by walking the trees, without a row of data.

    A walk follows the branch of the grid value where a tree splits on the feature, and elsewhere both branches, weighted by
    the share of samples in each. A leaf so counts for the grid values of one interval, with one weight. Each tree is a task's group (its
    size is the model's); trees then count alike.
    """
    at = sorted(float(g) for g in grid)

    def walk(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.set_index("id")
        left, right, split = tree["left"].to_dict(), tree["right"].to_dict(), tree["feature"].to_dict()
        bound, n, prediction = tree["threshold"].to_dict(), tree["n"].to_dict(), tree["prediction"].to_dict()
        change = np.zeros(len(at) + 1)
        root = (set(tree.index) - set(left.values()) - set(right.values())).pop()
        open_ = [(root, 1.0, 0, len(at))]
        while open_:
            i, weight, a, b = open_.pop()
            if a >= b or weight == 0:
                continue
            if left[i] < 0:
                change[a] += weight * prediction[i]
                change[b] -= weight * prediction[i]
            elif split[i] == feature:
                cut = bisect.bisect_right(at, bound[i])
                open_ += [(left[i], weight, a, min(b, cut)), (right[i], weight, max(a, cut), b)]
            else:
                share = n[left[i]] / (n[left[i]] + n[right[i]])
                open_ += [(left[i], weight * share, a, b), (right[i], weight * (1 - share), a, b)]
        return pd.DataFrame({"value": at, "prediction": np.cumsum(change)[:-1]})

    return nodes.groupBy("tree").applyInPandas(walk, "value double, prediction double").groupBy("value").agg(F.avg("prediction").alias("mean"))


def partial_dependence(rows: DataFrame, model, feature: str, grid: list[float], coverage: float = 1.0, seed: int = 1) -> DataFrame:
    """(value, mean, low, high) of predictions with the feature set to each grid value, over a share ``coverage`` of the rows.

    Between two thresholds of the feature the forest's predictions are equal, so rows are predicted once for each stretch between thresholds that
    grid values fall in (a feature has fewer thresholds than bins), not once for each grid value.
    """
    if not 0 < coverage <= 1:
        raise ValueError("coverage must lie in (0, 1]")
    spark = rows.sparkSession
    names = model.stages[0].getInputCols()
    nodes = forest_nodes(model, spark).where(F.col("feature") == names.index(feature))
    cuts = sorted(r[0] for r in nodes.select("threshold").distinct().collect())  # at most the bins of one feature
    stretch: dict[int, float] = {}
    for g in grid:
        stretch.setdefault(bisect.bisect_left(cuts, float(g)), float(g))
    used = rows if coverage == 1 else rows.sample(coverage, seed)
    spread = used.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(v) for v in stretch.values()])))
    found = model.transform(spread).groupBy(F.col(feature).alias("_at")).agg(F.avg("prediction").alias("mean"), F.min("prediction").alias("low"), F.max("prediction").alias("high"))
    places = spark.createDataFrame([(float(g), stretch[bisect.bisect_left(cuts, float(g))]) for g in grid], "value double, _at double")
    return places.join(F.broadcast(found), "_at").select("value", "mean", "low", "high")


def sampled_lines(rows: DataFrame, model, feature: str, grid: list[float], coverage: float, seed: int = 1, key: str | None = None) -> DataFrame:
    """(line, value, prediction): the single rows behind a partial dependence, for a sampled share of the rows."""
    used = rows.sample(coverage, seed).withColumn("line", F.col(key) if key else F.monotonically_increasing_id())
    spread = used.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return model.transform(spread).select("line", F.col(feature).alias("value"), "prediction")


def pdp_grid(rows: DataFrame, feature: str, n: int, low: float = 0.05, high: float = 0.95) -> list[float]:
    found = {r["share"]: r["percentile"] for r in exact_percentiles(rows, [], feature, sorted({low, high})).collect()}
    if not found:
        raise ValueError(f"{feature} has no values")
    a, b = found[low], found[high]
    return [a + (b - a) * i / (n - 1) for i in range(n)]


def feature_set_search(rows: DataFrame, sets_of_features: dict[str, list[str]], label: str, sets: list[dict], store: str, k: int = 5, order: str | None = None, test_share: float = 0.3, seed: int = 1, seconds: float | None = None, parallelism: int = 4):
    """Search the parameters of a forest for each of several sets of features (such as unlagged and lagged ones) on the same rows.

    One vector of all features is assembled and written once with the rows' held-out flag and fold; a set of features is a slice of that
    vector. Rows with a null feature or label count for no set, so that scores compare. The held-out share takes no part in the
    search. The score table at ``store`` is common to all sets, resumed by a later call, and complete once each set has its k splits for all
    parameters. Returns (scores, best): scores (features, number, params, split, train, test), and for each complete set its best
    parameters, mean score, R2 of the refitted model on training and held-out rows, and importances by falling weight.
    """
    spark = rows.sparkSession
    every = list(dict.fromkeys(f for fs in sets_of_features.values() for f in fs))
    whole = rows.dropna(subset=[*every, label])
    held = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in ([order] if order else [*every, label])]), F.lit(10_000)) < int(10_000 * test_share)
    dealt = folds(whole.withColumn("_held", held).where("not _held"), order or every[0], k).unionByName(whole.withColumn("_held", held).where("_held"), allowMissingColumns=True)
    vector = VectorAssembler(inputCols=every, outputCol="_all").transform(dealt).select("_all", F.col(label).cast("double").alias("_label"), "_held", "fold")
    table = materialize(vector, "search").persist()
    if exists(spark, store):
        done = {(r["features"], r["params"], r["split"]): r for r in spark.read.parquet(store).collect()}  # a row a fit
    else:
        done = {}
    until = None if seconds is None else time.monotonic() + seconds

    def pipeline(features: list[str], params: dict) -> Pipeline:
        cut = VectorSlicer(inputCol="_all", outputCol="features", indices=[every.index(f) for f in features])
        return Pipeline(stages=[cut, _regressor("_label", params)])

    def one(work):
        name, number, params, split = work
        said = ", ".join(f"{a}={b}" for a, b in sorted(params.items()))
        if (name, said, split) in done:
            r = done[name, said, split]
            return name, number, said, split, r["train"], r["test"], False
        if until is not None and time.monotonic() > until:
            return None
        train, test = table.where(~F.col("_held") & (F.col("fold") != split)), table.where(~F.col("_held") & (F.col("fold") == split))
        model = pipeline(sets_of_features[name], params).fit(train)
        return name, number, said, split, r2(model.transform(train), "_label"), r2(model.transform(test), "_label"), True

    work = [(name, i, params, split) for name in sets_of_features for i, params in enumerate(sets) for split in range(k)]
    with ThreadPoolExecutor(parallelism) as pool:
        found = [x for x in pool.map(inheritable_thread_target(spark)(one), work) if x is not None]
    schema = "features string, number int, params string, split int, train double, test double"
    if new := [x[:-1] for x in found if x[-1]]:
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(store)
    scores, best = spark.createDataFrame([x[:-1] for x in found], schema), {}
    for name, features in sets_of_features.items():
        own = scores.where(F.col("features") == name)
        if own.count() < len(sets) * k:
            continue
        top = best_parameters(own, k).first()
        number = own.where(F.col("params") == top["params"]).first()["number"]
        model = pipeline(features, sets[number]).fit(table.where("not _held"))
        weights = model.stages[-1].featureImportances.toArray().tolist()
        best[name] = {
            "params": sets[number], "score": top["score"], "r2_train": r2(model.transform(table.where("not _held")), "_label"), "r2_test": r2(model.transform(table.where("_held")), "_label"),
            "importances": sorted(zip(features, weights, strict=True), key=lambda x: -x[1]),
        }
    table.unpersist()
    return scores, best
