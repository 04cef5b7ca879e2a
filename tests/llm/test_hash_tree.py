import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cairnfield.llm import hash_tree
from cairnfield.llm.hash_tree import Tree


def test_query_rules(spark, docs, odd_rows, folder):
    for part in (docs.select(odd_rows.columns), odd_rows):
        rows = hash_tree.query(spark, folder(documents=part)).collect()
        texts = Counter((r["doc_id"], r["text"] or "") for r in part.collect())
        assert len(rows) == sum(texts.values())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter({k: 0 for k in ()} | Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for (i, t), n in texts.items() for _ in range(n)))
        by = {}
        for r in rows:
            assert 0 <= r["shard"] < 40 and r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
            by.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_empty(spark, no_rows, folder):
    assert hash_tree.query(spark, folder(documents=no_rows)).count() == 0


def test_weights_and_movement(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    before = Tree({"r0": {"a": {0: 1.0, 1: 3.0}, "b": {2: 2.0}}, "r1": {"c": {3: 2.0}}})
    after = Tree({"r0": {"a": {0: 1.0, 1: 3.0}, "b": {2: 5.0}}, "r1": {"c": {3: 2.0}}})
    both = hash_tree.assign(hash_tree.assign(keys, "k", before, "x"), "k", after, "y")
    share = {r["x"]: r["count"] / 20000 for r in both.groupBy("x").count().collect()}
    assert all(abs(share[s] - w / 8) < 0.015 for s, w in ((0, 1), (1, 3), (2, 2), (3, 2)))
    # only region r0 and in it only rack b grew: a row may leave r1 for r0, or a for b, and nothing else
    moves = {(r["x"], r["y"]) for r in both.where("x <> y").select("x", "y").distinct().collect()}
    assert moves <= {(0, 2), (1, 2), (3, 0), (3, 1), (3, 2)} and (0, 2) in moves and (3, 2) in moves


def plain_shard(key, tree):
    """The draws of one key, level by level, in plain Python."""
    weight = lambda node: sum(map(weight, node.values())) if isinstance(node, dict) else node
    node, path = tree.regions, ""
    while isinstance(node, dict):
        best = None
        for name, child in node.items():
            bits = xxhash.xxh64_intdigest(f"{path}/{name}".encode(), seed=xxhash.xxh64_intdigest(key.encode(), seed=42)) >> 12
            draw = -math.log((bits + 0.5) / 2**52) / weight(child)
            if best is None or draw < best[0]:
                best = draw, name, child
        path, node = f"{path}/{best[1]}", best[2]
    return int(path.rsplit("/", 1)[1])


def test_against_plain_draws(spark, docs, folder):
    tree = Tree({"r0": {"a": {0: 1.0, 1: 3.0}, "b": {2: 2.0}}, "r1": {"c": {3: 2.0, 4: 0.5, 5: 0.25}}})
    keys = [None, "", "É日本", *map(str, range(500))]
    got = hash_tree.assign(spark.createDataFrame([(k,) for k in keys], "k string"), "k", tree).collect()
    assert [r["shard"] for r in got] == [plain_shard(k or "", tree) for k in keys]
    even = Tree.even(40)
    for r in hash_tree.query(spark, folder(documents=docs)).collect():
        assert r["shard"] == plain_shard(str(r["doc_id"]), even) and r["grown_shard"] == plain_shard(str(r["doc_id"]), even.grown(40))


def test_names_copies_and_length(spark):
    rows = spark.range(3000).select(F.lit(7).alias("k"), F.lit("same").alias("node"), F.lit(1).alias("lane"), F.lit(2).alias("chunk"))
    got = hash_tree.with_slots(hash_tree.assign(rows, "k", Tree.even(40)), "shard", ["k"])
    assert sorted(r["slot"] for r in got.collect()) == list(range(3000)) and got.columns == [*rows.columns, "shard", "slot"]
    with pytest.raises(ValueError):
        hash_tree.assign(got, "k", Tree.even(40))
    long = spark.createDataFrame([("x" * 3_000_000,)], "k string")
    assert hash_tree.assign(long, "k", Tree.even(40)).first()["shard"] == plain_shard("x" * 3_000_000, Tree.even(40))
