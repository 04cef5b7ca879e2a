"""Part codes against plain Python and against SQL."""

import hashlib
import math

import duckdb
import pytest

from cairnfield.llm import vector_codes

ROW = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """Integer vectors and codebooks in loops."""
    kept = [(r[0], [math.floor(256 * x) for x in r[1]], r[2]) for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(cut(v, p), e), i) for i, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), err, sum(x for x, (_, _, o) in zip(error, kept, strict=True) if o == label), digest) for (i, _, label), f, err in zip(kept, found, error, strict=True)]


def test_against_plain_and_sql(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()))
    got = sorted(map(tuple, vector_codes.query(spark, sf).collect()))
    assert got == sorted(plain(rows))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(con.execute(vector_codes.ORACLE).fetchall()) == got


def test_odd_rows(spark, folder):
    import random

    rng = random.Random(4)
    vec = lambda n=32: [round(rng.uniform(-2, 2), 2) for _ in range(n)]
    same = vec()
    rows = [(i, vec(), i % 3 if i % 4 else None) for i in range(90)]
    rows += [(5, same, 1)] * 3 + [(None, vec(), None), (None, same, 2), (7, None, 1), (8, [], 1), (9, [None, *vec(31)], 1), (10, [math.nan, *vec(31)], 0), (11, [math.inf, *vec(31)], 0), (12, [-math.inf, *vec(31)], 0), (-3, [0.0] * 32, 0), (-3, [-0.001] * 32, 0)]
    df = spark.createDataFrame(rows, ROW)
    got = sorted(map(tuple, vector_codes.query(spark, folder(embeddings=df.selectExpr("*", "1 as code", "2 as data").repartition(5))).collect()), key=repr)
    assert got == sorted(plain([(a, None if b is None else [None if x is None else float(x) for x in b], c) for a, b, c in df.collect()]), key=repr)


def test_few_rows_and_none(spark, folder):
    few = spark.createDataFrame([(2, [1.0] * 16, 1), (1, [0.0] * 16, None)], ROW)
    got = sorted(map(tuple, vector_codes.query(spark, folder(embeddings=few)).collect()))
    assert got == sorted(plain([tuple(r) for r in few.collect()])) and [r[1] for r in got] == ["00" * 16, "01" * 16]
    assert vector_codes.query(spark, folder(embeddings=few.limit(0))).collect() == []
    assert vector_codes.query(spark, folder(embeddings=few.selectExpr("vec_id", "cast(null as array<float>) embedding", "label"))).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress(few.selectExpr("vec_id", "slice(embedding, 1, 15) embedding", "label"))
    with pytest.raises(ValueError):
        vector_codes.compress(few.selectExpr("vec_id", "transform(embedding, x -> float(1e9)) embedding", "label"))
