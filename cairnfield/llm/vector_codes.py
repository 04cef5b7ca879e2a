"""Compression of vectors into part codes by integer codebooks (product quantisation).

Vectors become integers, ``floor(scale * x)``, and columnar blocks: an array of dimensions x rows in one binary
value per block, written once, so a round reads integers and a lost executor costs its blocks alone. Every
round broadcasts the codebooks (parts x entries x width integers, a few KB) and folds the blocks with
``RDD.treeAggregate``: a block's distances to the entries of a part accumulate dimension by dimension, its sums
and counts go into int64 tensors by ``np.add.at``, and the tensors (fixed size) merge through a reduction tree. All
arithmetic is in integers, so no order of arrival changes a result.

Defined cases: vectors that are null or hold null or non-finite components are dropped, and so are those whose length is not that of
the kept vector with the least id; empty vectors count as null; of equal ids the one with the smaller integer vector comes first, null ids
last; repeated rows are rows of their own; equal distances go to the lower entry; fewer rows than entries make a
smaller codebook; null labels are one group; an empty table, or one without kept rows, gives no rows; a length that the number of parts does
not divide, or a component beyond ``limit`` (whose squared distances could leave 64 bits), is an error;
other columns, whatever their names, are left out, and the result has the names given here.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_up_to, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest integer component: distances of up to 512 dimensions stay below 2^63.
LIMIT = 1 << 26


def kept(rows: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """Columns vec_id, label and vector (doubles): the rows whose vector is whole."""
    whole = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return rows.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")).where((F.size("vector") > 0) & whole)


def first_rows(rows: DataFrame, entries: int, scale: int) -> list[np.ndarray]:
    """The integer vectors of the least ids (at most ``entries`` rows reach the driver), all as long as the first."""
    whole = rows.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale)).alias("v"), F.size("vector").alias("n"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = whole.orderBy(*order).limit(1).collect()
    if not first:
        return []
    return [np.array(r["v"], np.int64) for r in whole.where(F.col("n") == first[0]["n"]).orderBy(*order).limit(entries).collect()]


def blocks(rows: DataFrame, dims: int, scale: int = SCALE, size: int = 4096) -> DataFrame:
    """Blocks of up to ``size`` rows: their ids and labels, and the integer components, dimension by dimension."""
    schema = rows.select(F.array("vec_id").alias("vec_id"), F.array("label").alias("label")).schema.add("data", "binary")

    def pack(batches):
        for batch in batches:
            for at in range(0, len(batch), size):
                own = batch.slice(at, size)
                data = np.floor(own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * scale)
                if np.abs(data).max(initial=0) > LIMIT:
                    raise ValueError(f"a component leaves {-LIMIT}..{LIMIT}")
                columns = np.ascontiguousarray(data.astype(np.int32).T)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([columns.tobytes()], pa.binary())], names=["vec_id", "label", "data"])

    return rows.where(F.size("vector") == dims).mapInArrow(pack, schema)


def nearest(columns: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part (parts x rows); ``columns`` is dims x rows, ``codebooks`` parts x entries x width."""
    parts, entries, width = codebooks.shape
    code, error = np.empty((parts, columns.shape[1]), np.int64), np.empty((parts, columns.shape[1]), np.int64)
    for p in range(parts):
        distance = np.zeros((entries, columns.shape[1]), np.int64)
        for d in range(width):
            gap = columns[p * width + d].astype(np.int64)[None, :] - codebooks[p, :, d][:, None]
            distance += gap * gap
        code[p] = distance.argmin(0)  # the lowest of equals
        error[p] = distance.min(0)
    return code, error


def improve(packed: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: entries become the floors of the means of their parts; unused ones stay."""
    parts, entries, width = codebooks.shape
    shared = packed.sparkSession.sparkContext.broadcast(codebooks)

    def add(total, row):
        columns = np.frombuffer(row[0], np.int32).reshape(parts * width, -1)
        code, _ = nearest(columns, shared.value)
        sums, counts = total if total is not None else (np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64))
        for p in range(parts):
            np.add.at(sums[p], code[p], columns[p * width : (p + 1) * width].T)
            np.add.at(counts[p], code[p], 1)
        return sums, counts

    def merge(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    total = packed.select("data").rdd.treeAggregate(None, add, merge)
    shared.unpersist()
    if total is None:
        return codebooks
    sums, counts = total
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], codebooks)


def encode(packed: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row of the blocks."""
    kinds = {f.name: f.dataType.elementType for f in packed.schema if f.name != "data"}
    schema = packed.select(F.explode("vec_id").alias("vec_id")).schema
    schema = schema.add("label", kinds["label"]).add("code", "string").add("error", "long")
    shared = packed.sparkSession.sparkContext.broadcast(codebooks)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        parts, _, width = shared.value.shape
        for batch in batches:
            for i in range(len(batch)):
                columns = np.frombuffer(batch.column(2)[i].as_py(), np.int32).reshape(parts * width, -1)
                code, error = nearest(columns, shared.value)
                names = ["".join(row) for row in digits[code.T]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(names, pa.string()), pa.array(error.sum(0))], names=["vec_id", "label", "code", "error"])

    return packed.mapInArrow(run, schema)


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimals, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Columns vec_id, code, error, label_error and codebooks_sha256 for every kept row."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    rows = kept(rows, vector, key, label)
    first = first_rows(rows, entries, scale)
    dims = len(first[0]) if first else parts
    if dims % parts:
        raise ValueError(f"{parts} parts do not divide {dims} dimensions")
    codebooks = np.array(first, np.int64).reshape(-1, parts, dims // parts).transpose(1, 0, 2) if first else np.zeros((parts, 1, 1), np.int64)
    if np.abs(codebooks).max(initial=0) > LIMIT:
        raise ValueError(f"a component leaves {-LIMIT}..{LIMIT}")
    packed = materialize(blocks(rows, dims, scale), "blocks")
    for _ in range(rounds):
        codebooks = improve(packed, codebooks)
    coded = materialize(encode(packed, codebooks), "codes")
    by_label = broadcast_up_to(coded.groupBy("label").agg(F.sum("error").alias("label_error")), 100_000)
    found = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return found.select("c.vec_id", "c.code", "c.error", "l.label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same as DuckDB SQL: rounds written out one after the other."""
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, vec_id, label, v, len(v) // {parts} AS width
             FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"cells AS (SELECT r, p, v[p * width + 1 : (p + 1) * width] AS x FROM kept, range({parts}) t(p))",
        f"book0 AS (SELECT p, r AS e, x FROM cells WHERE r < {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS (SELECT r, p, any_value(c.x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.e)) AS best
                 FROM cells c JOIN book{k} b USING (p) GROUP BY r, p)"""
        )
        if k < rounds:
            steps += [
                f"sums{k} AS (SELECT p, best.e AS e, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM near{k}, range(1, (SELECT max(width) FROM kept) + 1) t(i) GROUP BY ALL)",
                f"means{k} AS (SELECT p, e, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS x FROM sums{k} GROUP BY p, e)",
                f"book{k + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m USING (p, e))",
            ]
    steps += [
        f"codes AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY r)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS s FROM book{rounds})",
    ]
    return f"""WITH {", ".join(f"{s.split(' AS ', 1)[0]} AS MATERIALIZED {s.split(' AS ', 1)[1]}" for s in steps)}
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM codes JOIN kept USING (r), digest"""


ORACLE = oracle()
