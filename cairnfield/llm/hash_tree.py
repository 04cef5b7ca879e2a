"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` from a hash of key and child name, and the smallest draw wins, so a
child is chosen in proportion to its weight. When a weight changes, only draws of that
child move: rows change place only into or out of the subtrees whose weights change.
Growth adds a region of its own, so rows move only into the new shard.

Levels are columns of their own, computed one after the other: a row draws among the children of
the node that it has reached, whose names and weights it takes from literal maps.

Null keys count as the empty string; repeated rows go to the same shard and take
slots of their own; of equal draws (2^-52 for each pair) the child named first wins; an empty table gives no rows;
a null text counts 16 bytes; very long texts are read for their size and checksum alone; other columns are carried
along, and none may be called like the new column (an error), while the working columns take free names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, table


@dataclass(frozen=True)
class Tree:
    """regions -> racks -> {shard number: weight}."""

    regions: dict[str, dict[str, dict[int, float]]] = field(default_factory=dict)

    @staticmethod
    def even(shards: int, per_rack: int = 5, racks_per_region: int = 2) -> "Tree":
        """Shards 0.. in equal weights, filled rack by rack and region by region."""
        out: dict[str, dict[str, dict[int, float]]] = {}
        for s in range(shards):
            rack = s // per_rack
            out.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
        return Tree(out)

    def grown(self, shard: int, weight: float = 1.0) -> "Tree":
        """One more shard in a region of its own."""
        return Tree({**self.regions, f"region-of-{shard}": {f"rack-of-{shard}": {shard: weight}}})

    @staticmethod
    def _weight(node) -> float:
        return float(node) if not isinstance(node, dict) else sum(Tree._weight(x) for x in node.values())


def _winner(key: Column, paths: Column, weights: Column, width: int) -> Column:
    """The position of the child with the least draw -ln(u) / weight, u in (0, 1) from 52 bits of a hash of key and path."""

    def draw(i: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.get(paths, F.lit(i))), 12).cast("double")
        value = -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.get(weights, F.lit(i))
        return F.struct(F.coalesce(value, F.lit(float("inf"))).alias("draw"), F.lit(i).alias("i"))

    return F.array_min(F.array(*[draw(i) for i in range(width)]))["i"]


def _levels(tree: Tree) -> list[dict[str, dict[str, object]]]:
    """For regions, racks and shards: path of the parent -> path of the child -> its node."""
    out, nodes = [], {"": tree.regions}
    for _ in range(3):
        level = {path: {f"{path}/{name}": child for name, child in node.items()} for path, node in nodes.items()}
        out.append(level)
        nodes = {path: child for children in level.values() for path, child in children.items()}
    return out


def assign(rows: DataFrame, key: str, tree: Tree, shard: str = "shard") -> DataFrame:
    """Add the shard column (null for a tree without shards)."""
    if shard.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"there is a column {shard}")
    at, text = free_name(rows, "node"), free_name(rows, "key_text")
    out = rows.withColumns({text: F.coalesce(F.col(key).cast("string"), F.lit("")), at: F.lit("")})
    for level in _levels(tree):
        if not level or not any(level.values()):
            return rows.withColumn(shard, F.lit(None).cast("int"))
        of = lambda value, level=level: F.element_at(F.create_map(*[x for path, children in level.items() for x in (F.lit(path), F.array(*[F.lit(value(p, c)) for p, c in children.items()]))]), F.col(at))
        paths, weights = of(lambda p, c: p), of(lambda p, c: Tree._weight(c))
        found = _winner(F.col(text), paths, weights, max(map(len, level.values())))
        out = out.withColumn(at, F.get(paths, found))
    number = F.substring_index(F.col(at), "/", -1).cast("int")
    return out.withColumn(shard, number).drop(at, text)


def with_slots(rows: DataFrame, shard: str, order: list[str], slot: str = "slot", rows_per_chunk: int = 200_000) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    The rows are written first, each with a number of its own. A shard is cut into chunks by a hash of the ordering columns and that
    number, so copies of one row are dealt over all chunks; chunks are numbered on
    their own, and the running sum of chunk sizes (shards x chunks rows) is joined back.
    Chunks follow the table's size, so no task gets a whole shard.
    """
    if slot.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"there is a column {slot}")
    names = rows.columns
    lane, chunk, start, count = (free_name(rows, n) for n in ("lane", "chunk", "start", "count"))
    rows = materialize(rows.withColumn(lane, F.monotonically_increasing_id()), "placed")
    chunks = max(8, -(-rows.count() // rows_per_chunk))
    cut = rows.withColumn(chunk, F.pmod(F.xxhash64(*order, lane), F.lit(chunks)).cast("int"))
    sizes = cut.groupBy(shard, chunk).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(shard).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select(shard, chunk, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start)), "starts")
    own = Window.partitionBy(shard, chunk).orderBy(*order, lane)
    numbered = cut.withColumn(slot, F.row_number().over(own) - 1)
    return numbered.join(starts, [shard, chunk]).withColumn(slot, (F.col(start) + F.col(slot)).cast("long")).drop(chunk, start, lane).select(*(f"`{c}`" for c in (*names, slot)))


def query(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    tree = Tree.even(shards)
    placed = assign(assign(docs, "doc_id", tree, "shard"), "doc_id", tree.grown(shards), "grown_shard")
    return with_slots(placed, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
