"""Document fingerprints by consistent weighted sampling.

A text is a set of words weighted by their counts. For each of K samples a word gets
gamma(2, 1) variates r and c and a uniform b from hashes of word and sample number;
with t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r the sample is the (word, t) of
least a. Two texts agree on a sample with the probability of their generalised Jaccard similarity
sum min(w) / sum max(w).

Only DataFrame functions run. Texts are shuffled once, by a hash of id and text; words, counts
and minima are then computed without further shuffles of words. Words are split at the white
space x20 and x09-x0D and A-Z is lower-cased.

Defined cases: null texts are empty; texts without words share the empty fingerprint and are
alike to each other only; repeated rows (same id and text) count as one place in the order and
are returned as often as they occur; equal ids with different texts follow each other in the order of a
hash; null ids come last; with one different row the next document is the row itself; very long texts are
weighted whole; of samples of equal ln a (31 bits) the least hash wins; other columns, whatever their names, are ignored; an empty table
gives no rows. Rows are told apart by 128 bits. A likeness of K = 32 samples has a standard error of sqrt(p (1 - p) / K), 0.088 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_az, materialize, row_keys, shuffle_parts, table

K, LANES = 32, 4
KEYS = ["ka", "kb"]
_EMPTY = (1 << 32) - 1


def _uniform(h: Column, high: bool) -> Column:
    bits = F.shiftrightunsigned(h, 32) if high else h.bitwiseAND(F.lit(0xFFFFFFFF))
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 32))


def _minima(weighted: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, sig: the K samples of each group of (h, w) rows.

    A row is taken through the samples in lanes of four. ln a (31 bits) and a hash of (word, t) (32 bits) share
    one long, so each lane is a plain minimum.
    """
    rows = weighted.select(*keys, "h", F.log("w").alias("lw"), F.explode(F.sequence(F.lit(0), F.lit(k // LANES - 1))).alias("g"))
    rows = rows.select(*keys, "g", "lw", *[F.xxhash64("h", "g", F.lit(i)).alias(f"a{i}") for i in range(LANES)])
    rows = rows.select(*keys, "g", "lw", *[f"a{i}" for i in range(LANES)], *[F.xxhash64(f"a{i}", F.lit(1)).alias(f"b{i}") for i in range(LANES)])
    r = [-F.log(_uniform(F.col(f"a{i}"), True) * _uniform(F.col(f"a{i}"), False)) for i in range(LANES)]
    c = [F.log(-F.log(_uniform(F.col(f"b{i}"), True) * _uniform(F.col(f"b{i}"), False))) for i in range(LANES)]
    u = [_uniform(F.xxhash64(f"b{i}", F.lit(2)), True) for i in range(LANES)]
    rows = rows.select(*keys, "g", "lw", *[f"a{i}" for i in range(LANES)], *[x.alias(f"{n}{i}") for n, xs in (("r", r), ("c", c), ("u", u)) for i, x in enumerate(xs)])
    rows = rows.select(*keys, "g", *[x for i in range(LANES) for x in (f"a{i}", f"r{i}", f"c{i}", f"u{i}", F.floor(F.col("lw") / F.col(f"r{i}") + F.col(f"u{i}")).alias(f"t{i}"))])
    ln_a = [F.col(f"c{i}") - F.col(f"r{i}") * (F.col(f"t{i}") - F.col(f"u{i}") + 1) for i in range(LANES)]
    packed = [F.shiftleft(F.floor((x + 128) * F.lit(float(1 << 23))), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(f"a{i}", f"t{i}"), 32)) for i, x in enumerate(ln_a)]
    least = rows.groupBy(*keys, "g").agg(*[F.min(x).alias(f"m{i}") for i, x in enumerate(packed)])
    each = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("g", F.array(*[F.col(f"m{i}").bitwiseAND(F.lit(_EMPTY)) for i in range(LANES)]).alias("m")))).alias("parts"))
    return each.select(*keys, F.flatten(F.transform("parts", lambda p: p["m"])).alias("sig"))


def fingerprints(texts: DataFrame, keys: list[str], copies: str | None = None, k: int = K) -> DataFrame:
    """Signatures of (keys, text) rows; with ``copies``, rows repeat that often and counts are divided by it."""
    times = F.col(copies) if copies else F.lit(1)
    words = texts.select(*keys, times.alias("times"), F.explode(F.split(lower_az(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counted = words.select(*keys, "times", F.xxhash64("word").alias("h")).groupBy(*keys, "h").agg((F.count(F.lit(1)) / F.max("times")).alias("w"))
    return _minima(counted, keys, k)


def alike(a: Column, b: Column, k: int = K) -> Column:
    """Share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(k))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(ka, kb, next_ka, next_kb, prev_ka, prev_kb, n_chars, prev_chars, times) in the order of falling key.

    Different rows are range-partitioned and numbered within partitions; only the first row of each partition
    (as many as there are shuffle partitions) passes the driver.
    """
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*row_keys(F.col(key), value), F.col(key).alias("id"), F.length(value).cast("long").alias("n_chars"))
    rows = rows.groupBy(*KEYS).agg(F.first("id").alias("id"), F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("times"))
    order = [F.col("id").desc_nulls_last(), F.col("ka"), F.col("kb")]
    parts = rows.repartitionByRange(shuffle_parts(spark), *order)
    parts = materialize(parts.withColumn("part", F.spark_partition_id()), "order")
    one = Window.partitionBy("part").orderBy(*order)
    firsts = parts.withColumn("at", F.row_number().over(one)).where("at = 1").select("part", *KEYS).orderBy("part").collect()
    following = [(a["part"], b["ka"], b["kb"]) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    ends = spark.createDataFrame(following, "part int, first_ka long, first_kb long")
    linked = parts.withColumn("in_part", F.lead(F.struct(*KEYS)).over(one)).join(F.broadcast(ends), "part")
    linked = linked.select(*KEYS, "n_chars", "times", F.coalesce(F.col("in_part.ka"), F.col("first_ka")).alias("next_ka"), F.coalesce(F.col("in_part.kb"), F.col("first_kb")).alias("next_kb"))
    linked = materialize(linked, "neighbours")
    before = linked.select(F.col("next_ka").alias("ka"), F.col("next_kb").alias("kb"), F.col("ka").alias("prev_ka"), F.col("kb").alias("prev_kb"), F.col("n_chars").alias("prev_chars"))
    return linked.join(before, KEYS)


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Every row's key with the fingerprints of its text and of its edited text, and their likenesses.

    Edited: the last third of the code points replaced by the first as many of the next document.
    """
    spark = docs.sparkSession
    n = 2 * shuffle_parts(spark)
    links = materialize(neighbours(docs, key, text), "links")
    repeated = links.where("times > 1").limit(1).count() > 0
    value = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(*row_keys(F.col(key), value), value.alias("text")).repartition(n, *KEYS)
    linked = texts.join(links.repartition(n, *KEYS).hint("merge"), KEYS)
    heads = linked.select(F.col("prev_ka").alias("ka"), F.col("prev_kb").alias("kb"), F.expr("left(text, cast(floor(prev_chars / 3) as int))").alias("head"))
    if repeated:
        heads = heads.groupBy(*KEYS).agg(F.first("head").alias("head"))
    pairs = linked.join(heads.repartition(n, *KEYS).hint("merge"), KEYS).withColumn("edited", F.expr("concat(left(text, cast(n_chars - floor(n_chars / 3) as int)), head)"))
    both = pairs.select(*KEYS, "times", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x")).select(*KEYS, "times", "x.kind", "x.text")
    prints = fingerprints(both, [*KEYS, "kind"], "times", k)
    prints = prints.groupBy(*KEYS).agg(F.max(F.when(F.col("kind") == 0, F.col("sig"))).alias("sig"), F.max(F.when(F.col("kind") == 1, F.col("sig"))).alias("edited_sig"))
    hashed = pairs.select(*KEYS, F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    if repeated:
        hashed = hashed.groupBy(*KEYS).agg(F.first("edited_sha256").alias("edited_sha256"))
    none = F.array_repeat(F.lit(_EMPTY), k)
    done = hashed.join(prints, KEYS, "left").select(*KEYS, "edited_sha256", F.coalesce("sig", none).alias("sig"), F.coalesce("edited_sig", none).alias("edited_sig"))
    done = materialize(done, "prints")
    next_ = done.select(F.col("ka").alias("next_ka"), F.col("kb").alias("next_kb"), F.col("sig").alias("next_sig"))
    result = done.join(links.select(*KEYS, "next_ka", "next_kb", "n_chars"), KEYS).join(next_, ["next_ka", "next_kb"])
    result = result.select(*KEYS, "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"), alike(F.col("sig"), F.col("edited_sig"), k).alias("near_edited"), alike(F.col("sig"), F.col("next_sig"), k).alias("near_next"))
    return docs.select(key, *row_keys(F.col(key), value)).join(result, KEYS).drop(*KEYS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
