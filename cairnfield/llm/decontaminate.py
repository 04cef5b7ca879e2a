"""Benchmark decontamination with a distributed positional inverted index.

The benchmark's terms are counted in the whole corpus. Each window of ``n`` consecutive item words is looked up by its two
rarest terms; the postings (term, document, position) of these terms are stored as a table. Postings, less the terms'
offsets in the window, are start positions. A place where the lists of both terms agree, or differ by at most
``slop``, is a candidate, and its document's words are compared with the window's. An exact match is the window itself;
a proximity match is the window's words in their order with at most ``slop`` other words between them
(every exact match is one too).

Everything runs on DataFrame functions. Rows are told apart by 128 bits of id and text; repeated rows are indexed once
and get equal answers. Defined cases: null and empty texts have no words, and an item without words no
window; an item of fewer words than ``n`` is one window; equal windows of several items count for each of them;
of equally rare terms the first in the window is taken; null ids are ids like others; empty tables give no hits or no rows;
very long texts are indexed whole; other columns, whatever their names, are ignored, and kept by ``keep_clean``.
Windows with a term that is absent from the corpus are dropped at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, alnum_words, broadcast_up_to, free_name, materialize, row_keys, table

N, SLOP = 10, 3
#: Rows of a benchmark table (terms, or two for each window) up to which it is broadcast; at most about 50 bytes each.
SMALL = 500_000


KEYS = ["ka", "kb"]


def windows(items: DataFrame, key: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """(win, words, items): the different windows, with the items that hold them."""
    each = items.select(F.col(key).cast("string").alias("item"), alnum_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    cut = each.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), n).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.xxhash64("words").alias("win"), "words", F.size("words").alias("n"), "items")


def frequencies(docs: DataFrame, wins: DataFrame, text: str = "text") -> DataFrame:
    """(word, df): how often each window's word occurs in the corpus, if it does."""
    terms = materialize(wins.select(F.explode("words").alias("word")).distinct(), "terms")
    words = docs.select(F.explode(alnum_words(F.col(text))).alias("word"))
    if terms.limit(SMALL + 1).count() <= SMALL:
        counted = words.join(F.broadcast(terms), "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    else:  # counts come first, so a frequent word is one row for each partition
        counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(terms, "word")
    return materialize(counted, "frequencies")


def anchors(wins: DataFrame, seen: DataFrame, count: int = 2) -> DataFrame:
    """(win, n, need, term, shift, rank): each window's rarest terms, of those windows whose terms all occur."""
    each = wins.select("win", "n", F.posexplode("words").alias("shift", "word")).join(broadcast_up_to(seen, SMALL), "word", "left")
    by = Window.partitionBy("win")
    ranked = each.withColumn("least", F.min(F.coalesce("df", F.lit(0))).over(by)).withColumn("rank", F.row_number().over(by.orderBy("df", "shift")))
    chosen = ranked.where((F.col("least") > 0) & (F.col("rank") <= count))
    return materialize(chosen.select("win", "n", F.least("n", F.lit(count)).alias("need"), F.xxhash64("word").alias("term"), "shift", F.col("rank").cast("int")), "anchors")


def postings(docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the index: one row (term, ka, kb, pos) for each place of an anchor term in a different row of the corpus."""
    terms = materialize(chosen.select("term").distinct(), "anchor_terms")
    words = docs.select(*row_keys(F.col(key), F.col(text)), F.posexplode(alnum_words(F.col(text))).alias("pos", "word"))
    placed = words.select(*KEYS, "pos", F.xxhash64("word").alias("term"))
    return materialize(placed.join(broadcast_up_to(terms, SMALL), "term").select("term", *KEYS, "pos").distinct(), "postings")


def candidates(index: DataFrame, chosen: DataFrame, slop: int = SLOP) -> DataFrame:
    """(ka, kb, win, at): places where the offset-adjusted lists of the two terms agree within ``slop``.

    A match that starts at p gives both lists a start in p .. p + slop; ``at`` is the greater one, so p lies in
    at - slop .. at. One running window over the starts of a document and window finds it, however often a term is repeated.
    """
    starts = index.join(broadcast_up_to(chosen, SMALL), "term").select(*KEYS, "win", "need", "rank", (F.col("pos") - F.col("shift")).alias("at")).where("at >= 0")
    single = starts.where("need = 1").select(*KEYS, "win", "at")
    by = Window.partitionBy(*KEYS, "win").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    other = F.when(F.col("rank") == 1, F.last(F.when(F.col("rank") == 2, F.col("at")), ignorenulls=True).over(by)).otherwise(F.last(F.when(F.col("rank") == 1, F.col("at")), ignorenulls=True).over(by))
    double = starts.where("need = 2").withColumn("other", other).where(F.col("at") - F.col("other") <= slop).select(*KEYS, "win", "at")
    return double.unionByName(single)


def _in_order(words: Column, wanted: Column) -> Column:
    """How many of the wanted words occur in this order, each taken as early as can be."""
    return F.aggregate(words, F.lit(0), lambda j, x: j + F.coalesce((F.get(wanted, j) == x).cast("int"), F.lit(0)))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, slop: int = SLOP) -> DataFrame:
    """Every row of docs: key, ka and kb (hashes of key and text), n_words, n_hit, items (sorted ids whose windows occur), near_items (those within slop), spans."""
    wins = materialize(windows(items, text=text, n=n), "windows")
    chosen = anchors(wins, frequencies(docs, wins, text))
    found = candidates(postings(docs, chosen, key, text), chosen, slop)
    found = found.join(broadcast_up_to(wins.select("win", "n", "words"), SMALL // 10), "win")
    each = found.groupBy(*KEYS).agg(F.collect_set(F.struct("at", "n", "win", "words")).alias("found"))
    rows = docs.select(F.col(key), F.col(text), *row_keys(F.col(key), F.col(text))).join(each, KEYS, "left")
    none = F.array().cast("array<struct<at:int,n:int,win:bigint,words:array<string>>>")

    def near(w: Column, c: Column) -> Column:
        first = F.sequence(F.greatest(c["at"] - slop, F.lit(0)), c["at"])
        return F.exists(first, lambda p: (F.get(w, p) == F.get(c["words"], F.lit(0))) & (_in_order(F.slice(w, p + 1, c["n"] + slop), c["words"]) == c["n"]))

    def checked(w: Column) -> Column:
        listed = F.coalesce("found", none)
        exact = F.filter(listed, lambda c: F.slice(w, c["at"] + 1, c["n"]) == c["words"])
        spans = F.array_sort(F.transform(exact, lambda c: F.struct(c["at"].alias("start"), c["n"].alias("n"), c["win"].alias("win"))))
        close = F.transform(F.filter(listed, lambda c: near(w, c)), lambda c: c["win"])
        return F.struct(F.size(w).cast("long").alias("n_words"), spans.alias("spans"), F.array_distinct(close).alias("near"))

    # the words are bound once to a lambda's variable and then serve every candidate
    rows = rows.select(key, *KEYS, F.explode(F.transform(F.array(alnum_words(F.col(text))), checked)).alias("x"))
    rows = materialize(rows.select(key, *KEYS, "x.n_words", "x.spans", "x.near"), "spans")
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["n"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("sum")),
        lambda a: a["sum"],
    )
    exact = F.transform("spans", lambda s: s["win"])
    held = rows.where(F.size("near") > 0).select(*KEYS, F.explode(F.transform("near", lambda x: F.struct(x.alias("win"), F.array_contains(exact, x).alias("whole")))).alias("x")).select(*KEYS, "x.win", "x.whole").distinct()
    held = held.join(wins.select("win", F.explode("items").alias("item")), "win")
    held = held.groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("item")))).alias("items"), F.array_sort(F.collect_set("item")).alias("near_items"))
    no_items = F.array().cast("array<string>")
    return rows.join(held, KEYS, "left").select(key, *KEYS, "n_words", step.alias("n_hit"), F.coalesce("items", no_items).alias("items"), F.coalesce("near_items", no_items).alias("near_items"), "spans")


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """The rows of docs in which no window of an item occurs."""
    found = matches(docs, items, key, text, n)
    a, b = free_name(docs, "ka"), free_name(docs, "kb")
    dirty = materialize(found.where("n_hit > 0").select(F.col("ka").alias(a), F.col("kb").alias(b)).distinct(), "contaminated")
    keyed = docs.select("*", *(k.alias(c) for k, c in zip(row_keys(F.col(key), F.col(text)), (a, b), strict=True)))
    return keyed.join(dirty, [a, b], "left_anti").drop(a, b)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    contaminated = (F.col("n_hit") > 0).alias("contaminated")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated, F.size("near_items").cast("long").alias("n_near"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < {N} THEN [w] ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: w[i : i + {N - 1}]) END) AS ws FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(ws) AS n FROM win),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes),
hit AS (SELECT DISTINCT p.doc_id, p.pos, p.n, win.item_id FROM place p JOIN win ON p.w[p.pos : p.pos + p.n - 1] = win.ws),
covered AS (SELECT doc_id, count(DISTINCT place_hit) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place_hit FROM hit) GROUP BY doc_id),
held AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
df AS (SELECT x, count(*) AS c FROM word GROUP BY x),
part AS (SELECT ws, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS s FROM (SELECT DISTINCT ws FROM win)),
rare AS (SELECT ws, r.x AS x, r.s AS s FROM (SELECT ws, arg_min({{'x': x, 's': s}}, c) AS r FROM part JOIN df USING (x) GROUP BY ws HAVING count(*) = len(ws))),
start AS (SELECT DISTINCT doc_id, ws, unnest(range(p - s + 1 - {SLOP}, p - s + 2)) AS p FROM rare JOIN word USING (x)),
seen AS (SELECT start.*, d.w FROM start JOIN d ON start.doc_id = d.doc_id AND start.p > 0 AND d.w[start.p] = ws[1]),
near AS (SELECT DISTINCT doc_id, ws FROM seen WHERE regexp_matches(' ' || array_to_string(w[p : p + len(ws) + {SLOP - 1}], ' ') || ' ', '^ ' || array_to_string(ws, ' (?:[^ ]+ )*?') || ' ')),
close AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN win USING (ws) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id) LEFT JOIN close USING (doc_id)
"""
