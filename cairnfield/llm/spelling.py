"""Spelling variants: words that one inserted, deleted or replaced letter parts, and the frequent form each belongs to.

Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, counted over all texts. The near words of each are found by a rare-first
prefix filter over positional bigrams. Bigrams are ordered by how many words hold them (there are at most 90 * 90); one edit
destroys two bigrams at most, so of a word's three rarest (with repeats of the third, for exactness) one survives in the
near word, and there it is among the three rarest too. The edit lies on one side of that bigram, so the letters on its other side are equal
and its place, counted from there, is the same; lengths differ by one at most. The join is on exactly that: bigram with the letters
on one side, and length; of the letters on the other side one half is equal too. Candidates are verified by edit distance inside the
join, so it emits near pairs only.

A word's form is its near word of largest count, if that is at least ``ratio`` times its own. Forms at least double the count, so chains are
short; roots come by pointer doubling, in as many rounds as the logarithm of the longest chain.

Defined cases: a null text has no words, a null id counts as an empty one, an empty table gives no rows; a run of any length is one word;
repeated documents count again; of equal counts the near word first in code-point order is the form; words without near words have n_near 0,
and are their own root; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az, materialize, table
from .vectext import mix, powers

#: Letters a-z and U+00C0 to U+00FF.
ALPHABET = 26 + 64


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id", noise: int | None = None) -> DataFrame:
    """One row (word) for each run; where ``noise`` divides the CRC-32 of ``key:run`` a letter of the run is deleted, if given."""
    words = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.split(lower_az(F.col(text)), r"[^a-zÀ-ÿ]+")).alias("word")).where("word != ''")
    if noise is None:
        return words.select("word")
    h = F.crc32(F.encode(F.concat("k", F.lit(":"), "word"), "UTF-8"))
    at = (F.pmod("h", F.length("word").cast("long"))).cast("int")
    cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return words.withColumn("h", h).select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """word, n: the words that are long and frequent enough."""
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _number(points: np.ndarray) -> np.ndarray:
    """Letters as 0 .. ALPHABET - 1."""
    return np.where(points >= 0xC0, points - 0xC0 + 26, points - 0x61)


def _letters(column) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words of a column as numbers, and where each word starts (and the last ends)."""
    words = column.to_pylist()
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return _number(points), np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """The place of each bigram in the global order: by how many words hold it, then by its letters."""
    size = ALPHABET**2

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            letters, start = _letters(batch.column(0))
            owner = np.repeat(np.arange(len(batch)), np.diff(start))
            same = owner[1:] == owner[:-1]
            held = np.unique((owner[1:] * size + letters[:-1] * ALPHABET + letters[1:])[same])
            total += np.bincount(held % size, minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    counts = np.zeros(size, np.int64)
    for r in words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most ALPHABET squared
        counts[r["gram"]] = r["n"]
    return np.argsort(np.lexsort((np.arange(size), counts)))


def _hash(total: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the letters from a to b (not included), of the running sums of letters times powers."""
    return mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))


def places(letters: np.ndarray, start: np.ndarray, rank: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(word, place in ``letters``) of the rarest bigrams of each word: the first ``most`` by rank, and repeats of the last of these."""
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    at = np.flatnonzero(owner[1:] == owner[:-1])
    word, order = owner[at], rank[letters[at] * ALPHABET + letters[at + 1]]
    by = np.lexsort((order, word))
    at, word, order = at[by], word[by], order[by]
    first = np.searchsorted(word, np.arange(len(start)))
    last = np.minimum(first[:-1] + most, first[1:]) - 1
    keep = order <= order[last[word]]
    return word[keep], at[keep]


def sided(words: DataFrame, rank: np.ndarray, longer: bool) -> DataFrame:
    """Rows (key, h1, h2, word, n) for each rare bigram and each side of it that may be untouched.

    The key holds the bigram, the letters on that side, the side and the length. h1 and h2 are hashes of the halves of the letters on the other side: one
    edit leaves one of them as it is. A word stands for itself, or with ``longer`` also for a word that is one letter longer than its partner: its
    length counts one less then, and its halves are as long as the partner's.
    """
    shared = words.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                letters, start = _letters(part.column(0))
                power, inverse = powers(len(letters) + 1)
                total = np.zeros(len(letters) + 1, np.uint64)
                np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * power[: len(letters)], out=total[1:])
                word, at = places(letters, start, shared.value)
                low, high = start[word], start[word + 1]
                for less in (0, 1) if longer else (0,):
                    for side, (a, b, c, d) in enumerate(((low, at + 2, at + 2, high), (at, high, low, at))):
                        key = _hash(total, inverse, a, b) + (2 * (high - low - less) + side).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        n = np.maximum(d - c - less, 0)
                        h1, h2 = _hash(total, inverse, c, c + n // 2), _hash(total, inverse, d - (n - n // 2), d)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(mix(key).view(np.int64)), pa.array(h1.astype(np.uint32).view(np.int32)), pa.array(h2.astype(np.uint32).view(np.int32)), part.column(0).take(pa.array(word)), part.column(1).take(pa.array(word))],
                            names=["key", "h1", "h2", "word", "n"],
                        )

    return words.select("word", "n").mapInArrow(run, "key long, h1 int, h2 int, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair (a, na, b, nb) of words at edit distance one, once. Words have four bigrams or more."""
    rank = bigram_ranks(words)
    a = sided(words, rank, False).select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("word").alias("a"), F.col("n").alias("na"))
    b = sided(words, rank, True).select("key", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("word").alias("b"), F.col("n").alias("nb"))
    half = (F.col("a1") == F.col("b1")) | (F.col("a2") == F.col("b2"))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    near = a.hint("merge").join(b, (a["key"] == b["key"]) & half & once & (F.levenshtein("a", "b", 1) == 1))
    return near.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form and form_n."""
    ways = F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("n"), F.col("b").alias("word")).alias("near")), F.struct(F.col("b").alias("word"), F.struct((-F.col("na")).alias("n"), F.col("a").alias("word")).alias("near")))
    best = pairs.select(F.inline(ways)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    large = -F.col("near.n") >= ratio * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("near.word")).alias("form"), F.when(large, -F.col("near.n")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word and root, for the words that have a form."""
    step = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if joined.where("moved").isEmpty():
            return step
        step = joined.select("word", "root")


def group(docs: DataFrame, text: str = "text", key: str = "doc_id", noise: int | None = None, least_letters: int = 5, least_n: int = 3, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the texts."""
    if least_letters < 4:
        raise ValueError("three bigrams decide: words need four letters")
    words = materialize(vocabulary(runs(docs, text, key, noise), least_letters, least_n), "words")
    formed = materialize(forms(words, near_pairs(words), ratio), "formed")
    return formed.join(roots(formed), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents").select("doc_id", "text"), noise=97)


#: The same in DuckDB: the CRC-32 by its table, near words by equal deletions, roots by recursion.
ORACLE = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS i))),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -n, w := near)) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 2 * w.n THEN b.w END AS form, CASE WHEN -b.n >= 2 * w.n THEN -b.n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE c AS (SELECT word, form AS root FROM formed WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN formed f ON c.root = f.word AND f.form IS NOT NULL) SELECT * FROM c),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(e.root, f.word) AS root FROM formed f LEFT JOIN ends e USING (word)
"""
