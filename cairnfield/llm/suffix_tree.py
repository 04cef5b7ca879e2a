"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of up to ``depth`` words. A context of at least ``min_count`` training
places, whatever the size of the corpus, is retained if its next-word distribution diverges from that of its suffix: the
Kullback-Leibler divergence, less its small-sample bias (T - 1) / 2c for T different next
words in c places, is at least ``min_divergence`` nats. A state's distribution is smoothed
with its longest retained suffix's, ``(c(s, w) + T(s) p(w | suffix)) / (c(s) + T(s))``; the root is
add-one over words. A word is scored by the longest retained suffix of the words before it.

Texts are tokenised once into blocks (a table bucketed by block). The counts of words, of pairs, and then the statistics of contexts of d words
with the counts of the next longer n-grams are asked for in depth + 2 rounds. Every count or statistic is a
sum by key over all blocks: blocks send their different keys with their own sums, dealt by key
range; each range is summed and returned to the blocks that asked. So frequent keys are one
entry for each block, nothing passes the driver but two totals, and no task holds more than a key range or a block. A block
sends a row for each range that it has keys of, so rows never outnumber keys and grow with the corpus; the ranges' number follows
the tokens.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end for each text. Defined
cases: null and empty texts are an end alone; repeated rows are scored and learned from as
often as they occur; a corpus without training rows gives the uniform root; an empty table gives no
rows; very long texts are whole, in a block of their own; null keys are keys like others; retention depends on sums alone, so there are no ties; other columns,
whatever their names, are ignored. Words are held as 64-bit hashes.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, note_table, shared_dir, shuffle_parts, shuffles_dropped, table
from .vectext import NOT_SPACE, chunks, mix, strings, word_hashes

END = np.uint64(0x5AFE0E2D0FDA7A11)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    import zstandard

    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def _unpack(b: bytes, dtype, columns: int = 1) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    width = dtype.itemsize * columns
    out = np.ascontiguousarray(flat.reshape(width, -1).T).view(dtype)
    return out if columns > 1 else out.ravel()


def _bucketed(df: DataFrame, parts: int) -> DataFrame:
    """Write a table bucketed by block in the shared folder: later joins on block need no shuffle."""
    spark = df.sparkSession
    name = f"cairnfield_{uuid.uuid4().hex}"
    note_table(name)
    empty = spark.createDataFrame([], df.schema)
    empty.write.format("parquet").option("compression", "none").option("path", f"{shared_dir(spark)}/{name}").bucketBy(parts, "block").saveAsTable(name)
    with shuffles_dropped(spark):
        df.write.insertInto(name)
    return spark.table(name)


def tokenise(docs: DataFrame, key: str, text: str, train: Column, block_bytes: int = 2 << 20) -> DataFrame:
    """Blocks of about block_bytes of text: (block, keys, train, lengths, words, index, n_tokens, n_train).

    words: the block's different tokens by falling frequency; index: the token at each place.
    """
    rows = docs.select(F.col(key), train.alias("train"), F.col(text).alias("text"))
    schema = T.StructType().add("block", "long").add("keys", T.ArrayType(rows.schema[0].dataType)).add("train", "binary").add("lengths", "binary").add("words", "binary").add("index", "binary").add("n_tokens", "long").add("n_train", "long")

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        keys, flags, hashes, sizes, held = [], [], [], [], 0

        def flush():
            nonlocal block
            tokens, lengths, learn = np.concatenate(hashes), np.concatenate(sizes), np.concatenate(flags)
            words, index, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            listed = pa.concat_arrays(keys)
            columns = [[block], pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed), [learn.astype(np.uint8).tobytes()], [_pack(lengths)], [_pack(words[order])], [_pack(rank[index])], [len(tokens)], [int(lengths[learn].sum())]]
            block += 1
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], names=schema.names)

        arrow = [pa.field("block", pa.int64()), None, *[pa.field(n, pa.binary()) for n in ("train", "lengths", "words", "index")], pa.field("n_tokens", pa.int64()), pa.field("n_train", pa.int64())]
        for batch in batches:
            texts = strings(batch.column(2))
            for i, j in chunks(texts, 1 << 20):
                part = texts.slice(i, j - i)
                words, bounds = word_hashes(part, NOT_SPACE)
                hashes.append(np.insert(words, bounds[1:], END))
                sizes.append(np.diff(bounds) + 1)
                keys.append(batch.column(0).slice(i, j - i))
                flags.append(np.asarray(batch.column(1).slice(i, j - i).fill_null(False).to_numpy(zero_copy_only=False), bool))
                held += len(hashes[-1]) * 6
                if held >= block_bytes:
                    yield flush()
                    keys, flags, hashes, sizes, held = [], [], [], [], 0
        if sizes:
            yield flush()

    return rows.mapInArrow(run, schema)


def _different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and the place of each value among them."""
    codes, values = pd.factorize(hashes, sort=True)
    return values, codes


class Block:
    """A block's arrays: index and lengths, place by place, and what the answered levels have returned for it.

    Level 0 has counts of words, level 2 d - 1 counts of n-grams of d + 1 words, level 2 d the retained ones among their contexts.
    """

    def __init__(self, row: dict, levels: dict[int, list], answered: int):
        words = _unpack(row["words"], np.uint64)
        index = _unpack(row["index"], np.int32)
        order = np.argsort(words)
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        #: the different tokens' hashes, sorted, and which of them stands at each place
        self.words, self.codes = words[order], rank[index]
        self.lengths = _unpack(row["lengths"], np.int64)
        train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.learn = np.repeat(train, self.lengths)
        ends = np.cumsum(self.lengths)
        #: how many tokens of its text stand before each place
        self.depth = np.arange(len(index)) - np.repeat(ends - self.lengths, self.lengths)
        self.starts = ends - self.lengths
        self.token = self.words[self.codes]
        self.levels, self.answered = levels, answered

    def _returned(self, level: int, keys: np.ndarray) -> np.ndarray:
        """What level returned for the sorted keys."""
        parts = sorted(self.levels.get(level, []), key=lambda p: p["part"])
        got = [_unpack(p["sums"], np.int64) for p in parts]
        out = np.concatenate(got) if got else np.zeros(0, np.int64)
        assert len(out) == len(keys), "a level does not fit its block"
        return out

    def asked(self, depth: int, min_count: int, total: tuple[int, int]) -> list[tuple]:
        """The requests (level, keys, own) that the answered levels allow: a context's statistics and the counts of the next longer n-grams at once."""
        return list(self._walk(depth, min_count, total))

    def scores(self, depth: int, min_count: int, total: tuple[int, int]) -> tuple:
        """(lengths, known, base, score) of each text, when all levels are answered."""
        return next(self._walk(depth, min_count, total))

    def _walk(self, depth: int, min_count: int, total: tuple[int, int]) -> Iterator[tuple]:
        keys, codes = self.words, self.codes  # of the n-grams that end at each place
        if not self.answered:
            yield 0, keys, np.bincount(codes, self.learn, len(keys)).astype(np.int64)
            return
        last = self.answered > 2 * depth
        count = self._returned(0, keys)[codes]  # of the n-gram that ends here, its last n words
        known = count > 0
        base = (count + 1.0) / (total[0] + total[1] + 1.0)
        prob = base.copy()
        shorter = count / max(1, total[0])  # share of this word after the context without its first word
        gram, alive = self.token, np.ones(len(count), bool)  # alive: count holds for this place
        for d in range(1, depth + 1):
            # contexts: the d-gram that ends one place before
            at = np.flatnonzero((self.depth >= d) & np.concatenate(([False], alive[:-1])) & (np.concatenate(([0], count[:-1])) >= min_count))
            in_context = count[at - 1]
            long_ = mix(gram[at - 1] * _STEP + self.token[at])
            longer, back = _different(long_)
            if self.answered <= 2 * d - 1:
                yield 2 * d - 1, longer, np.bincount(back, self.learn[at], len(longer)).astype(np.int64)
                return
            joint = self._returned(2 * d - 1, longer)[back]
            if last or self.answered <= 2 * d:
                used = np.zeros(len(keys), bool)
                used[codes[at - 1]] = True
                context, contexts = (np.cumsum(used) - 1)[codes[at - 1]], keys[used]
            if last:
                types = self._returned(2 * d, contexts)[context]
                kept = types > 0
                prob[at[kept]] = (joint[kept] + types[kept] * prob[at[kept]]) / (in_context[kept] + types[kept])
            elif self.answered <= 2 * d:
                learn = self.learn[at]
                ratio = np.zeros(len(at))
                ratio[learn] = np.log(joint[learn] / in_context[learn]) - np.log(shorter[at[learn]])
                types = np.zeros(len(at))
                types[learn] = 1.0 / joint[learn]
                counted = np.zeros(len(contexts))
                counted[context] = in_context
                yield 2 * d, contexts, np.stack([np.bincount(context, ratio, len(contexts)), np.bincount(context, types, len(contexts)), counted], 1)
            shorter = np.zeros(len(count))
            shorter[at] = joint / in_context
            alive = np.zeros(len(count), bool)
            alive[at] = True
            count = np.zeros(len(count), np.int64)
            count[at] = joint
            gram = np.zeros(len(gram), np.uint64)
            gram[at] = long_
            keys, codes = longer, np.zeros(len(gram), np.int64)
            codes[at] = back
        if last:
            yield self.lengths, np.add.reduceat(known.astype(np.int64), self.starts), np.add.reduceat(np.log10(base), self.starts), np.add.reduceat(np.log10(prob), self.starts)


def _request(blocks: DataFrame, returned: list[DataFrame], ranges: int, args: tuple, min_divergence: float, parts: int) -> DataFrame:
    """One round: requests by level and key range, sums, and a table (block, answers, positive).

    A count is returned as it is, a context as the number of its different next words if it is retained, else 0.
    """
    answered = max(0, 2 * len(returned) - 2) or len(returned)

    def ask(batches):
        for row, levels in _rows(batches):
            for level, keys, own in Block(row, levels, answered).asked(*args):
                if not len(keys):
                    continue
                part = (keys >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                    deltas = np.diff(keys[a:b], prepend=np.uint64(0))
                    columns = [pa.array([level], pa.int32()), pa.array([part[a]], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([_pack(deltas)], pa.binary()), pa.array([_pack(own[a:b])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["level", "part", "block", "keys", "own"])

    def add_up(group: pa.Table) -> pa.Table:
        level = group["level"][0].as_py()
        keys = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in group["keys"].to_pylist()]
        bounds = np.cumsum([0, *map(len, keys)])
        different, back = _different(np.concatenate(keys))
        del keys
        if level % 2 or not level:
            flat = np.concatenate([_unpack(x, np.int64) for x in group["own"].to_pylist()])
            sums = np.bincount(back, flat, len(different)).astype(np.int64)  # whole numbers below 2^53 are exact
        else:
            flat = np.concatenate([_unpack(x, np.float64, 3) for x in group["own"].to_pylist()])
            types = np.maximum(np.rint(np.bincount(back, flat[:, 1], len(different))), 1)
            in_context = np.ones(len(different))
            in_context[back] = flat[:, 2]
            kept = (np.bincount(back, flat[:, 0], len(different)) - (types - 1) / 2) / in_context >= min_divergence
            sums = np.where(kept, types, 0).astype(np.int64)
        answers = [_pack(sums[back[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        positive = np.zeros(len(answers), np.int64)
        positive[0] = 0 if level else int((sums > 0).sum())
        return pa.table({"block": group["block"], "level": group["level"], "part": group["part"], "sums": pa.array(answers, pa.binary()), "positive": positive})

    asked = _joined(blocks, returned).mapInArrow(ask, "level int, part long, block long, keys binary, own binary")
    summed = asked.groupBy("level", "part").applyInArrow(add_up, "block long, level int, part long, sums binary, positive long")
    answers = summed.groupBy("block").agg(F.collect_list(F.struct("level", "part", "sums")).alias("answers"), F.sum("positive").alias("positive"))
    return _bucketed(answers, parts)


def _joined(blocks: DataFrame, returned: list[DataFrame]) -> DataFrame:
    out = blocks.drop("n_tokens", "n_train")
    for i, level in enumerate(returned):
        out = out.join(level.select("block", F.col("answers").alias(f"level{i}")), "block", "left")
    return out


def _rows(batches) -> Iterator[tuple[dict, dict[int, list]]]:
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() if not n.startswith("level") and n != "keys" else batch.column(k)[i] for k, n in enumerate(names)}
            levels: dict[int, list] = {}
            for answer in (x for n in names if n.startswith("level") for x in row[n].as_py() or []):
                levels.setdefault(answer["level"], []).append(answer)
            yield row, levels


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", depth: int = 4, min_count: int = 16, min_divergence: float = 0.05, range_tokens: int = 3_000_000) -> DataFrame:
    """(key, trained, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    blocks = _bucketed(tokenise(docs, key, text, train), parts)
    n, n_tokens = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    # a block's row holds megabytes, so few rows pass to Python at a time
    with small_batches(spark):
        return _levels(docs, blocks, n, n_tokens, (depth, min_count, min_divergence), range_tokens, key, parts)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "4m")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _levels(docs: DataFrame, blocks: DataFrame, n: int, n_tokens: int, limits: tuple, range_tokens: int, key: str, parts: int) -> DataFrame:
    depth, min_count, min_divergence = limits
    ranges = 1 << (max(parts, n_tokens // range_tokens) - 1).bit_length()
    returned = [_request(blocks, [], ranges, (depth, min_count, (n, 0)), min_divergence, parts)]
    distinct = returned[0].agg(F.coalesce(F.sum("positive"), F.lit(0))).first()[0]
    args = (depth, min_count, (n, distinct))
    for _ in range(depth + 1):
        returned.append(_request(blocks, returned, ranges, args, min_divergence, parts))
    kind = docs.select(key).schema[0].dataType
    schema = T.StructType().add(key, kind).add("trained", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")

    def finish(batches):
        for row, levels in _rows(batches):
            lengths, known, base, value = Block(row, levels, 2 * depth + 1).scores(*args)
            flags = np.frombuffer(row["train"], np.uint8).astype(bool)
            columns = [row["keys"].values, pa.array(flags), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), n, np.int64)), pa.array(base), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return materialize(_joined(blocks, returned).mapInArrow(finish, schema), "scores")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(7))
    out = score(table(spark, sf_dir, "documents"), rest != 2)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
