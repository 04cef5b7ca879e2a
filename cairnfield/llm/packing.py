"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents become token ids (a public byte-level BPE vocabulary, then one end id). The ids of
a stretch of documents, in order, are cut into sequences of at most ``window`` ids. Cuts may fall
at document ends (free), at sentence ends (a small penalty) and, where sentences leave no
other way, inside them (a larger one). ``cost[j] = min over i of cost[i] + padding(i, j) + penalty(j)``
within a window is a sliding minimum of ``cost[i] + position[i]``, kept in a monotone
queue; a sequence whose length is a power of two is not padded, which adds one candidate
for each power (at a small penalty, so that short sequences stay rare). A stretch is one partition's documents up to ``stretch`` ids, so that memory stays bounded,
no document moves, and at most one sequence in ``stretch / window`` ends early.

Defined cases: a null text is empty and gives its end id alone; repeated rows are packed
one after the other, null keys like others; texts longer than a window go over several sequences, very long ones in a stretch of their own; of
equally good cuts the later start wins; other columns, whatever their names, are ignored; a key that is called like a column
of the result is an error; an empty table gives no pieces. The order is that of the input's partitions and rows.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vectext import mix

WINDOW, END_ID = 1024, 0
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts: splits texts into the vocabulary's pre-tokens with NumPy and encodes each different one once.

    The split is that of the byte-level BPE pattern (contractions, letters, digits, other
    signs, each with an optional space before; white space). Texts with contractions, or with signs outside
    the Latin blocks, go to the tokenizer whole.
    """

    LATIN = 0x250

    def __init__(self, path: str, memory: int = 250_000):
        import os
        import unicodedata

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memory = memory
        kinds = [unicodedata.category(chr(c))[0] for c in range(self.LATIN)]
        space = [chr(c).isspace() and not 0x1C <= c <= 0x1F for c in range(self.LATIN)]
        #: 0 white space, 1 letter, 2 number, 3 other
        self.kind = np.array([0 if s else 1 if k == "L" else 2 if k == "N" else 3 for k, s in zip(kinds, space, strict=True)], np.uint8)
        self.sentence = np.array([self._ends_sentence(i) for i in range(self.tokenizer.get_vocab_size())])
        self._forget()

    def _ends_sentence(self, i: int) -> bool:
        t = self.tokenizer.id_to_token(i)
        return bool(t) and t.rstrip("Ġ\"')]»”")[-1:] in (".", "!", "?", "Ċ")

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.store, self.begin, self.size = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def _learn(self, keys: list[int], texts: list[str]) -> None:
        if not keys:
            return
        e = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        ids, size = np.array(e.ids, np.int32), np.bincount(e.word_ids, minlength=len(keys))
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        self.store[self.used : self.used + len(ids)] = ids
        self.known.update(zip(keys, range(len(self.begin), len(self.begin) + len(keys)), strict=True))
        self.begin = np.concatenate((self.begin, self.used + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.used += len(ids)

    def _whole(self, text: str) -> bool:
        """Whether a text must go to the tokenizer as it is."""
        at = text.find("'")
        while at >= 0:
            if text[at + 1 : at + 2] in tuple("stmdrvl"):
                return True
            at = text.find("'", at + 1)
        return False

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        easy = [i for i, t in enumerate(texts) if t and not self._whole(t)]
        joined = "".join(texts[i] for i in easy)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([0, *(len(texts[i]) for i in easy)])
        if len(points) and points.max() >= self.LATIN:
            far = np.concatenate(([0], np.cumsum(points >= self.LATIN)))
            keep = far[bounds[1:]] == far[bounds[:-1]]
            easy = [i for i, k in zip(easy, keep, strict=True) if k]
            points = points[np.repeat(keep, np.diff(bounds))]
            bounds = np.cumsum([0, *(len(texts[i]) for i in easy)])
            joined = "".join(texts[i] for i in easy)
        for i, ids in zip(easy, self._split(points, bounds, joined), strict=True):
            out[i] = ids
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if t else [], np.int32)
        return out

    def _split(self, points: np.ndarray, bounds: np.ndarray, joined: str) -> list[np.ndarray]:
        if not len(points):
            return []
        n = len(points)
        kind = self.kind[points]
        first = np.ones(n + 1, bool)  # where a pre-token starts
        first[1:n] = kind[1:] != kind[:-1]
        first[bounds] = True
        # a run's last white-space sign stands alone, and a space there goes to what follows
        before = np.zeros(n, bool)
        before[:-1] = (kind[:-1] == 0) & (kind[1:] != 0)
        before[bounds[1:] - 1] = False
        at = np.flatnonzero(before)
        first[at] = True
        spaces = at[points[at] == 32]
        first[spaces + 1] = False
        starts = np.flatnonzero(first[:n])
        ends = np.append(starts[1:], n)
        weights = np.cumprod(np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64))
        inverse = np.cumprod(np.full(n + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * weights[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts])
        back, unique = pd.factorize(hashes)
        where = np.empty(len(unique), np.int64)
        where[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        if len(self.known) > self.memory:
            self._forget()
        keys = unique.tolist()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        self._learn([keys[k] for k in new], [joined[starts[where[k]] : ends[where[k]]] for k in new])
        slot = np.fromiter((self.known[key] for key in keys), np.int64, len(keys))
        begin, size = self.begin[slot][back], self.size[slot][back]
        stops = np.cumsum(size)
        ids = self.store[np.repeat(begin - (stops - size), size) + np.arange(stops[-1])]
        edge = np.concatenate(([0], stops))[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


@functools.lru_cache(maxsize=1)
def encoder_for(path: str) -> Encoder:
    """One encoder for each worker process: tasks that follow in it find their words encoded."""
    return Encoder(path)


def best_cuts(position: np.ndarray, penalty: np.ndarray, window: int, each: float = 0.0) -> list[int]:
    """Indices of the cuts, first to last, that minimise padding plus penalties.

    position: rising cut places, the first 0, neighbours at most ``window`` apart; penalty: of a
    cut at each; each: cost of a sequence that is shorter than the window but not padded.
    """
    place, cost_of = position.tolist(), penalty.tolist()
    n = len(place)
    cost, back = [0.0] * n, [0] * n
    # for each cut the ones a power of two before it, rising powers, as (size < window, index)
    exact: list[tuple[int, bool, int]] = []
    for size in (1 << k for k in range(window.bit_length()) if 1 << k <= window):
        at = np.minimum(np.searchsorted(position, position - size), n - 1)
        met = np.flatnonzero(position[at] == position - size)
        exact += zip(met.tolist(), [size < window] * len(met), at[met].tolist(), strict=True)
    exact.sort(key=lambda x: x[0])  # stable: powers stay in their order
    exact.append((n, False, 0))
    upto = 0
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        p = place[j]
        while place[queue[0][1]] < p - window:
            queue.popleft()
        value, i = queue[0]
        best = value + window - p
        while exact[upto][0] == j:
            _, short, k = exact[upto]
            upto += 1
            if cost[k] + (each if short else 0) < best:
                best, i = cost[k] + (each if short else 0), k
        best += cost_of[j]
        cost[j], back[j] = best, i
        value = best + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def cut_places(docs: list[np.ndarray], sentence: np.ndarray, window: int, sentence_penalty: float, inner_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of documents may be cut, and what each cut costs."""
    ids = np.concatenate(docs)
    ends = np.cumsum([len(d) for d in docs])
    penalty = np.full(len(ids) + 1, -1.0)
    penalty[1:][sentence[ids]] = sentence_penalty
    penalty[0] = 0
    penalty[ends] = 0
    place = np.flatnonzero(penalty >= 0)
    gaps = np.flatnonzero(np.diff(place) > window)
    for g in gaps:  # a sentence longer than a window: it may also be cut at each sixteenth of one
        inner = np.arange(place[g] + window // 16, place[g + 1], window // 16)
        penalty[inner] = inner_penalty
    place = np.flatnonzero(penalty >= 0)
    return place, penalty[place]


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, sentence_penalty: float = 2.0, inner_penalty: float = 64.0, short_penalty: float = 4.0, stretch: int = 2_000_000) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer_path must be readable where tasks run, as an installed package's file is.
    sequence_id holds the partition (upper bits) and the sequence's number in it.
    """
    if key.lower() in [x.split()[0] for x in PIECES.split(", ")]:
        raise ValueError(f"the key {key} is called like a column of the result")
    rows = docs.select(key, text)
    schema = rows.select(key).schema
    for name, kind in (x.split() for x in PIECES.split(", ")):
        schema = schema.add(name, kind)

    def run(batches):
        from pyspark import TaskContext

        encoder, sequence = encoder_for(tokenizer_path), TaskContext.get().partitionId() << 40
        keys, held, total = [], [], 0

        def flush():
            nonlocal sequence
            place, penalty = cut_places(held, encoder.sentence, window, sentence_penalty, inner_penalty)
            cuts = place[best_cuts(place, penalty, window, short_penalty)]
            ends = np.cumsum([len(d) for d in held])
            edges = np.union1d(cuts, ends)  # a piece starts at each cut and each document
            begin, stop = np.concatenate(([0], edges[:-1])), edges
            begin, stop = begin[stop > begin], stop[stop > begin]
            doc = np.searchsorted(ends, begin, "right")
            seq = np.searchsorted(cuts, begin, "right") - 1
            sizes = np.array([len(d) for d in held])
            start = begin - (ends - sizes)[doc]
            crc = [zlib.crc32(held[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(doc, start, stop - begin, strict=True)]
            taken = pa.concat_arrays(keys).take(pa.array(doc))
            columns = [taken, start, stop - begin, crc, sizes[doc], seq + sequence, begin - cuts[seq]]
            sequence += len(cuts) - 1
            batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=schema.names)
            keys.clear(), held.clear()
            return batch

        for batch in batches:
            texts = batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= 1 << 20):
                    size += len(texts[j] or "")
                    j += 1
                for ids in encoder.encode([t or "" for t in texts[i:j]]):
                    held.append(np.append(ids, np.int32(end_id)))
                    total += len(held[-1])
                keys.append(batch.column(0).slice(i, j - i))
                i = j
                if total >= stretch:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
