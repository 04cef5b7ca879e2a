"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens, and accepts exactly the token sequences into which byte-pair
merging turns words. It starts as one state with an arc for each base symbol; the merges are then applied
one after the other. The gadget of merge (u, v) -> w splits the state that u leads to: the copy for u loses its
arc v, and every state with an arc u gets an arc w to where v leads. Equal labels lead to equal
states all along, so a table of bits (arc class x state) and two vectors hold the automaton: tokens whose arcs leave the
same states share a class until a gadget parts them. The table grows with the vocabulary alone (20 MB for 49,408
tokens) and is built once on the driver.

A prefix of a word has one accepted token sequence, hence one state. So a word is encoded from left to right: each
token of the vocabulary that starts at a reached place, and for which the table has an arc from that place's
state, leads to a further place. Decoding emits the labels of the arcs, joined by a space (the tokenizer has no decoder of its own).

Texts are pre-split as the tokenizer's file says: its special tokens are taken out of the raw text, the rest is
normalised and split by the library. White space separates chunks; a chunk is split and encoded once and then looked up in a
memory of bounded size.

Defined cases: a null text is empty; an empty one has no tokens, and the digest of the empty string; texts of
any length are read whole, in pieces that end at white space; repeated rows get equal answers; a word has one
sequence, so there are no ties; null keys are carried along as all other columns are; a column called like a new
one is an error; a null list of ids decodes to null, an id outside the vocabulary is an error; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import table

END = "</w>"
#: Byte-level alphabet: visible bytes of Latin-1 stand for themselves, the others for U+0100 and on, in their order.
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


class Automaton:
    """The deterministic automaton over tokens that the merges make."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = END, added: dict[str, int] | None = None):
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        every = {**vocab, **(added or {})}
        size = max(every.values(), default=-1) + 1
        # state 0 is the start, state 1 the end of a word; a token's class has a row of bits, one for each state
        self.leads = np.zeros(size, np.int32)
        self.row = np.zeros(size, np.int32)
        self.row[[*(added or {}).values()]] = -1  # special tokens stand between words: labels without arcs
        bits = np.zeros((1024, 256), np.uint8)
        bits[0, 0] = 1
        in_class, into = [len(base)], [0, 0]
        for t in base:
            self.leads[vocab[t]] = bool(end) and t.endswith(end)
            into[self.leads[vocab[t]]] += 1
        into[0] += 1
        for a, b in merges:
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            state, after = int(self.leads[u]), int(self.leads[v])
            if min(self.row[u], self.row[v]) < 0 or not bits[self.row[v], state >> 3] >> (state & 7) & 1:
                self.row[w], self.leads[w] = -1, after  # no sequence has u before v: no arc w
                continue
            if into[state] > 1 or u == v:
                # other labels lead there too, or w will: u gets a copy of its own
                copy = len(into)
                if copy >= 8 * bits.shape[1]:
                    bits = np.concatenate((bits, np.zeros_like(bits)), axis=1)
                bits[: len(in_class), copy >> 3] |= (bits[: len(in_class), state >> 3] >> (state & 7) & 1) << (copy & 7)
                into[state] -= 1
                into.append(1)
                self.leads[u] = state = copy
            if in_class[self.row[v]] > 1:
                if len(in_class) == len(bits):
                    bits = np.concatenate((bits, np.zeros_like(bits)))
                in_class[self.row[v]] -= 1
                bits[len(in_class)] = bits[self.row[v]]
                self.row[v] = len(in_class)
                in_class.append(1)
            bits[self.row[v], state >> 3] &= 255 - (1 << (state & 7))
            self.row[w], self.leads[w] = self.row[u], after
            in_class[self.row[u]] += 1
            into[after] += 1
        self.states, self.classes = len(into), len(in_class)
        self.width = -(-self.states // 8)
        self.bits = bits[: self.classes, : self.width].tobytes()
        self.labels = [""] * size
        for t, i in every.items():
            self.labels[i] = t
        self.end = end
        self._index()

    def _index(self) -> None:
        """Tokens inside words, with all their prefixes (-1 for one that is no token itself), and tokens that end words."""
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        for i, t in enumerate(self.labels):
            if not t or self.row[i] < 0:
                continue
            if self.end and t.endswith(self.end):
                self.last[t[: -len(self.end)]] = i
            else:
                self.inner[t] = i
                for k in range(1, len(t)):
                    self.inner.setdefault(t[:k], -1)
        self.longest = max(map(len, self.last), default=0)
        self._row, self._leads = [int(r) * self.width for r in self.row], self.leads.tolist()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("inner", "last", "_row", "_leads", "longest")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._index()

    def accepts(self, ids: list[int]) -> bool:
        """Whether byte-pair merging makes this token sequence of the word that it spells."""
        state = 0
        for t in ids:
            if self.row[t] < 0 or not self.bits[self._row[t] + (state >> 3)] >> (state & 7) & 1:
                return False
            state = self._leads[t]
        return True

    def encode(self, word: str) -> tuple[int, ...]:
        """The tokens of one pre-split word (in the vocabulary's alphabet): the one accepted path that spells it.

        Longer tokens are tried first. A place has one state, so it is left for good once no path leads on from it.
        """
        n, bits, row, leads, inner = len(word), self.bits, self._row, self._leads, self.inner
        if not n:
            return ()
        stop = n - 1 if self.end else n
        at, s, out, states, open_, seen = 0, 0, [], [], [], set()
        while True:
            if self.end and n - at <= self.longest:
                t = self.last.get(word[at:])
                if t is not None and bits[row[t] + (s >> 3)] >> (s & 7) & 1:
                    return (*out, t)
            found = []
            for to in range(at + 1, stop + 1):
                t = inner.get(word[at:to])
                if t is None:
                    break
                if t >= 0:
                    found.append((t, to))
            open_.append(found)
            states.append(s)
            while True:
                if not open_[-1]:
                    open_.pop()
                    states.pop()
                    if not open_:
                        raise ValueError(f"the vocabulary cannot spell {word[:80]!r}")
                    out.pop()
                    continue
                t, at = open_[-1].pop()
                s = states[-1]
                if at not in seen and bits[row[t] + (s >> 3)] >> (s & 7) & 1:
                    break
            seen.add(at)
            out.append(t)
            s = leads[t]
            if at == n:
                return tuple(out)


class Encoder:
    """Whole texts to token ids; lives in a Python worker.

    Texts of characters below U+0180, but for U+0130 and U+001C to U+001F, are in NFC, become lower case letter by letter and
    have Python's white space; the library normalises all others.
    """

    def __init__(self, path: str, automaton: Automaton, memory: int = 150_000, piece: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        special = tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.odd = regex.compile(r"[^\x00-\x1B\x20-įı-ſ]")
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.space = regex.compile(r"\s")
        self.automaton, self.memory, self.piece = automaton, memory, piece
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.weight = 0

    def _learn(self, chunk: str, plain: bool) -> tuple[int, ...]:
        """The ids of a chunk without white space; plain chunks are split here, others by the library."""
        if not plain:
            return tuple(t for word, _ in self.splitter.pre_tokenize_str(chunk) for t in self.automaton.encode(word))
        out, words = (), self.word.findall(chunk)
        for w in words:
            ids = self.known.get(w) if len(words) > 1 else None
            if ids is None:
                ids = self.automaton.encode(w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(BYTES))
                if len(words) > 1:
                    self.known[w] = ids
                    self.weight += len(w)
            out += ids
        return out

    def _plain(self, text: str) -> list[int]:
        """The ids of a text without special tokens."""
        plain = not self.odd.search(text)
        chunks = text.lower().split() if plain else self.normalizer.normalize_str(text).split(" ")
        if self.weight > 12 * self.memory:
            self.known, self.older, self.weight = {}, self.known, 0
        known = self.known
        for c in set(chunks).difference(known):
            known[c] = self.older.get(c) or self._learn(c, plain)
            self.weight += len(c)
        return list(itertools.chain.from_iterable(map(known.__getitem__, chunks)))

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.piece:
            cut = self.space.search(text, at + self.piece)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        parts = self.marks.split(text) if self.marks and self.marks.search(text) else [text]
        out: list[np.ndarray] = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32))
            elif part:
                out.extend(np.array(self._plain(p), np.int32) for p in self._pieces(part))
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def compile_automaton(path: str) -> Automaton:
    """The automaton of a tokenizer's file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    data = json.loads(text)
    model = data["model"]
    if model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
        raise ValueError("merges are not all that decides in this tokenizer")
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    automaton = Automaton(vocab, merges, model.get("end_of_word_suffix") or "", added)
    automaton.stamp = hashlib.sha256(text.encode()).hexdigest()
    return automaton


#: A worker's encoder, kept from task to task, by the digest of the tokenizer's file.
_encoders: dict[str, Encoder] = {}


def _free(docs: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name}")


def encode(docs: DataFrame, path: str, automaton, text: str = "text", ids: str = "ids") -> DataFrame:
    """Put the token ids in place of the text; ``automaton`` is a broadcast Automaton."""
    names = [c for c in docs.columns if c != text]
    _free(docs.select(*(f"`{c}`" for c in names)), ids)
    schema = docs.select(*(f"`{c}`" for c in names)).schema.add(ids, ArrayType(IntegerType()))

    stamp = automaton.value.stamp

    def run(batches):
        if stamp not in _encoders:
            _encoders.clear()
            _encoders[stamp] = Encoder(path, automaton.value)
        encoder = _encoders[stamp]
        for batch in batches:
            at = 0
            while at < len(batch):  # a few MB at a time
                lists, size, to = [], 0, at
                while to < len(batch) and size < 1 << 21:
                    lists.append(encoder.encode(batch.column(0)[to].as_py() or ""))
                    size += 4 * len(lists[-1])
                    to += 1
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns[1:], found], names=[*names, ids])
                at = to

    return docs.select(f"`{text}`", *(f"`{c}`" for c in names)).mapInArrow(run, schema)


def decode(rows: DataFrame, arc_labels, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the decoded text: the labels of the arcs that the ids name (``arc_labels``: the automaton's, broadcast), joined by a space."""
    _free(rows, text)
    names = rows.columns
    schema = rows.select(*(f"`{c}`" for c in names)).schema.add(text, "string")
    place = names.index(ids)

    def run(batches):
        labels = pa.array(arc_labels.value, pa.string())
        for batch in batches:
            sizes = pc.fill_null(batch.column(place).value_lengths(), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes, dtype=np.int64) >> 19  # some half a million ids at a time
            for at, to in itertools.pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]):
                own = batch.slice(at, to - at)
                ids_ = own.column(place)
                ends = np.concatenate(([0], np.cumsum(sizes[at:to]))).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), labels.take(ids_.flatten())), " ")
                yield pa.RecordBatch.from_arrays([*own.columns, pc.if_else(ids_.is_valid(), joined, None)], names=[*names, text])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    automaton = compile_automaton(path)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decode(encode(docs, path, spark.sparkContext.broadcast(automaton)), spark.sparkContext.broadcast(automaton.labels))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
