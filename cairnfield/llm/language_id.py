"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier per bit predicts it. A
classifier's weights are log odds of hashed byte n-grams between the languages whose bit
is 1 and those whose bit is 0, each language counting alike. A bit's margin is scaled by the scores that the
languages' own n-gram distributions would get: the gap between the lowest of those with bit 1 and the highest of those with bit 0.
Decoding adds, over the bits, a logistic loss of the margin against the codeword's sign, weighted by the bit's gap, and
takes the language with the least loss; a small lead over the second is flagged as ambiguous.

Training reads at most about ``train_docs`` texts of each language, whole, picked by a hash
of key and text; all languages are learned, and more than ``max_languages``, which bounds the model's memory, are an error; the rest of the work covers every row. Defined cases: text null or without a letter gives
``und`` with score 0; very long texts are read whole, in pieces of 1 MB; repeated rows get equal answers and train together or
not at all; of equal losses the language whose name sorts first wins; rows whose language is null do not train, those whose key is null
do; without any language to learn all rows are ``und``; ``predict`` replaces columns called like its own, and
``keep_identified`` keeps all columns as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

SIZES, BITS = (1, 2, 3, 4), 13
SLOTS = len(SIZES) << BITS
#: ASCII bytes that are no letters become spaces, A-Z lower case.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # slots x bits
    shift: np.ndarray  # bits: margin = (score - shift) * scale
    scale: np.ndarray
    trust: np.ndarray  # bits: weight of the bit's loss


def code_words(n: int, seed: int = 7) -> np.ndarray:
    """All ways to part up to five languages; for more, random words of 4 log2(n) + 11 bits, the set with the largest least distance of 200."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        return np.array([[1, *rest] for rest in itertools.product((1, -1), repeat=n - 1)][1:]).T.astype(float)
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(4 * np.log2(n)) + 11))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code @ code.T + np.eye(n) * 1e9).min()
        if apart > most:
            best, most = code, apart
    return best


def _slots(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram slots that start at each place but the last few, and where a run of spaces says nothing."""
    n = len(data) - max(SIZES) + 1
    gram, rows = np.zeros(n, np.uint32), []
    for i, size in enumerate(SIZES):
        gram |= data[size - 1 : size - 1 + n] << np.uint32(8 * (size - 1))
        rows.append(((gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)) + np.uint32(i << BITS))
    return np.stack(rows, 1), (data[:n] == 32) & (data[1 : n + 1] == 32)


def profiles(texts: list[str], piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """For each text how often it has each slot (letters only, words separated by one space or more)."""
    pad, more = b" " * max(SIZES), max(SIZES) - 1
    parts = [pad + t.lower().encode().translate(_TABLE) + pad for t in texts]
    if sum(map(len, parts)) > 4 * piece and len(parts) > 1:
        for t in texts:
            yield from profiles([t], piece)
    elif len(parts) == 1:
        data, total = np.frombuffer(parts[0], np.uint8), np.zeros(SLOTS, np.int64)
        for at in range(0, len(data) - more, piece):
            rows, blank = _slots(data[at : at + piece + more].astype(np.uint32))
            total += np.bincount(rows[~blank].ravel(), minlength=SLOTS)
        yield total
    elif parts:
        rows, blank = _slots(np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32))
        ends = np.cumsum([len(p) for p in parts])
        for a, b in zip(np.concatenate(([0], ends[:-1])), ends - more, strict=True):
            yield np.bincount(rows[a:b][~blank[a:b]].ravel(), minlength=SLOTS)


def _groups(column, size: int = 1 << 20):
    texts, total = [], 0
    for t in column.to_pylist():
        texts.append(t or "")
        total += len(texts[-1])
        if total >= size:
            yield texts
            texts, total = [], 0
    if texts:
        yield texts


def train(docs: DataFrame, train_docs: int = 3000, text: str = "text", lang: str = "lang", key: str = "doc_id", max_languages: int = 1024) -> Model | None:
    """Fit on (text, lang): n-gram counts of about train_docs texts of each language."""
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"there are more than {max_languages} languages")
    if not sizes:
        return None
    languages = tuple(sorted(sizes))
    part = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, train_docs / sizes[name]))])
    chosen = docs.where(F.col("lang").isin(*languages)).where(F.pmod(F.xxhash64("k", "text"), F.lit(1 << 30)) < F.element_at(part, F.col("lang")) * float(1 << 30)).select("lang", "text")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for texts in _groups(batch.column(1)):
                for counts in profiles(texts):
                    own = totals.setdefault(names[at], np.zeros(SLOTS, np.int64))
                    own += counts
                    at += 1
        for name, own in totals.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], ["lang", "slot", "n"])

    counted = chosen.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), SLOTS))
    for row in counted.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns")).toLocalIterator():
        counts[languages.index(row["lang"]), row["slots"]] = row["ns"]
    # each n-gram size is a distribution of its own, with 0.05 added to every slot
    shares = (counts + 0.05).reshape(len(languages), len(SIZES), -1)
    shares = (shares / shares.sum(2, keepdims=True)).reshape(len(languages), -1)
    code = code_words(len(languages))
    weights = np.zeros((SLOTS, code.shape[1]))
    for b in range(code.shape[1]):
        up, down = code[:, b] > 0, code[:, b] < 0
        if up.any() and down.any():
            weights[:, b] = np.log(shares[up].mean(0)) - np.log(shares[down].mean(0))
    weights = (weights / len(SIZES)).astype(np.float32)
    # expected scores by language calibrate the margins
    means = shares @ weights
    high = np.array([means[code[:, b] > 0, b].min(initial=np.inf) for b in range(code.shape[1])])
    low = np.array([means[code[:, b] < 0, b].max(initial=-np.inf) for b in range(code.shape[1])])
    high, low = np.where(np.isfinite(high), high, 1.0), np.where(np.isfinite(low), low, -1.0)
    gap = np.maximum(high - low, 1e-3)
    return Model(languages, code, weights, (high + low) / 2, 8.0 / gap, gap / gap.sum())


def decode(model: Model, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its share of exp(-loss) and its lead over the second, for rows of bit scores."""
    margin = (score - model.shift) * model.scale
    loss = np.stack([(np.logaddexp(0, -margin * word) * model.trust).sum(1) for word in model.code], 1)
    share = np.exp(-(loss - loss.min(1, keepdims=True)))
    share /= share.sum(1, keepdims=True)
    top = np.sort(share, 1)
    return loss.argmin(1), top[:, -1], top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0)


def predict(docs: DataFrame, model: Model | None, text: str = "text", ambiguous_below: float = 0.05, names_out: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Add lang_pred, score and ambiguous to every row; other columns are carried along, those of these names replaced."""
    names = [c for c in docs.columns if c not in names_out]
    schema = docs.select(*names).schema.add(names_out[0], "string").add(names_out[1], "double").add(names_out[2], "boolean")
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches):
        import regex

        letter, m = regex.compile(r"\p{L}"), shared.value
        for batch in batches:
            scores, lettered = [], []
            for texts in _groups(batch.column(at)):
                lettered += [bool(letter.search(t)) for t in texts]
                if m is not None:
                    for counts in profiles(texts):
                        n = max(1, int(counts.sum()) // len(SIZES))
                        scores.append(counts.astype(np.float32) @ m.weights / n)
            lettered = np.array(lettered, bool)
            if m is None:
                best, share, lead = np.zeros(len(lettered), int), np.zeros(len(lettered)), np.ones(len(lettered))
                lettered[:] = False
            elif scores:
                best, share, lead = decode(m, np.array(scores, float))
            else:
                continue
            pred = [m.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            extra = [pa.array(pred, pa.string()), pa.array(np.where(lettered, share, 0.0)), pa.array(~lettered | (lead < ambiguous_below))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *names_out])

    return docs.select(*names).mapInArrow(classify, schema)


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose text has a language; learns from their own language column."""
    names = tuple(free_name(docs, n) for n in ("lang_pred", "score", "ambiguous"))
    found = predict(docs, train(docs, text=text, lang=lang, key=key), text, names_out=names)
    return found.where(F.col(names[0]) != "und").drop(*names)


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    rows = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
