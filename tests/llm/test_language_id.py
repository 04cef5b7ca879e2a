import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cairnfield.llm import language_id


def test_held_out_accuracy(spark, sf, docs):
    got = {r["doc_id"]: r for r in language_id.query(spark, sf).collect()}
    rows = docs.collect()
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= g["score"] <= 1 for g in got.values())


def test_odd_rows(spark, docs, odd_rows, no_rows, folder):
    rows = odd_rows.unionByName(docs.where("doc_id between 20 and 120").select(odd_rows.columns))
    got = language_id.query(spark, folder(documents=rows)).collect()
    assert len(got) == rows.count()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {2, 3, 4, 5} <= und and not {6, 7, 8} & und
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert language_id.query(spark, folder(documents=no_rows)).count() == 0
    unlabelled = odd_rows.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.query(spark, folder(documents=unlabelled)).collect()} == {"und"}
    named = rows.withColumns({"score": F.lit("s"), "lang_pred": F.lit("p")})
    same = language_id.keep_identified(named)
    assert same.columns == named.columns and {(r["score"], r["lang_pred"]) for r in same.collect()} == {("s", "p")}
    clash = rows.withColumns({"score": F.lit("s"), "lang_pred": F.lit("p")})
    kept = language_id.keep_identified(rows)
    assert kept.columns == rows.columns and language_id.predict(clash, language_id.train(rows)).count() == rows.count()


def test_codes_correct_errors():
    for n in (2, 3, 4, 5, 12):
        code = language_id.code_words(n)
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2)
        ones = np.ones(code.shape[1])
        model = language_id.Model(tuple(map(str, range(n))), code, np.zeros((1, 1)), 0 * ones, ones, ones / len(ones))
        rng = np.random.default_rng(0)
        for i in range(n):
            bits = code[i] * 4
            bits[rng.choice(len(bits), (apart - 1) // 2, replace=False)] *= -1
            best, share, lead = language_id.decode(model, bits[None])
            assert best[0] == i and 0 < share[0] <= 1 and lead[0] >= 0


def test_long_texts_in_pieces():
    texts = ["ab  cd é" * 700, "", "x", "Grüße an alle " * 300]
    whole = list(language_id.profiles(texts))
    for piece in (64, 1000, 1 << 20):
        assert all((a == b).all() for a, b in zip(whole, (next(language_id.profiles([t], piece)) for t in texts)))


def plain_slots(text):
    """Slots of one text's n-grams, one place after the other."""
    data = b"    " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()) + b"    "
    for i in range(len(data) - 3):
        if data[i : i + 2] != b"  ":
            for k in (1, 2, 3, 4):
                yield (int.from_bytes(data[i : i + k], "little") * 2654435761 % 2**32 >> 19) + ((k - 1) << 13)


def test_against_plain_classifier(spark, docs):
    """Counts, weights, margins and decoding worked out one by one."""
    rows = [r for r in docs.where("doc_id < 60").collect() if r["text"]]
    names = sorted({r["lang"] for r in rows})
    counts = {n: Counter() for n in names}
    for r in rows:
        counts[r["lang"]].update(plain_slots(r["text"]))
    share = {}
    for n in names:
        for k in range(4):
            total = sum(c for s, c in counts[n].items() if s >> 13 == k) + 0.05 * 8192
            share |= {(n, s): (counts[n][s] + 0.05) / total for s in range(k << 13, (k + 1) << 13)}
    code = language_id.code_words(len(names))
    bits = []
    for b in range(code.shape[1]):
        up, down = [n for i, n in enumerate(names) if code[i, b] > 0], [n for i, n in enumerate(names) if code[i, b] < 0]
        weight = [(math.log(sum(share[n, s] for n in up) / len(up)) - math.log(sum(share[n, s] for n in down) / len(down))) / 4 for s in range(4 << 13)]
        mean = {n: sum(share[n, s] * weight[s] for s in range(4 << 13)) for n in names}
        high, low = min(mean[n] for n in up), max(mean[n] for n in down)
        bits.append((weight, (high + low) / 2, max(high - low, 1e-3)))
    model = language_id.train(docs.where("doc_id < 60"), train_docs=10**6)
    got = {r["doc_id"]: r for r in language_id.predict(docs.where("doc_id < 60").select("doc_id", "text"), model).collect()}
    whole = sum(gap for _, _, gap in bits)
    for r in rows:
        own = Counter(plain_slots(r["text"]))
        n = max(1, sum(own.values()) // 4)
        loss = [0.0] * len(names)
        for b, (weight, shift, gap) in enumerate(bits):
            margin = (sum(c * weight[s] for s, c in own.items()) / n - shift) * 8 / gap
            for i in range(len(names)):
                loss[i] += math.log1p(math.exp(-margin * code[i, b])) * gap / whole
        best = loss.index(min(loss))
        odds = math.exp(-min(loss)) / sum(math.exp(-x) for x in loss)
        if any(c.isalpha() for c in r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == names[best] and math.isclose(got[r["doc_id"]]["score"], odds, rel_tol=1e-3)


def test_more_languages_than_the_bound_are_an_error(spark):
    import pytest

    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    assert len(language_id.train(docs, max_languages=5).languages) == 5
    with pytest.raises(ValueError):
        language_id.train(docs, max_languages=4)
