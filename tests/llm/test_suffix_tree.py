import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairnfield.llm import suffix_tree


def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]


def brute(rows, train, depth, min_count, min_divergence):
    words = [tokens(t) for t in rows]
    count = [Counter() for _ in range(depth + 1)]
    for ws, use in zip(words, train):
        if use:
            for d in range(depth + 1):
                for i in range(d, len(ws)):
                    count[d][tuple(ws[i - d : i + 1])] += 1
    total, distinct = sum(count[0].values()), len(count[0])
    after = [defaultdict(dict) for _ in range(depth + 1)]
    for d in range(1, depth + 1):
        for gram, c in count[d].items():
            after[d][gram[:-1]][gram[-1]] = c
    kept = {}
    for d in range(1, depth + 1):
        for s, nexts in after[d].items():
            c = count[d - 1][s]
            if c >= min_count:
                llr = sum(k * (math.log(k / c) - math.log(count[d - 1][(*s[1:], w)] / (count[d - 2][s[1:]] if d > 1 else total))) for w, k in nexts.items())
                if (llr - (len(nexts) - 1) / 2) / c >= min_divergence:
                    kept[s] = (c, len(nexts), nexts)

    def p(context, w):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return (count[0][(w,)] + 1) / (total + distinct + 1)
        c, t, nexts = kept[context]
        return (nexts.get(w, 0) + t * p(context[1:], w)) / (c + t)

    out = []
    for ws in words:
        base = sum(math.log10((count[0][(w,)] + 1) / (total + distinct + 1)) for w in ws)
        out.append((len(ws), sum((w,) in count[0] for w in ws), total, base, sum(math.log10(p(tuple(ws[max(0, i - depth) : i]), w)) for i, w in enumerate(ws))))
    return out, kept


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_against_brute_force(spark, docs, depth):
    part = docs.where("doc_id < 120").select("doc_id", "text").orderBy("doc_id")
    part = part.unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1002, "A a\x0bB \u00c9\u00a0x"), (1002, "A a\x0bB \u00c9\u00a0x")], "doc_id long, text string"))
    rows = part.collect()
    train = [r["doc_id"] % 5 != 0 for r in rows]
    want, kept = brute([r["text"] for r in rows], train, depth, 8, 0.05)
    assert len(kept) > 20 and (depth == 1 or any(len(s) == 2 for s in kept))
    got = suffix_tree.score(part, F.col("doc_id") % 5 != 0, depth=depth, min_count=8).drop("trained").collect()
    a, b = sorted((r["doc_id"], *w) for r, w in zip(rows, want)), sorted(tuple(r) for r in got)
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for p, q in zip(a, b) for x, y in zip(p[4:], q[4:]))


def test_query_odd_rows(spark, docs, odd_rows, no_rows, folder):
    got = suffix_tree.query(spark, folder(documents=odd_rows)).collect()
    assert len(got) == odd_rows.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2) and math.isfinite(r["score"])
    assert suffix_tree.query(spark, folder(documents=no_rows)).count() == 0
    never = suffix_tree.score(odd_rows, F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in never)


def test_beats_unigrams_on_held_out(spark, sf):
    r = suffix_tree.query(spark, sf).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_least_count_does_not_grow_with_the_corpus(spark):
    filler = spark.range(800).select("id", F.expr("repeat('filler ', 10000)").alias("text"))
    rare = spark.range(1000, 1017).select("id", F.lit("alpha beta").alias("text"))
    r = suffix_tree.score(filler.unionByName(rare), F.lit(True), key="id").where("id = 1000").first()
    n = 800 * 10_001 + 17 * 3
    assert r["train_tokens"] == n
    p = [18 / (n + 5), (17 + 18 / (n + 5)) / 18, (17 + 818 / (n + 5)) / 18]
    assert math.isclose(r["score"], sum(map(math.log10, p)), rel_tol=1e-9)


def test_clashing_names_and_long_texts(spark, odd_rows):
    named = odd_rows.selectExpr("*", "1 as block", "2 as keys", "3 as score", "4 as trained")
    a = sorted(map(repr, map(tuple, suffix_tree.score(odd_rows, F.lit(True)).collect())))
    assert a == sorted(map(repr, map(tuple, suffix_tree.score(named, F.lit(True)).collect()))) and len(a) == odd_rows.count()


def test_rounds_and_rows(spark, docs, monkeypatch):
    """Contexts of up to d words take d + 2 rounds, and a context's answer is one whole number."""
    tables, real = [], suffix_tree._bucketed
    monkeypatch.setattr(suffix_tree, "_bucketed", lambda df, parts: tables.append(real(df, parts)) or tables[-1])
    suffix_tree.score(docs.where("doc_id < 60"), F.lit(True), depth=3, min_count=8)
    assert len(tables) == 1 + 3 + 2
    answers = [r for t in tables[1:] for r in t.select(F.explode("answers").alias("a")).select("a.*").collect()]
    assert {r["level"] for r in answers} == set(range(7))
    sums = [suffix_tree._unpack(bytes(r["sums"]), "i8") for r in answers if r["level"] == 2]
    assert sum(map(len, sums)) > 10 and any((s > 0).any() for s in sums)
