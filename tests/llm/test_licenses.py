import random

from cairnfield.llm import licenses
from cairnfield.llm.common import alnum_words_py


def brute(text, templates, threshold):
    lines = (text or "").split("\n")
    out = {}
    for name, t in templates.items():
        grams = licenses._bigrams(alnum_words_py(t))
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                d = licenses.dice(licenses._bigrams([w for x in lines[i : j + 1] for w in alnum_words_py(x)]), grams)
                if d >= threshold and d > out.get(name, 0):
                    out[name] = d
    return {k: round(v, 9) for k, v in out.items()}


def test_against_brute_force(spark, odd_rows):
    rng, texts = random.Random(4), []
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            t = rng.choice(list(licenses.TEMPLATES.values())[:1] + list(licenses.TEMPLATES.values())[2:])
            words = t.split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = "other"
            cut = rng.randrange(1, len(words))
            lines.append(rng.choice([t, " ".join(words), "free text of no licence", " ".join(words[:cut]) + "\n" + " ".join(words[cut:]), t.upper()]))
        texts.append("\n".join(lines))
    texts += [None, "", "MIT", "a\n\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.8, 0.9):
        got = {r["doc_id"]: {x["license"]: round(x["dice"], 9) for x in r["licenses"]} for r in licenses.scan(docs, threshold=threshold).collect()}
        assert got == {i: brute(t, licenses.TEMPLATES, threshold) for i, t in enumerate(texts)}
    assert licenses.scan(odd_rows.withColumnRenamed("lang", "licenses")).count() == odd_rows.count()


def test_query(spark, sf, docs, no_rows, folder):
    got = {r["doc_id"]: r["licenses"] for r in licenses.query(spark, sf).collect()}
    for r in docs.collect():
        for name, t in licenses.TEMPLATES.items():
            if t in r["text"].split("\n"):
                assert name in got[r["doc_id"]].split(",")
    assert licenses.query(spark, folder(documents=no_rows)).count() == 0


def test_words_against_brute_force(spark):
    rng, texts = random.Random(5), []
    templates = {k: t for k, t in licenses.TEMPLATES.items() if len(t) < 100} | {"twice": "a b a b c a b", "text": "the terms of the use of the work and of the terms"}
    grams = {k: licenses._bigrams(alnum_words_py(t)) for k, t in templates.items()}
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            t = rng.choice(list(templates.values())).split()
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(["other", "the", "a"])
            words += ["a", "b", "of", "the"][: rng.randrange(5)] + t
        texts.append("".join(w + rng.choice([" ", " ", "\n"]) for w in words))
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "MIT", "a\n\nb"])), "doc_id long, text string")
    for threshold in (0.7, 0.9):
        got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs, templates=templates, threshold=threshold, windows="words").collect()}
        assert sum(map(len, got.values())) > 40
        for i, text in enumerate(texts):
            words = [(w, n) for n, line in enumerate(text.split("\n")) for w in alnum_words_py(line)]
            want = {}
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + 30)):
                    window = licenses._bigrams([w for w, _ in words[a : b + 1]])
                    for k, g in grams.items():
                        d = licenses.dice(window, g)
                        if d >= threshold and d > want.get(k, (0,))[0]:
                            want[k] = (d, words[a][1], words[b][1])
            assert {x["license"]: (x["dice"], x["first_line"], x["last_line"]) for x in got[i]} == want


def test_query_notices_inside_lines_and_full_texts(spark, folder):
    full = licenses.full_texts()
    texts = ["Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0.", "some words before\nand on this line Released under\nthe MIT License. and more after it", "nothing of that kind"]
    texts += ["words before " + " ".join(t.split()) + " words after" for t in full.values()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"].split(",") for r in licenses.query(spark, folder(documents=docs)).collect()}
    assert got[0] == ["Apache-2.0"] and got[1] == ["MIT"] and got[2] == [""]
    for i, name in enumerate(full, 3):
        assert name in got[i]


def test_other_columns_stay(spark, odd_rows):
    named = odd_rows.selectExpr("*", "1 as license", "2 as dice", "'own' as licenses")
    out = licenses.scan(named, windows="words")
    assert set(out.columns) == set(named.columns) and out.count() == odd_rows.count() and all(r["licenses"] == [] for r in out.collect())


def test_most_specific_licence_wins(spark, folder):
    full = licenses.full_texts()
    docs = spark.createDataFrame([(0, "see " + full["AGPL-3.0-header"]), (1, licenses.TEMPLATES["GPL-3.0-header"]), (2, full["BSD-3-Clause-text"]), (3, full["BSD-2-Clause-text"]), (4, full["ISC-text"].replace("THE AUTHOR", "ACME")), (5, full["Zlib-text"]), (6, full["Unlicense-text"])], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"].split(",") for r in licenses.query(spark, folder(documents=docs)).collect()}
    assert got[0] == ["AGPL-3.0-header"] and "GPL-3.0-header" in got[1] and "AGPL-3.0-header" not in got[1]
    assert got[2][0].startswith("BSD-3-Clause") and "BSD-2-Clause-text" not in got[2] and "BSD-3-Clause-text" not in got[3] and "BSD-2-Clause-text" in got[3]
    assert got[4] == ["ISC-text"] and got[5] == ["Zlib-text"] and got[6] == ["Unlicense-text"]
    assert licenses.most_specific([("a", 0.95, 0, 100), ("b", 1.0, 2, 100), ("c", 1.0, 40, 60)]) == [("b", 1.0, 2, 100), ("c", 1.0, 40, 60)]
