import hashlib

from cairnfield.llm import decontaminate
from cairnfield.llm.common import alnum_words_py


def within(w, k, wanted, slop):
    """Do the wanted words stand in order from place k, with at most slop others between them?"""
    if w[k] != wanted[0]:
        return False
    rest = iter(w[k : k + len(wanted) + slop])
    return all(any(x == y for y in rest) for x in wanted)


def brute(docs, items, n=10, slop=3):
    wins = {}
    for i, t in items:
        w = alnum_words_py(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, held, near = alnum_words_py(t), set(), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                found = wins.get(tuple(w[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    held |= found
        first = {}
        for x in wins:
            first.setdefault(x[0], []).append(x)
        for k in range(len(w)):
            for x in first.get(w[k], ()):
                if not wins[x] <= near and within(w, k, x, slop):
                    near |= wins[x]
        out.append((d, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=repr)


def run(spark, folder, docs, items):
    path = folder(documents=docs, benchmark=items)
    return sorted((tuple(r) for r in decontaminate.query(spark, path).collect()), key=repr)


def test_against_brute_force(spark, sf, docs, folder):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert run(spark, folder, docs, items) == want and any(r[5] for r in want)


def test_odd_rows(spark, odd_rows, no_rows, folder):
    items = spark.createDataFrame([(1, "The same words"), (2, None), (3, "..."), (10, "word " * 12), (11, "WORD word word word word word word word word word"), (4, "É日本"), (5, "nowhere to be found"), (6, "again and AGAIN"), (6, "again and AGAIN")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_rows.collect()]
    want = brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert run(spark, folder, odd_rows, items) == want and sum(r[5] for r in want) >= 3
    assert run(spark, folder, no_rows, items) == []
    assert not any(r[5] for r in run(spark, folder, odd_rows, items.limit(0)))
    clean = decontaminate.keep_clean(odd_rows, items).collect()
    dirty = {r[0] for r in want if r[5]}
    assert len(clean) == sum(not r[5] for r in want) and not any(r["doc_id"] in dirty - {1} for r in clean)


def test_proximity(spark, folder):
    texts = ["alpha x beta", "alpha x y z beta", "alpha x y z w beta", "beta alpha", "alpha beta", "alpha alpha x alpha beta " * 50, "one", "two one", "a b c d e f g h i", "a q b c d e q f g h q i", "a q b c d e q f g h q i", "a b c d q q q q e f g h i", "i h g f e d c b a", "a q a b c d e f g h q i", "x " * 3000 + "a b c d e f g h z i"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(4, "alpha beta")], "doc_id long, text string")
    rows = [(1, "alpha beta"), (2, "one"), (3, "a b c d e f g h i"), (4, "a b c d e f g h i j k"), (5, "x x x a b")]
    want = brute([tuple(r) for r in docs.collect()], rows)
    assert run(spark, folder, docs, spark.createDataFrame(rows, "item_id long, text string")) == want
    assert {r[0]: r[6] for r in want if r[0] < 4} == {0: 1, 1: 1, 2: 0, 3: 0} and {r[0]: r[6] for r in want}[9] == 1


def test_clashing_names(spark, odd_rows):
    items = spark.createDataFrame([(1, "The same words")], "item_id long, text string")
    named = odd_rows.selectExpr("*", "1 as ka", "2 as kb", "3 as found", "4 as n_words")
    clean = decontaminate.keep_clean(named, items)
    assert clean.columns == named.columns and clean.count() == odd_rows.count() - 2


def test_no_python_in_plan(spark, docs, sf):
    plan = decontaminate.matches(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
