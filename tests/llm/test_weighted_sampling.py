import hashlib
import re
from collections import Counter

from cairnfield.llm import weighted_sampling


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))) for t in (a, b))
    return (a & b).total() / max(1, (a | b).total())


def test_query_against_brute_force(spark, sf, docs):
    got = {r["doc_id"]: r for r in weighted_sampling.query(spark, sf).collect()}
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids, errors = sorted(rows, reverse=True), []
    assert set(got) == set(ids)
    by_text = {}
    for i, d in enumerate(ids):
        text, after = rows[d], rows[ids[(i + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"] and re.fullmatch("[0-9a-f]{256}", r["fingerprint"])
        errors += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, after)]
    assert len(set(by_text.values())) >= 0.95 * len({jaccard_key(t) for t in by_text})  # texts a word apart may agree on all samples
    assert abs(sum(errors) / len(errors)) < 0.02 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.08


def jaccard_key(t):
    return tuple(sorted(Counter(re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))).items()))


def test_odd_rows(spark, odd_rows, no_rows, folder):
    rows = weighted_sampling.query(spark, folder(documents=odd_rows)).collect()
    assert len(rows) == odd_rows.count()
    same = [r for r in rows if r["doc_id"] == 1]
    assert len(same) == 3 and len({r["fingerprint"] for r in same}) == 2
    empty = [r for r in rows if r["doc_id"] in (2, 3, 4)]
    assert {r["fingerprint"] for r in empty} == {"f" * 256} and all(0 <= r["near_edited"] <= 1 for r in rows)
    assert weighted_sampling.query(spark, folder(documents=no_rows)).count() == 0
    one = weighted_sampling.compare_with_next(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_collision_rate_with_weights(spark):
    a, b = {"x": 3, "y": 1, "z": 6}, {"x": 1, "y": 4, "w": 2}
    rows = [(0, " ".join(w for w, n in a.items() for _ in range(n))), (1, " ".join(w for w, n in b.items() for _ in range(n)))]
    sigs = weighted_sampling.fingerprints(spark.createDataFrame(rows, "id int, text string"), ["id"], k=2048).orderBy("id").collect()
    rate = sum(x == y for x, y in zip(sigs[0]["sig"], sigs[1]["sig"])) / 2048
    assert abs(rate - 2 / 15) < 0.03


def test_no_python_in_plan(spark, docs):
    plan = weighted_sampling.fingerprints(docs.select("doc_id", "text"), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_names_ties_and_long_texts(spark, odd_rows):
    named = odd_rows.selectExpr("*", "1 as ka", "2 as kb", "3 as k", "4 as fingerprint")
    a = sorted(map(repr, map(tuple, weighted_sampling.compare_with_next(odd_rows).collect())))
    assert a == sorted(map(repr, map(tuple, weighted_sampling.compare_with_next(named).collect()))) and len(a) == odd_rows.count()
