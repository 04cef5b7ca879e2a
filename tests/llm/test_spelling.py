"""Spelling variants against brute force over deletions, and against all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb

from cairnfield.llm import spelling
from cairnfield.llm.common import LOWER, UPPER

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def near_by_deletion(words):
    """Near words by shared deletions, verified letter by letter."""
    owners = defaultdict(set)
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            owners[v].add(w)
    near = defaultdict(set)
    for own in owners.values():
        for a in own:
            for b in own:
                if a < b and one_edit(a, b):
                    near[a].add(b)
                    near[b].add(a)
    return near


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and len(b) - len(a) < 2 and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near, form = near_by_deletion(n), {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, c, len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w, c in n.items())


def result(df):
    return sorted(map(tuple, df.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def test_query_against_plain(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = result(spelling.query(spark, sf))
    assert got == plain(rows) and sum(r[2] for r in got) > 100
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = "word, n, n_near, form, form_n, root"
    assert sorted(con.execute(f"select {columns} from ({spelling.ORACLE})").fetchall()) == got


def test_edits_of_repeating_letters(spark):
    """All pairs of words in which bigrams repeat, the case that needs the third bigram's repeats."""
    rng = random.Random(8)
    words = {"".join(rng.choice(rng.choice(["ab", "aab", "abc", "aàÿz"])) for _ in range(rng.randint(5, 8))) for _ in range(900)}
    for w in list(words)[:400]:
        i = rng.randrange(len(w))
        words |= {w[:i] + rng.choice(LETTERS) + w[i:], w[:i] + rng.choice(LETTERS) + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 5)
    found = spelling.near_pairs(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long").repartition(4)).collect()
    got = [tuple(sorted((r["a"], r["b"]))) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def test_chains_lead_to_the_last_form(spark):
    chain = ["planet", "planett", "plannett", "plannettt", "pplannettt"]
    text = " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2 ** (len(chain) - i)))
    got = {r["word"]: r["root"] for r in spelling.group(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(chain, "planet")


def test_odd_rows(spark, odd_rows, no_rows):
    from pyspark.sql import functions as F

    more = spark.createDataFrame([(9, ("z" * 3000 + " ") * 3 + "Ärger ärger ärger ärger Àrger ×÷×÷× ×÷×÷× ×÷×÷×", None, None, None)], odd_rows.schema)
    docs = odd_rows.union(more).withColumn("word", F.lit("q")).withColumn("n", F.lit(1)).withColumn("h", F.lit(2))
    assert result(spelling.group(docs.select("doc_id", "text", "word", "n", "h"), noise=97)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert spelling.group(no_rows).collect() == []
