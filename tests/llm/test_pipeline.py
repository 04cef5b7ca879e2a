"""The pipeline against plain Python on small tables."""

import corpus_pipeline
import public_tokenizers
import regex
from test_decontaminate import brute as contaminated
from test_near_dups import brute as classes
from test_near_dups import made
from test_packing import check

from cairnfield.llm import packing, queries

import __spark_entry__


def test_registered():
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_against_brute_force(spark, folder):
    rows = made(5) + [(500, None), (501, "12 ++"), (502, "a clean text that stays"), (503, "with the secret benchmark passage of more than ten words right inside it")]
    items = [(1, "the secret benchmark passage of more than ten words right inside")]
    docs = spark.createDataFrame([(d, t, "en" if d % 2 else "de", "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = folder(documents=docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = corpus_pipeline.run(spark, path).collect()
    lettered = [(d, t) for d, t in rows if t and regex.search(r"\p{L}", t)]
    kept = set(classes(lettered).values())
    left = [(d, t) for d, t in lettered if d in kept]
    dirty = {r[0] for r in contaminated(left, items) if r[5]}
    assert dirty == {503}
    check([{"doc_id": d, "text": t} for d, t in left if d not in dirty], got, packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")))


def test_stage_columns(spark, sf, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()


def test_empty(spark, folder, no_rows):
    path = folder(documents=no_rows, benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_stages_on_odd_rows(spark, folder, odd_rows):
    """Nulls, repeated rows, equal ids, a very long text, and columns that are named like the stages' own."""
    names = ["lang_pred", "score", "ambiguous", "ka", "kb", "root", "body", "found", "n_words", "length", "licenses"]
    docs = odd_rows.selectExpr("*", *(f"'{n}' as {n}" for n in names))
    path = folder(benchmark=spark.createDataFrame([(1, "another text under the same id"), (2, None)], "item_id long, text string"))
    for (name, stage), left in zip(corpus_pipeline.STAGES[:-1], (7, 6, 5), strict=True):
        docs = stage(spark, docs, path)
        assert docs.columns == [*odd_rows.columns, *names] and all(r[n] == n for r in docs.collect() for n in names), name
        assert docs.count() == left, name
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()} == {r["doc_id"] for r in docs.collect()}
