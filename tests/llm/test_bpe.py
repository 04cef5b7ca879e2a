"""The automaton against the library: random words, odd texts, whole tables; and against plain merging."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairnfield.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def automaton():
    return bpe.compile_automaton(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def merged(word, merges):
    """Byte-pair merging, one merge after the other, from the left."""
    out = list(word)
    for a, b in merges:
        i = 0
        while i < len(out) - 1:
            if out[i] == a and out[i + 1] == b:
                out[i : i + 2] = [a + b]
            i += 1
    return out


def test_random_merges_against_plain_merging():
    rng = random.Random(3)
    for _ in range(150):
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(0, 14)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        vocab = {t: i for i, t in enumerate(tokens)}
        made = bpe.Automaton(vocab, merges, end="")
        for _ in range(60):
            word = "".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 16)))
            want = [vocab[t] for t in merged(word, merges)]
            assert list(made.encode(word)) == want and made.accepts(want)
            other = [vocab[c] for c in word]
            assert made.accepts(other) == (other == want)


def test_encoder_against_library(automaton, library):
    encoder, rng = bpe.Encoder(PATH, automaton, memory=50, piece=20), random.Random(1)
    texts = ["", " ", "x<|endoftext|>y<|startoftext|><|endoftext|> <|endof", "a" * 5000, "É日本 'll don't <|endoftext|> ½", "ΣΑΣ İ é ́", "word " * 3000]
    texts += ["a" + chr(c) + "b " + chr(c) + "!" for c in [*range(0x250), *range(0x250, 0x11000, 97)] if not 0xD800 <= c < 0xE000]
    for _ in range(4000):
        letters = rng.choice(["a", "ab", "the in", "abcdefghijklmnopqrstuvwxyz", "étàüß ñ 's't\x1c\x85\xa0", "aa!!.?", "0123456789 ", "ΣσςİIıſK日本é́ <|endoftext|>"])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode(text).tolist()
        assert got == want, text[:80]
        assert " ".join(automaton.labels[i] for i in got) == library.decode(want, skip_special_tokens=False)


def test_words_are_accepted_in_one_way(automaton, library):
    for word in ("the", "information", "aaaaaaaaaa"):
        ids = library.encode(word, add_special_tokens=False).ids
        assert automaton.accepts(ids)
        letters = [automaton.inner[c] for c in word[:-1]] + [automaton.last[word[-1]]]
        assert not automaton.accepts(letters)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))


def test_query_against_library(spark, sf, library, odd_rows, no_rows, folder):
    for path in (sf, folder(documents=odd_rows)):
        rows = bpe.query(spark, path).collect()
        want = sorted(((r["doc_id"], *expected(library, r["text"])) for r in spark.read.parquet(f"{path}/documents.parquet").collect()), key=repr)
        assert sorted(map(tuple, rows), key=repr) == want
    assert bpe.query(spark, folder(documents=no_rows)).collect() == []


def test_round_trip_carries_columns(spark, automaton, odd_rows):
    from pyspark.sql import functions as F

    shared, labels = spark.sparkContext.broadcast(automaton), spark.sparkContext.broadcast(automaton.labels)
    docs = odd_rows.withColumn("a b", F.lit(1)).withColumn("labels", F.lit("x"))
    rows = bpe.decode(bpe.encode(docs, PATH, shared), labels)
    assert rows.columns == ["doc_id", "lang", "source", "n_chars", "a b", "labels", "ids", "decoded"]
    assert rows.count() == odd_rows.count()
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("IDS", F.lit(1)), PATH, shared)
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(nulls, labels).collect()] == [None, ""]
