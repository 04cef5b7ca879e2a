import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from cairnfield.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def test_encoder_gives_the_tokenizers_ids(encoder, docs):
    texts = [r["text"] for r in docs.collect()] + ["", "  a  b\n\n c", "don't they'll x 's", "a b \t\tc  ", "日本語 text", "éx 12a3 ½ ²", " \n", "x'", "'", " '", "<|endoftext|> hi", "it\x1cis \x85 x", "\r\n\r\n x", "a\u00a0b", "''s 's'"]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def brute_cuts(place, penalty, window, each):
    cost = [0.0] + [float("inf")] * (len(place) - 1)
    for j in range(1, len(place)):
        for i in range(j):
            n = place[j] - place[i]
            if n <= window:
                pad = (each if n < window else 0) if n & (n - 1) == 0 else window - n
                cost[j] = min(cost[j], cost[i] + min(pad, window - n) + penalty[j])
    return cost[-1]


def test_dynamic_program_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        window = rng.choice([8, 16, 32])
        steps = [rng.randint(1, window) for _ in range(rng.randint(1, 25))]
        place = np.cumsum([0, *steps])
        penalty = np.array([rng.choice([0.0, 2.0, 5.0]) for _ in place])
        each = rng.choice([0.0, 1.0])
        cuts = packing.best_cuts(place, penalty, window, each)
        got = 0.0
        for a, b in zip(cuts, cuts[1:]):
            n = place[b] - place[a]
            assert n <= window
            got += min((each if n < window else 0) if n & (n - 1) == 0 else window - n, window - n) + penalty[b]
        assert cuts[0] == 0 and cuts[-1] == len(place) - 1
        assert abs(got - brute_cuts(place.tolist(), penalty.tolist(), window, each)) < 1e-9


def check(rows, got, encoder, window=1024):
    """Every id of every row lies in one piece, and sequences have no gaps."""
    ids = {}
    for r in rows:
        ids.setdefault(r["doc_id"], []).append(encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    pieces, seqs = {}, {}
    for p in got:
        pieces.setdefault(p["doc_id"], []).append(p)
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert set(pieces) == set(ids)
    for d, own in ids.items():
        total = sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces[d])
        if len(own) == 1:
            at = 0
            for start, length, crc, n in total:
                assert start == at and n == len(own[0]) and crc == zlib.crc32(np.array(own[0][start : start + length], "<u4").tobytes())
                at += length
            assert at == len(own[0])
        else:
            assert sum(t[1] for t in total) == sum(map(len, own))
    return padding / max(1, sum(p["length"] for p in got))


def test_round_trip(spark, sf, docs, odd_rows, no_rows, folder, encoder):
    assert check(docs.collect(), packing.query(spark, sf).collect(), encoder) < 0.05
    check(odd_rows.collect(), packing.query(spark, folder(documents=odd_rows)).collect(), encoder)
    assert packing.query(spark, folder(documents=no_rows)).count() == 0
    small = packing.pack(docs.where("doc_id < 40"), PATH, stretch=3000)
    check(docs.where("doc_id < 40").collect(), small.collect(), encoder)


def test_clashing_and_key_names(spark, odd_rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    named = odd_rows.selectExpr("*", "1 as length", "2 as sequence_id", "3 as start")
    plain = [tuple(r) for r in packing.pack(odd_rows.coalesce(1), path).collect()]
    assert sorted(map(repr, plain)) == sorted(repr(tuple(r)) for r in packing.pack(named.coalesce(1), path).collect())
    with pytest.raises(ValueError):
        packing.pack(named, path, key="length")


def test_cuts_cost_as_little_as_a_plain_table():
    """Each cut is tried from every earlier one within a window: padding, or at a power of two the cost of a short sequence."""
    import numpy as np

    from cairnfield.llm.packing import best_cuts

    rng = np.random.default_rng(5)
    step = lambda size: min(16 - size, 4.0 if size < 16 and size & (size - 1) == 0 else 16)
    for _ in range(60):
        position = np.concatenate(([0], np.cumsum(rng.integers(1, 7, 40))))
        penalty = rng.integers(0, 3, 41).astype(float)
        cost = [0.0] + [np.inf] * 40
        for j in range(1, 41):
            cost[j] = penalty[j] + min(cost[i] + step(position[j] - position[i]) for i in range(j) if position[j] - position[i] <= 16)
        cuts = best_cuts(position, penalty, 16, 4.0)
        assert cuts[0] == 0 and cuts[-1] == 40
        assert sum(step(position[b] - position[a]) + penalty[b] for a, b in zip(cuts, cuts[1:])) == cost[-1]
