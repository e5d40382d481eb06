"""Containers: everything placed once, nothing overflows, little space is lost."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemill.llm import packing as pk

PATH = os.path.join(pk.TOKENIZERS, pk.VOCABULARY)


def pack(spark, lengths, capacity=2048):
    df = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length int")
    return pk.pack(df, capacity).collect()


def check(placed, lengths, capacity):
    assert sorted(r["doc_id"] for r in placed) == list(range(len(lengths)))
    full = {}
    for r in placed:
        assert r["length"] == lengths[r["doc_id"]]
        full[r["container"]] = full.get(r["container"], 0) + r["length"]
    assert max(full.values()) <= capacity
    return sum(lengths) / (len(full) * capacity)


@pytest.mark.parametrize("seed, draw, least", [(1, lambda r: min(2048, int(r.lognormvariate(5.5, 0.9)) + 1), 0.99), (2, lambda r: r.randrange(1, 2049), 0.97), (3, lambda r: 700, 0.6), (4, lambda r: r.choice([1025, 1024]), 0.66)])
def test_everything_is_placed_once(spark, seed, draw, least):
    rnd = random.Random(seed)
    lengths = [draw(rnd) for _ in range(4000)]
    assert check(pack(spark, lengths), lengths, 2048) >= least


def test_a_length_that_a_third_have(spark):
    rnd = random.Random(5)
    lengths = [1000] * 2000 + [rnd.randrange(1, 1500) for _ in range(4000)]
    assert check(pack(spark, lengths), lengths, 2048) > 0.97


def test_zero_full_and_few(spark):
    assert pack(spark, []) == []
    lengths = [0, 0, 2048, 1, 2047, 2048]
    assert check(pack(spark, lengths), lengths, 2048) == 1.0
    with pytest.raises(ValueError):
        pack(spark, [2049])


def test_pieces_of_long_texts(spark):
    counts = spark.createDataFrame([(1, 0), (2, 2048), (3, 2049), (4, 5000), (4, 10)], "doc_id long, n_tokens long")
    got = sorted((r["doc_id"], r["piece"], r["length"]) for r in pk.pieces(counts, 2048).collect())
    assert got == [(1, 0, 0), (2, 0, 2048), (3, 0, 2048), (3, 1, 1), (4, 0, 10), (4, 0, 2048), (4, 1, 2048), (4, 2, 904)]


@pytest.mark.parametrize("size", [1, 2, 7, 50, 1000])
def test_stretches_change_no_count(size):
    rnd = random.Random(size)
    words = ["don't", "it's", "naïve", "  ", "\n\n", "\t", "x1y22z", "!!'s", "שלום", "日本語", "a" * 40, "----", "'ll", "1234567", "\r\n", "é́", "🙂🙂"]
    for _ in range(30):
        text = "".join(rnd.choice(words) + rnd.choice(["", " ", "\n"]) for _ in range(60))
        parts = list(pk._stretches(text, size))
        assert "".join(parts) == text
        enc = pk._encoding(PATH)
        assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))


def test_a_text_without_a_place_to_cut_stays_whole():
    assert list(pk._stretches("a" * 5000, 100)) == ["a" * 5000]
    assert list(pk._stretches("", 100)) == [""]


def test_texts_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 6), (3, "", 7), (None, "x", 8), (1, "hello world", 5), (4, "word " * 9000, 1)], "doc_id long, text string, length int").withColumns({"salt": F.lit(1), "piece": F.lit("p")})
    got = pk.pack_texts(df, 2048, PATH).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r["length"])
    assert of[2] == [0] and of[3] == [0] and of[1] == [2, 2] and None not in of
    assert sum(of[4]) == pk.count_tokens("word " * 9000, PATH) and sorted(of[4])[1:] == [2048] * (len(of[4]) - 1)
    full = {}
    for r in got:
        full[r["container"]] = full.get(r["container"], 0) + r["length"]
    assert max(full.values()) <= 2048


def test_least_squares_is_never_negative_and_exact_where_it_can_be():
    import numpy as np

    a = np.array([[2.0, 0, 1], [0, 1, 1]])
    x = pk.nnls(a, np.array([5.0, 3.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [5, 3], atol=1e-6)
    assert (pk.nnls(a, np.array([-1.0, 2.0])) >= 0).all()
