"""Reading levels: held-out accuracy, size independence and odd inputs."""

import random

import numpy as np
import pytest

from tidemill.llm import language as lg
from tidemill.llm import reading as rd

REFS = "reading_level int, passage string"
DOCS = "doc_id long, text string, lang string"
random.seed(3)
EASY = ["cat", "dog", "run", "sun", "big", "red", "ball", "tree", "home", "play", "good", "look", "see", "fun", "hat"]
MIDDLE = ["travel", "market", "window", "winter", "village", "morning", "question", "station", "weather", "garden", "kitchen", "history"]
HARD = ["epistemic", "jurisdiction", "heterogeneous", "stochastic", "ontological", "hermeneutic", "paradigmatic", "fiduciary", "asymptotic"]
COMMON = ["the", "and", "of", "to", "in", "it", "was", "for", "with", "that", "on", "they"]
GERMAN = ["und", "nicht", "eine", "wir", "gehen", "morgen", "durch", "straße", "schön", "über", "zwischen", "haben", "werden"]


def text(rnd, level, n):
    """Words whose difficulty grows with the level 1 to 5."""
    x = (level - 1) / 4
    weights = {"e": (1 - x) ** 2, "m": 2 * x * (1 - x), "h": x * x}
    of = {"e": EASY, "m": MIDDLE, "h": HARD}
    return " ".join(rnd.choice(COMMON) if rnd.random() < 0.45 else rnd.choice(of[rnd.choices("emh", [weights[k] for k in "emh"])[0]]) for _ in range(n))


def made(n=400, words=200, seed=1):
    rnd = random.Random(seed)
    refs = [(1 + k % 5, text(rnd, 1 + k % 5, 250)) for k in range(60)]
    docs, truth = [], {}
    for d in range(n):
        if d % 8 == 0:
            docs.append((d, "Subject: x\n\n" + " ".join(rnd.choice(GERMAN) for _ in range(words)), "de"))
        else:
            truth[d] = 1 + d % 5
            docs.append((d, "Subject: x\n\n" + text(rnd, truth[d], words), rnd.choice(["en"] * 17 + ["EN ", None, "de"])))
    return refs, docs, truth


def levels(spark, docs, refs, **more):
    rows = rd.reading_levels(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(refs, REFS), **more).collect()
    return {r["doc_id"]: r["reading_level"] for r in rows}


def test_held_out_accuracy(spark):
    refs, docs, truth = made()
    got = levels(spark, docs, refs)
    assert set(got) == set(truth), "English alone, whatever the label says"
    assert np.mean([got[d] == truth[d] for d in truth]) > 0.85 and max(abs(got[d] - truth[d]) for d in truth) <= 1


def test_a_larger_corpus_does_not_move_the_scale(spark):
    refs, docs, truth = made(160)
    once = levels(spark, docs, refs)
    more = [(d + 1000 * k, t, la) for k in range(6) for d, t, la in docs]
    assert {d: v for d, v in levels(spark, more, refs).items() if d < 1000} == once


def test_words_beyond_65536_keep_their_own_difficulty():
    keys = np.unique(rd._keys([f"word{k}" for k in range(200_000)]))
    assert len(keys) == 200_000
    assert rd.places(keys, keys[[5, 199_999]]).tolist() == [5, 199_999] and rd.places(keys, rd._keys(["unheard"])).tolist() == [-1]


def test_vocabulary_is_bounded_by_the_share(spark):
    rows = [(k, rd._keys([f"w{k}", "the", "the"]).tobytes()) for k in range(300)]
    corpus = spark.createDataFrame(rows, "doc_id long, words binary")
    held = rd.vocabulary(corpus, rd._keys(["anchor"]), 0.01)
    assert set(held.tolist()) == set(rd._keys(["the", "anchor"]).tolist())


def test_newton_recovers_difficulties():
    theta, b = np.linspace(-2, 2, 9), np.linspace(-1, 1, 40)
    p = np.exp(theta[:, None] * b[None])
    _, got = rd.fit_words(200_000 * p / p.sum(1, keepdims=True), theta)
    assert np.abs((got - got.mean()) - (b - b.mean())).max() < 1e-3


def test_odd_inputs(spark):
    refs, docs, _ = made(80)
    extra = [(None, docs[1][1], "en"), (5000, None, "en"), (5001, "", "en"), (5002, "Subject: x\n\nonly a few words here", "en"), (docs[1][0], docs[1][1], "en")]
    df = spark.createDataFrame(docs + extra, DOCS).selectExpr("*", "1 AS words", "'n' AS n", "2 AS label")
    got = rd.reading_levels(df, spark.createDataFrame([*refs, (None, "x y z"), (3, None), (3, "")], REFS)).collect()
    ids = [r["doc_id"] for r in got]
    assert not {None, 5000, 5001, 5002} & set(ids) and ids.count(docs[1][0]) == 2
    assert rd.reading_levels(df.limit(0), spark.createDataFrame(refs, REFS)).collect() == []
    with pytest.raises(ValueError):
        rd.reading_levels(df, spark.createDataFrame([], REFS))


def test_without_labels_all_is_english(spark):
    refs, docs, truth = made(80)
    assert set(levels(spark, docs, refs, language=None)) == {d for d, _, _ in docs}
    assert set(levels(spark, [(d, t, None) for d, t, _ in docs], refs)) == {d for d, _, _ in docs}


def test_languages_with_wrong_labels():
    rnd = random.Random(9)
    counts = {}
    for label, words in (("en", COMMON + EASY + MIDDLE), ("de", GERMAN)):
        counts[label] = sum(np.bincount(lg.trigrams(" ".join(rnd.choice(words) for _ in range(60))), minlength=lg.BUCKETS) for _ in range(20))
    model = lg.Languages(counts)
    assert model.of("the dog was in the garden") == "en" and model.of("wir gehen morgen durch eine straße") == "de"
    assert model.of("12 34 !") is None and lg.Languages({}).of("the") is None
