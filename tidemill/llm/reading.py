"""Reading level of what the senders of e-mails wrote, on the scale of graded reference passages.

A Rasch-style model links a text's level theta and a word's difficulty b by the chance that the next word is w:
p(w | theta) is proportional to exp(mu_w + theta * b_w). All words share one discrimination; a text's level is the
theta at which the expected word difficulty equals the mean difficulty of its words. The references, whose levels are
given, fix the scale; the fit alternates between the levels of all texts (one pass over the corpus with the word
parameters at every task) and the word parameters (from word counts by level, summed over the corpus), until the
parameters settle.

The vocabulary is exact: every word of the references, and every word that makes up MIN_SHARE of the corpus or more,
which are at most 1 / MIN_SHARE words whatever the corpus. A rarer word says nothing about a text's level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import language as lg
from tidemill.llm import mail
from tidemill.session import cut

#: Least share of the corpus' words that a word of the vocabulary has.
MIN_SHARE = 2e-6
#: Centres of the level classes in which corpus words are counted.
BINS = np.arange(-4, 4.25, 0.5)
GRID = np.linspace(-6, 6, 601)
#: The fit has settled when a smaller share of the corpus' words than this comes to lie in another level class; most
#: rounds it may take.
SETTLED, ROUNDS = 0.01, 40
#: A reference word counts as so many corpus words, and all corpus words together as so many times the references, at any size.
ANCHOR, CORPUS_WEIGHT = 3.0, 10.0
MIN_WORDS = 40
ENGLISH = "en"
#: Reference passages are collected and held at every task; a graded set beyond this is refused.
MAX_REFERENCES = 100_000
#: Words whose parameters are worked on together.
CHUNK = 8192

_ALNUM = re.compile(r"[^\W_]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


@lru_cache(maxsize=1 << 17)
def key_of(word: str) -> int:
    """64 bits that stand for the word."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def own_text(text: str | None) -> str:
    """What the sender wrote themselves."""
    return mail.own_text(mail.body_text(mail.parts(text)))


def own_tokens(text: str | None, languages: lg.Languages, min_words: int = MIN_WORDS) -> list[str] | None:
    """Tokens of what the sender wrote, if that is at least ``min_words`` words of English."""
    own = own_text(text)
    if sum(w.isalnum() or _ALNUM.search(w) is not None for w in own.split()) < min_words or languages.of(own) != ENGLISH:
        return None
    return tokens(own) or None


def _keys(found: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(key_of, found), np.uint64, len(found))


def own_words(documents: DataFrame, languages: lg.Languages, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, words): the keys of the sender's words, for the documents that ``own_tokens`` admits."""
    shared = documents.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (found := own_tokens(t, shared.value, min_words)) is not None:
                    ids.append(i)
                    out.append(_keys(found).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "words"])

    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id bigint, words binary")


# ---- the vocabulary ----------------------------------------------------------------------------------------------------


def _joined(words: Sequence[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all words of a batch, number of words of each text)."""
    return np.frombuffer(b"".join(words), kind), np.array([len(w) // np.dtype(kind).itemsize for w in words], np.int64)


def vocabulary(corpus: DataFrame, references: np.ndarray, min_share: float = MIN_SHARE) -> np.ndarray:
    """Sorted keys of the words that have a difficulty; at most 1 / ``min_share`` of them come from the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = np.unique(_joined(b.column(0).to_pylist(), np.uint64)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    counts = cut(corpus.select("words").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    held = counts.where(F.col("n") >= min_share * total).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    return np.union1d(held, references)


def places(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary, -1 for words that it lacks."""
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    return np.where(keys[at] == words, at, -1).astype(np.int32)


def numbered(corpus: DataFrame, keys: np.ndarray) -> DataFrame:
    """``own_words`` with the words' numbers in the vocabulary in place of their keys."""
    shared = corpus.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, size = _joined(b.column(1).to_pylist(), np.uint64)
            texts = np.split(places(shared.value, words), np.cumsum(size)[:-1]) if len(size) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.tobytes() for t in texts], pa.binary())], names=["doc_id", "words"])

    return corpus.mapInArrow(run, "doc_id bigint, words binary")


# ---- the model ---------------------------------------------------------------------------------------------------------


def _chunks(n: int) -> Iterator[slice]:
    return (slice(a, min(a + CHUNK, n)) for a in range(0, n, CHUNK))


class Model:
    """Word parameters, and the mean difficulty at each level of GRID; a word without counts says nothing (NaN)."""

    def __init__(self, mu: np.ndarray, b: np.ndarray, seen: np.ndarray) -> None:
        self.mu, self.b = mu, np.where(seen, b, np.nan).astype(np.float32)
        top, mass, sums = mu.max(), np.zeros(len(GRID)), np.zeros(len(GRID))
        for c in _chunks(len(mu)):
            p = np.exp(mu[None, c] + GRID[:, None] * b[None, c] - top) * seen[None, c]
            mass += p.sum(1)
            sums += (p * b[None, c]).sum(1)
        self.mean = np.maximum.accumulate(sums / mass) + np.arange(len(GRID)) * 1e-12

    def level(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """theta of each text from its words' numbers; 0 for a text without a known word."""
        if not len(words):
            return np.zeros(len(size))
        b = np.append(self.b, np.float32(np.nan))[words].astype(float)
        known = ~np.isnan(b)
        edge = np.concatenate([[0], np.cumsum(size)])
        total = np.concatenate([[0], np.cumsum(np.where(known, b, 0))])
        count = np.concatenate([[0], np.cumsum(known)])
        n = count[edge[1:]] - count[edge[:-1]]
        mean = (total[edge[1:]] - total[edge[:-1]]) / np.maximum(n, 1)
        return np.where(n > 0, np.interp(mean, self.mean, GRID), 0.0)


def fit_words(counts: np.ndarray, theta: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """mu and b by Newton steps, for each word in both at once, from counts (level class x word) at levels theta."""
    total = counts.sum(0) + 0.01
    mu, b = (x.copy() for x in start) if start is not None else (np.log(total / total.sum()), np.zeros(counts.shape[1]))
    n = counts.sum(1)
    for _ in range(steps):
        top = np.array([max((mu[c] + t * b[c]).max() for c in _chunks(len(mu))) for t in theta])
        mass = sum(np.exp(mu[None, c] + theta[:, None] * b[None, c] - top[:, None]).sum(1) for c in _chunks(len(mu)))
        moved = 0.0
        for c in _chunks(len(mu)):
            expect = (n / mass)[:, None] * np.exp(mu[None, c] + theta[:, None] * b[None, c] - top[:, None])
            e0, e1, e2 = expect.sum(0) + 1e-9, (expect * theta[:, None]).sum(0), (expect * theta[:, None] ** 2).sum(0)
            short = total[c] - e0
            step = np.clip(((counts[:, c] * theta[:, None]).sum(0) - e1 - ridge * b[c] - e1 / e0 * short) / (e2 - e1**2 / e0 + ridge), -0.5, 0.5)
            b[c] += step
            mu[c] += np.clip((short - e1 * step) / e0, -1, 1)
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-4:
            break
    return mu, b


def _counting(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            words, size = _joined(batch.column(0).to_pylist(), np.int32)
            at = np.clip((model.level(words, size) - BINS[0]) / (BINS[1] - BINS[0]), 0, len(BINS) - 1)
            low = np.minimum(np.floor(at), len(BINS) - 2).astype(np.int64)
            held = words >= 0
            of = np.repeat(low, size)[held] * len(model.b) + words[held]
            upper = np.repeat(at - low, size)[held]  # a text between two classes counts in both, by nearness
            key, place = np.unique(np.concatenate([of, of + len(model.b)]), return_inverse=True)
            n = np.bincount(place, np.concatenate([1 - upper, upper]), len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return run


def fit(corpus: DataFrame, keys: np.ndarray, references: list[tuple[int, np.ndarray]], rounds: int = ROUNDS) -> tuple[Model, np.ndarray, list[int]]:
    """(model, bounds, levels): ``bounds[k]`` parts the texts of ``levels[k]`` from those of ``levels[k + 1]``.

    ``corpus`` is ``numbered``, ``references`` are (level, numbers of the words).
    """
    levels = sorted({lv for lv, _ in references})
    anchors = np.zeros((len(levels), len(keys)))
    for lv, w in references:
        np.add.at(anchors[levels.index(lv)], w, 1)
    scale = np.array(levels, float) - (levels[0] + levels[-1]) / 2
    spark = corpus.sparkSession
    parameters = fit_words(anchors, scale)
    model, before = Model(*parameters, anchors.sum(0) > 0), None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        rows = corpus.select("words").mapInArrow(_counting(shared), "key bigint, n double").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
        found = np.zeros((len(BINS), len(keys)))
        key = rows["key"].to_numpy(np.int64)
        found[key // len(keys), key % len(keys)] = rows["n"].to_numpy(float)
        shared.unpersist()
        if not found.sum():
            break
        share = found / found.sum()
        parameters = fit_words(np.vstack([CORPUS_WEIGHT * anchors.sum() * share, ANCHOR * anchors]), np.concatenate([BINS, scale]), parameters)
        model = Model(*parameters, share.sum(0) + anchors.sum(0) > 0)
        if before is not None and np.abs(share - before).sum() / 2 < SETTLED:
            break
        before = share
    own = model.level(np.concatenate([w for _, w in references]), np.array([len(w) for _, w in references]))
    of = np.array([lv for lv, _ in references])
    mean = [own[of == lv].mean() for lv in levels]
    spread = [max(own[of == lv].std(), 0.02) for lv in levels]
    bounds = np.array([(mean[k] * spread[k + 1] + mean[k + 1] * spread[k]) / (spread[k] + spread[k + 1]) for k in range(len(levels) - 1)])
    return model, np.maximum.accumulate(bounds) if len(bounds) else bounds, levels


def reading_levels(documents: DataFrame, references: DataFrame, doc_id: str = "doc_id", text: str = "text", level: str = "reading_level", passage: str = "passage", min_words: int = MIN_WORDS, rounds: int = ROUNDS, language: str | None = "lang") -> DataFrame:
    """(doc_id, reading_level, theta) of each document whose sender wrote at least ``min_words`` words of English.

    ``references`` is a small graded set of English passages (at most MAX_REFERENCES rows, checked); without any there is
    no scale, which is an error. English is told by a classifier that is fitted on the column ``language`` (a bounded
    sample, see ``language.fit``) and the references; with None, or without labels, every text is taken for English.
    Null ids, null and empty texts give no row; a repeated document gives a row each time. An empty corpus gives an
    empty result.
    """
    graded = references.select(F.col(level).cast("int"), F.col(passage)).limit(MAX_REFERENCES + 1).collect()
    if len(graded) > MAX_REFERENCES:
        raise ValueError(f"more than {MAX_REFERENCES} reference passages")
    refs = sorted((r[0], r[1]) for r in graded if r[0] is not None and r[1] and tokens(r[1]))
    if not refs:
        raise ValueError("the scale needs graded reference passages")
    sure = {ENGLISH: [p for _, p in refs]}
    languages = lg.Languages({ENGLISH: np.ones(lg.BUCKETS)}) if language is None else lg.fit(documents, text, language, doc_id, own_text, sure)
    own = cut(own_words(documents, languages, doc_id, text, min_words))
    words = [(lv, _keys(tokens(p))) for lv, p in refs]
    keys = vocabulary(own, np.unique(np.concatenate([w for _, w in words])))
    corpus = cut(numbered(own, keys))
    model, bounds, levels = fit(corpus, keys, [(lv, places(keys, w)) for lv, w in words], rounds)
    shared = documents.sparkSession.sparkContext.broadcast((model, bounds, np.array(levels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, parting, scale = shared.value
        for b in batches:
            theta = fitted.level(*_joined(b.column(1).to_pylist(), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scale[np.searchsorted(parting, theta)].astype(np.int32)), pa.array(theta)], names=["doc_id", "reading_level", "theta"])

    return corpus.select("doc_id", "words").mapInArrow(run, "doc_id bigint, reading_level int, theta double")
