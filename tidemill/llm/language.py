"""Which language a text is in: naive Bayes over character trigrams, trained on the texts' own labels.

The labels may be wrong now and then: after a first fit the sample is labelled anew by the model and counted again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the trigrams; trigrams that share one are told apart by the others of a text.
BUCKETS = 1 << 14
#: Texts of the training sample for each label, in expectation; the most labels; the least share of the labelled rows.
PER_LABEL, MAX_LABELS, LEAST_SHARE = 1000, 20, 0.005
_OTHER = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the text's letters, words apart by one blank."""
    letters = _OTHER.sub(" ", text.lower()).strip()
    if not letters:
        return np.empty(0, np.int64)
    x = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)).astype(np.int64) & (BUCKETS - 1)


class Languages:
    """Trigram chances of each label."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.labels = sorted(counts)
        share = [(counts[k] + 0.1) / (counts[k].sum() + 0.1 * BUCKETS) for k in self.labels]
        self.log = np.log(np.array(share)) if share else np.empty((0, BUCKETS))

    def of(self, text: str) -> str | None:
        """The likeliest label; without a letter or a label None."""
        found = trigrams(text)
        if not len(found) or not self.labels:
            return None
        return self.labels[int(self.log[:, found].sum(axis=1).argmax())]


def _counting(read: Callable[[str], str], shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, np.ndarray] = {}
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = read(text)
                label = label if shared is None else shared.value.of(own)
                if label is not None:
                    counts.setdefault(label, np.zeros(BUCKETS, np.int64))
                    np.add.at(counts[label], trigrams(own), 1)
            keys = [(k, int(i)) for k, c in counts.items() for i in np.flatnonzero(c)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.int32()), pa.array([int(counts[k][i]) for k, i in keys], pa.int64())], names=["label", "bucket", "n"])

    return run


def fit(documents: DataFrame, text: str, language: str, key: str, read: Callable[[str], str], known: dict[str, list[str]], rounds: int = 1) -> Languages:
    """Fits the labels in column ``language`` (case and blanks aside) on what ``read`` makes of the column ``text``.

    The sample is bounded: PER_LABEL texts of each of the MAX_LABELS commonest labels, chosen by a hash of ``key``;
    labels of fewer than LEAST_SHARE of the labelled rows are taken for slips. ``known`` gives texts of sure label,
    which always count. Without labels the model knows only those of ``known``.
    """
    label = F.lower(F.trim(F.col(language).cast("string")))
    rows = documents.select(label.alias("label"), F.col(text).alias("text"), F.xxhash64(key).alias("h")).where("label <> '' AND text IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(MAX_LABELS).collect()}
    share = {k: min(1.0, PER_LABEL / n) for k, n in sizes.items() if n >= LEAST_SHARE * sum(sizes.values())}
    sure = {k: sum((np.bincount(trigrams(t), minlength=BUCKETS) for t in texts), np.zeros(BUCKETS, np.int64)) for k, texts in known.items()}
    if not share:
        return Languages(sure)
    quota = F.lit(0)
    for k, x in share.items():
        quota = F.when(F.col("label") == k, F.lit(int(x * 1_000_000))).otherwise(quota)
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < quota).select("label", "text")
    model = None
    for _ in range(rounds + 1):
        shared = None if model is None else documents.sparkSession.sparkContext.broadcast(model)
        found = sample.mapInArrow(partial(_counting(read, shared)), "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = {k: v.copy() for k, v in sure.items()}
        for k, part in found.groupby("label"):
            counts.setdefault(k, np.zeros(BUCKETS, np.int64))
            np.add.at(counts[k], part["bucket"].to_numpy(), part["n"].to_numpy())
        model = Languages(counts)
    return model
