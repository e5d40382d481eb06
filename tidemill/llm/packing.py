"""Texts into containers of a fixed number of tokens.

The lengths of all pieces form a histogram of at most ``capacity`` lengths. On it the driver enumerates shallow
combinations of length classes that fill a container, solves for their repeat counts by non-negative least squares,
rounds the counts down and packs what is left greedily by best fit. The result is a list of patterns (lengths and
repeat count) whose size depends on the capacity, not on the data; the pieces are then ranked within their length and
take their places in the patterns, all without a shuffle of more than the ranks.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut

#: Folder of the public tokenizers; their path is a parameter and they are read where the tasks run.
TOKENIZERS = os.environ.get("TIDEMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Length classes in the enumeration, and the most lengths that a combination has.
CLASSES, DEPTH = 128, 3
#: Parts into which the ranking of one length is cut.
SALTS = 64


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    # Fixed value: the splitting pattern that belongs to this public vocabulary.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Characters that are encoded at a time, and on to the next place where a token ends in any case.
STRETCH = 1_000_000
#: The pattern never joins a letter, or a digit, to what follows its run; it looks at nothing before a token.
_ENDS = regex.compile(r"\p{L}(?=\P{L})|\p{N}(?=\P{N})")


def count_tokens(text: str, path: str) -> int:
    """Tokens of the whole text, whatever its length."""
    enc = _encoding(path)
    return sum(len(enc.encode_ordinary(s)) for s in _stretches(text))


def _stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in pieces of ``size`` characters or more, cut only where a letter or digit run ends."""
    at, n = 0, len(text)
    while n - at > size and (m := _ENDS.search(text, at + size - 1)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def token_counts(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens); a null text has 0 tokens, rows without id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, path) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, length): one piece for a text that fits, else full pieces and the rest; an empty text is one piece of 0."""
    n = F.col("n_tokens")
    last = F.greatest(F.floor((n - 1) / capacity), F.lit(0))
    return counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(n - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("length"))


# ---- the plan on the histogram ---------------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets: least |a x - b| with x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    gradient = atb - ata @ x
    for _ in range(rounds):
        free = np.where(active, -np.inf, gradient)
        k = int(np.argmax(free))
        if free[k] <= 1e-8 * max(1.0, float(np.abs(atb).max())):
            break
        active[k] = True
        while True:
            idx = np.flatnonzero(active)
            s = np.linalg.solve(ata[np.ix_(idx, idx)] + 1e-9 * np.eye(len(idx)), atb[idx])
            if (s > 0).all():
                x[:] = 0
                x[idx] = s
                break
            falling = s <= 0
            step = np.min(x[idx][falling] / np.maximum(x[idx][falling] - s[falling], 1e-300))
            x[idx] += step * (s - x[idx])
            active[idx[x[idx] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
        gradient = atb - ata @ x
    return x


def combinations(classes: int, present: np.ndarray, depth: int) -> list[tuple[int, ...]]:
    """Descending tuples of at most ``depth`` present class sizes that sum to ``classes``."""
    sizes = [int(s) for s in np.flatnonzero(present) if s > 0]
    out: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], rest: int, top: int) -> None:
        if rest == 0:
            out.append(chosen)
            return
        left = depth - len(chosen)
        if not left:
            return
        for s in sizes[: bisect.bisect_right(sizes, min(top, rest))]:
            if s * left >= rest:
                extend((*chosen, s), rest - s, s)

    extend((), classes, classes)
    return out


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, pieces of it), ...), containers


def plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES, depth: int = DEPTH) -> list[Pattern]:
    """Patterns that place every piece of the histogram {length: count} exactly once."""
    left = {k: v for k, v in histogram.items() if v > 0}
    groups: list[list] = []  # [remaining, {length: n}, containers]
    if full := left.pop(capacity, 0):
        groups.append([0, {capacity: 1}, full])
    width = -(-capacity // classes)
    classes = capacity // width
    class_of = {k: -(-k // width) for k in left if 0 < k <= classes * width}
    weight = np.zeros(classes + 1)
    for k, c in class_of.items():
        weight[c] += left[k]
    combos = combinations(classes, weight > 0, depth) if class_of else []
    if combos:
        a = np.zeros((classes + 1, len(combos)))
        for j, combo in enumerate(combos):
            for c in combo:
                a[c, j] += 1
        # what is left of a long class is harder to place than of a short one: errors count by length
        hard = np.maximum(np.arange(classes + 1), 1) / classes
        scale = max(1.0, weight.max())
        repeats = np.floor(nnls(a * hard[:, None], hard * weight / scale) * scale + 1e-6).astype(np.int64)
        lengths = sorted(class_of)

        def longest(at_most: int, least: int, taken: dict[int, int]) -> int | None:
            """The longest piece in stock with least <= length <= at_most."""
            for i in range(bisect.bisect_right(lengths, at_most) - 1, -1, -1):
                k = lengths[i]
                if k < least:
                    return None
                if left[k] > taken.get(k, 0):
                    return k
            return None

        for j in np.argsort(-repeats, kind="stable"):
            need = int(repeats[j])
            while need > 0:
                # the longest pieces of each class; the last takes the room that these really leave
                take: dict[int, int] = {}
                room = capacity
                for i, c in enumerate(combos[j]):
                    top = room if i == len(combos[j]) - 1 else c * width
                    pick = longest(top, (c - 1) * width + 1, take)
                    if pick is None:
                        take = {}
                        break
                    take[pick] = take.get(pick, 0) + 1
                    room -= pick
                if not take:
                    break
                n = min(need, *(left[k] // m for k, m in take.items()))
                for k, m in take.items():
                    left[k] -= n * m
                groups.append([room, take, n])
                need -= n
    return _best_fit(groups, left, capacity)


def _best_fit(groups: list[list], left: dict[int, int], capacity: int) -> list[Pattern]:
    """Places the remaining pieces, longest first, where they leave the least space; whole runs at a time."""
    by_room: dict[int, list[list]] = defaultdict(list)
    for g in groups:
        by_room[g[0]].append(g)
    rooms = sorted(r for r in by_room if by_room[r])
    for k in sorted((k for k, n in left.items() if n > 0), reverse=True):
        n = left[k]
        while n > 0:
            i = bisect.bisect_left(rooms, k)
            if i == len(rooms):
                per = capacity // k if k else n
                whole, rest = divmod(n, per)
                fresh = [[capacity - k * per, {k: per}, whole]] if whole else []
                if rest:
                    fresh.append([capacity - k * rest, {k: rest}, 1])
                for g in fresh:
                    _file(by_room, rooms, g)
                n = 0
                continue
            room = rooms[i]
            g = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(i)
            fit = room // k if k else n
            used = min(g[2], n // fit) if n >= fit else 0
            if used == 0:
                used, fit = 1, n
            if used < g[2]:
                _file(by_room, rooms, [room, dict(g[1]), g[2] - used])
            pieces_of = dict(g[1])
            pieces_of[k] = pieces_of.get(k, 0) + fit
            _file(by_room, rooms, [room - k * fit, pieces_of, used])
            n -= used * fit
    merged: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    for gs in by_room.values():
        for g in gs:
            merged[tuple(sorted(g[1].items(), reverse=True))] += g[2]
    return sorted(merged.items(), reverse=True)


def _file(by_room: dict[int, list[list]], rooms: list[int], g: list) -> None:
    if not by_room[g[0]]:
        bisect.insort(rooms, g[0])
    by_room[g[0]].append(g)


def slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: rank at which each pattern begins, its first container, and its pieces of that length per container."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, n in patterns:
        for k, m in lengths:
            out[k].append((taken[k], base, m))
            taken[k] += n * m
        base += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in out.items()}


# ---- the placing ------------------------------------------------------------------------------------------------


def pack(lengths: DataFrame, capacity: int, classes: int = CLASSES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, piece, length) -> the same with ``container``; every piece is placed once and no container overflows.

    Lengths lie in 0..capacity. Equal lengths are interchangeable: they are ranked by doc_id and piece within
    SALTS parts of the length, so that a length that a third of all pieces have is spread. An empty input gives an
    empty result.
    """
    spark = lengths.sparkSession
    held = cut(lengths.select("doc_id", "piece", "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int").alias("salt")))
    counted = held.groupBy("length", "salt").count()
    rows = counted.collect()  # at most (capacity + 1) x SALTS rows
    histogram: dict[int, int] = defaultdict(int)
    offset: dict[tuple[int, int], int] = {}
    for r in sorted(rows, key=lambda r: (r["length"], r["salt"])):
        if not 0 <= r["length"] <= capacity:
            raise ValueError(f"a piece of {r['length']} does not fit a container of {capacity}")
        offset[r["length"], r["salt"]] = histogram[r["length"]]
        histogram[r["length"]] += r["count"]
    shared = spark.sparkContext.broadcast((slots(plan(dict(histogram), capacity, classes, depth)), offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offsets = shared.value
        for b in batches:
            length, salt, number = (b.column(k).to_numpy() for k in (2, 3, 4))
            container = np.empty(len(length), np.int64)
            order = np.lexsort((salt, length))
            cuts = np.flatnonzero((np.diff(length[order]) != 0) | (np.diff(salt[order]) != 0)) + 1
            for run in np.split(order, cuts):
                if len(run):
                    k = int(length[run[0]])
                    begin, base, per = table[k]
                    rank = number[run] - 1 + offsets[k, int(salt[run[0]])]
                    i = np.searchsorted(begin, rank, "right") - 1
                    container[run] = base[i] + (rank - begin[i]) // per[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container)], names=["doc_id", "piece", "length", "container"])

    ranked = held.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")).cast("bigint"))
    return ranked.select("doc_id", "piece", "length", "salt", "number").mapInArrow(place, "doc_id bigint, piece int, length int, container bigint")


def pack_texts(documents: DataFrame, capacity: int = 2048, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts of ``documents``, sized in tokens of the vocabulary at ``path``, packed."""
    return pack(pieces(token_counts(documents, path or os.path.join(TOKENIZERS, VOCABULARY), doc_id, text), capacity), capacity)
