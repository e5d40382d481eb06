"""Passages of held-out tests in a corpus of e-mails.

All runs of ``SEED`` words of the normalised passages form a hash set that every task holds. Each document part is
decoded, normalised and scanned window by window against the set; where runs are hit, the document and the passage are
aligned word by word around the hits, and an alignment that is long and close enough is a leak.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import mail
from tidemill.session import cut

#: Words of a seed. Twenty words with three of them edited still hold a run of five.
SEED = 5
#: Passages, and characters of their normalised text, in one block of the query set; larger sets go through in blocks.
BLOCK_ITEMS, BLOCK_CHARS = 4096, 16_000_000
#: Words of one segment: longer passages are cut, each segment beginning with the last OVERLAP words of the one before.
SEGMENT, OVERLAP = 20_000, 200
#: Words that a leak has at least, where the caller names no other number.
LEAST = 20
#: An alignment of such a leak may span SHORT words less and match UNMATCHED less (edits at and near its ends), with so
#: many edits per spanned word.
SHORT, UNMATCHED, MAX_EDITS = 2, 3, 0.17
#: Diagonals on either side that an alignment may drift to.
BAND = 8
#: Around a seed, so many words to either side are compared, on the seed's diagonal and DRIFT others to either side.
AROUND, DRIFT = 22, 3
#: So many compared words that aren't among the passages' commonest must agree; a word is common from this share on.
SUPPORT, COMMON = 9, 0.015
#: A word with fewer places in all passages is uncommon in any case: in a small set every word has a large share.
LEAST_COMMON = 20
#: Probes that are scored together.
TOGETHER = 2048
#: Characters that are scanned together.
SLICE = 2_000_000
#: Unknown words between the parts of a batch.
PAD = AROUND + SEED + DRIFT

_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 for k in range(SEED)], dtype=np.uint64)


def _hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of each run of SEED word ids; 0 where a word of the run is unknown (id 0)."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SEED):
        w = x[k : k + n]
        known &= w != 0
        h = (w + np.uint64(k * 0x1000003)) * _MIX[k]
        out = (out ^ (h ^ (h >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out[out == 0] = 1
    return np.where(known, out, np.uint64(0))


class PassageSet:
    """A block of passages: vocabulary, word ids, and the sorted seeds with the places where they occur."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST) -> None:
        self.least = least
        self.vocabulary: dict[str, int] = {}
        by_words: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item, passage in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in mail.words(passage))
            by_words[ids].append(item)
        self.passages = [np.array(k, np.int64) for k in by_words]
        self.items = [sorted(set(v)) for v in by_words.values()]
        seeds = [_hashes(p) for p in self.passages]
        flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        which = np.concatenate([np.full(len(s), k) for k, s in enumerate(seeds)]) if seeds else np.empty(0, int)
        where = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.empty(0, int)
        order = np.argsort(flat, kind="stable")
        self.lists = [p.tolist() for p in self.passages]
        self.start = np.concatenate([[0], np.cumsum([len(p) + 2 * PAD for p in self.passages])])[:-1] + PAD if self.passages else np.empty(0, int)
        self.flat = np.full(int(sum(len(p) + 2 * PAD for p in self.passages)) + 1, -1, np.int64)
        for at, p in zip(self.start, self.passages):
            self.flat[at : at + len(p)] = p
        counts = np.bincount(self.flat[self.flat > 0], minlength=len(self.vocabulary) + 1)
        self.rare = counts < max(LEAST_COMMON, COMMON * counts.sum())
        self.rare[0] = False
        self.needed = np.array([self._needed(p) for p in self.passages], np.int64)
        self.seeds, self.which, self.where = flat[order], which[order].astype(np.int64), where[order].astype(np.int64)

    def _needed(self, passage: np.ndarray) -> int:
        """Uncommon words that any leak of the passage keeps: those of its poorest stretch less the edits, SUPPORT at most."""
        span = self.least - SHORT
        rare = np.concatenate([[0], np.cumsum(self.rare[passage])])
        poorest = int((rare[span:] - rare[:-span]).min()) if len(passage) >= span else int(rare[-1])
        return min(SUPPORT, max(0, poorest - int(MAX_EDITS * span)))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, passage, position in the passage) of every seed that occurs."""
        lo = np.searchsorted(self.seeds, hashes, "left")
        hi = np.searchsorted(self.seeds, hashes, "right")
        at = np.flatnonzero((hi > lo) & (hashes != 0))
        count = (hi - lo)[at]
        pick = np.repeat(lo[at], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        return np.repeat(at, count), self.which[pick], self.where[pick]

    def support(self, ids: np.ndarray, pos: np.ndarray, which: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Whether enough uncommon words around the seeds are in the passage, at or near their place."""
        offset = np.arange(-AROUND, SEED + AROUND)
        doc = ids[pos[:, None] + offset]
        base = (self.start[which] + where)[:, None] + offset
        same = np.zeros(doc.shape, bool)
        for s in range(-DRIFT, DRIFT + 1):
            same |= doc == self.flat[base + s]
        return (same & self.rare[doc]).sum(axis=1) >= self.needed[which]


    def reachable(self, ids: np.ndarray, pos: np.ndarray, which: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Whether an alignment around the seed can score what the least leak scores; the score alone, all probes at once.

        The score is that of ``align`` on the same band, over the passage's whole length, so no leak is lost.
        """
        out = np.zeros(len(pos), bool)
        least = 2 * (self.least - UNMATCHED) - int(MAX_EDITS * self.least)
        width = 2 * BAND + 1
        ramp = np.arange(width, dtype=np.int32)
        size = np.array([len(p) for p in self.passages])[which]
        order = np.argsort(size, kind="stable")
        for k in range(0, len(order), TOGETHER):
            at = order[k : k + TOGETHER]
            word, place = pos[at] - where[at] - BAND, self.start[which[at]] - 2 * BAND
            prev, best = np.zeros((len(at), width + 1), np.int32), np.zeros(len(at), np.int32)
            for i in range(int(size[at].max()) + 2 * BAND):
                doc = ids[np.clip(word + i, 0, len(ids) - 1)]
                same = (self.flat[np.clip((place + i)[:, None] + ramp, 0, len(self.flat) - 1)] == doc[:, None]) & (doc > 0)[:, None]
                cell = np.where(same, prev[:, :-1] + 2, np.maximum(prev[:, :-1], prev[:, 1:]) - 1)
                row = np.maximum(np.maximum.accumulate(cell + ramp, axis=1) - ramp, 0)
                np.maximum(best, row.max(axis=1), out=best)
                prev[:, :-1] = row
            out[at] = best >= least
        return out


def align(doc: list[int], passage: list[int], shift: int) -> list[tuple[int, int]]:
    """Matched words (place in ``doc``, place in ``passage``), in order, of the best local alignment near the diagonal
    ``shift`` (place in the passage less place in ``doc``).

    Match +2, change, drop or addition -1: one matching word behind two edits is still taken in, so that edits near
    either end don't shorten a stretch. What is taken in beyond a leak is for ``stretch`` to leave out.
    """
    m, width = len(passage), 2 * BAND + 1
    zero = (0, None)  # score, chain of matched words
    best, end = 0, None
    blank = [zero] * (width + 2)  # cell b + 1 is the diagonal shift - BAND + b
    prev, live = blank, False
    for i, w in enumerate(doc):
        if not w and not live:
            continue
        row, left, live = blank[:], zero, False
        first = i + shift - BAND
        for b in range(max(0, -first), min(width, m - first)):
            src = prev[b + 1]
            if w and w == passage[first + b]:
                cell = (src[0] + 2, (i, first + b, src[1]))
                if cell[0] >= best:
                    best, end = cell[0], cell[1]
            else:
                if prev[b + 2][0] > src[0]:
                    src = prev[b + 2]
                if left[0] > src[0]:
                    src = left
                cell = (src[0] - 1, src[1]) if src[0] else zero
            if cell[1] is not None:
                row[b + 1], live = cell, True
            left = cell
        prev = row
    pairs = []
    while end is not None:
        pairs.append(end[:2])
        end = end[2]
    return pairs[::-1]


def stretch(pairs: list[tuple[int, int]], least: int = LEAST) -> tuple[int, int, int, int] | None:
    """(first, last, span, edits) of the longest run of matched words that is a leak, first and last as numbers in ``pairs``."""
    edits = [0]
    for (i, j), (i2, j2) in zip(pairs, pairs[1:]):
        edits.append(edits[-1] + max(i2 - i, j2 - j) - 1)
    for n in range(len(pairs), least - UNMATCHED - 1, -1):
        for a in range(len(pairs) - n + 1):
            z = a + n - 1
            span, e = pairs[z][1] - pairs[a][1] + 1, edits[z] - edits[a]
            if passes(span, n, e, least):
                return a, z, span, e
    return None


def stretches(pairs: list[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """``stretch``, and those of what is left on either side of it."""
    if (got := stretch(pairs, least)) is None:
        return []
    first, last = got[:2]
    after = [(a + last + 1, z + last + 1, *more) for a, z, *more in stretches(pairs[last + 1 :], least)]
    return [*stretches(pairs[:first], least), got, *after]


def passes(span: int, matched: int, edits: int, least: int = LEAST) -> bool:
    return span >= least - SHORT and matched >= least - UNMATCHED and edits <= MAX_EDITS * span


class Found(NamedTuple):
    row: int
    part: int
    passage: int
    span: int
    matched: int
    edits: int
    begin: int
    end: int
    words: str


Body = tuple[int, int, list[str]]  # row, number of the text part, its words


def bodies_of(texts: Sequence[str | None]) -> list[Body]:
    """The decoded, normalised text parts of messages."""
    return [(r, k, mail.words(mail.readable(part))) for r, text in enumerate(texts) for k, part in enumerate(mail.parts(text))]


def scan(texts: Sequence[str | None], passages: PassageSet) -> list[Found]:
    return scan_bodies(bodies_of(texts), passages)


def scan_bodies(found_bodies: list[Body], passages: PassageSet) -> list[Found]:
    """All disjoint leaks of each (text part, passage) whose surroundings of a seed hold enough further words of the passage."""
    kept_bodies = [b for b in found_bodies if len(b[2]) >= passages.least - UNMATCHED]
    bodies = [b[2] for b in kept_bodies]
    origin = [b[:2] for b in kept_bodies]
    if not bodies or not passages.passages:
        return []
    # All parts in one array, with unknown words between them.
    size = np.array([len(b) for b in bodies])
    begin = np.concatenate([[0], np.cumsum(size + PAD)])[:-1] + PAD
    ids = np.zeros(int(begin[-1] + size[-1] + PAD), np.int64)
    for b, at in zip(bodies, begin):
        ids[at : at + len(b)] = np.fromiter(map(passages.vocabulary.get, b, repeat(0)), np.int64, len(b))
    pos, which, where = passages.hits(_hashes(ids))
    if not len(pos):
        return []
    # One probe for each run of hits on a diagonal.
    diag = pos - where
    order = np.lexsort((pos, diag, which))
    pos, which, where, diag = pos[order], which[order], where[order], diag[order]
    lead = np.ones(len(pos), bool)
    lead[1:] = (which[1:] != which[:-1]) | (diag[1:] != diag[:-1]) | (np.diff(pos) > SEED)
    pos, which, where = pos[lead], which[lead], where[lead]
    enough = np.concatenate([passages.support(ids, pos[k : k + 65536], which[k : k + 65536], where[k : k + 65536]) for k in range(0, len(pos), 65536)])
    pos, which, where = pos[enough], which[enough], where[enough]
    enough = passages.reachable(ids, pos, which, where)
    pos, which, where = pos[enough], which[enough], where[enough]
    order = np.lexsort((pos, which))
    part = np.searchsorted(begin, pos, "right") - 1
    found: dict[tuple[int, int], list[Found]] = defaultdict(list)
    seen: list[tuple[int, int, int]] = []  # stretches of the part aligned with the passage: begin, end, diagonal
    of = (-1, -1)
    for i in order:
        k, p, w = int(part[i]), int(which[i]), int(where[i])
        at = int(pos[i] - begin[k])
        if (k, p) != of:
            of, seen = (k, p), []
        passage = passages.lists[p]
        near = [(a, z) for a, z, d in seen if abs((w - at) - d) <= BAND // 2]
        if any(a <= at and at + SEED <= z for a, z in near):
            continue  # inside a stretch aligned before
        lo, hi = max(0, at - w - BAND), min(len(bodies[k]), at + len(passage) - w + BAND)
        for a, z in near:
            lo, hi = (max(lo, z), hi) if a <= at else (lo, min(hi, a))
        # The best alignment needn't hold the seed: go on beside it until one does.
        while hi - lo >= SEED:
            pairs = align(ids[begin[k] + lo : begin[k] + hi].tolist(), passage, w - at + lo)
            if not pairs:
                break
            a, z = lo + pairs[0][0], lo + pairs[-1][0] + 1
            seen.append((a, z, w - at))
            row, number = origin[k]
            for first, last, span, edits in stretches(pairs, passages.least):
                d0, d1 = lo + pairs[first][0], lo + pairs[last][0] + 1
                found[k, p].append(Found(row, number, p, span, last - first + 1, edits, d0, d1, " ".join(bodies[k][d0:d1])))
            if z <= at:
                lo = z
            elif a >= at + SEED:
                hi = a
            else:
                break
    # Of stretches of one passage that overlap, as seeds on neighbouring diagonals give them, the one with most matches.
    out: list[Found] = []
    for each in found.values():
        kept: list[Found] = []
        for f in sorted(each, key=lambda f: (-f.matched, f.edits, f.begin)):
            if all(f.end <= g.begin or f.begin >= g.end for g in kept):
                kept.append(f)
        out += sorted(kept, key=lambda f: f.begin)
    return out


def is_leak(f: Found, least: int = LEAST) -> bool:
    return passes(f.span, f.matched, f.edits, least)


def _slices(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of about SLICE characters, or one text if that is longer."""
    a = size = 0
    for k, n in enumerate(sizes):
        if k > a and size + n > SLICE:
            yield a, k
            a, size = k, 0
        size += n
    if a < len(sizes):
        yield a, len(sizes)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("part", pa.int32()), ("span", pa.int32()), ("matched", pa.int32()), ("edits", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("words", pa.string())])
_COLUMNS = "doc_id bigint, item_id bigint, part int, span int, matched int, edits int, begin int, end int, words string"


def _rows(ids: list[int], found: list[Found], passages: PassageSet) -> list[tuple]:
    return [(ids[f.row], item, f.part, f.span, f.matched, f.edits, f.begin, f.end, f.words) for f in found if is_leak(f, passages.least) for item in passages.items[f.passage]]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA.types)], schema=_SCHEMA)


def _scanning(shared):
    """(id, raw text) -> leaks of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages: PassageSet = shared.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for lo, hi in _slices([len(t or "") for t in texts]):
                rows += _rows(ids[lo:hi], scan(texts[lo:hi], passages), passages)
            yield _batch(rows)

    return run


def _decoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, raw text) -> (id, part, its words in one string)."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi in _slices([len(t or "") for t in texts]):
            found = bodies_of(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array([ids[lo + r] for r, _, _ in found], pa.int64()), pa.array([k for _, k, _ in found], pa.int32()), pa.array([" ".join(w) for _, _, w in found], pa.string())], names=["d", "part", "w"])


def _scanning_decoded(shared):
    """(id, part, words) -> leaks of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages: PassageSet = shared.value
        for b in batches:
            ids, part, words = (b.column(k).to_pylist() for k in range(3))
            rows = []
            for lo, hi in _slices([len(w) for w in words]):
                bodies = [(k - lo, part[k], words[k].split(" ")) for k in range(lo, hi)]
                rows += _rows(ids[lo:hi], scan_bodies(bodies, passages), passages)
            yield _batch(rows)

    return run


def segments(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(i, p): normalised passages, each row once; those of more than SEGMENT words in overlapping segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held = mail.words(text)
                for at in range(0, max(len(held) - OVERLAP, 1), SEGMENT - OVERLAP):
                    ids.append(i)
                    out.append(" ".join(held[at : at + SEGMENT]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["i", "p"])

    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(passage).alias("p")).where("i IS NOT NULL AND p IS NOT NULL")
    return rows.mapInArrow(run, "i bigint, p string").distinct()


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, part, span, matched, edits, begin, end, words): the leaked passages of each document, one row per stretch.

    A leak is a stretch of at least ``least`` words of a passage, about one in ten of them edited; a passage that is
    shorter than that by more than UNMATCHED words is never found. ``part`` numbers the text parts of the message,
    ``begin`` and ``end`` are word numbers in the part. Items that share a passage are all reported, a document that
    stands in the table twice is reported twice.

    What is broadcast is one block of passages: at most BLOCK_ITEMS of them and BLOCK_CHARS characters, both checked.
    A set that fits one block is scanned for in the pass that decodes the documents. For more blocks the decoded words
    are written once to the shared folder, and each block scans those.

    Passages of fewer than SEED words, null ids, null and empty texts match nothing; empty tables give an empty result.
    """
    spark = documents.sparkSession
    held = cut(segments(items, item_id, passage))
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // (BLOCK_ITEMS // 2)) if size["n"] > BLOCK_ITEMS else 1, -(-size["chars"] // (BLOCK_CHARS // 2)) if size["chars"] > BLOCK_CHARS else 1)
    rows = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    if blocks > 1:
        rows = cut(rows.mapInArrow(_decoding, "d bigint, part int, w string"))
    out = None
    for k in range(blocks):
        of = held.where(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == k)
        room = of.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("chars")).first()
        if room["n"] > BLOCK_ITEMS or room["chars"] > BLOCK_CHARS:
            raise ValueError("a block of passages is larger than its bound")
        block = [(r.i, r.p) for r in of.collect()]
        if not block and out is not None:
            continue
        shared = spark.sparkContext.broadcast(PassageSet(block, least))
        found = rows.mapInArrow((_scanning if blocks == 1 else _scanning_decoded)(shared), _COLUMNS)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaked_documents(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``documents`` without those in ``found``; rows with a null id stay."""
    return documents.join(found.select(F.col("doc_id").alias("_leaked")).distinct(), F.col(doc_id) == F.col("_leaked"), "left_anti")


def _cut_words(text: str, spans: list[tuple[int, int, int]]) -> str:
    kept = []
    for number, part in enumerate(mail.parts(text)):
        body = mail.readable(part)
        own = sorted((a, b) for k, a, b in spans if k == number)
        if own:
            places = [(m.start(), m.end()) for m in mail._WORD.finditer(mail._SOFT.sub("", body).lower())]
            body = mail._SOFT.sub("", body)
            pieces, at = [], 0
            for a, b in own:
                if b > a:
                    pieces.append(body[at : max(at, places[a][0])])
                    at = max(at, places[b - 1][1])
            body = "".join([*pieces, body[at:]])
        kept.append(body)
    return "\n".join(kept)


def without_leaked_spans(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, clean): the decoded text of the documents in ``found``, its leaked stretches cut out."""
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("part", "begin", "end")).alias("spans"))
    hit = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(spans, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, marks = (b.column(k).to_pylist() for k in range(3))
            clean = [_cut_words(t, [(s["part"], s["begin"], s["end"]) for s in m]) for t, m in zip(texts, marks)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clean, pa.string())], names=["doc_id", "clean"])

    return hit.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, clean string")
