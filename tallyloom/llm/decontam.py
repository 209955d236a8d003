"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased runs of word characters; shingles have five.  A block of benchmark items (``INDEX_BYTES`` at most, so
what a task holds is bounded; further blocks are further passes) becomes an index: postings of the items' fingerprints
by five Hamming blocks of 12 or 13 bits, each item under all block values within three bits of its own.  A fingerprint
within ``RADIUS`` of an item's differs by at most ``RADIUS // 5`` bits in some block, so one look at each block's postings
finds all of them.  Documents are slid over with windows of
each item size; windows in which fewer than half of the shingles occur in any item of the block can't reach the
similarity and are passed over, all others are fingerprinted and looked up, and the pairs found are verified by the exact
weighted Jaccard similarity of their shingle counts.  Of the windows of a document that match an item the best stays.

Rules for odd rows: a null or empty text matches nothing; an item without words matches nothing; an item of fewer than
five words is one shingle of all of them; a document shorter than an item is one window; equal items all match; repeated
documents each get their row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 19  # of 64 bits; similarity 0.8 has about 10 on average, one pair in 3000 more than 19
CUTS = (0, 13, 26, 39, 52, 64)
INDEX_BYTES = 64 << 20  # of an index's postings, shingles and words, about
ITEM_BYTES = 12_000  # an item's postings: 5 times 300 to 378 values of 6 bytes
LOOKUPS = 1 << 20  # postings read at a time, about

_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def near_values(width: int, most: int) -> np.ndarray:
    """All values of ``width`` bits of which ``most`` are set at most."""
    values = np.arange(1 << width, dtype=np.uint16)
    return values[np.bitwise_count(values) <= most]


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of every run of five words (of all, if fewer) from the words' hashes."""
    k = min(SHINGLE_WORDS, len(hashes))
    n = len(hashes) - k + 1 if k else 0
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _P + hashes[i : i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _bits(h: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhash(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints from the number of set bits (m, 64) among n shingles each (m)."""
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / max(1, a.total() + b.total() - both)


class Index:
    """Items of one block: shingle counts, fingerprints by size, multi-index of their 8-bit blocks."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS):
        self.radius, self.ids, self.counts, self.sizes, fps = radius, [], [], [], []
        self.vocab: dict[str, int] = {}
        for item, text in items:
            if not (words := words_of(text)):
                continue
            h = shingle_hashes(np.array([_word_hash(w) for w in words], np.uint64))
            fps.append(simhash(_bits(h).sum(0, dtype=np.int64)[None], np.array([len(h)]))[0])
            self.ids.append(item)
            self.sizes.append(len(words))
            self.counts.append(Counter(h.tolist()))
            for w in words:
                self.vocab.setdefault(w, len(self.vocab))
        self.hashes = np.array([*map(_word_hash, self.vocab), 0], np.uint64)  # the last is for words of no item
        self.shingles = np.array(sorted({s for c in self.counts for s in c}), np.uint64)
        self.fps = np.array(fps, np.uint64)
        self.by_size = {n: np.flatnonzero(np.array(self.sizes) == n) for n in sorted(set(self.sizes))}
        flips = {w: near_values(w, min(w, radius // (len(CUTS) - 1))) for w in np.diff(CUTS).tolist()}
        self.postings = {n: [self._posted(rows, k, flips) for k in range(len(CUTS) - 1)] for n, rows in self.by_size.items()}

    def _posted(self, rows: np.ndarray, k: int, flips: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted block values and the item of each: every item under all values near its own."""
        near = flips[CUTS[k + 1] - CUTS[k]]
        values = (self._block(self.fps[rows], k)[:, None] ^ near).ravel()
        by = np.argsort(values, kind="stable")
        return values[by], np.repeat(rows, len(near)).astype(np.int32)[by]

    @staticmethod
    def _block(fps: np.ndarray, k: int) -> np.ndarray:
        return ((fps >> np.uint64(CUTS[k])) & np.uint64((1 << (CUTS[k + 1] - CUTS[k])) - 1)).astype(np.uint16)

    def near(self, size: int, fps: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(window, item)`` for all items of ``size`` words whose fingerprint is within the radius of a window's."""
        n_items = len(self.by_size[size])
        step = max(1, LOOKUPS // n_items)
        for at in range(0, len(fps), step):
            part = fps[at : at + step]
            met = []
            for k, (values, rows) in enumerate(self.postings[size]):
                own = self._block(part, k)
                low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                n = high - low
                place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                w, r = np.repeat(np.arange(len(part)), n), rows[place]
                inside = np.bitwise_count(part[w] ^ self.fps[r]) <= self.radius
                met.append(w[inside] * len(self.fps) + r[inside])
            pairs = np.unique(np.concatenate(met))  # a pair may meet in several blocks
            yield from zip((pairs // len(self.fps) + at).tolist(), (pairs % len(self.fps)).tolist(), strict=True)

    def matches(self, text: str | None, similarity: float = SIMILARITY) -> list[tuple[int, float, int, int]]:
        """``(item id, similarity, first word, words)`` for each item that a window of ``text`` matches, best window."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        other = len(self.vocab)
        get = self.vocab.get
        ids = np.array(list(map(get, words, repeat(other))), np.int64)
        known = np.concatenate([[0], np.cumsum(ids != other)])
        best: dict[int, tuple[float, int]] = {}
        hits: dict[int, np.ndarray] = {}  # by shingle length, the running number of shingles that some item has
        for size, _ in self.by_size.items():
            k = min(SHINGLE_WORDS, size)
            n = len(words) - k + 1
            if n < 1:
                continue
            if k not in hits:
                at = np.flatnonzero(known[k:] - known[:-k] == k)
                own = self.hashes[ids]
                seen = np.zeros(n, bool)
                if len(at):
                    h = np.zeros(len(at), np.uint64)
                    for i in range(k):
                        h = h * _P + own[at + i]
                    h ^= h >> np.uint64(32)
                    h *= np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(32)
                    pos = np.searchsorted(self.shingles, h)
                    seen[at] = self.shingles[np.minimum(pos, len(self.shingles) - 1)] == h
                hits[k] = np.concatenate([[0], np.cumsum(seen)])
            if not hits[k][-1]:
                continue
            m = min(size - k + 1, n)  # shingles in a window
            inside = hits[k][m:] - hits[k][:-m]
            starts = np.flatnonzero(2 * inside >= m)
            if len(starts):
                self._windows(words, size, k, m, starts, similarity, best)
        return [(self.ids[r], s, at, min(self.sizes[r], len(words))) for r, (s, at) in sorted(best.items())]

    def _windows(self, words: list[str], size: int, k: int, m: int, starts: np.ndarray, similarity: float, best: dict) -> None:
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1):  # neighbouring windows share their sums
            lo, hi = int(run[0]), int(run[-1]) + m + k - 1
            own = np.array([_word_hash(w) for w in words[lo:hi]], np.uint64)
            h = shingle_hashes(own) if k == SHINGLE_WORDS else self._short(own, k)
            sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(_bits(h), axis=0, dtype=np.int64)])
            at = run - lo
            fps = simhash(sums[at + m] - sums[at], np.full(len(at), m))
            counts: dict[int, Counter] = {}
            for w, r in self.near(size, fps):
                a = int(at[w])
                if w not in counts:
                    counts[w] = Counter(h[a : a + m].tolist())
                s = weighted_jaccard(counts[w], self.counts[r])
                if s >= similarity and s > best.get(r, (0.0, 0))[0]:
                    best[r] = (s, a + lo)

    @staticmethod
    def _short(own: np.ndarray, k: int) -> np.ndarray:
        """Shingles of ``k`` words, fewer than five; the run may be longer than one of them."""
        return np.concatenate([shingle_hashes(own[i : i + k]) for i in range(len(own) - k + 1)])


FOUND = ("_items", "_similarity", "_first_words", "_n_words")
_KINDS = ("array<bigint>", "double", "array<bigint>", "array<bigint>")


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", similarity: float = SIMILARITY, index_bytes: int = INDEX_BYTES, names: tuple[str, ...] = FOUND) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, by the given names, items, similarity of the best, first words, numbers of words.

    ``benchmark(item id, text)`` streams to the driver in blocks; each block is one pass over ``docs`` without a shuffle.
    """
    held = fresh(docs, "_text")[0]
    items = ((r[0], r[1]) for r in benchmark.select(*benchmark.columns[:2]).toLocalIterator())
    empty = (F.expr(f"CAST({'array()' if k[0] == 'a' else 'NULL'} AS {k})").alias(c) for c, k in zip(names, _KINDS, strict=True))
    out = docs.select(*(F.col(c) for c in keep), *empty, F.col(text_col).alias(held))
    block, size = [], 0
    for item, text in items:
        block.append((item, text))
        size += ITEM_BYTES + 40 * len(text or "")
        if size >= index_bytes:
            out, block, size = out.mapInArrow(_merged(Index(block), similarity), out.schema), [], 0
    if block:
        out = out.mapInArrow(_merged(Index(block), similarity), out.schema)
    return out.drop(held)


def _merged(index: Index, similarity: float):
    """The matches of one block join those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns
            found = [index.matches(t, similarity) for t in b.column(n - 1).to_pylist()]
            old = [c.to_pylist() for c in b.columns[n - 5 : n - 1]]
            new = (
                [x + [m[0] for m in f] for x, f in zip(old[0], found, strict=True)],
                [max([m[1] for m in f] + ([] if x is None else [x]), default=None) for x, f in zip(old[1], found, strict=True)],
                [x + [m[2] for m in f] for x, f in zip(old[2], found, strict=True)],
                [x + [m[3] for m in f] for x, f in zip(old[3], found, strict=True)],
            )
            cols = [pa.array(c, kind) for c, kind in zip(new, b.schema.types[n - 5 : n - 1], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 5], *cols, b.column(n - 1)], b.schema.names)

    return run
