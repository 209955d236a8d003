"""Near-duplicate documents by SimHash and deletion-variant signatures.

A fingerprint has 64 bits and two documents link when theirs differ in at most three.  Cut in two halves, one half
differs in at most one bit; so each distinct fingerprint is indexed under both halves as they are and under the 32
one-wildcard variants of each, an equality join on those 66 keys meets every linking pair, and the pair's whole
fingerprints are verified.  Copies share a fingerprint and are one vertex.  Within a key only a spanning forest of the
verified links is emitted, never all pairs, which leaves the components as they are.

Rules for odd rows: a null or empty text, or one of white space only, has fingerprint zero and links like any other;
fewer words than a shingle give one shingle of the whole sequence; repeated rows are documents of their own with
equal fingerprints; a null id is never a component id unless every id of the component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .store import Scratch

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
EXACT = 32  # the wildcard position that stands for "none"


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text``, repeats counted."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], np.uint64)
    lanes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # eight byte counters to a word; 255 additions can't overflow one
        counts += np.add.reduce(lanes[at : at + 255], axis=0).view(np.uint8)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for each row of ``docs``; fp is the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, f"id {kind}, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[list, list]:
    """Spanning forest of the links inside ``a`` or, given ``b``, between ``a`` and ``b``."""
    left, right = [], []
    todo = np.concatenate([a, b]) if b is not None else a
    side = np.concatenate([np.zeros(len(a), bool), np.ones(len(b), bool)]) if b is not None else None
    while len(todo) > 1:
        x, s = todo[:1], None if side is None else side[:1]
        todo = todo[1:]
        side = None if side is None else side[1:]
        while len(x) and len(todo):  # breadth first: whatever was reached leaves the rest
            near = _popcount(todo ^ x[0]) <= radius
            if side is not None:
                near &= side != s[0]
            if near.any():
                left.append(np.full(int(near.sum()), x[0]))
                right.append(todo[near])
                x = np.concatenate([x, todo[near]])
                todo = todo[~near]
                if side is not None:
                    s, side = np.concatenate([s, side[near]]), side[~near]
            x, s = x[1:], None if s is None else s[1:]
    return left, right


def _runs(key: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    """Verified links among rows sorted by key."""
    cut = np.flatnonzero(np.diff(key)) + 1
    start = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([start, [len(key)]]))
    left, right = [], []
    two = start[size == 2]
    if len(two):
        x, k = fp[two] ^ fp[two + 1], key[two]
        wild = (k >> 32) & 63
        apart = (wild == EXACT) | ((x >> (32 * (k >> 40) + wild).astype(np.uint64)) & np.uint64(1) == 1)
        near = apart & (_popcount(x) <= radius)  # equal halves meet under the exact key alone
        left.append(fp[two[near]])
        right.append(fp[two[near] + 1])
    for s, n in zip(start[size > 2], size[size > 2], strict=True):
        own, k = fp[s : s + n], int(key[s])
        half, wild = k >> 40, (k >> 32) & 63
        if wild == EXACT:
            got = _forest(own, None, radius)
        else:  # equal halves met under the exact key; here those that differ at the wildcard
            bit = (own >> np.uint64(32 * half + wild)) & np.uint64(1)
            got = _forest(own[bit == 0], own[bit == 1], radius) if 0 < bit.sum() < n else ([], [])
        left += got[0]
        right += got[1]
    u = np.concatenate(left) if left else np.zeros(0, np.uint64)
    v = np.concatenate(right) if right else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:  # sorted by key; only the last, unfinished run is carried on
            key = np.concatenate([key, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield _runs(key[:whole], fp[:whole], radius)
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield _runs(key, fp, radius)

    return run


def variant_keys(fp: str = "fp") -> F.Column:
    """The 66 keys of a fingerprint: half (1 bit), wildcard position (6 bits), half with that bit cleared (32 bits)."""
    one = (
        "CAST({h} AS BIGINT) * 1099511627776 + CAST(i AS BIGINT) * 4294967296"
        " + (shiftrightunsigned({fp}, 32 * {h}) & 4294967295 & ~(CASE WHEN i < 32 THEN shiftleft(1L, i) ELSE 0L END))"
    )
    return F.expr("concat(" + ", ".join(f"transform(sequence(0, 32), i -> {one.format(h=h, fp=fp)})" for h in (0, 1)) + ")")


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fps(fp)``, distinct -> ``(u, v)``: a spanning set of the links between fingerprints."""
    keyed = fps.select(F.explode(variant_keys()).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(id, fp, component_id)``."""
    scratch = Scratch(spark, "simhash")
    own = scratch.save(fingerprints(docs, id_col, text_col), "fingerprints")
    heads = scratch.save(own.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    stars = components(near_links(heads.select("fp")), scratch)
    rooted = heads.join(stars, heads.fp == stars.node, "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    of = rooted.join(best, "root").select("fp", "component_id")
    return own.join(of, "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> F.Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
