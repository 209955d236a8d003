"""Removal of long strings that an earlier document has, by merged Burrows-Wheeler transforms.

A text is bytes.  A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document of a smaller id.

Which strings can be repeated at all is narrowed down without loss: every window of ``LENGTH`` bytes has a least hash of
its grams, equal windows have equal ones, so a window whose least hash occurs in one document only is not repeated.
Hashes seen in two documents are kept in a bit table of fixed size; a false hit only adds work.  The bytes of
neighbouring windows with the same least hash are a segment; equal segments are one string with its least document.

A hash that only one segment has needs no more: that segment's least document is each window's.  Segments of all other
hashes are dealt by hash, so strings that share a window meet; a hot hash's windows are dealt by a second hash.  Windows
whose own hash no other has are not repeated either; a task cuts runs of all others, equal ones once, into shards, builds
each shard's multi-string transform over pairs of bytes, and merges all shards by interleave refinement: each round
carries the interleave one symbol further by a stable bucket pass, and rows stay in one block while they agreed in all
symbols so far.  The blocks left are the intervals of common prefix ``LENGTH`` or more; suffixes are sorted in their
small shards only.  The least document of a block tells which of its windows go.

Rules for odd rows: a null text is an empty one; texts below ``LENGTH`` bytes lose nothing; a string repeated only inside
documents of one id stays; a null id counts as larger than any other and rows with a null id as one document; rows
that repeat id and text get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shuffle_files_go
from .store import Scratch

LENGTH = 50
GRAM = 24  # bytes, 16 to 24: rare enough not to recur by chance, short enough for few segments
TABLE_BITS = 28  # 32 MB, whatever the corpus
SLICES = 64
PART_BYTES = 1 << 20  # of text hashed at a time
SHARD_BYTES = 1 << 16
MERGE_BYTES = 1 << 19  # of segments merged at a time, the last hash's to its end
HOT_SEGMENTS = 50_000  # different segments of a hash; with more, its windows are dealt by a second hash
JOIN_PARTS = 3  # of the segments, joined one after the other: the files of one part's shuffle go before the next
NO_ID = 2**63 - 1
SEED = 42  # of Spark's xxhash64
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def least_hashes(data: bytes, length: int = LENGTH) -> np.ndarray:
    """For every window of ``length`` bytes the least hash of its grams of ``GRAM`` bytes."""
    n = len(data) - GRAM + 1
    padded = data + b"\0" * 8
    word = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    h = word[:n] * _A + word[8 : n + 8] * _B
    h ^= (word[GRAM - 8 : n + GRAM - 8] ^ (h >> np.uint64(29))) * _C  # the last word ends with the gram
    h *= _A
    h ^= h >> np.uint64(32)
    h *= _B
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (span - width)], h[span - width :]) if span > width else h


def _runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of a batch: text number, first window in the text, windows, least hash of each run."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PART_BYTES):
            size += len(texts[end])
            end += 1
        part = [(i, t) for i, t in enumerate(texts[at:end], at) if len(t) >= length]
        at = end
        if not part:
            continue
        data = b"".join(t for _, t in part)
        sizes = np.array([len(t) for _, t in part])
        first = np.cumsum(sizes) - sizes
        m = least_hashes(data, length)
        owner = np.repeat(np.arange(len(part)), sizes)[: len(m)]
        inside = np.arange(len(m)) - first[owner] <= sizes[owner] - length
        cut = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])]))
        count = np.diff(np.concatenate([cut, [len(m)]]))
        good = inside[cut]
        cut, count = cut[good], count[good]
        longest = length - GRAM + 1  # a hash can't be least for longer unless it recurs; such runs are cut
        if len(cut) and count.max() > longest:
            times = -(-count // longest)
            k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            cut = np.repeat(cut, times) + k * longest
            count = np.minimum(longest, np.repeat(count, times) - k * longest)
        number = np.array([i for i, _ in part])
        yield number[owner[cut]], cut - first[owner[cut]], count, m[cut] * _A  # minima crowd at the low end; their order ends here


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _hashed(length: int):
    """``(hash, doc)``: the least and the greatest document of each least hash in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0).to_numpy()
            for number, _, _, m in _runs(_bytes(b.column(1)), length):
                own = doc[number]
                order = np.argsort(m)
                m, own = m[order], own[order]
                at = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                m, least, most = m[at].view(np.int64), np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)
                both = least != most  # of one document one row is enough
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m, m[both]])), pa.array(np.concatenate([least, most[both]]))], ["hash", "doc"])

    return run


def _slice_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of the bit table that a slice's hashes set; a task may hold several slices."""
    bits: dict[int, np.ndarray] = {}
    per = (1 << TABLE_BITS) // SLICES
    for b in batches:
        at = (b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        for s in np.unique(at // per).tolist():
            own = bits.setdefault(s, np.zeros(per, bool))
            own[at[at // per == s] % per] = True
    for s, own in bits.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])


def bit_table(hashes: DataFrame) -> bytes:
    """The bit table of ``hashes(hash)``, put together from slices of fixed size."""
    piece = F.shiftrightunsigned("hash", 64 - SLICES.bit_length() + 1)
    with shuffle_files_go(hashes.sparkSession):
        parts = hashes.select("hash").repartition(SLICES, piece).mapInArrow(_slice_bits, "slice int, bits binary").collect()
    table, per = bytearray((1 << TABLE_BITS) // 8), (1 << TABLE_BITS) // 8 // SLICES
    for p in parts:
        table[p.slice * per : (p.slice + 1) * per] = p.bits
    return bytes(table)


def shared_table(docs: DataFrame, length: int = LENGTH) -> bytes:
    """The bit table of the least hashes that occur in two documents or more of ``docs(doc, text)``."""
    seen = docs.mapInArrow(_hashed(length), "hash long, doc long")
    return bit_table(seen.groupBy("hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most"))


def _segments(table, length: int, with_bytes: bool):
    """``(doc, th, start, n, hash, k1)`` for runs of windows whose hash is in the table, or ``(hash, k1, doc, segment)``.

    ``th`` is the text's hash, as Spark's ``xxhash64`` gives it, which tells texts of one id apart.  ``k1`` hashes the whole segment; with the least hash of its windows it makes a key of 128 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        for b in batches:
            doc, texts = b.column(0).to_numpy(), _bytes(b.column(1))
            if not with_bytes:
                th = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64)
            for number, start, count, m in _runs(texts, length):
                at = (m >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                hit = bits[at >> 3] >> (at & 7) & 1 == 1
                number, start, count, m = number[hit], start[hit], count[hit], m[hit]
                seg = [texts[i][s : s + n + length - 1] for i, s, n in zip(number.tolist(), start.tolist(), count.tolist(), strict=True)]
                k1 = np.array([xxhash.xxh3_64_intdigest(s) for s in seg], np.uint64).view(np.int64)
                own, h = doc[number], m.view(np.int64)
                if with_bytes:  # of equal segments of a part the one of the least document
                    order = np.lexsort((own, k1, h))
                    new = (np.diff(h[order]) != 0) | (np.diff(k1[order]) != 0)
                    order = order[np.concatenate([[True], new])] if len(order) else order
                    cols = [pa.array(h[order]), pa.array(k1[order]), pa.array(own[order]), pa.array([seg[i] for i in order.tolist()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["hash", "k1", "doc", "segment"])
                else:
                    cols = [pa.array(own), pa.array(th[number]), pa.array(start), pa.array(count), pa.array(h), pa.array(k1)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc", "th", "start", "n", "hash", "k1"])

    return run


@dataclass
class Shard:
    """A shard's multi-string transform: for each of its suffixes, in order, what stands before it and where that leads.

    Symbols are ``step`` bytes, 0 where the string begins.  ``left`` is the row of the suffix that begins with the symbol,
    ``string`` and ``offset`` say whose suffix a row is.
    """

    symbol: np.ndarray
    left: np.ndarray
    string: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, strings: list[bytes], step: int) -> Shard:
        """Suffixes are ordered as bytes, ends first; equal ones as their strings are.  No byte may be 255."""
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        width = int(size.max()) + step
        flat = np.zeros(len(strings) * 2 * width + step, np.uint8)  # each string with zeros behind, bytes are one more
        begin = np.arange(len(strings)) * 2 * width + step
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(begin, size) + inside] = np.frombuffer(b"".join(strings), np.uint8) + 1
        rows = size + step  # suffixes of a string: those of its bytes, and an empty one for each phase
        string = np.repeat(np.arange(len(strings)), rows)
        offset = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
        place = begin[string] + offset
        suffix = np.lib.stride_tricks.sliding_window_view(flat, width)[np.minimum(place, len(flat) - width)]
        order = np.argsort(np.ascontiguousarray(suffix).view(f"S{width}").ravel(), kind="stable")
        row_of = np.empty(len(order), np.int32)
        row_of[order] = np.arange(len(order), dtype=np.int32)
        string, offset, place = string[order], offset[order], place[order]
        symbol = flat[place - 1].astype(np.uint16)
        if step == 2:
            symbol |= flat[place - 2].astype(np.uint16) << 8
        first = np.cumsum(rows) - rows
        begins = offset < step
        left = np.where(begins, -1, row_of[first[string] + np.maximum(0, offset - step)])
        return cls(np.where(begins, 0, symbol).astype(np.uint16), left.astype(np.int32), string.astype(np.int32), offset.astype(np.int32))


def merge(symbol: np.ndarray, left: np.ndarray, need: np.ndarray, depth: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement of shards' transforms, their rows one after the other, to ``depth`` bytes.

    Each round carries the interleave one symbol further: a stable bucket pass by what stands before each row.  A shard's
    rows never change their order among themselves, and rows stay in one block while they agreed in all symbols so far.
    ``need`` is the depth to which a row's block is asked for; rows leave when that is passed.  Returns the rows that are
    left, in merged order, and the number of each one's block: an interval of common prefix ``depth`` or more.
    """
    need = np.append(need, -1)
    order, block = np.arange(len(symbol), dtype=np.int32), np.zeros(len(symbol), np.int32)
    for reached in range(step, depth + 1, step):
        to = left[order]
        stays = need[to] >= reached
        to, own, before = to[stays], symbol[order[stays]], block[stays]
        by = np.argsort(own, kind="stable")
        order, own, before = to[by], own[by], before[by]
        new = (own[1:] != own[:-1]) | (before[1:] != before[:-1])
        block = np.concatenate([np.zeros(min(1, len(by)), np.int32), np.cumsum(new, dtype=np.int32)])
    return order, block


def window_hashes(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of every window of ``length`` bytes; equal windows have equal ones."""
    h, width = np.ndarray((len(data),), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,)).copy(), 8
    if length < width:
        h &= np.uint64((1 << 8 * length) - 1)
        return h[: len(data) - length + 1] * _A
    while width < length:
        ahead = min(width, length - width)  # the last two overlap
        h = h[:-ahead] * _A + h[ahead:]
        h ^= h >> np.uint64(29)
        h *= _B
        width += ahead
    return h[: len(data) - length + 1]


def least_documents(segments: list[bytes], doc: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each segment the least document in whose segments the window occurs."""
    windows = np.fromiter(map(len, segments), np.int64, len(segments)) - length + 1
    return np.split(_least(segments, doc, windows, length), np.cumsum(windows)[:-1])


def _least(segments: list[bytes], doc: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """``least_documents``, one after the other.

    A window whose hash no other has is not repeated.  Runs of all others are the strings that are transformed, equal ones once.
    """
    data = np.frombuffer(b"".join(segments), np.uint8)
    owner = np.repeat(np.arange(len(segments)), windows)
    place = np.arange(len(owner)) + owner * (length - 1)
    key = window_hashes(data, length)[place]
    order = np.argsort(key)
    same = np.append(np.diff(key[order]) == 0, False)
    again = np.empty(len(key), bool)
    again[order] = same | np.roll(same, 1)
    out = doc[owner]
    opens = again & ~(np.roll(again, 1) & (owner == np.roll(owner, 1)))
    if len(opens):
        opens[0] = again[0]
    begin = np.flatnonzero(opens)
    if not len(begin):
        return out
    at = np.flatnonzero(again)
    run = np.cumsum(opens)[at] - 1
    size = np.bincount(run)
    text, number = data.tobytes(), {}
    own = [number.setdefault(text[p : p + n + length - 1], len(number)) for p, n in zip(place[begin].tolist(), size.tolist(), strict=True)]
    own = np.array(own)
    least = np.full(len(number), NO_ID)
    np.minimum.at(least, own, out[begin])
    strings = list(number)
    of = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
    found = _transformed(strings, least, of, length)
    out[at] = found[(np.cumsum(of) - of)[own][run] + at - begin[run]]
    return out


def _transformed(strings: list[bytes], doc: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """``_least`` by shards' transforms and their merge."""
    step, at, rows, shards = (2 if length % 2 == 0 else 1), 0, 0, []
    while at < len(strings):
        end, size = at, 0
        while end < len(strings) and (end == at or size < SHARD_BYTES):
            size += len(strings[end])
            end += 1
        own = Shard.of(strings[at:end], step)
        own.string += at
        own.left[own.left >= 0] += rows
        rows += len(own.symbol)
        shards.append(own)
        at = end
    symbol, left, string, offset = (np.concatenate([getattr(x, k) for x in shards]) for k in ("symbol", "left", "string", "offset"))
    need = np.minimum(length, length - 1 + windows[string] - offset).astype(np.int16)  # what stands behind the windows only continues them
    row, block = merge(symbol, left, need, length, step)
    least = np.minimum.reduceat(doc[string[row]], np.flatnonzero(np.concatenate([[True], np.diff(block) != 0])))
    first = np.cumsum(windows) - windows
    out = np.empty(windows.sum(), np.int64)
    out[first[string[row]] + offset[row]] = least[block]
    return out


def _resolved(length: int):
    """``(hash, salt, k1, least)`` for segments sorted by hash and salt; ``least`` has one entry if it is the same for all windows."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        segments = rows.column(4).to_pylist()
        windows = np.fromiter(map(len, segments), np.int64, len(segments)) - length + 1
        least = _least(segments, rows.column(3).to_numpy(), windows, length)
        first = np.cumsum(windows) - windows
        one = np.minimum.reduceat(least, first) == np.maximum.reduceat(least, first)
        kept = ~np.repeat(one, windows)
        kept[first] = True
        ends = np.concatenate([[0], np.cumsum(np.where(one, 1, windows))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(least[kept]))
        return pa.RecordBatch.from_arrays([*(rows.column(k).combine_chunks() for k in range(3)), lists], ["hash", "salt", "k1", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            if not len(b):
                continue
            h, salt = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(4)).to_numpy(), dtype=np.int64)])
            opens = np.flatnonzero(np.concatenate([[(h[0], salt[0]) != last], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]))
            at, done = 0, 0
            for i, end in zip(opens.tolist(), ends[opens].tolist(), strict=True):
                if size + end - done >= MERGE_BYTES:
                    yield flush([*held, b.slice(at, i - at)])
                    held, size, at, done = [], 0, i, end
            held.append(b.slice(at))
            size, last = size + int(ends[-1]) - done, (h[-1], salt[-1])
        if held:
            yield flush(held)

    return run


def removed(texts: list[bytes], number: np.ndarray, start: np.ndarray, mask: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which bytes of the texts, one after the other, go: windows from ``start`` on in text ``number`` where ``mask`` has bits."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size) - size
    bits = np.unpackbits(np.ascontiguousarray(mask, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    span, j = np.nonzero(bits)
    at = (first[number] + start)[span] + j
    change = np.bincount(at, minlength=size.sum() + 1) - np.bincount(at + length, minlength=size.sum() + 1)
    return np.cumsum(change)[:-1] > 0


def _parts(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in parts of ``PART_BYTES`` or one text, so that what is held does not depend on Arrow's batches."""
    at, texts, size = 0, [], 0
    for i, t in enumerate(b.column(1)):
        texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size >= PART_BYTES:
            yield b.slice(at, len(texts)), texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield b.slice(at, len(texts)), texts


def _kept(length: int, with_text: bool):
    def part(b: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        spans = b.column(2)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(size) - size
        counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        gone = removed(texts, np.repeat(np.arange(len(texts)), counts), flat.field("start").to_numpy(), flat.field("mask").to_numpy(), length)
        all_bytes = np.frombuffer(b"".join(texts), np.uint8)
        opens = gone & ~np.concatenate([[False], gone[:-1]])
        opens[first[size > 0]] = gone[first[size > 0]]  # a run ends with its text
        rows = []
        for t, at, n, some in zip(texts, first.tolist(), size.tolist(), (counts > 0).tolist(), strict=True):
            if not some:
                rows.append((n, 0, 0, hashlib.sha256(t).hexdigest(), t if with_text else None))
                continue
            rest = all_bytes[at : at + n][~gone[at : at + n]].tobytes()
            rows.append((n, n - len(rest), int(opens[at : at + n].sum()), hashlib.sha256(rest).hexdigest(), rest if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        cols = (pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))
        return pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, texts in _parts(b):
                yield part(own, texts)

    return run


def _split(pieces: DataFrame, several: DataFrame, length: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of hashes with more than ``limit`` of them: their windows alone, ``(hash, salt, k1, doc, segment, i)``.

    Equal windows get the same salt, so they still meet, and no task holds all strings of a hot hash.
    """
    hot = several.where(F.col("n") > limit).select(F.col("hash").alias("_hash"), F.ceil(F.col("n") * length / limit).alias("_parts"))
    cool = pieces.join(hot, F.col("hash") == F.col("_hash"), "left_anti").select("hash", F.lit(0).cast("long").alias("salt"), "k1", "doc", "segment")
    each = pieces.join(hot, F.col("hash") == F.col("_hash")).select("hash", "_parts", "k1", "doc", "segment", F.explode(F.sequence(F.lit(0), F.octet_length("segment") - length)).alias("i"))
    each = each.select("hash", "_parts", "k1", "doc", "i", F.substring("segment", F.col("i") + 1, F.lit(length)).alias("segment"))
    each = each.select("hash", F.pmod(F.xxhash64("segment"), F.col("_parts")).alias("salt"), "k1", "doc", "i", "segment")
    return cool, each


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True, hot_segments: int = HOT_SEGMENTS, join_parts: int = JOIN_PARTS) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for each row of ``docs``; integer ids."""
    scratch = Scratch(spark, "substrings")
    kind = docs.schema[id_col].dataType.simpleString()
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    own = docs.select(doc.alias("doc"), F.col(text_col).alias("text"))
    table = spark.sparkContext.broadcast(shared_table(own, length))
    seen = own.mapInArrow(_segments(table, length, False), "doc long, th long, start long, n long, hash long, k1 long")
    seen = scratch.save(seen, "segments")
    strings = seen.groupBy("hash", "k1").agg(F.min("doc").alias("doc"))
    counted = strings.groupBy("hash").agg(F.count("*").alias("n"), F.min("k1").alias("k1"), F.min("doc").alias("doc"))
    counted = scratch.save(counted, "counted")
    alone = counted.where("n = 1").select(F.col("hash").alias("_hash"), F.col("k1").alias("_k1"), F.array("doc").alias("least"))  # all windows are its least document's
    several = counted.where("n > 1")
    mixed = spark.sparkContext.broadcast(bit_table(several))
    pieces = own.mapInArrow(_segments(mixed, length, True), "hash long, k1 long, doc long, segment binary")
    pieces = pieces.groupBy("hash", "k1").agg(F.min("doc").alias("doc"), F.min("segment").alias("segment"))
    is_hot = not several.where(F.col("n") > hot_segments).isEmpty()
    cool, each = _split(scratch.save(pieces, "pieces"), several, length, hot_segments) if is_hot else (pieces.select("hash", F.lit(0).cast("long").alias("salt"), "k1", "doc", "segment"), None)
    found = "hash long, salt long, k1 long, least array<bigint>"
    by_hash = lambda df: df.select("hash", "salt", "k1", "doc", "segment").repartition("hash", "salt").sortWithinPartitions("hash", "salt").mapInArrow(_resolved(length), found)
    least = by_hash(cool).select(F.col("hash").alias("_hash"), F.col("k1").alias("_k1"), "least")
    if each is not None:
        each = scratch.save(each.withColumn("own", F.xxhash64("segment")), "each")
        lone = scratch.save(by_hash(each.groupBy("hash", "salt", F.col("own").alias("k1")).agg(F.min("doc").alias("doc"), F.min("segment").alias("segment"))), "lone")
        lone = lone.select(F.col("hash").alias("_h"), F.col("k1").alias("_own"), F.col("least")[0].alias("_least"))
        back = each.join(lone, (F.col("hash") == F.col("_h")) & (F.col("own") == F.col("_own"))).groupBy("hash", "k1").agg(F.array_sort(F.collect_list(F.struct("i", "_least"))).alias("all"))
        least = least.unionByName(back.select(F.col("hash").alias("_hash"), F.col("k1").alias("_k1"), F.col("all._least").alias("least")))
    resolved = scratch.save(least, "least")
    least = resolved.unionByName(alone)
    each = F.expr("aggregate(sequence(0, size(least) - 1), 0L, (m, j) -> m | CASE WHEN least[j] < doc THEN shiftleft(1L, j) ELSE 0L END)")
    mask = F.when(F.size("least") > 1, each).when(F.col("least")[0] < F.col("doc"), F.expr("shiftleft(1L, CAST(n AS INT)) - 1")).otherwise(F.lit(0))
    parts = []
    for k in range(join_parts):
        own, of = seen.where(F.pmod("hash", F.lit(join_parts)) == k), least.where(F.pmod("_hash", F.lit(join_parts)) == k)
        hit = own.join(of, (F.col("hash") == F.col("_hash")) & (F.col("k1") == F.col("_k1")))
        parts.append(scratch.save(hit.select("doc", "th", "start", mask.alias("mask")).where("mask <> 0"), "part"))
    scratch.drop(seen, counted, resolved)
    gone = reduce(DataFrame.unionByName, parts)
    spans = gone.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("start", "mask")).alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.drop(*parts)
    rows = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(spans, (F.col("doc") == F.col("_doc")) & (F.xxhash64("text") == F.col("_th")), "left")
    return rows.select("id", "text", "spans").mapInArrow(_kept(length, with_text), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
