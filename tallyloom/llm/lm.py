"""Language-model scores by online logistic context mixing.

A text is its lower-cased (A-Z) words and one end.  Every word is a sequence of bits: the path to it in a Huffman tree of
the frequent training words, or the path to an escape and then, byte by byte, the paths in a tree of bytes, up to a blank.
Each bit is predicted in ``ORDERS`` contexts, hashed with the tree's node into one table of bit counts: for words none,
the word before, the two words before; for bytes the one, two and four bytes before, which reach into the word before.
The counts' logits are added with weights that a gate selects (words or bytes, and how sure the two longest contexts are),
and an adaptive map refines the result.  A document's score is the sum over all its bits.

The model learns the whole texts of all training documents online, repeats counted: for every ``SLICE`` tokens it
predicts, corrects weights and map by the error, then counts.  That runs in shards.  A document's shard and place in it
are hashes of the document, the number of shards follows from the training bytes, and shards' counts are added up and
their weights averaged by use in an order of their own, so scores do not depend on how rows are partitioned.

What tasks hold is bounded: the table grows with the training bytes up to ``MAX_TABLE_BITS``, the words held in memory
are ``FREQUENT_WORDS`` at most; counts of all other words, for the base score, go through a join, and those are rare by
construction, so no key is hot.

Rules for odd rows: a null text is an empty one; an empty text is an end alone; repeated rows score alike and count
each; a row with a null id is not held out; without training documents the untrained mixer decides alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch

FOLDS, HELD_OUT = 7, 2
END = b"\n"  # the end token: no word holds this byte
ORDERS = 3
TABLE_BITS, MAX_TABLE_BITS = 20, 23  # one slot for 256 bytes of training text or more, between these
BLOCK = 4096  # slots that are added up together
FREQUENT_WORDS = 200_000
COUNTED_BYTES = 4 << 20  # of text whose words are counted at a time
SLICE = 4_096  # tokens between two corrections
PART = 64 * SLICE  # tokens held at a time
SHARD_BYTES = (64 << 20, 1 << 30)  # of training text: a 256th of it, between these
RATE = 0.25
BUCKETS = 24  # of the adaptive map
_GATES = 32
_PRIOR = np.float32(0.4)
_MASK = np.int64(0xFFFFFFFF)
_BYTE_NODES = np.uint32(1 << 24)  # numbers of the byte tree's nodes start here
_N, _P, _Q, _R = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


@dataclass
class Code:
    """Paths of a Huffman tree: symbol i has ``node`` and ``bit`` from ``start[i]`` on, ``length[i]`` of them."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @classmethod
    def of(cls, weights: list[int]) -> Code:
        """Two symbols at least; ties by number."""
        n = len(weights)
        leaves = sorted(range(n), key=lambda i: (weights[i], i))
        total, up, side = [weights[i] for i in leaves] + [0] * (n - 1), np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        leaf, inner = 0, n  # nodes in the order of their weights: leaves, then inner ones
        for made in range(n, 2 * n - 1):
            for bit in (0, 1):
                if leaf < n and (inner >= made or total[leaf] <= total[inner]):
                    child, leaf = leaf, leaf + 1
                else:
                    child, inner = inner, inner + 1
                up[child], side[child] = made, bit
                total[made] += total[child]
        depth = np.zeros(2 * n - 1, np.int64)
        for child in range(2 * n - 3, -1, -1):
            depth[child] = depth[up[child]] + 1
        length = np.empty(n, np.int64)
        length[leaves] = depth[:n]
        start = np.cumsum(length) - length
        node, bit = np.zeros(length.sum(), np.uint32), np.zeros(length.sum(), np.uint8)
        at, where = np.arange(n), start[leaves] + depth[:n] - 1
        left = depth[:n].copy()
        while left.any():
            on = left > 0
            node[where[on]], bit[where[on]] = up[at[on]] - n, side[at[on]]
            at, where, left = np.where(on, up[at], at), where - on, left - on
        return cls(start, length, node, bit)

    @cached_property
    def steps(self) -> np.ndarray:
        """Node and bit of each place in one number, made once a process."""
        return self.node << np.uint32(1) | self.bit

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and bits of all symbols one after the other, and the number of each symbol's."""
        n = self.length.take(symbols)
        ends = np.cumsum(n)
        at = np.repeat(self.start.take(symbols) - (ends - n), n)
        at += np.arange(len(at))
        step = self.steps.take(at, mode="clip")  # in range: "clip" only spares the check
        bit = step.astype(np.uint8)
        bit &= np.uint8(1)
        step >>= np.uint32(1)
        return step, bit, n


@dataclass
class Words:
    """The frequent words of the training documents and both trees."""

    number: dict[bytes, int]  # 0 is the escape, 1 the end
    code: Code
    spelling: Code

    @classmethod
    def of(cls, frequent: list[tuple[bytes, int]], ends: int, rare: int, letters: np.ndarray) -> Words:
        own = sorted(((w, c) for w, c in frequent if w != END), key=lambda x: (-x[1], x[0]))
        number = {END: 1} | {w: i for i, (w, _) in enumerate(own, 2)}
        return cls(number, Code.of([rare + 1, ends + 1, *(c for _, c in own)]), Code.of([int(x) + 1 for x in letters]))


@dataclass
class Mixer:
    """Gated weights and the adaptive map."""

    weights: np.ndarray  # (_GATES, ORDERS)
    map: np.ndarray  # (_GATES, BUCKETS): probabilities

    @classmethod
    def new(cls) -> Mixer:
        centre = (np.arange(BUCKETS) - (BUCKETS - 1) / 2) / (BUCKETS - 1) * 16
        return cls(np.full((_GATES, ORDERS), 1.5 / ORDERS, np.float32), np.tile(1 / (1 + np.exp(-centre)), (_GATES, 1)).astype(np.float32))

    def predict(self, logit: np.ndarray, spelled: np.ndarray) -> tuple:
        """Gates, mixed probabilities and map places of ones from logits (ORDERS, n)."""
        sure = np.abs(logit[1:])
        level = (sure > 0).view(np.int8) + (sure > 1.6).view(np.int8) + (sure > 3.5).view(np.int8)
        gate = (spelled * np.int8(16) + level[0] * np.int8(4) + level[1]).astype(np.int64)
        mixed = self.weights[:, 0].take(gate, mode="clip")
        mixed *= logit[0]
        for j in range(1, ORDERS):
            part = self.weights[:, j].take(gate, mode="clip")
            part *= logit[j]
            mixed += part
        np.clip(mixed, -12, 12, out=mixed)
        p = np.exp(-mixed)
        p += 1
        np.divide(np.float32(1), p, out=p)
        mixed += 8
        mixed *= np.float32((BUCKETS - 1) / 16)
        np.rint(mixed, out=mixed)
        np.clip(mixed, 0, BUCKETS - 1, out=mixed)
        place = mixed.astype(np.int64)
        place += gate * BUCKETS
        return gate, p, place

    def refine(self, p: np.ndarray, place: np.ndarray) -> np.ndarray:
        refined = self.map.ravel().take(place, mode="clip")
        refined += p
        refined /= 2
        np.clip(refined, 1e-6, 1 - 1e-6, out=refined)
        return refined

    def correct(self, used: np.ndarray, logit: np.ndarray, bit: np.ndarray, gate: np.ndarray, p: np.ndarray, place: np.ndarray) -> None:
        ones = np.bincount(place * 2 + bit, minlength=_GATES * BUCKETS * 2).reshape(-1, 2)
        m, hit = ones.sum(1), ones[:, 1]
        n = m.reshape(_GATES, BUCKETS).sum(1)
        error = bit - p
        for j in range(ORDERS):
            self.weights[:, j] += RATE * np.bincount(gate, error * logit[j], _GATES) / np.maximum(n, 1)
        used += n
        flat = self.map.reshape(-1)
        flat += np.where(m > 0, (hit / np.maximum(m, 1) - flat) * np.minimum(0.5, m / (m + 500)), 0)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Stream:
    """The tokens of some texts, and the bits of any slice of them with their contexts' slots."""

    def __init__(self, words: Words, texts: list[list[bytes]], table_bits: int):
        self.words, self.shift = words, np.uint32(32 - table_bits)
        self.all = [w for t in texts for w in t]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(sizes) - sizes
        self.symbol = np.fromiter(map(words.number.get, self.all, repeat(0)), np.int64, len(self.all))
        own = self.symbol.astype(np.uint32) * _P
        self.rare = np.flatnonzero(self.symbol == 0)
        own[self.rare] = np.fromiter((zlib.crc32(self.all[i]) for i in self.rare.tolist()), np.uint32, len(self.rare)) * _Q
        opens = np.zeros(len(self.all) + 1, bool)
        opens[self.first] = True
        self.opens = opens[: len(self.all)]
        one = np.concatenate([np.zeros(1, np.uint32), own[:-1]]) if len(own) else own
        one[self.opens] = 0
        two = np.concatenate([np.zeros(1, np.uint32), one[:-1]]) if len(own) else own
        two[self.opens] = 0
        self.contexts = one * _R + np.uint32(2), one * _N + two * _Q + np.uint32(3)
        nodes = np.arange(len(words.code.length) - 1, dtype=np.uint32)
        self.alone = self._slots(np.uint32(1), nodes * _N).astype(np.int64)  # without words before, slots follow from nodes

    def _slots(self, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Of contexts and nodes times ``_N``."""
        h = context ^ node
        h *= _P
        h ^= h >> np.uint32(15)
        h *= _Q
        h >>= self.shift
        return h

    def _spelled(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Symbols, contexts and tokens of the letters of the rare words of a slice, each word with a blank behind."""
        at = self.rare[np.searchsorted(self.rare, a) : np.searchsorted(self.rare, b)]
        if not len(at):
            return None
        words, opens = self.all, self.opens.take(at).tolist()
        own = [(END * 4 if first else words[i - 1][-3:].rjust(3) + b" ") + words[i] + b" " for i, first in zip(at.tolist(), opens, strict=True)]
        s = np.frombuffer(b"".join(own), np.uint8)
        size = np.fromiter(map(len, own), np.int64, len(own)) - 4
        place = np.repeat(np.arange(len(own)) * 4, size)
        place += np.arange(len(place))
        four = np.ndarray(len(s) - 3, ">u4", s, strides=(1,)).astype(np.uint32).take(place)  # the nearest byte is the lowest
        contexts = np.stack([(four & np.uint32(0xFF)) * _R + np.uint32(4), (four & np.uint32(0xFFFF)) * _R + np.uint32(5), four * _R + np.uint32(6)])
        return s[4:].take(place).astype(np.int64), contexts, np.repeat(at, size)

    def slice(self, a: int, b: int, behind: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slots (ORDERS, n), bits, whether spelled, and tokens of the bits of tokens a to b.

        ``behind``: nodes' own places from there on stand for the slots ``alone``.
        """
        node, bit, n = self.words.code.bits(self.symbol[a:b])
        token, m = np.repeat(np.arange(a, a + len(n)), n), len(node)
        letters = self._spelled(a, b)
        more = 0
        if letters is not None:
            symbols, contexts, owner = letters
            to, own, k = self.words.spelling.bits(symbols)
            more = len(to)
        slots = np.empty((ORDERS, m + more), np.int64)
        if behind is None:
            slots[0, :m] = self.alone.take(node)
        else:
            np.add(node, behind, out=slots[0, :m])
        node *= _N
        for j, context in enumerate(self.contexts, 1):
            slots[j, :m] = self._slots(np.repeat(context[a:b], n), node)
        spelled = np.zeros(m + more, np.int8)
        if letters is None:
            return slots, bit, spelled, token
        node = (to + _BYTE_NODES) * _N
        for j in range(ORDERS):
            slots[j, m:] = self._slots(np.repeat(contexts[j], k), node)
        spelled[m:] = 1
        return slots, np.concatenate([bit, own]), spelled, np.concatenate([token, np.repeat(owner, k)])


@dataclass
class Model:
    words: Words
    mixer: Mixer
    logit: np.ndarray  # by slot

    @property
    def bits(self) -> int:
        return len(self.logit).bit_length() - 1

    @cached_property
    def table(self) -> np.ndarray:
        """Logits by slot, and behind them by node those without words before, which lie close together there."""
        return np.concatenate([self.logit, self.logit.take(Stream(self.words, [], self.bits).alone)])

    def scores(self, texts: list[list[bytes]]) -> tuple[np.ndarray, Stream]:
        """log10 probability of each token, and the tokens."""
        stream = Stream(self.words, texts, self.bits)
        out = np.zeros(len(stream.all))
        size = 4 * SLICE  # nothing is corrected: fewer, longer slices
        for a in range(0, len(out), size):
            slots, bit, spelled, token = stream.slice(a, min(a + size, len(out)), len(self.logit))
            _, p, place = self.mixer.predict(self.table.take(slots, mode="clip"), spelled)
            p = self.mixer.refine(p, place)
            p -= 1 - bit
            np.abs(p, out=p)
            np.log(p, out=p)
            ends = np.cumsum(self.words.code.length.take(stream.symbol[a : a + size]))  # paths lie one after the other, letters behind
            out[a : a + size] = np.add.reduceat(p[: ends[-1]], np.concatenate([[0], ends[:-1]]))
            out[a : a + size] += np.bincount(token[ends[-1] :] - a, p[ends[-1] :], len(ends))
        return out / np.log(10), stream


class Learner:
    """One shard: counts of zeros and ones in the low and high half of each slot."""

    def __init__(self, words: Words, bits: int):
        self.words, self.bits = words, bits
        self.mixer, self.used = Mixer.new(), np.zeros(_GATES)
        self.table = np.zeros((1 << bits) + len(words.code.length) - 1, np.int64)
        self.counts, self.own = self.table[: 1 << bits], self.table[1 << bits :]

    def learn(self, texts: list[list[bytes]]) -> None:
        """Slots without words before are copied by node, where they lie close together, and what these gain is added back."""
        stream = Stream(self.words, texts, self.bits)
        before = self.counts.take(stream.alone)
        self.own[:] = before
        for a in range(0, len(stream.all), SLICE):
            slots, bit, spelled, _ = stream.slice(a, min(a + SLICE, len(stream.all)), len(self.counts))
            halves = self.table.take(slots, mode="clip").view("<i4").astype(np.float32)
            halves += _PRIOR
            logit = halves[:, 1::2] / halves[:, ::2]
            np.log(logit, out=logit)
            gate, p, place = self.mixer.predict(logit, spelled)
            self.mixer.correct(self.used, logit, bit, gate, p, place)
            one = bit.astype(np.int64)
            one *= (1 << 32) - 1
            one += 1
            for j in range(ORDERS):
                np.add.at(self.table, slots[j], one)
        np.add.at(self.counts, stream.alone, self.own - before)


def table_bits(n_bytes: int) -> int:
    return min(MAX_TABLE_BITS, max(TABLE_BITS, n_bytes.bit_length() - 8))


def shard_count(n_bytes: int) -> int:
    low, high = SHARD_BYTES
    return max(1, -(-n_bytes // min(high, max(low, n_bytes // 256))))


def _learned(words, bits: int):
    """Rows sorted by shard -> a shard's table as ``(block, counts)``; block -1 holds sums of mixer and map, and their use."""

    def flush(own: Learner) -> Iterator[pa.RecordBatch]:
        used = own.used[:, None]
        yield _blocks([-1], [np.concatenate([(own.mixer.weights * used).ravel(), (own.mixer.map * used).ravel(), own.used]).astype(np.float64).tobytes()])
        pairs = np.stack([own.counts & _MASK, own.counts >> 32]).astype(np.float32).reshape(2, -1, BLOCK)
        some = np.flatnonzero(pairs.any(axis=(0, 2)))
        for at in range(0, len(some), 64):
            part = some[at : at + 64].tolist()
            yield _blocks(part, [pairs[:, k].tobytes() for k in part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, held, size = None, None, [], 0
        for b in batches:
            for number, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if number != shard or size >= PART:  # a batch of texts is closed by what is in the shard, not by Arrow
                    if held:
                        own.learn(held)
                        held, size = [], 0
                    if number != shard:
                        if own:
                            yield from flush(own)
                        own, shard = Learner(words.value, bits), number
                held.append([*tokens(text), END])
                size += len(held[-1])
        if held:
            own.learn(held)
        if own:
            yield from flush(own)

    return run


def _blocks(numbers: list[int], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.binary())], ["block", "counts"])


def _added(table: pa.Table) -> pa.Table:
    """The sum of one block over all shards."""
    kind = np.float64 if table.column(0)[0].as_py() < 0 else np.float32
    rows = sorted(table.column(1).to_pylist())  # in an order that does not depend on the tasks'
    total = np.zeros(len(rows[0]) // kind().itemsize, np.float64)
    for r in rows:
        total += np.frombuffer(r, kind)
    return pa.Table.from_batches([_blocks([table.column(0)[0].as_py()], [total.astype(kind).tobytes()])])


def train(spark: SparkSession, texts: DataFrame, words: Words, n_bytes: int) -> Model:
    """The model of all of ``texts(id, text)``; ids only order them."""
    bits, shards = table_bits(n_bytes), shard_count(n_bytes)
    held = spark.sparkContext.broadcast(words)
    key = F.xxhash64("id", "text")
    rows = texts.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), "text", key.alias("key"), F.xxhash64(F.lit("again"), "text").alias("key2"))
    rows = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "key", "key2").select("shard", "text")  # a hash would deal few numbers unevenly
    sums = rows.mapInArrow(_learned(held, bits), "block int, counts binary").groupBy("block").applyInArrow(_added, "block int, counts binary").toArrow()
    counts, mixer = np.zeros((2, 1 << bits), np.float32), Mixer.new()
    for block, value in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True):
        if block >= 0:
            counts[:, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(value, np.float32).reshape(2, BLOCK)
            continue
        own = np.frombuffer(value, np.float64)
        used = own[-_GATES:]
        ok = used > 0
        mixer.weights[ok] = own[: _GATES * ORDERS].reshape(_GATES, ORDERS)[ok] / used[ok, None]
        mixer.map[ok] = own[_GATES * ORDERS : -_GATES].reshape(_GATES, BUCKETS)[ok] / used[ok, None]
    return Model(words, mixer, np.log((counts[1] + _PRIOR) / (counts[0] + _PRIOR)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task's documents: ``(word, n)``, n in training documents."""
    parts, size = [], 0
    for b in batches:
        for held in (False, True):
            texts = b.column(0).filter(pc.equal(b.column(1), held)).fill_null("")
            for part in _cut(texts):
                parts.append(_counts(part, held))
                size += len(parts[-1])
                if size > 1_000_000:  # what a task holds is bounded; Spark adds the parts up
                    parts = [_summed(parts)]
                    size = len(parts[0])
                    if size > 500_000:
                        yield from parts[0].to_batches()
                        parts, size = [], 0
    if parts:
        yield from _summed(parts).to_batches()


def _cut(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in parts of ``COUNTED_BYTES`` or a text more."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // COUNTED_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def _counts(texts: pa.Array, held: bool) -> pa.Table:
    """Counts of the words that ``tokens`` gives, by Arrow, and of the ends; of held-out texts zeros."""
    found = pc.value_counts(pc.ascii_split_whitespace(pc.ascii_lower(texts)).flatten())
    word, n = found.field("values").cast(pa.binary()), found.field("counts")
    if held:
        n = pa.array(np.zeros(len(n), np.int64))
    own = pa.table({"word": word, "n": n}).filter(pc.greater(pc.binary_length(word), 0))  # blanks at a text's ends leave empty words
    return own if held else pa.concat_tables([own, pa.table({"word": pa.array([END]), "n": pa.array([len(texts)])})])


def _summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def held_out(id_col: str, folds: int = FOLDS) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == HELD_OUT, F.lit(False))


@dataclass
class Totals:
    n: int  # training tokens
    v: int  # distinct training tokens

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(letter, n)``: bytes of words by their counts, each word with a blank behind."""
    total = np.zeros(256, np.int64)
    for b in batches:
        words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
        s = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        total += np.bincount(s, np.repeat(n, size), 256).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["letter", "n"])


def _scored(model, base, end_known: bool):
    """Score of each document and sums over its frequent words; what is left goes on as a list of words and numbers."""

    def part(b: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        each, stream = model.value.scores(texts)
        known = base.value.take(stream.symbol)
        sums = [np.add.reduceat(x, stream.first) for x in (each, np.where(stream.symbol > 0, known, 0), (stream.symbol > 1) | end_known & (stream.symbol == 1))]
        left: list[Counter] = [Counter() for _ in texts]
        row = np.searchsorted(stream.first, stream.rare, side="right") - 1
        for i, r in zip(stream.rare.tolist(), row.tolist(), strict=True):
            left[r][stream.all[i]] += 1
        cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array(sums[2].astype(np.int64)), pa.array(sums[1].astype(np.float64)), pa.array(sums[0])]
        cols += [pa.array([list(x) for x in left], pa.list_(pa.binary())), pa.array([list(x.values()) for x in left], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], "n_tokens", "n_known", "base_score", "score", "words", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # in parts, so that what is held does not depend on Arrow's batches
            texts, size, at = [], 0, 0
            for i, t in enumerate(b.column(b.num_columns - 1)):
                texts.append([*tokens(t.as_py()), END])
                size += len(texts[-1])
                if size >= PART:
                    yield part(b.slice(at, len(texts)), texts)
                    texts, size, at = [], 0, i + 1
            if texts:
                yield part(b.slice(at, len(texts)), texts)

    return run


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` for each row of ``docs``."""
    scratch = Scratch(spark, "lm")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counts = own.select("text", "held_out").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = scratch.save(counts, "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    totals = Totals(n, v)
    training = own.where(~F.col("held_out"))
    n_bytes = training.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    step = F.floor(8 * F.log2(F.col("c") + 1))
    steps = counts.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    room, least = FREQUENT_WORDS, None  # steps of an eighth of a doubling: a few hundred rows
    for s in steps:
        room -= s.n
        if room < 0:
            break
        least = s.step
    is_known = (F.col("c") > 0) & (step >= (2**40 if least is None else least)) | (F.col("word") == F.lit(END))
    frequent = counts.where(is_known).toArrow()  # at most FREQUENT_WORDS rows and the end
    pairs = list(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), strict=True))
    ends = dict(pairs).get(END, 0)
    rare = counts.where(~is_known)
    letters = np.zeros(256, np.int64)
    for r in rare.where("c > 0").mapInArrow(_letters, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():  # 256 rows
        letters[r.letter] = r.n
    words = Words.of(pairs, ends, n - sum(c for _, c in pairs), letters)
    base = np.zeros(len(words.number) + 1)
    for w, c in [(END, ends), *pairs]:
        base[words.number[w]] = totals.base(c)
    model = spark.sparkContext.broadcast(train(spark, training.select("id", "text"), words, n_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<bigint>"
    parts = own.mapInArrow(_scored(model, spark.sparkContext.broadcast(base), ends > 0), schema)
    parts = scratch.save(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    each = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("k"))
    log_all = float(np.log10(n + v + 1))
    sums = each.join(rare, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_known"),
        F.sum(F.col("k") * (F.log10(F.col("c") + 1) - log_all)).alias("_base"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.join(sums, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("_base")).alias("base_score"),
        "score",
        F.try_divide(-F.col("score") / float(np.log10(2)), F.col("n_bytes")).alias("bits_per_byte"),
    )
