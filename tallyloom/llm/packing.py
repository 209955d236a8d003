"""Best-fit packing of tokenised documents into sequences of a fixed capacity, bulk-synchronously.

Documents longer than the capacity are cut into full pieces from the end, so only the first piece can be shorter; full
pieces are sequences of their own.  All other pieces go through rounds.  A round range-sorts pieces and gaps together
by size, descending, gaps first among equals, and sweeps: a gap opens a bracket and a piece closes the nearest open one,
which is its successor, the least gap that holds it among those that no larger or earlier piece has taken.  The
sweep is distributed as bracket matching: partitions sum their brackets, the sums of the partitions before give each
row its depth, and rows of equal depth, in order, pair off.  That rank settles every conflict, so a gap takes one piece a
round.  Then gaps shrink and the rest goes into the next round.  New sequences are opened for the longest rest only
when its volume exceeds the free space, or when nothing fits any more, so a round never opens more than the bound needs.

Every size of input goes through these rounds; only the last ``LAST_ITEMS`` pieces, a constant, are placed by the same rule
one after the other, for which that many gaps of each size are enough, and never before ``LEAST_SWEEPS`` rounds.

Rules for odd rows: a null text is an empty one; an empty text is one piece of the end token alone; repeated rows and
repeated or null ids are documents of their own; strings of special tokens in a text are these tokens, as the tokenizer
file has them; very long texts and runs of blanks are encoded whole; a capacity below one is an error.
"""

from __future__ import annotations

import bisect
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .store import Scratch

CAPACITY = 2048
END_ID = 0
LAST_ITEMS, LEAST_SWEEPS = 1_024, 2
LONG_RUN = 1_000  # blanks in a row that are cut out before the pattern runs, which would recurse over them
ROWS_A_TASK = 200_000

# Fixed value: the split pattern of byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANKS = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_BLANKS = re.compile(f"{_BLANKS}{{{LONG_RUN},}}")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """``text -> ids`` as little-endian unsigned 32-bit bytes, for the tokenizer file at ``path``.

    Byte-level BPE whose ids are its merge ranks is run by ``tiktoken``, which gives the same ids as ``tokenizers`` and is
    faster; any other file is run by ``tokenizers``.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
    odd = any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or odd:
        slow = Tokenizer.from_file(path)
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    letters = _byte_letters()
    special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
    at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def pack(text: str) -> bytes:
        return np.array(core.encode_ordinary(text), "<u4").tobytes()

    def ordinary(text: str) -> bytes:
        if len(text) < LONG_RUN or not _LONG_BLANKS.search(text):
            return pack(text)
        out, at = [], 0
        for run in _LONG_BLANKS.finditer(text):  # all but its last blank are one chunk, or all at the text's end
            end = run.end() - (run.end() < len(text))
            out += [pack(text[at : run.start()]), blanks(run.string[run.start() : end])]
            at = end
        return b"".join([*out, pack(text[at:])])

    def blanks(run: str) -> bytes:
        return np.array(core._encode_single_piece(run), "<u4").tobytes()

    def encode(text: str) -> bytes:
        if at_special is None or not at_special.search(text):
            return ordinary(text)
        return b"".join(special[part] if part in special else ordinary(part) for part in at_special.split(text))

    return encode


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: full ones from the end, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _tokenised(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            row, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    row.append(i)
                    out.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            cols = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``; no shuffle, and no ids leave the task."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_tokenised(tokenizer_path, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _sweep() -> tuple:
    return F.desc("size"), F.asc("kind"), F.asc("id")



def _depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sum of brackets inside a partition: +1 for a gap (kind 0), -1 for a piece (kind 1)."""
    pid, total = TaskContext.get().partitionId(), 0
    for b in batches:
        step = 1 - 2 * b.column(1).to_numpy().astype(np.int64)
        depth = np.cumsum(step) + total
        total = int(depth[-1]) if len(depth) else total
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(depth), pid, np.int32)), pa.array(depth)], ["size", "kind", "id", "pid", "depth"])


def match(pending: DataFrame, gaps: DataFrame, n_rows: int, scratch: Scratch) -> DataFrame:
    """One successor sweep: ``pending(item, length)``, ``gaps(bin, gap)`` -> ``(item, length, bin, gap)``."""
    rows = gaps.selectExpr("gap AS size", "0 AS kind", "bin AS id").union(pending.selectExpr("length AS size", "1 AS kind", "item AS id"))
    tasks = 1 + n_rows // ROWS_A_TASK
    swept = rows.repartitionByRange(tasks, *_sweep()).sortWithinPartitions(*_sweep())
    swept = scratch.save(swept.mapInArrow(_depths, "size long, kind int, id long, pid int, depth long"), "sweep")
    totals = {r.pid: r.t for r in swept.groupBy("pid").agg(F.sum(1 - 2 * F.col("kind")).alias("t")).collect()}  # a row a task
    before, table = 0, []
    for pid in sorted(totals):
        table.append((pid, before))
        before += totals[pid]
    offsets = F.broadcast(scratch.spark.createDataFrame(table or [(0, 0)], "pid int, before long"))
    level = F.col("depth") + F.col("before") + F.col("kind")  # behind a gap, in front of a piece
    w = W.partitionBy("level").orderBy(*_sweep())
    paired = swept.join(offsets, "pid").withColumn("level", level).select("size", "kind", "id", F.lead(F.struct("kind", "id", "size")).over(w).alias("next"))
    paired = paired.where("kind = 0 AND next.kind = 1").selectExpr("next.id AS item", "next.size AS length", "id AS bin", "size AS gap")
    paired = scratch.save(paired, "paired", n_rows)
    scratch.drop(swept)
    return paired


def best_fit(items: list[tuple[int, int]], gaps: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """Serial rule: ``(item, length)`` longest first, each into the least gap that holds it, else a new sequence."""
    by_gap: dict[int, list[int]] = {}
    for b, g in gaps:
        by_gap.setdefault(g, []).append(b)
    sizes, out = sorted(by_gap), []
    for item, length in sorted(items, key=lambda x: (-x[1], x[0])):
        at = bisect.bisect_left(sizes, length)
        if at < len(sizes):
            gap = sizes[at]
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], sizes[at]
        else:
            gap, b = capacity, item
        out.append((item, b, capacity - gap))
        if gap > length:
            if gap - length not in by_gap:
                by_gap[gap - length] = []
                bisect.insort(sizes, gap - length)
            by_gap[gap - length].append(b)
    return out


def _finish(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        docs, gaps = frame[frame.kind == 1], frame[frame.kind == 0]
        rows = best_fit(list(zip(docs.id, docs["size"], strict=True)), list(zip(gaps.id, gaps["size"], strict=True)), capacity)
        return pd.DataFrame(rows, columns=["item", "bin", "offset"]).astype("int64")

    return run


def assign(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY, last_items: int = LAST_ITEMS) -> DataFrame:
    """``items(item long, length long)``, item distinct, 1 <= length <= capacity -> ``(item, bin, offset)``."""
    if capacity < 1:
        raise ValueError("the capacity must be one token at least")
    own = F.col("length") > capacity // 2  # no two of these share a sequence
    placed = [items.where(own).selectExpr("item", "item AS bin", "0L AS offset")]
    gaps = scratch.save(items.where(own & (F.col("length") < capacity)).selectExpr("item AS bin", f"{capacity}L - length AS gap"), "gaps")
    pending, sweeps = scratch.save(items.where(~own), "pending"), 0
    while True:
        sizes = {r.length: r.n for r in pending.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
        if not sizes:
            break
        n, least, volume = sum(sizes.values()), min(sizes), sum(k * v for k, v in sizes.items())
        fit = gaps.where(F.col("gap") >= least)
        n_gaps, space = fit.agg(F.count("*"), F.coalesce(F.sum("gap"), F.lit(0))).first()
        sweeps += 1
        if n <= last_items and sweeps > LEAST_SWEEPS:
            some = fit.withColumn("rank", F.row_number().over(W.partitionBy("gap").orderBy("bin"))).where(F.col("rank") <= last_items)
            rest = some.selectExpr("gap AS size", "0 AS kind", "bin AS id").union(pending.selectExpr("length AS size", "1 AS kind", "item AS id"))
            placed.append(scratch.save(rest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_finish(capacity), "item long, bin long, offset long"), "finish"))
            break
        old = (pending, gaps)
        paired, n_paired = None, 0
        if n_gaps:
            paired = match(pending, fit, n + n_gaps, scratch)
            n_paired, used = paired.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            volume, space = volume - used, space - used
        if n_paired:
            placed.append(paired.selectExpr("item", "bin", f"{capacity}L - gap AS offset"))
            taken = paired.selectExpr("bin AS _bin", "length")
            gaps = fit.join(taken, F.col("bin") == F.col("_bin"), "left").selectExpr("bin", "gap - coalesce(length, 0L) AS gap").where("gap > 0")
            pending = pending.join(paired.select("item"), "item", "left_anti")
            for length, k in paired.groupBy("length").count().collect():
                sizes[length] -= k
        new = math.ceil((volume - space) / capacity) if n_paired else math.ceil(volume / capacity)
        if new > 0:  # the longest of the rest, to that number, open sequences
            cut, more = 0, new
            for cut in sorted(sizes, reverse=True):
                if more <= sizes[cut]:
                    break
                more -= sizes[cut]
            rank = F.pmod(F.xxhash64("item"), F.lit(1_000_003)) < math.ceil(1_000_003 * more / max(1, sizes[cut]))
            pending = scratch.save(pending.withColumn("seed", (F.col("length") > cut) | (F.col("length") == cut) & rank), "seeded", n)
            seeds = pending.where("seed")
            placed.append(seeds.selectExpr("item", "item AS bin", "0L AS offset"))
            gaps = gaps.union(seeds.selectExpr("item AS bin", f"{capacity}L - length AS gap"))
            pending = pending.where("NOT seed").drop("seed")
        pending, gaps = scratch.save(pending, "pending", n), scratch.save(gaps.where(F.col("gap") >= least), "gaps", n + n_gaps)
        scratch.drop(*old)
    out = placed[0]
    for more in placed[1:]:
        out = out.union(more)
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every row of ``docs``."""
    scratch = Scratch(spark, "packing")
    cut = pieces(docs, tokenizer_path, capacity, id_col, text_col).withColumn("item", F.monotonically_increasing_id())
    cut = scratch.save(cut, "pieces")  # item numbers are fixed from here on
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < capacity)
    where = assign(rest.select("item", "length"), scratch, capacity).withColumnRenamed("bin", "sequence_id")
    return full.unionByName(rest.join(where, "item")).drop("item")
