"""Small fixtures against brute force; odd rows; equal results for repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallyloom.llm")

from tallyloom.llm import decontam, lines, lm, packing, pii, simhash, substrings, toxicity, vectors, warc
from tallyloom.llm.graph import components
from tallyloom.llm.queries import tokenizer_path
from tallyloom.llm.store import Scratch

WORDS = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "été", "straße", "Ω"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, a long text, exact and near copies, repeated rows, a clashing extra column."""
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randint(0, 120))) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(200, rows[7][1] + " more"), (201, None), (202, ""), (203, "  \n\t "), (3, rows[3][1]), (204, text(rng, 5000))]
    rows += [(205, rows[9][1] + "\n" + rows[8][1]), (206, "word"), (None, rows[5][1])]
    return spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, id string")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    nodes = {x for e in edges for x in e}
    want = union_find(edges, nodes)
    assert all(got.get(n, n) == want[n] for n in nodes)
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_tables_of_few_rows_get_few_files(spark, tmp_path, monkeypatch):
    """Executors start two processes a file on a local shared folder, whatever it holds."""
    monkeypatch.setattr("tallyloom.llm.store.shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(Scratch, "drop", lambda self, *tables: None)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("23", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        edges = spark.range(400).selectExpr("id AS u", "id - id % 10 AS v")
        got = {r.node: r.root for r in components(edges, Scratch(spark, "few"), 400).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 10 for i in range(400) if i % 10}
    tables = [p for p in tmp_path.glob("few-*/*")]
    assert len(tables) >= 3 and all(len(list(p.glob("*.parquet"))) == 1 for p in tables)


def test_scratch_tables_have_no_checksum_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tallyloom.llm.store.shared_dir", lambda spark: f"file://{tmp_path}")
    scratch = Scratch(spark, "own")
    table = scratch.save(spark.range(100).repartition(3), "numbers")
    assert sorted(r.id for r in table.collect()) == list(range(100))
    names = [p.name for p in tmp_path.rglob("*") if p.is_file()]
    assert any(n.endswith(".parquet") for n in names) and not any(n.endswith(".crc") for n in names)  # a process was started for each of them
    scratch.drop(table)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_packing(spark, docs):
    got = packing.pack(spark, docs, tokenizer_path(), 64).toPandas()
    encode = packing.encoder(tokenizer_path())
    assert len(got.groupby("sequence_id")) and got.groupby("sequence_id").length.sum().max() <= 64
    own = got.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id").length.cumsum() - own.length == own.offset).all()
    tokens = Counter()
    for i, t in rows_of(docs):
        ids = encode(t or "") + b"\0\0\0\0"
        for k, (s, n) in enumerate(packing.pieces_of(len(ids) // 4, 64)):
            tokens[i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])] += 1
    assert Counter((None if np.isnan(r.id) else int(r.id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == tokens
    assert packing.pack(spark, docs.where("false"), tokenizer_path(), 64).count() == 0


def test_packing_rounds_reach_the_serial_rule(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([rng.randint(1, 100), rng.randint(1, 30), 50])) for i in range(300)]
    df = spark.createDataFrame(items, "item long, length long")
    got = packing.assign(df, Scratch(spark, "t"), 100, last_items=3).toPandas()
    assert sorted(got["item"]) == [i for i, _ in items]
    length = dict(items)
    used = got.assign(n=got["item"].map(length)).sort_values(["bin", "offset"])
    assert used.groupby("bin").n.sum().max() <= 100 and (used.groupby("bin").n.cumsum() - used.n == used.offset).all()
    assert used.bin.nunique() <= 1.05 * len({b for _, b, _ in packing.best_fit(items, [], 100)}) + 1


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path())
    encode, rng = packing.encoder(tokenizer_path()), random.Random(3)
    parts = ["a", "foo", "é", " ", " ", "  ", "\n", "\t", "'s", "12", "!", "字", "\x1c", "\x85", "\u3000", "\xa0", "<|endoftext|>", "<|end", " " * 1005, "\n" * 1003]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    for t in [*texts, "hello <|endoftext|> world", "x" + " " * 1_000_000 + "y", "\n" * 1_000_000 + " b", "z" * 50_000]:
        assert np.frombuffer(encode(t), "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t[:80])
    assert len(encode(" " * 5_000_000)) > 0


def brute_substrings(rows, length):
    first, key = {}, lambda i: substrings.NO_ID if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, substrings.NO_ID), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_substrings_of_one_id_with_several_texts(spark):
    rng = random.Random(71)
    a, b = letters(rng, 90, 90), letters(rng, 200, 200)
    rows = [(1, a), (1, b), (1, a + b), (0, b[100:]), (2, None), (2, a[:60]), (2, a[:60]), (None, a), (None, b[:70])]
    got = substrings.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_substrings(rows, 50)


def test_substrings(spark, docs):
    got = substrings.dedup(spark, docs)
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_substrings(rows_of(docs), 50)
    assert substrings.dedup(spark, docs.where("false")).count() == 0


def test_hot_hashes_are_split(spark):
    rng = random.Random(61)
    base = letters(rng, 60, 60)
    rows = [(i, letters(rng, 0, 30) + base[rng.randint(0, 8) :] + letters(rng, 0, 40)) for i in range(60)]
    rows += [(100 + i, rng.choice(rows)[1][5:] + "é") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.dedup(spark, df, hot_segments=2)
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_substrings(rows, 50)


def test_segments_are_joined_in_parts(spark, monkeypatch):
    rng = random.Random(67)
    base = [letters(rng, 200, 200) for _ in range(12)]
    rows = [(i, letters(rng, 5, 60) + " ".join(rng.choice(base)[rng.randint(0, 90) :] for _ in range(3))) for i in range(60)]
    saved, save = Counter(), Scratch.save

    def counting(self, df, name):
        out = save(self, df, name)
        saved[name, sum(n == name for n, _ in saved)] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counting)
    got = substrings.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_substrings(rows, 50)
    parts = [n for (name, _), n in saved.items() if name == "part"]  # none holds most of what the join finds
    assert len(parts) == substrings.JOIN_PARTS and 0 < max(parts) < 0.6 * sum(parts)


def test_least_hashes_fill_the_bit_table_evenly():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 4000, np.uint8).tobytes() for _ in range(50)]
    h = np.unique(np.concatenate([m for *_, m in substrings._runs(texts, substrings.LENGTH)]))
    slices = np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=substrings.SLICES)
    assert slices.max() < 2 * slices.mean() and slices.min() > slices.mean() / 2
    assert len(np.unique(h >> np.uint64(48))) > 0.85 * len(h)  # as many of 65,536 places as numbers drawn evenly take


def test_transform_merge():
    rng = random.Random(4)
    for length in (12, 7):  # symbols of two bytes and of one
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 40))) for _ in range(30)]
        doc = np.array([rng.randint(0, 9) for _ in segments])
        old, substrings.SHARD_BYTES = substrings.SHARD_BYTES, 100
        try:
            got = substrings.least_documents(segments, doc, length)
        finally:
            substrings.SHARD_BYTES = old
        for s, found in zip(segments, got, strict=True):
            assert len(found) == len(s) - length + 1
            for p, d in enumerate(found):
                assert d == min(doc[i] for i, o in enumerate(segments) if s[p : p + length] in o)


def test_only_repeated_windows_are_transformed(monkeypatch):
    """Runs of repeated windows enter the transforms once, what is alone does not."""
    rng, length, seen = random.Random(6), 20, []
    made = lambda n: bytes(rng.randint(97, 122) for _ in range(n))
    common = made(30)
    segments = [made(10) + common + made(10) for _ in range(40)] + [made(60) for _ in range(40)]
    doc = np.array([rng.randint(0, 99) for _ in segments])
    real = substrings.merge
    monkeypatch.setattr(substrings, "merge", lambda symbol, *rest: seen.append(len(symbol)) or real(symbol, *rest))
    got = substrings.least_documents(segments, doc, length)
    for i, (s, found) in enumerate(zip(segments, got, strict=True)):
        assert found.tolist() == [min(d for o, d in zip(segments, doc.tolist(), strict=True) if s[p : p + length] in o) for p in range(len(s) - length + 1)], i
    assert 0 < sum(seen) < 2000  # suffixes of the common part, some with a byte beside it that agrees by chance; 4,560 of all segments
    assert [x.tolist() for x in substrings.least_documents(segments[40:], doc[40:], length)] == [[d] * 41 for d in doc[40:].tolist()]
    data = np.frombuffer(b"abcabcabcabcabcabcabcabc" * 3, np.uint8)
    for n in (1, 7, 8, 9, 16, 17, 50):
        h = substrings.window_hashes(data, n)
        assert len(h) == len(data) - n + 1 and (h[:-3] == h[3:]).all() and len(set(h[:3].tolist())) == 3


def test_shard_transforms():
    """Rows are the suffixes in order, and following the symbols backwards spells the strings."""
    strings = [b"banana", b"ananas", b"banana", b"a", b"zz"]
    for step in (1, 2):
        t = substrings.Shard.of(strings, step)
        suffixes = [(strings[i][j:], i) for i, j in zip(t.string.tolist(), t.offset.tolist())]
        assert suffixes == sorted(suffixes) and len(suffixes) == sum(len(s) + step for s in strings)
        for i, s in enumerate(strings):
            row = next(k for k in range(len(suffixes)) if t.string[k] == i and t.offset[k] == (len(s) if step == 1 or len(s) % 2 == 0 else len(s) + 1))
            spelled = []
            while t.left[row] >= 0:
                spelled.append(t.symbol[row])
                row = t.left[row]
            text = b"".join(bytes(x - 1 for x in (([c >> 8] if step == 2 else []) + [c & 255]) if x) for c in map(int, reversed(spelled)))
            assert text == s


def brute_items(t, items, similarity=0.8):
    """Best similarity of each item over all windows of its size, exact, no fingerprints."""
    words, out = decontam.words_of(t), {}
    for item, own in items:
        own = decontam.words_of(own)
        if not own or not words:
            continue
        k, n = min(5, len(own)), len(own)
        grams = lambda w, k=k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        a, best = grams(own), 0.0
        for at in range(max(1, len(words) - n + 1)):
            b = grams(words[at : at + n])
            both = sum((a & b).values())
            best = max(best, both / max(1, a.total() + b.total() - both))
        if best >= similarity:
            out[item] = best
    return out


def test_decontamination_recall(spark):
    """Passages changed to similarities around the threshold, short and long items, ties, repeats, a long text."""
    rng = random.Random(67)
    items = [(i, " ".join(letters(rng, 2, 8) for _ in range(rng.choice([15, 25, 40, 60, 90])))) for i in range(40)] + [(99, "tiny item"), (98, "tiny item")]
    rows = []
    for i in range(300):
        own = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = letters(rng, 2, 8)
        head, tail = (" ".join(letters(rng, 2, 8) for _ in range(rng.randint(0, 40))) for _ in range(2))
        rows.append((i, f"{head} {' '.join(own)} {tail}"))
    rows += [rows[0], (500, " ".join(r[1] for r in rows)), (501, None), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontam.search(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id", "text"])
    got = Counter((r.doc_id, r.text, tuple(sorted(r._items))) for r in found.collect())
    want = Counter((i, t, tuple(sorted(brute_items(t, items)))) for i, t in rows)
    pairs = lambda c: sum(len(k[2]) * n for k, n in c.items())
    assert pairs(want) > 200 and pairs(got) >= 0.995 * pairs(want)
    assert all(set(g[2]) <= set(brute_items(g[1], items)) for g in got)


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, text(rng, n)) for i, n in enumerate((30, 12, 45, 3, 0))]
    changed = items[2][1].split()
    changed[0] = "changed"
    rows = [(1, text(rng, 80) + " " + items[0][1] + " " + text(rng, 5)), (2, text(rng, 60)), (3, None), (4, ""), (5, "intro " + " ".join(changed)), (6, items[1][1]), (7, text(rng, 30))]
    docs = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, _x string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_items(t, items) for i, t in rows}
    assert 0 in want[1] and 2 in want[5] and 1 in want[6] and not want[3] and not want[4]
    for size in (decontam.INDEX_BYTES, 30_000):  # in one pass and in several
        got = {r.doc_id: dict(zip(r._items, r._first_words, strict=True)) for r in decontam.search(docs, bench, ["doc_id", "_x"], index_bytes=size).collect()}
        assert {i: set(v) for i, v in got.items()} == {i: set(v) for i, v in want.items()}
    found = {r.doc_id: r._similarity for r in decontam.search(docs, bench, ["doc_id"]).collect()}
    assert all(found[i] is None if not v else abs(found[i] - max(v.values())) < 1e-9 for i, v in want.items())
    assert decontam.search(docs, bench.where("false"), ["doc_id"]).where("size(_items) > 0").count() == 0


def test_short_items_in_neighbouring_windows():
    for n in (1, 2, 3, 4):
        index = decontam.Index([(7, " ".join("a" * n)), (8, " ".join("bcde"[:n]))])
        assert [m[0] for m in index.matches("a a a a a a a a")] == [7]
        assert [m[0] for m in index.matches("x b c d e b c d e y")] == [8]
    both = decontam.Index([(1, "a b c d"), (2, "b c d e")])
    assert [m[0] for m in both.matches("a b c d e")] == [1, 2]


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    index = decontam.Index([(i, " ".join(f"w{rng.integers(0, 50)}" for _ in range(20))) for i in range(40)])
    size = next(iter(index.by_size))
    rows = index.by_size[size]
    fps = index.fps[rng.integers(0, len(index.fps), 200)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (200, 22)).astype(np.uint64), axis=1)
    want = {(w, int(r)) for w, fp in enumerate(fps) for r in rows if (int(fp) ^ int(index.fps[r])).bit_count() <= index.radius}
    assert set(index.near(size, fps)) == want


def test_simhash(spark, docs):
    rows = rows_of(docs)
    fp = [simhash.fingerprint(t) for _, t in rows]
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root = union_find(edges, range(len(rows)))
    least = {}
    for n, r in root.items():
        if rows[n][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[n][0])
    want = Counter((rows[n][0], f"{fp[n]:016x}", least.get(root[n])) for n in range(len(rows)))
    got = simhash.near_duplicates(spark, docs).select("id", simhash.hex_fingerprint().alias("h"), "component_id")
    assert Counter(tuple(r) for r in got.collect()) == want
    assert simhash.near_duplicates(spark, docs.where("false")).count() == 0


def test_simhash_links(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(25)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    got = union_find([(r.u % 2**64, r.v % 2**64) for r in links], fps)
    assert got == union_find([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], fps)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.2)], i % 2) for i in range(120)]
    rows += [(200 + k, rows[0][1], 0) for k in range(3)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, rows[0][1], None), (304, [1.0, 2.0], 0), (305, [2.0, 4.0], 0), (306, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit("clash"))
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark, df).collect()}
    able = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if v and lab is not None and np.isfinite(v).all() and np.any(v)}

    def linked(a, b):
        (x, p), (y, q) = able[a], able[b]
        return p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    edges = [(a, b) for a in able for b in able if a < b and linked(a, b)]
    root, n = union_find(edges, [r[0] for r in rows]), Counter(x for e in edges for x in e)
    assert got == {i: (n[i], root[i], root[i] == i) for i, _, _ in rows}
    assert vectors.near_duplicates(spark, df.where("false")).count() == 0


def test_pii_odd_rows(spark):
    """Empty table, clashing names, repeated rows, a very long text."""
    long = ("call +1 (555) 123-4567, token=" + "a1" * 20 + " " + "account " * 3) * 20_000
    rows = [(1, long, 1, "p"), (2, "x", 2, "q"), (2, "x", 2, "q"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, n_email string")
    got = sorted((str(r.id), r.n_phone, len(r.spans.split(",")) if r.spans else 0) for r in pii.find(df).collect())
    assert got == [("1", 20_000, 40_000), ("2", 0, 0), ("2", 0, 0), ("None", 0, 0)]
    assert pii.find(df.where("false")).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii(spark):
    rng = random.Random(7)
    parts = ["1", "2", "0", ".", " ", "-", "+", "@", "a", "b", "é", "(", ")", "255", "4242 4242", "İ"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == base_spans(t), t
    t = "account no 12345678, IBAN DE89370400440532013000, http://me:pw@host.org/x"
    assert {s[0] for s in pii.spans(t)} >= {"account", "address"} and "12345678" not in pii.redact(t)
    key = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    for t in (f'token = "{key}"', f"API_KEY: {key}", f"bearer {key}.", f"the TOKEN {key} is"):
        assert [t[a:b] for k, a, b in pii.spans(t) if k == "secret"] == [key], t
    assert pii.redact("password=hunter2 and pwd: x") == "password=[secret] and pwd: x"
    for t in ("a token of friendship", "the secret ingredient", "tokenisation1234567890 works", "password reset"):
        assert not [x for x in pii.spans(t) if x[0] == "secret"], t
    df = spark.createDataFrame([(1, None), (2, "a@b.co " * 3), (None, "1" * 5000)], "doc_id long, text string")
    got = {r.id: r for r in pii.find(df).collect()}
    assert got[2].n_email == 3 and got[1].spans == "" and got[None].n_card == 0


def test_warc(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "y" * (i % 4)) for i in range(12)] + [(20, None, None), (21, "u", ""), (11, "again", "<p>" + "y" * 3), (22, "z", "ü" * 10_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, _ = warc.archive(spark, pages)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), i)
    want = Counter((str(i), len((h or "").encode()), warc.payload_digest((h or "").encode()), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else str(last[h or ""])) for i, _, h in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want
    assert any(bytes(r.payload).decode() == "ü" * 10_000 for r in got.collect())
    assert warc.archive(spark, pages.where("false"))[0].count() == 0


def test_language_model(spark, docs):
    rows = rows_of(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, lm.tokens(t) + [lm.END]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6), held(i)) for i, ws in tokens)
    old = lm.FREQUENT_WORDS
    try:
        scores = []
        for lm.FREQUENT_WORDS in (old, 40):  # with and without the join
            got = lm.score(spark, docs).collect()
            assert Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.held_out) for r in got) == want
            scores.append(sorted(round(r.score, 6) for r in got))
        assert max(scores[0] + scores[1]) < 0
    finally:
        lm.FREQUENT_WORDS = old
    assert lm.score(spark, docs.where("false")).count() == 0


def small_model(rng, n=60):
    """A model learned from some texts in one shard, and these."""
    own = [[*lm.tokens(text(rng, rng.randint(0, 60))), lm.END] for _ in range(n)]
    c = Counter(w for t in own for w in t)
    frequent = [(w, k) for w, k in c.most_common(25)]
    words = lm.Words.of(frequent, c[lm.END], 40, np.arange(256))
    learner = lm.Learner(words, 20)
    learner.learn(own)
    n0, n1 = learner.counts & 0xFFFFFFFF, learner.counts >> 32
    return lm.Model(words, learner.mixer, np.log((n1 + lm._PRIOR) / (n0 + lm._PRIOR)).astype(np.float32)), own


def brute_token(model, before, word):
    """log10 probability of a token bit by bit, with Python's integers."""
    m = 2**32
    N, P, Q, R = (int(x) for x in (lm._N, lm._P, lm._Q, lm._R))
    number = model.words.number

    def own(w):
        return number[w] * P % m if w in number else zlib.crc32(w) * Q % m

    def slot(context, node):
        h = (context ^ (node * N % m)) * P % m
        h ^= h >> 15
        return (h * Q % m) >> (32 - model.bits)

    def path(code, symbol, contexts, first, spelled):
        total = 0.0
        for k in range(code.length[symbol]):
            at = code.start[symbol] + k
            logit = [float(model.logit[slot(x, int(code.node[at]) + first)]) for x in contexts]
            level = [sum(abs(x) > t for t in (0, 1.6, 3.5)) for x in logit[1:]]
            gate = 16 * spelled + 4 * level[0] + level[1]
            mixed = max(-12.0, min(12.0, sum(float(w) * x for w, x in zip(model.mixer.weights[gate], logit, strict=True))))
            place = max(0, min(lm.BUCKETS - 1, round((mixed + 8) * (lm.BUCKETS - 1) / 16)))
            p = (1 / (1 + np.exp(-mixed)) + float(model.mixer.map[gate, place])) / 2
            p = max(1e-6, min(1 - 1e-6, p))
            total += np.log10(p if code.bit[at] else 1 - p)
        return total

    one = own(before[-1]) if before else 0
    two = own(before[-2]) if len(before) > 1 else 0
    out = path(model.words.code, number.get(word, 0), [1, (one * R + 2) % m, (one * N + two * Q + 3) % m], 0, 0)
    if word not in number:
        s = (before[-1][-3:].rjust(3) + b" " if before else lm.END * 4) + word + b" "
        for k in range(4, len(s)):
            four = s[k - 1] | s[k - 2] << 8 | s[k - 3] << 16 | s[k - 4] << 24
            contexts = [((four & 0xFF) * R + 4) % m, ((four & 0xFFFF) * R + 5) % m, (four * R + 6) % m]
            out += path(model.words.spelling, s[k], contexts, 1 << 24, 1)
    return out


def test_words_are_counted_without_lists_of_tokens(monkeypatch):
    rng = random.Random(5)
    odd = [None, "", " ", "  a  b ", "A\x0bB\x0c C\rD\nE\tF a", "\x1c\x1d\x85\xa0\u00c9 \u0130\u2028x", "\x00 a\x00b", "B" * 90]
    texts = [(rng.choice(odd), rng.random() < 0.3) for _ in range(500)]
    expected = Counter({w: 0 for t, _ in texts for w in lm.tokens(t)})
    for t, held in texts:
        expected.update([] if held else [*lm.tokens(t), lm.END])
    monkeypatch.setattr(lm, "tokens", None)
    monkeypatch.setattr(lm, "COUNTED_BYTES", 64, raising=False)
    batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in own]), pa.array([h for _, h in own])], ["text", "held_out"]) for own in (texts[:200], texts[200:])]
    found = [r for b in lm._counted(iter(batches)) for r in b.to_pylist()]
    assert {r["word"]: r["n"] for r in found} == dict(expected) and len(found) == len(expected)
    assert not list(lm._counted(iter([])))


def test_scores_equal_the_mixer_bit_by_bit():
    rng = random.Random(43)
    model, _ = small_model(rng)
    texts = [[*lm.tokens(t), lm.END] for t in (text(rng, 40), "", "été unseen words Ωmega", text(rng, 3))]
    got, _ = model.scores(texts)
    want = [brute_token(model, t[:i], w) for t in texts for i, w in enumerate(t)]
    assert np.allclose(got, want, atol=1e-4)


def test_slices_hash_only_contexts_with_words_before(monkeypatch):
    model, own = small_model(random.Random(59))
    known = [[w for w in t if w in model.words.number] for t in own]  # nothing is spelled
    stream, hashed, plain = lm.Stream(model.words, known, 20), [], lm.Stream._slots
    monkeypatch.setattr(lm.Stream, "_slots", lambda self, context, node: hashed.append(len(node)) or plain(self, context, node))
    slots, bit, spelled, token = stream.slice(0, len(stream.all))
    assert sum(hashed) == (lm.ORDERS - 1) * len(bit) and not spelled.any()
    at, m = np.concatenate([model.words.code.start[x] + np.arange(model.words.code.length[x]) for x in stream.symbol]), 2**32
    want = [(h ^ h >> 15) * int(lm._Q) % m >> 12 for n in model.words.code.node[at].tolist() for h in [(1 ^ n * int(lm._N) % m) * int(lm._P) % m]]
    assert slots[0].tolist() == want and (np.diff(token) >= 0).all()


def test_slots_without_words_before_are_hashed_once_a_node(monkeypatch):
    model, own = small_model(random.Random(61))
    hashed, plain = [], lm.Stream._slots
    monkeypatch.setattr(lm.Stream, "_slots", lambda self, context, node: hashed.append(len(node)) or plain(self, context, node))
    lm.Stream(model.words, own, 20)
    assert sum(hashed) == len(model.words.code.length) - 1 < len(model.words.code.node)
    monkeypatch.undo()
    learner, want = lm.Learner(model.words, 20), np.zeros(1 << 20, np.int64)
    for texts in (own[:20], own[20:]):  # what nodes gain comes back after each part
        learner.learn(texts)
        stream = lm.Stream(model.words, texts, 20)
        slots, bit, _, _ = stream.slice(0, len(stream.all))
        for each in slots:
            np.add.at(want, each, np.where(bit, np.int64(1) << 32, 1))
    assert (learner.counts == want).all()


def test_scores_are_a_distribution():
    model, own = small_model(random.Random(47))
    for before in ([], own[0][:1], own[3][:2]):
        known = sum(10 ** model.scores([[*before, w]])[0][-1] for w in model.words.number)
        spelled = sum(10 ** model.scores([[*before, bytes([x])]])[0][-1] for x in range(256) if x not in (10, 32))
        assert 0.2 < known < known + spelled < 1


def test_slices_and_shards_do_not_matter(spark, docs):
    model, own = small_model(random.Random(53))
    whole, old = model.scores(own)[0], lm.SLICE
    try:
        lm.SLICE = 37
        assert np.allclose(model.scores(own)[0], whole)
    finally:
        lm.SLICE = old
    got, sizes, n = [], lm.SHARD_BYTES, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        lm.SHARD_BYTES = (4_000, 4_000)  # several shards
        for parts in ("2", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append(sorted((str(r.id), r.score) for r in lm.score(spark, docs.repartition(int(parts))).collect()))
    finally:
        lm.SHARD_BYTES = sizes
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert got[0] == got[1]


def test_scores_depend_on_the_order_of_words(spark):
    rng = random.Random(23)
    follow = {w: WORDS[(i + 1) % 7] for i, w in enumerate(WORDS[:7])}  # each word has its successor

    def chain(n):
        w = [rng.choice(WORDS[:7])]
        while len(w) < n:
            w.append(follow[w[-1]])
        return w

    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    own = chain(200)
    rows = [(i, " ".join(chain(60))) for i in range(300) if i not in held]
    rows += [(held[0], " ".join(own)), (held[1], " ".join(rng.sample(own, len(own))))]
    got = {r.id: r for r in lm.score(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    straight, mixed = (got[i] for i in held)
    assert straight.held_out and mixed.held_out and abs(straight.base_score - mixed.base_score) < 1e-6
    assert straight.score > mixed.score / 2


def test_huffman_codes_are_prefix_free():
    rng = random.Random(59)
    for n in (2, 3, 50):
        weights = [rng.randint(1, 100) for _ in range(n)]
        code = lm.Code.of(weights)
        paths = ["".join(map(str, code.bit[s : s + k])) for s, k in zip(code.start, code.length, strict=True)]
        assert sum(2.0 ** -len(p) for p in paths) == 1 and len(set(paths)) == n
        heap = sorted(weights)
        cost = 0
        while len(heap) > 1:
            a, b, *heap = heap
            cost += a + b
            heap = sorted([*heap, a + b])
        assert sum(w * len(p) for w, p in zip(weights, paths, strict=True)) == cost


def test_table_and_shards_grow_with_the_input():
    assert lm.table_bits(0) == lm.TABLE_BITS < lm.table_bits(800_000_000) < lm.table_bits(6_000_000_000) == lm.MAX_TABLE_BITS
    assert lm.shard_count(0) == 1 and lm.shard_count(10**9) == 15 and lm.shard_count(10**13) == 9314


def test_toxicity(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, 40) + (f" you {rng.choice(['zork', 'blarg'])} . " if i % 5 == 0 else " . ") + text(rng, 20)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows[:300]] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {"zork", "blarg"} <= model.words.keys()
    got = {r.doc_id: r._score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i, _ in rows) and got[900] == got[901] < 0.3
    assert toxicity.fit(docs, labels.where("false")).words == toxicity.Model().words


def brute_toxicity(t, model):
    """The grammar read clause by clause by its rules in words, without transducers."""
    low, total, most, clauses, hits = (t or "").lower(), 0.0, 0.0, 0, 0
    for clause in re.split(r"[.!?;:\n]", low):
        denial = near = after = threats = 0  # words for which a negation or a target still acts, and an insult waits for one
        named = reported = threatened = False
        weight, n = 0.0, 0
        for w in toxicity._WORD.findall(clause):
            own = max([model.words.get(w, 0.0)] + [model.stems.get(w[:k], 0.0) for k in toxicity.STEMS if len(w) >= k])
            kind = "I" if own > 0 else next((k for k, c in (("P", toxicity.TARGETS), ("N", toxicity.NEGATIONS), ("R", toxicity.REPORTS), ("T", toxicity.THREATS)) if w in c), "O")
            factor, bonus, aimed = 1.0, 0.0, False
            denied, quoted = kind == "I" and denial > 0, kind in "IT" and reported
            denial = toxicity.REACH if kind == "N" else max(0, denial - 1)
            reported = reported or kind == "R"
            free = kind == "I" and not denied and not quoted
            if kind == "I":
                factor = (0.5 if denied else 1.0) * (0.6 if quoted else 1.0)
            if kind == "P":
                if after:
                    aimed, bonus = True, 0.5
                near, after = toxicity.REACH, 0
            elif free and near:
                aimed, factor, near = True, factor * 1.25, near - 1
            elif free:
                after = 2
            elif after:
                after -= 1
            else:
                near = max(0, near - 1)
            if not threatened and kind == "T" and not quoted:
                if named:
                    threatened, bonus = True, bonus + 2.0
                else:
                    threats = 1
            elif not threatened and (kind == "P" or aimed):
                if threats:
                    threatened, bonus = True, bonus + 2.0
                named = True
            weight += own * factor + bonus
            n += own > 0 or bonus > 0
        if n:
            total, most, clauses, hits = total + weight, max(most, weight), clauses + 1, hits + n
    x = [np.log1p(total), np.log1p(most), np.log1p(clauses), np.log1p(1000 * hits / (len(low) + 1))]
    return 1 / (1 + np.exp(-(model.coef[0] + model.coef[1:] @ np.array(x))))


def test_toxicity_equals_the_grammar_read_by_hand(spark):
    rng = random.Random(73)
    model = toxicity.Model(words={"zork": 3.0, "blarg": 2.5}, stems={"grun": 2.0}, coef=np.array([-2.0, 0.7, 0.4, 0.3, 0.2]))
    parts = ["zork", "blarg", "grunty", "you", "not", "said", "kill", "the", "a", "été", ".", "!", "\n", ";", "Zork", "never", "he", "hurt"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), rows[5], (1002, " ".join(r[1] for r in rows) * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", F.lit(1)).withColumn("_score", F.lit(2))
    got = sorted((r.doc_id, round(r.own, 9)) for r in toxicity.score(df, model, ["doc_id", "_score"], name="own").collect())
    assert got == sorted((i, round(float(brute_toxicity(t, model)), 9)) for i, t in rows)
    assert toxicity.score(df.where("false"), model, ["doc_id"]).count() == 0


def test_operators_pass_over_clashing_columns(spark, docs):
    """Extra columns with the names that operators use themselves change nothing."""
    names = ["doc", "th", "k1", "k2", "fp", "head", "row", "payload", "sha", "x", "mult", "cid", "words", "times", "n_bytes", "score", "piece", "item", "length", "bin", "base_score", "n", "hash", "start", "text_", "no", "component_id", "node", "root"]
    wide = docs.select("*", *(F.lit(7).alias(n) for n in names))
    for run in (
        lambda d: packing.pack(spark, d, tokenizer_path(), 64).drop("sequence_id", "offset"),
        lambda d: substrings.dedup(spark, d, with_text=False),
        lambda d: simhash.near_duplicates(spark, d),
        lambda d: pii.find(d),
        lambda d: lm.score(spark, d),
    ):
        plain, extra = (Counter(str(r) for r in run(d).collect()) for d in (docs, wide))
        assert plain == extra
    pages = spark.createDataFrame([(1, "u", "<p>", 1), (2, "v", "<p>", 2)], "page_id long, url string, html string, payload int").selectExpr("*", "1 AS sha", "2 AS last", "3 AS n")
    assert sorted((r.page_id, r.record_type) for r in warc.archive(spark, pages)[0].collect()) == [("1", "revisit"), ("2", "response")]
    vecs = spark.createDataFrame([(1, [1.0, 0.0], 0, 5), (2, [1.0, 0.001], 0, 6)], "vec_id long, embedding array<float>, label int, x int").selectExpr("*", "1 AS v", "2 AS cell", "3 AS id")
    assert sorted((r.id, r.n_links) for r in vectors.near_duplicates(spark, vecs).collect()) == [(1, 1), (2, 1)]


def test_clauses():
    m = toxicity.Model()
    w = lambda s: toxicity.clause_weight(s, m)[0]
    assert w("you idiot") > w("idiot") > w("not an idiot") > 0 and w("he said idiot") < w("idiot") and w("kill the process") == 0 and w("i will kill you") > 0
    assert w("idiot you") > w("idiot") and w("not you idiot") < w("you idiot") and w("somebody wrote kill you") == 0


def brute_lines(rows):
    """Lines kept by document, every pair compared."""
    seen, order = {}, lambda x: (x[0] is not None, x[0] or 0)
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            s = line.strip(" ")
            if s:
                seen.setdefault(s, []).append((i, no))
    grams = {s: {s[k : k + 8] for k in range(len(s) - 7)} for s in seen}
    keys = sorted(seen)
    edges = [(a, b) for a in keys for b in keys if a < b and grams[a] and grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8]
    del order
    return union_find(edges, keys), seen


def test_lines(spark):
    rng = random.Random(11)
    long = [text(rng, 30) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice(long) if rng.random() < 0.6 else text(rng, 8) for _ in range(rng.randint(1, 6)))) for i in range(30)]
    rows += [(40, long[0] + " tail"), (41, long[1][:-3]), (42, None), (43, "\n\n"), (44, "a\nb\na"), (45, "x" * 20_000), (46, "x" * 20_001)]
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, line string")
    got = {r.doc_id: r for r in lines.dedup(spark, df).collect()}
    root, seen = brute_lines(rows)
    assert got[42].text == "" and got[43].text == "\n\n" and got[42].line == "c"
    kept = Counter(root[s] for r in got.values() for line in r.text.split("\n") if (s := line.strip(" ")))
    assert set(kept) == set(root.values()) and max(kept.values()) == 1  # one line of each component, none lost
    assert sum(r._n_lines for r in got.values()) == sum(map(len, seen.values()))
    assert lines.dedup(spark, df.where("false")).count() == 0


def share_joined(spark, pairs):
    """The share of pairs of near-equal lines of which one line goes."""
    df = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    return 1 - (lines.dedup(spark, df).agg(F.sum("_n_kept")).first()[0] - len(pairs)) / len(pairs)


def near_pairs(rng, n, line, other):
    """``n`` pairs of a line and its change whose exact similarity is 0.8 at least."""
    grams = lambda s: {s[k : k + 8] for k in range(len(s) - 7)}
    out = []
    while len(out) < n:
        a = line(rng)
        b = other(rng, a)
        x, y = grams(a), grams(b)
        if b and len(x & y) / len(x | y) >= 0.8:
            out.append((a, b))
    return out


def letters(rng, low, high):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))


def test_lines_near_across_lengths_and_blanks(spark):
    rng = random.Random(17)

    def prose(rng):
        own = letters(rng, 3, 7)
        while len(own) < 92:
            own += " " + letters(rng, 2, 7)
        return own[:99].strip()

    longer = near_pairs(rng, 150, prose, lambda rng, a: a + " " + letters(rng, 3, 9))
    assert all(len(a) < 100 for a, _ in longer) and sum(len(b) >= 100 for _, b in longer) > 100
    assert share_joined(spark, longer) >= 0.95
    sparse = lambda rng: " ".join(letters(rng, 28, 32) for _ in range(8))  # noqa: E731  # 7 blanks in about 247
    blanks = near_pairs(rng, 100, sparse, lambda rng, a: a + "".join(" " + letters(rng, 1, 1) for _ in range(10)))
    assert share_joined(spark, blanks) >= 0.95


def test_lines_recall_near_the_threshold(spark):
    assert 1 - (1 - lines.SIMILARITY**lines.ROWS) ** lines.BANDS > 0.99
    rng = random.Random(31)
    one = " ".join(letters(rng, 5, 8) for _ in range(20))
    met = spark.createDataFrame([(0, one), (1, one + " tail"), (2, one[:40])], "lid long, line string")
    keys = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 2), (2, 1), (2, 3)], "lid long, key long")
    links = lines.near_lines(met, keys, Scratch(spark, "t"))  # one band in common is enough to be compared
    assert {frozenset((r.u, r.v)) for r in links.collect()} == {frozenset((0, 1))}


def family_roots(spark, family):
    """Components that the operator finds in distinct lines, and those of all pairs compared."""
    own = spark.createDataFrame(list(enumerate(family)), "lid long, line string")
    links = lines.near_lines(own, lines.signed(own), Scratch(spark, "t")).collect()
    grams = [{s[k : k + 8] for k in range(len(s) - 7)} for s in family]
    near = [(a, b) for a in range(len(family)) for b in range(a) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8]
    assert all(len(grams[r.u] & grams[r.v]) / len(grams[r.u] | grams[r.v]) >= 0.8 for r in links)
    return union_find([(r.u, r.v) for r in links], range(len(family))), union_find(near, range(len(family)))


def drifting(rng, n, words=24):
    """Each line an earlier one with a word replaced: near to that, not to most."""
    family = [[letters(rng, 4, 8) for _ in range(words)]]
    while len(family) < n:
        own = list(rng.choice(family))
        own[rng.randrange(words)] = letters(rng, 4, 8)
        family.append(own)
    return [" ".join(own) for own in family]


def test_lines_of_a_drifting_family(spark):
    for n in (177, 400):  # hot groups, in which similarity is not transitive
        got, want = family_roots(spark, drifting(random.Random(n), n))
        assert len(set(got.values())) <= len(set(want.values())) + 1


def test_rounds_of_hot_groups_leave_small_ones_and_start_from_stars(spark, monkeypatch):
    rng = random.Random(59)
    pairs = [s for _ in range(40) for s in drifting(rng, 3, 12)]
    family = sorted({*drifting(random.Random(177), 177), *pairs})
    saved, met, save, joined = [], [], Scratch.save, lines.components

    def seen(self, df, name):
        out = save(self, df, name)
        if name == "open":
            saved.append({r.n <= lines.SMALL_GROUP for r in out.select("n").distinct().collect()})
        return out

    def counted(edges, scratch):
        met.append(edges.count())
        return joined(edges, scratch)

    monkeypatch.setattr(Scratch, "save", seen)
    monkeypatch.setattr(lines, "components", counted)
    got, want = family_roots(spark, family)
    assert len(set(got.values())) <= len(set(want.values())) + 1
    assert len(saved) > 2 and True in saved[0] and all(True not in s for s in saved[1:-1])
    assert max(met) < 2 * len(family)  # a star has one edge a line, however many links were found


def test_lines_around_one_base_and_one_passage(spark):
    rng = random.Random(37)
    base, passage = [letters(rng, 3, 8) for _ in range(40)], " ".join(letters(rng, 3, 8) for _ in range(30))
    copies = [" ".join(letters(rng, 3, 8) if rng.random() < 0.06 else w for w in base) for _ in range(700)]
    shared = [passage + " " + " ".join(letters(rng, 3, 8) for _ in range(15)) for _ in range(300)]  # alike, none near
    got, want = family_roots(spark, sorted({*copies, *shared}))
    lost = len(set(got.values())) - len(set(want.values()))
    assert 0 <= lost <= 0.05 * (len(want) - len(set(want.values())))


def test_prefix_pairs_lose_nothing(spark):
    rng = random.Random(41)
    family = drifting(rng, 60, 12) + [drifting(rng, 2, 5)[k] for _ in range(20) for k in (0, 1)] + ["tiny", "x" * 30, "x" * 31]
    family = sorted(set(family))
    own = spark.createDataFrame([(i, i, s) for i, s in enumerate(family)], "lid long, label long, line string")
    first = lines.prefixes(own, 0.8, Scratch(spark, "t"))
    got = {(r.u, r.v) for r in lines.prefix_pairs(first, 0.8).collect()}
    grams = [{s[k : k + 8] for k in range(len(s) - 7)} for s in family]
    assert got >= {(a, b) for a in range(len(family)) for b in range(a + 1, len(family)) if grams[a] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8}


def test_sketches_lose_no_pair_and_spare_most(spark):
    rng = random.Random(43)
    family = drifting(rng, 50, 12) + drifting(rng, 12, 400) + ["ab" * 20, "ab" * 60, "é🙂" * 9, "é🙂" * 30, "x" * 8, "x" * 9, "12345678"]
    family = sorted({*family, *(" ".join(letters(rng, 4, 8) for _ in range(40)) for _ in range(30))})
    texts = spark.createDataFrame(list(enumerate(family)), "lid long, line string")
    texts = texts.join(lines.sketches(texts), "lid").cache()
    pairs = spark.createDataFrame([(a, b) for b in range(len(family)) for a in range(b)], "u long, v long")
    grams = [{s[k : k + 8] for k in range(len(s) - 7)} for s in family]
    near = {(a, b) for b in range(len(family)) for a in range(b) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8}
    kept = {(r.u, r.v) for r in lines._possible(pairs, texts, 0.8).collect()}
    assert kept >= near and len(kept) - len(near) < 0.1 * (pairs.count() - len(near))
    assert {(r.u, r.v) for r in lines._verified(pairs, texts, 0.8).collect()} == near


def test_lines_with_clashing_columns(spark):
    names = ["_text", "_hash", "_id", "_th", "_nos", "_new", "_n_lines", "_n_kept", "lid", "key", "first", "no", "label"]
    rows = [(1, "a line that comes twice\nown", *range(len(names))), (2, "a line that comes twice", *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = lines.dedup(spark, df)
    assert out.columns == [*df.columns, "__n_lines", "__n_kept"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == rows[0][1] and got[2].text == "" and got[2]['__n_lines'] == 1 and got[1].label == len(names) - 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    rows = [(i, text(rng, 60) + (" you zork ." if i % 4 == 0 else ""), "en", "s", 0) for i in range(120)]
    passage = text(rng, 30)
    rows += [(500, rows[1][1], "en", "s", 0), (501, passage + " and " + text(rng, 30), "en", "s", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r.length for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == {i for i in range(120) if i % 4} | {500} and len(corpus_pipeline.STAGES) == 5
    assert got[500] == 1 and min(n for i, n in got.items() if i != 500) > 1  # the copy lost all its lines; its row stays


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated rows, an empty table, and columns with every name that a stage uses itself."""
    import corpus_pipeline

    names = ["_text", "_score", "_k1", "_k2", "_key", "_id", "_th", "_hash", "_new", "_nos", "_items", "_similarity", "id", "line", "item", "label"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    rng = random.Random(3)
    texts = [text(rng, 40), text(rng, 40), None, "", " \n ", text(rng, 3000)]
    rows = [(i, t, None, "s", 0, *range(len(names))) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1], "en", None, None, *[None] * len(names))]
    sf = str(tmp_path)
    spark.createDataFrame(rows, kind).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, text(rng, 20)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {r.doc_id for r in got} >= {0, 5} and any(r.text == texts[1] for r in got)  # of 1 and null, equal texts, null is the least
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {0, 5} <= {r.doc_id for r in packed}
