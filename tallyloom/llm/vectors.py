"""Near-duplicate embeddings by product quantisation.

Vectors of one label link when their cosine, in double precision, is at least ``COSINE``.  Unit vectors at that cosine
are at most ``sqrt(2 - 2 * COSINE)`` apart.  Each label has inverted lists of its own, in proportion to its rows, by a
coarse k-means of the label's part of the sample; a vector is kept in the list of its nearest centre as residual codes, one of ``CODES`` per subspace, with the error of its code.  A vector
probes every list that could hold a neighbour: the ball around it must reach the bisector between its own centre and the
list's, which is necessary, so the probes are sufficient.  In a list the table-lookup distance less the
code's error never exceeds the true distance; what passes is reranked by the exact cosine.  So no link is lost whatever
the centres are, and these may come from a bounded sample (``SAMPLE`` vectors, least hashes first).  The sample also bounds
the number of lists; a label of which it has too few vectors is one list.

Equal vectors of a label are one class with a multiplicity.  Long lists and many probes are dealt over a grid of blocks,
each of bounded size.  A block returns link counts and a spanning forest of its links, never its pairs.

Rules for odd rows: a vector that is null, empty, zero, or has null or non-finite components, or whose label is null,
links with nothing and is its own component; vectors of other lengths than the sample's commonest are one list per
length and label; repeated ids are vectors of their own; rows with a null id are counted as links but are never a
component id unless all ids of the component are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .store import Scratch

COSINE = 0.98
SAMPLE = 20_000
SUBSPACES, CODES = 8, 64
CELL_ROWS = 1_000  # vectors a list
CELL_SAMPLE = 10  # vectors of the sample a list, at least
BLOCK_HOMES, BLOCK_PROBES = 4_096, 8_192
_SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    """Lloyd's algorithm; an empty cell keeps its centre."""
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = nearest(x, centre)[0]
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances (n, k)."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1))


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, centre)
    return d.argmin(1), d


@dataclass
class Quantiser:
    lists: dict  # by label, centres (k, dim)
    rest: np.ndarray  # (1, dim), the list of every other label
    books: list[np.ndarray]  # by subspace (codes, width)
    cuts: np.ndarray  # bounds of the subspaces

    @property
    def dim(self) -> int:
        return self.rest.shape[1]

    def centres(self, label) -> np.ndarray:
        return self.lists.get(label, self.rest)

    @classmethod
    def fit(cls, sample: np.ndarray, labels: list, rows: dict) -> Quantiser:
        """``rows`` has the number of vectors of each label of the sample."""
        rng = np.random.default_rng(7)
        of: dict = {}
        for i, label in enumerate(labels):
            of.setdefault(label, []).append(i)
        middle, residual, lists = sample.mean(0, keepdims=True), np.empty_like(sample), {}
        for label, own in of.items():
            x = sample[own]
            k = min(rows[label] // CELL_ROWS, len(own) // CELL_SAMPLE)
            if k > 1:
                lists[label] = kmeans(x, k, rng)
            centre = lists.get(label, middle)
            residual[own] = x - centre[nearest(x, centre)[0]]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        return cls(lists, middle, [kmeans(residual[:, a:b], CODES, rng) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)

    def encode(self, x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, subspaces) and the distance between each vector and what its code stands for; a centre a vector."""
        rest = x - centre
        codes = np.stack([nearest(rest[:, a:b], book)[0] for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], 1)
        back = np.concatenate([book[c] for book, c in zip(self.books, codes.T, strict=True)], 1)
        return codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    @staticmethod
    def probes(x: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
        """(n, k): whether a list can hold a vector within ``radius``."""
        own, d = nearest(x, centre)
        apart = np.sqrt(distances(centre, centre))[own]
        return d - d[np.arange(len(x)), own][:, None] <= 2 * radius * apart + _SLACK

    def lookup(self, x: np.ndarray, centre: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances between probes (n, dim) and coded vectors of one list (m, subspaces)."""
        rest, total = x - centre, np.zeros((len(x), len(codes)))
        for j, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            total += distances(rest[:, a:b], self.books[j])[:, codes[:, j]]
        return np.sqrt(total)


def _unit(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        x = None if not v or any(c is None for c in v) else np.array(v, np.float64)
        if x is None or not np.isfinite(x).all() or not x.any():
            out.append(None)
        else:
            x = x / np.abs(x).max()  # squares neither overflow nor vanish
            out.append(x / np.sqrt(x @ x))
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        unit = [None if u is None else u.tolist() for u in _unit(b.column(b.num_columns - 1))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(unit, pa.list_(pa.float64()))], [*b.schema.names[:-1], "x"])


def _placed(q: Quantiser, radius: float):
    """For each class a home row and a row for every list that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, mult, label, xs = (b.column(i).to_pylist() for i in range(4))
            rows = []
            of: dict = {}
            for i, x in enumerate(xs):
                if len(x) == q.dim:
                    of.setdefault(label[i], []).append(i)
            for name, usual in of.items():
                x, centre = np.array([xs[i] for i in usual]), q.centres(name)
                cell = nearest(x, centre)[0]
                codes, err = q.encode(x, centre[cell])
                reach = q.probes(x, centre, radius)
                for r, i in enumerate(usual):
                    rows.append((label[i], int(cell[r]), True, cid[i], mult[i], codes[r].tobytes(), float(err[r]), xs[i]))
                    rows += [(label[i], int(c), False, cid[i], mult[i], None, None, xs[i]) for c in np.flatnonzero(reach[r])]
            for i in (i for i, x in enumerate(xs) if len(x) != q.dim):
                rows.append((label[i], -len(xs[i]), True, cid[i], mult[i], b"", 0.0, xs[i]))
                rows.append((label[i], -len(xs[i]), False, cid[i], mult[i], None, None, xs[i]))
            kinds = [b.schema.types[2], pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.float64())]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["label", "cell", "home", "cid", "mult", "codes", "err", "x"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the links ``a``-``b`` connect."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def _block(q: Quantiser, cosine: float, radius: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        home = frame[frame["home"]]
        probe = frame[~frame["home"]]
        us, vs, ns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        a, b = [], []
        if len(home) and len(probe):
            y, yid, mult = np.array(home["x"].tolist()), home["cid"].to_numpy(), home["mult"].to_numpy()
            x, xid, cell = np.array(probe["x"].tolist()), probe["cid"].to_numpy(), int(frame["cell"].iloc[0])
            codes = np.frombuffer(b"".join(home["codes"]), np.uint8).reshape(len(home), -1) if cell >= 0 else None
            centre = q.centres(frame["label"].iloc[0])[cell] if cell >= 0 else None
            err = home["err"].to_numpy()
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                if codes is None:
                    i, j = np.indices((len(part), len(y))).reshape(2, -1)
                else:
                    i, j = np.nonzero(q.lookup(part, centre, codes) - err <= radius + _SLACK)
                for k in range(0, len(i), 1 << 18):  # a dense block has many candidates
                    ii, jj = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                    near = (np.einsum("ij,ij->i", part[ii], y[jj]) >= cosine) & (xid[at + ii] != yid[jj])
                    ii, jj = ii[near], jj[near]
                    if len(ii):
                        n = np.bincount(ii, mult[jj], len(part)).astype(np.int64)
                        hit = np.flatnonzero(n)
                        ns.append((xid[at + hit], n[hit]))
                        u, v = forest(xid[at + ii], yid[jj])
                        a.append(u)
                        b.append(v)
        if a:
            us, vs = forest(np.concatenate(a), np.concatenate(b))
            links = pd.DataFrame({"u": np.concatenate([u for u, _ in ns]), "n": np.concatenate([n for _, n in ns])}).groupby("u", as_index=False).sum()
            edges = pd.DataFrame({"u": us, "v": vs, "n": np.zeros(len(us), np.int64)})
            return pd.concat([edges, links.assign(v=pd.array([pd.NA] * len(links), "Int64"))[["u", "v", "n"]]])
        return pd.DataFrame({"u": us[0], "v": vs[0], "n": np.zeros(0, np.int64)})

    return run


def near_duplicates(spark: SparkSession, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row of ``table``."""
    scratch = Scratch(spark, "vectors")
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    kinds = {c: table.schema[c].dataType for c in (id_col, label_col)}
    own = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.select("id", "label", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("v"), "v").alias("k2"), "v")
    schema = f"id {kinds[id_col].simpleString()}, label {kinds[label_col].simpleString()}, k1 long, k2 long, x array<double>"
    own = scratch.save(own.mapInArrow(_units, schema).withColumn("row", F.monotonically_increasing_id()), "units")
    able = own.where("x IS NOT NULL AND label IS NOT NULL")
    classes = able.groupBy("label", "k1", "k2").agg(F.min("id").alias("head"), F.count("*").alias("mult"), F.min("row").alias("cid"), F.first("x").alias("x"))
    classes = scratch.save(classes, "classes")
    sample = classes.select("cid", "label", "x").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toPandas()
    lengths = sample["x"].map(len)
    dim = int(lengths.mode().iloc[0]) if len(sample) else 1
    sample = sample[lengths == dim]
    met = classes.join(F.broadcast(spark.createDataFrame([(x,) for x in sample["label"].drop_duplicates().tolist()], classes.select("label").schema)), "label") if len(sample) else None
    rows = {r.label: r.n for r in met.groupBy("label").agg(F.count("*").alias("n")).collect()} if met is not None else {}  # labels of the sample
    fit_on = np.array(sample["x"].tolist()) if len(sample) else np.ones((1, 1))
    q = Quantiser.fit(fit_on, sample["label"].tolist() if len(sample) else [None], rows or {None: 1})
    placed = classes.select("cid", "mult", "label", "x").mapInArrow(
        _placed(q, radius), f"label {kinds[label_col].simpleString()}, cell int, home boolean, cid long, mult long, codes binary, err double, x array<double>"
    )
    placed = scratch.save(placed, "placed")
    size = placed.groupBy("label", "cell").agg(F.ceil(F.count_if(F.col("home")) / BLOCK_HOMES).alias("nh"), F.ceil(F.count_if(~F.col("home")) / BLOCK_PROBES).alias("np"))
    dealt = placed.join(size, ["label", "cell"]).where("nh > 0 AND np > 0")
    bucket = F.pmod(F.xxhash64("cid"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("np")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("np")).otherwise(F.col("nh")) - 1))
    dealt = dealt.withColumn("mine", bucket).withColumn("other", other)
    dealt = dealt.withColumns({"hb": F.when(F.col("home"), F.col("mine")).otherwise(F.col("other")), "pb": F.when(F.col("home"), F.col("other")).otherwise(F.col("mine"))})
    found = dealt.select("label", "cell", "hb", "pb", "home", "cid", "mult", "codes", "err", "x").groupBy("label", "cell", "hb", "pb").applyInPandas(_block(q, cosine, radius), "u long, v long, n long")
    found = scratch.save(found, "links")
    scratch.drop(placed)
    stars = components(found.where("v IS NOT NULL").select("u", "v"), scratch)
    counts = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
    known = classes.select("label", "k1", "k2", "cid", "head", "mult").join(stars, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    best = known.groupBy("root").agg(F.min("head").alias("component_id"))
    known = known.join(best, "root").join(counts, F.col("cid") == F.col("u"), "left")
    known = known.select(F.col("label").alias("_label"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    own = own.select("id", "label", F.when(F.col("x").isNotNull(), F.col("k1")).alias("k1"), "k2")
    out = own.join(known, (F.col("label") == F.col("_label")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col("id") == F.col("component_id"))
