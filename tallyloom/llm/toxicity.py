"""Toxicity by a weighted finite-state pattern grammar.

Tokens become symbols (insult, threat, target, negation, report, other); four small transducers are composed, each reading
what the one before wrote, into one machine that reads a clause and gives its weight.  An insult counts by its own
weight; a denied one is rewritten and counts less, a quoted one too, and neither can be aimed any more; one that is
aimed at somebody named before or right behind it counts more.  A threat counts with a target and unless quoted.  Only
matched clauses get weight; an insult alone is a clause of its own weight.  A document's clause weights
become four features and a logistic gives its score.

The weights of insult words and stems and the logistic come from labelled training documents: a bounded sample of at
most ``SAMPLE_DOCS`` labelled rows, least hashes first.  Everything else reads every whole text.  Labels, language,
source and ids are no inputs of a score.

Rules for odd rows: a null text is an empty one and gets the score of a text without matches; equal texts get equal
scores; a label row with a null label or id is not used; without any usable training row of both classes the fixed seeds and
``PRIOR`` decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh

SAMPLE_DOCS = 40_000  # bound of the labelled rows that the model is fitted on
MAX_UNITS = 2_000  # bound of the learned lexicon
STEMS = (4, 5, 6)  # lengths of word beginnings that can be learned
CHANCE = 0.05  # expected number of units that chance alone would add to the lexicon
LEAST_ODDS = 2.5  # log odds below this make no insult
THRESHOLD = 0.3
PRIOR = np.array([-3.0, 1.0, 0.5, 0.5, 0.25])  # bias, then the features

# The closed word classes of the grammar.
SEED_INSULTS = "idiot moron stupid loser scum pathetic worthless trash disgusting clown idioten dummkopf crétin imbécile estúpido imbécil".split()
THREATS = "kill hurt destroy punch stab shoot töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours yourself u he she him her they them their this that these those du dich dir dein ihr euch sie tu toi te ton vous votre usted tú ti ustedes vosotros".split()
NEGATIONS = "not no never nobody neither nor isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote writes claimed called quoted reported according sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
REACH = 4  # tokens over which a negation or a target acts

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


class Transducer:
    """Deterministic weighted transducer: ``step(state, symbol) -> (state, symbol written, factor, bonus)``; 0 is the start.

    Symbols without an arc are written as they were read; states that ``fade`` count down then.
    """

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float, float]], fade: bool = False):
        self.arcs, self.fade = arcs, fade

    def step(self, state: int, symbol: str) -> tuple[int, str, float, float]:
        hit = self.arcs.get((state, symbol))
        return hit if hit is not None else (max(0, state - 1) if self.fade else state, symbol, 1.0, 0.0)


_OPEN = range(1, REACH + 1)  # states in which something still acts

#: An insult (I) soon behind a negation (N) is denied: it is written as D and weighs half.
NEGATION = Transducer({(s, "N"): (REACH, "N", 1.0, 0.0) for s in range(REACH + 1)} | {(s, "I"): (s - 1, "D", 0.5, 0.0) for s in _OPEN}, fade=True)
#: An insult or threat (T) behind a word of reporting (R) is quoted: Q and a lesser weight, or no threat of the writer's (q).
REPORT = Transducer({(0, "R"): (1, "R", 1.0, 0.0), (1, "I"): (1, "Q", 0.6, 0.0), (1, "D"): (1, "Q", 0.6, 0.0), (1, "T"): (1, "q", 1.0, 0.0)})
#: An insult that is neither denied nor quoted is aimed (A) if somebody (P) is named shortly before it, or right behind it.
AIM = Transducer(
    {(s, "P"): (REACH, "P", 1.0, 0.0) for s in range(REACH + 1)}
    | {(s, "I"): (s - 1, "A", 1.25, 0.0) for s in _OPEN}
    | {(0, "I"): (REACH + 2, "I", 1.0, 0.0), (REACH + 1, "I"): (REACH + 2, "I", 1.0, 0.0), (REACH + 2, "I"): (REACH + 2, "I", 1.0, 0.0)}
    | {(REACH + 2, "P"): (REACH, "A", 1.0, 0.5), (REACH + 1, "P"): (REACH, "A", 1.0, 0.5)}
    | {(REACH + 2, x): (REACH + 1, x, 1.0, 0.0) for x in "ODNRTQq"}
    | {(REACH + 1, x): (0, x, 1.0, 0.0) for x in "ODNRTQq"},
    fade=True,
)
#: A threat counts once a clause, with somebody named anywhere in it; aimed insults name somebody too.
MENACE = Transducer(
    {(0, x): (1, x, 1.0, 0.0) for x in "PA"}
    | {(0, "T"): (2, "T", 1.0, 0.0), (1, "T"): (3, "M", 1.0, 2.0)}
    | {(2, x): (3, "M", 1.0, 2.0) for x in "PA"}
)


def compose(*parts: Transducer):
    """The chain as one machine: each part reads what the one before wrote; states are made as they are met."""
    made: dict[tuple, tuple] = {}

    def step(state: tuple, symbol: str) -> tuple[tuple, float, float]:
        if (hit := made.get((state, symbol))) is None:
            now, factor, bonus, read = [], 1.0, 0.0, symbol
            for part, own in zip(parts, state, strict=True):
                own, read, f, b = part.step(own, read)
                now.append(own)
                factor, bonus = factor * f, bonus + b
            made[state, symbol] = hit = (tuple(now), factor, bonus)
        return hit

    return step, (0,) * len(parts)


_STEP, _START = compose(NEGATION, REPORT, AIM, MENACE)
_CLOSED = {w: s for s, words in (("P", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("T", THREATS)) for w in words}


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_INSULTS, 3.0))
    stems: dict[str, float] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: PRIOR)

    def insult(self, token: str) -> float:
        return max([self.words.get(token, 0.0), *(self.stems.get(token[:k], 0.0) for k in STEMS if len(token) >= k)])

    def automaton(self) -> ahocorasick.Automaton:
        """All that can make a clause match: insult words, stems and threats."""
        a = ahocorasick.Automaton()
        for unit in {*self.words, *self.stems, *THREATS}:
            a.add_word(unit, len(unit))
        a.make_automaton()
        return a


def clause_weight(clause: str, model: Model) -> tuple[float, int]:
    """Weight of a lower-cased clause and the number of insults and threats in it."""
    state, weight, hits = _START, 0.0, 0
    for token in _WORD.findall(clause):
        own = model.insult(token)
        symbol = "I" if own > 0 else _CLOSED.get(token, "O")
        state, factor, bonus = _STEP(state, symbol)
        weight += own * factor + bonus
        hits += own > 0 or bonus > 0
    return weight, hits


def features(text: str | None, model: Model, machine: ahocorasick.Automaton) -> np.ndarray:
    """Sum and maximum of the clause weights, matched clauses, density of matches."""
    text = (text or "").lower()
    total, most, clauses, hits, done = 0.0, 0.0, 0, 0, -1
    for last, size in machine.iter(text):
        start = last + 1 - size
        if start < done or start and text[start - 1].isalpha():
            continue  # in a clause that was read, or inside a word
        begin = max(text.rfind(c, 0, start) for c in ".!?;:\n") + 1
        end = m.start() if (m := _CLAUSE_END.search(text, start)) else len(text)
        weight, n = clause_weight(text[max(begin, done) : end], model)
        done = end
        if n:
            total, most, clauses, hits = total + weight, max(most, weight), clauses + 1, hits + n
    return np.array([math.log1p(total), math.log1p(most), math.log1p(clauses), math.log1p(1000 * hits / (len(text) + 1))])


def _units(text: str | None) -> set[str]:
    """Words as ``=word`` and word beginnings as ``^stem``."""
    words = set(_WORD.findall((text or "").lower()))
    return {"=" + w for w in words} | {"^" + w[:k] for w in words for k in STEMS if len(w) > k}


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[toxic].update(_units(text))
        units = list({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), *(pa.array([s[u] for u in units], pa.int64()) for s in seen)], ["unit", "clean", "toxic"])


def _featured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for b in batches:
            rows = [features(t, model, machine).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    return run


def _lexicon(counted: DataFrame, n_clean: int, n_toxic: int) -> Model:
    """Units that mark toxic documents beyond chance; of nested units the most specific that loses little."""
    base = n_toxic / (n_clean + n_toxic)
    n_units = max(1, counted.count())
    least = max(3, math.ceil(math.log(CHANCE / n_units) / math.log(min(base, 0.9))))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    top = counted.where((F.col("toxic") >= least) | F.col("unit").isin(["=" + w for w in SEED_INSULTS])).withColumn("odds", odds)
    rows = top.orderBy(F.desc("odds"), F.desc("toxic"), "unit").limit(MAX_UNITS).collect()
    toxic = {r.unit: r.toxic for r in rows}
    model = Model()
    for r in rows:
        kind, unit = r.unit[0], r.unit[1:]
        if kind == "=":
            if r.odds >= LEAST_ODDS:
                model.words[unit] = float(r.odds)
            else:
                model.words.pop(unit, None)  # a seed that is no insult in these documents
        elif r.odds >= LEAST_ODDS:
            inner = max((n for u, n in toxic.items() if u != r.unit and u[1:].startswith(unit) and (u[0] == "=" or len(u) > len(r.unit))), default=0)
            if inner < 0.95 * r.toxic:
                model.stems[unit] = float(r.odds)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the bias."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the documents that ``labels(id, toxic)`` names; the caller leaves held-out rows out."""
    known = labels.select(F.col(labels.columns[0]).alias("_id"), F.col(labels.columns[1]).cast("int").alias("toxic"))
    known = known.where("_id IS NOT NULL AND toxic IN (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)  # at most 40,000 rows of 12 bytes: may be broadcast
    rows = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("_own") == F.col("_id"))
    rows = rows.select("text", "toxic")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    counted = rows.mapInArrow(_count_units, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = counted.where("clean + toxic > 1").persist()
    model = _lexicon(counted, n[0], n[1])
    counted.unpersist()
    sample = rows.mapInArrow(_featured(model), "x array<double>, toxic int").toPandas()
    model.coef = _logistic(np.array(sample["x"].tolist()), sample["toxic"].to_numpy(float))
    return model


def _scores(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for b in batches:
            z = np.array([model.coef[0] + model.coef[1:] @ features(t, model, machine) for t in b.column(b.num_columns - 1).to_pylist()], float)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], name])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", name: str = "_score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score as ``name``; no shuffle."""
    text = fresh(docs, "_text")[0]
    own = docs.select(*(F.col(c) for c in keep), F.col(text_col).alias(text))
    schema = own.drop(text).schema.add(name, "double")
    return own.mapInArrow(_scores(model, name), schema)


def held_out(id_col: str, folds: int = 4) -> F.Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by ``folds``; not for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 2, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the labelled rows of ``sf_dir`` that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return fit(docs, labels.where(~held_out("doc_id")))
