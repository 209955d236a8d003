"""A training corpus from ``documents`` in five stages.

Every stage reads what its predecessor wrote.  Each calls one operator of ``tallyloom.llm``; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontam, lines, packing, simhash, toxicity
from tallyloom.llm.queries import tokenizer_path
from tallyloom.llm.store import Scratch, fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.  The model is fitted on the labelled rows that are not held out."""
    model, score = toxicity.train(spark, docs, sf_dir), fresh(docs, "_score")[0]
    kept = toxicity.score(docs, model, docs.columns, name=score)
    return kept.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines one stays; n_chars follows the text.  A document that lost all its lines keeps its row."""
    out = lines.dedup(spark, docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row of the least id stays (then of the least text hash); of equal rows, one."""
    k1, k2, key = fresh(docs, "_k1", "_k2", "_key")
    keyed = docs.withColumns({k1: F.xxhash64("doc_id", "text"), k2: F.xxhash64(F.lit("row"), "doc_id", "text")})
    own = F.struct("doc_id", F.col(k1).alias("k1"), F.col(k2).alias("k2"))
    found = simhash.near_duplicates(spark, keyed.select(own.alias(key), "text"), key)
    heads = found.where(F.col("id") == F.col("component_id")).select(F.col("id.k1").alias(k1), F.col("id.k2").alias(k2)).distinct()
    return keyed.join(heads, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    names = tuple(fresh(docs, *decontam.FOUND))
    found = decontam.search(docs, benchmark, docs.columns, names=names)
    return found.where(F.size(names[0]) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(spark, docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Fuzzy lines, fingerprints, learned scores and token ids have no SQL form; the tests compare each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        after = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        docs = before = after
    return docs
