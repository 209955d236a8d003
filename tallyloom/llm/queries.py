"""Driver queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lines, lm, packing, pii, simhash, substrings, toxicity, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The installed public vocabulary that the packing queries use."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(spark, _table(spark, sf_dir, "documents"), with_text=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark").select("item_id", "text"), ["doc_id"])
    return found.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_items").alias("item_ids"), F.col("_similarity").alias("similarity"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.archive(spark, _table(spark, sf_dir, "pages"))
    page = F.when(F.col("page_id") != "", F.col("page_id")).cast("long").alias("page_id")
    return records.select(page, "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, _table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(spark, docs, sf_dir), ["doc_id"])
    predicted = (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), predicted)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_kept").alias("n_kept"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
}

# Every 50-byte string of the corpus, by its MD5; bytes as two hex digits, in parts of 256.
_OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, unnest(range(0, length(h) // 2, 256)) AS q, h FROM d WHERE h <> ''),
m AS (SELECT doc_id, q, substr(h, 2 * q + 1, 512) AS own, substr(h, 2 * q + 1, 612) AS more FROM k),
b AS (SELECT doc_id, q + unnest(range(0, length(own) // 2)) AS p, unnest(range(0, length(own) // 2)) AS i, more FROM m),
s AS (SELECT doc_id, p, substr(more, 2 * i + 1, 2) AS x, CASE WHEN length(more) >= 2 * i + 100 THEN md5_number(substr(more, 2 * i + 1, 100)) END AS s FROM b),
f AS (SELECT s, min(doc_id) AS least FROM s WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
c AS (SELECT s.doc_id, s.p, s.x, max(CASE WHEN f.least < s.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY s.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s LEFT JOIN f ON f.s = s.s),
g AS (SELECT doc_id, p, x, gone, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM c),
r AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans, string_agg(CASE WHEN gone = 0 THEN x END, '' ORDER BY p) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""

# All pairs of a label, components by reachability.
_OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
able AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_bool_or(list_transform(x, lambda c: c <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c::BIGINT AS component_id, vec_id = c.c AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

# Base32 digits are five bits each of the hex digits.
_OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id::BIGINT AS page_id, n::BIGINT AS payload_bytes,
array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, (1 + 5 * k // 4)::BIGINT, 2))::BIGINT >> (3 - 5 * k % 4)::BIGINT) & 31))::BIGINT, 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END::BIGINT AS refers_to FROM h
"""

# All pairs of lines with a shingle in common; recall of the operator is part of what is compared.
_OP10_SQL = """
WITH RECURSIVE l AS (SELECT doc_id, unnest(range(0, len(string_split(coalesce(text, ''), chr(10)))::BIGINT)) AS no, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, no, ls[no + 1] AS raw, trim(ls[no + 1], ' ') AS line FROM l),
f AS (SELECT line, min((doc_id, no)) AS first FROM r WHERE line <> '' GROUP BY line),
s AS (SELECT row_number() OVER (ORDER BY first) AS id, line, first, list_distinct(list_transform(range(1, greatest(length(line) - 6, 1)), lambda i: substr(line, i, 8))) AS g FROM f),
t AS (SELECT id, len(g) AS n, unnest(g) AS g FROM s WHERE length(line) >= 8),
q AS (SELECT g FROM t GROUP BY g HAVING count(*) > 1),
u AS (SELECT t.id, t.n, t.g FROM t SEMI JOIN q ON q.g = t.g),
e AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) + any_value(b.n) AS n FROM u a JOIN u b ON a.g = b.g AND a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY a.id, b.id),
e2 AS (SELECT a, b FROM e WHERE k / (n - k)::DOUBLE >= 0.8), e3 AS (SELECT a, b FROM e2 UNION ALL SELECT b, a FROM e2),
reach AS (SELECT a, a AS b FROM e3 UNION SELECT x.a, y.b FROM reach x JOIN e3 y ON y.a = x.b),
gone AS (SELECT s.line FROM s JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = s.id WHERE c.m < s.id),
k AS (SELECT r.doc_id, r.no, r.raw, r.line = '' AS blank, r.line <> '' AND f.first = (r.doc_id, r.no) AND r.line NOT IN (SELECT line FROM gone) AS kept FROM r LEFT JOIN f ON f.line = r.line)
SELECT doc_id, count(*) FILTER (WHERE NOT blank)::INT AS n_lines, count(*) FILTER (WHERE kept)::INT AS n_kept, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE blank OR kept), '') AS text FROM k GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": _OP2_SQL,
    "op5_embedding_near_dedup": _OP5_SQL,
    "op7_warc": _OP7_SQL,
    "op10_line_dedup": _OP10_SQL,
}
