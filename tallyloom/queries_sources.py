"""Driver queries of sources, sinks, flattening and inference: what was written and read again equals the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import infer
from .plans import spec
from .registry import query, table
from .sources import files
from .sources.shared import Files, shared_dir


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/round-{uuid.uuid4().hex}/{name}"


def _again(df: DataFrame, name: str, single: bool = False, own: spec.Table | None = None) -> DataFrame:
    """``df`` written in the format of ``name`` and read."""
    path = _place(df.sparkSession, name)
    if single:
        files.write_single(df, path, own)
    else:
        files.write(df, path, table=own)
    return files.read(df.sparkSession, path)


_DOCS = "SELECT {id} AS doc_id, lang, length(text)::BIGINT AS n, md5(text) AS digest FROM documents"


def _digested(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "lang", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query(_DOCS.format(id="doc_id::VARCHAR") + " WHERE text <> ''")
def csv_round_trip(spark, sf_dir):
    return _digested(_again(table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "lang", "text"), "d.csv"))


@query("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, md5(text) AS digest FROM conversations WHERE text <> ''")
def tsv_round_trip(spark, sf_dir):
    back = _again(table(spark, sf_dir, "conversations").where("text <> ''"), "c.tsv", single=True)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(_DOCS.format(id="doc_id"))
def jsonl_round_trip(spark, sf_dir):
    return _digested(_again(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "d.jsonl"))


@query("SELECT item_id, text FROM benchmark")
def json_array_round_trip(spark, sf_dir):
    return _again(table(spark, sf_dir, "benchmark").select("item_id", "text"), "b.json").select("item_id", "text")


@query("SELECT item_id, text FROM benchmark")
def json_object_with_a_list(spark, sf_dir):
    """The first list of an object that has other keys too."""
    path = _place(spark, "o.json")
    rows = table(spark, sf_dir, "benchmark").select(F.to_json(F.struct("item_id", "text")).alias("j")).toLocalIterator()

    def parts():
        yield '{"about": {"z": 1}, "version": 3, "rows": ['
        for i, r in enumerate(rows):
            yield ("," if i else "") + r.j
        yield '], "later": [{"item_id": -1}]}'

    Files(spark).write(path, parts())
    return files.read(spark, path).select("item_id", "text")


@query("SELECT vec_id, label, len(embedding)::BIGINT AS n, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def parquet_round_trip(spark, sf_dir):
    back = _again(table(spark, sf_dir, "embeddings"), "e.parquet")
    return back.select("vec_id", "label", F.size("embedding").cast("long").alias("n"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


_SQLITE = {
    "tables": {
        "places": {"fields": {"key": {"type": "integer", "generator": "sequence"}, "name": "string", "price": "number"}},
        "visits": {"fields": {"key": {"type": "integer", "generator": "sequence"}, "place": {"ref": "places.key"}, "day": {"type": "date"}}},
    }
}


@query("SELECT o_orderkey AS key, o_custkey AS place, strftime(o_orderdate, '%Y-%m-%d') AS day, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def sqlite_round_trip(spark, sf_dir):
    """Two tables with primary and foreign key in one file, by ranges of the row number."""
    from urllib.parse import urlparse

    from .sources.sqlite import read_sqlite, write_sqlite

    path = urlparse(_place(spark, "")).path.rstrip("/") + ".sqlite"
    own = {t.name: t for t in spec.from_dict(_SQLITE).tables}
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("price"))
    visits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("place"), F.to_date("o_orderdate").alias("day"))
    write_sqlite({"visits": visits, "places": places}, own, path)
    names = read_sqlite(spark, path, "places").select(F.col("key").alias("_key"), "name")
    return read_sqlite(spark, path, "visits").join(names, F.col("place") == F.col("_key")).select("key", "place", "day", "name")


@query("SELECT * FROM (VALUES ('a.csv', 'csv', ','), ('b/c.TSV', 'csv', chr(9)), ('d.json', 'json', ','), ('e.jsonl', 'jsonl', ','), ('f.ndjson', 'jsonl', ','), ('g.parquet/', 'parquet', ','), ('h.db', 'sqlite', ','), ('i.txt', 'refused', ',')) t(path, format, separator)")
def format_detection(spark, sf_dir):
    def kind(path: str) -> str:
        try:
            return files.format_of(path)
        except ValueError:
            return "refused"

    paths = ["a.csv", "b/c.TSV", "d.json", "e.jsonl", "f.ndjson", "g.parquet/", "h.db", "i.txt"]
    return spark.createDataFrame([(p, kind(p), files.separator(p)) for p in paths], "path string, format string, separator string")


@query("SELECT least(7, count(*)) AS n, 1 AS names FROM orders")
def limit_on_read(spark, sf_dir):
    df = files.read(spark, f"{sf_dir}/orders.parquet", limit=7)
    return df.agg(F.count("*").alias("n"), F.lit(int(df.columns == table(spark, sf_dir, "orders").columns)).alias("names"))


def _nested(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    inner = F.struct(F.col("o_orderstatus").alias("code"), F.struct(F.col("o_orderpriority").alias("name")).alias("rank"))
    return o.select(F.col("o_orderkey").alias("key"), inner.alias("state"), F.array(F.lit(1), F.col("o_custkey").cast("int")).alias("list"))


@query("SELECT o_orderkey AS key, o_orderstatus AS \"state.code\", o_orderpriority AS \"state.rank.name\", '[1,' || o_custkey || ']' AS list FROM orders")
def flatten_nested(spark, sf_dir):
    return files.flatten(_nested(spark, sf_dir))


@query("SELECT o_orderkey AS key, o_orderstatus AS code, o_orderpriority AS rank, o_custkey::BIGINT AS second, '[not a list]' AS other FROM orders")
def unflatten_dotted(spark, sf_dir):
    """Dotted columns are structs again; text that is no JSON array stays text, with a schema or without."""
    flat = files.flatten(_nested(spark, sf_dir)).withColumn("other", F.lit("[not a list]"))
    return files.unflatten(flat).select("key", F.col("state.code").alias("code"), F.col("state.rank.name").alias("rank"), F.col("list")[1].cast("long").alias("second"), "other")


@query("SELECT event_id, event_id % 2 = 0 AS flag, event_id * 3 AS whole, event_id / 4.0::DOUBLE AS part, 'x' || event_id AS word, lpad(event_id::VARCHAR, 9, '0') AS padded, 'boolean,bigint,double,string,string' AS kinds FROM events")
def scalar_parsing(spark, sf_dir):
    """Text columns take the type that all their values have; numbers with leading zeros are text."""
    i = F.col("event_id")
    text = {"flag": F.when(i % 2 == 0, "True").otherwise("false"), "whole": (i * 3).cast("string"), "part": (i / 4).cast("string"), "word": F.concat(F.lit("x"), i), "padded": F.lpad(i.cast("string"), 9, "0")}
    df = infer.parsed(table(spark, sf_dir, "events").select("event_id", *(c.alias(k) for k, c in text.items())))
    return df.withColumn("kinds", F.lit(",".join(dict(df.dtypes)[k] for k in text)))


_INFERRED = "field string, type string, generator string, low string, high string, labels string, decimals int, null_rate double, unique_values boolean, shape string"


@query("""WITH e AS (SELECT * FROM events), n AS (SELECT count(*) AS n FROM e),
l AS (SELECT string_agg(v || ':' || round(k / n, 4), ' ' ORDER BY k DESC, v) AS labels FROM (SELECT event_type AS v, count(*)::DOUBLE AS k FROM e GROUP BY 1), n),
w AS (SELECT string_agg(v || ':' || round(k / n, 4), ' ' ORDER BY v) AS labels FROM (SELECT event_id % 4 AS v, count(*)::DOUBLE AS k FROM e GROUP BY 1), n)
SELECT * FROM (
SELECT 'place' AS field, 'integer' AS type, 'sequence' AS generator, NULL AS low, NULL AS high, NULL AS labels, NULL::INT AS decimals, NULL::DOUBLE AS null_rate, NULL::BOOLEAN AS unique_values, NULL AS shape
UNION ALL SELECT 'kind', 'enum', NULL, NULL, NULL, labels, NULL, NULL, NULL, NULL FROM l
UNION ALL SELECT 'few', 'enum', NULL, NULL, NULL, labels, NULL, NULL, NULL, NULL FROM w
UNION ALL SELECT 'backwards', 'integer', NULL, (SELECT min(-event_id)::VARCHAR FROM e), (SELECT max(-event_id)::VARCHAR FROM e), NULL, NULL, NULL, NULL, 'normal'
UNION ALL SELECT 'half', 'number', NULL, '0.5', (SELECT (max(event_id % 40) + 0.5)::DOUBLE::VARCHAR FROM e), NULL, 1, NULL, NULL, 'normal'
UNION ALL SELECT 'day', 'date', NULL, '2024-01-01', '2024-01-28', NULL, NULL, NULL, NULL, 'uniform'
UNION ALL SELECT 'mail', 'email', NULL, NULL, NULL, NULL, NULL, (SELECT round(1 - count(*) FILTER (WHERE event_id % 3 = 0) / count(*)::DOUBLE, 3) FROM e), NULL, NULL
UNION ALL SELECT 'link', 'url', NULL, NULL, NULL, NULL, NULL, NULL, true, NULL
UNION ALL SELECT 'empty', 'string', NULL, NULL, NULL, NULL, NULL, 1.0, NULL, NULL)""")
def infer_schema(spark, sf_dir):
    """The specification that a sample suggests, a row a field."""
    i = F.col("event_id")
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("place"),
        F.col("event_type").alias("kind"),
        (i % 4).cast("string").alias("few"),
        (-i).alias("backwards"),
        ((i % 40) + 0.5).cast("double").alias("half"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 28).cast("int")), "yyyy-MM-dd").alias("day"),
        F.when(i % 3 == 0, F.concat(F.lit("u"), i % 50, F.lit("@example.org"))).alias("mail"),
        F.concat(F.lit("https://example.org/"), i).alias("link"),
        F.lit(None).cast("string").alias("empty"),
    )
    rows = []
    for f in infer.fields_of(df, order="place"):
        labels = " ".join(f"{v}:{w}" for v, w in zip(f["values"], f["weights"], strict=True)) if "values" in f else None
        shape = f.get("distribution")
        text = lambda v: None if v is None else str(v)
        null = 1.0 if f.get("nullable") else f.get("null_rate")
        rows.append((f["name"], f["type"], f.get("generator"), text(f.get("min")), text(f.get("max")), labels, f.get("decimals"), null, f.get("unique"), shape["type"] if isinstance(shape, dict) else shape))
    return spark.createDataFrame(rows, _INFERRED)


@query("SELECT name, sha256(body) AS digest FROM (SELECT 'regions.jsonl' AS name, string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' || chr(10), '' ORDER BY r_regionkey) AS body FROM region)")
def manifest_hashes(spark, sf_dir):
    """Hashes of a manifest's files, from the manifest as it was read again."""
    folder = _place(spark, "")[:-1]
    path = f"{folder}/regions.jsonl"
    files.write_single(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), path)
    files.write_manifest(spark, folder, [path], {"by": "test"})
    found = Files(spark).read_json(f"{folder}/manifest.json")
    return spark.createDataFrame(list(found["files"].items()), "name string, digest string")


@query("SELECT '1,2' AS committed, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS rows, 'run' AS last_folder, 0 AS after_reset")
def store_rounds(spark, sf_dir):
    """Rounds that were committed are read; a torn one is not; the last run is remembered; a reset forgets."""
    from .sources.store import Store, read_last_run, write_last_run

    folder = _place(spark, "run")
    own = spec.from_dict({"name": "t", "fields": {"k": "integer", "n": "string"}}).tables[0]
    store = Store(spark, folder)
    store.append("t", table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("n")), 1, store.state("t"))
    store.append("t", table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("n")), 2, store.state("t"))
    table(spark, sf_dir, "nation").select(F.lit(1).cast("long").alias("k"), F.lit("torn").alias("n")).write.parquet(f"{store.table_path('t')}/round=3")
    write_last_run(spark, {"folder": "run"}, folder)
    n, rounds = store.load(own).count(), ",".join(map(str, store.state("t")["rounds"]))
    last = read_last_run(spark, folder)["folder"]
    store.reset("t")
    return spark.createDataFrame([(rounds, n, last, store.load(own).count())], "committed string, rows long, last_folder string, after_reset int")
