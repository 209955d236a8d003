"""Driver queries of the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import rng, text
from .functions.checks import Compiler
from .operators import metrics, validate
from .plans import slots, spec
from .registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401

# Profiling -----------------------------------------------------------------------------------------------------------
_NUM = ("o_totalprice", "o_custkey")


def _numeric_sql(name: str, columns: tuple[str, ...]) -> str:
    one = (
        "SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.05), 4) AS p5, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50,"
        " round(quantile_cont({c}::DOUBLE, 0.95), 4) AS p95, round(max({c})::DOUBLE, 4) AS max, round(avg({c}::DOUBLE), 4) AS mean, round(stddev_pop({c}::DOUBLE), 4) AS std FROM {t}"
    )
    return " UNION ALL ".join(one.format(c=c, t=name) for c in columns)


@query(_numeric_sql("orders", _NUM))
def numeric_profile(spark, sf_dir):
    return metrics.numeric(table(spark, sf_dir, "orders"), list(_NUM))


@query(_numeric_sql("lineitem", ("l_quantity", "l_extendedprice", "l_discount")))
def numeric_profile_lineitem(spark, sf_dir):
    return metrics.numeric(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


def _completeness_sql(source: str, columns: dict[str, str]) -> str:
    one = "SELECT '{c}' AS \"column\", count(*) AS rows, round((count(*) - count({v})) / count(*)::DOUBLE, 3) AS null_rate, count(DISTINCT {v}) AS \"distinct\" FROM ({s})"
    return " UNION ALL ".join(one.format(c=c, v=v, s=source) for c, v in columns.items())


@query(_completeness_sql("SELECT * FROM orders", {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "nullif(o_orderstatus, '')", "o_orderpriority": "nullif(o_orderpriority, '')"}))
def null_rate_profile(spark, sf_dir):
    return metrics.completeness(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query(_completeness_sql("SELECT d.doc_id, l.quality, l.toxic, nullif(d.lang, 'en') AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", {"quality": "quality", "toxic": "toxic", "lang": "nullif(lang, '')"}))
def null_rate_with_nulls(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_id")
    df = d.join(labels, d.doc_id == labels._id, "left").select("doc_id", "quality", "toxic", F.nullif("lang", F.lit("en")).alias("lang"))
    return metrics.completeness(df, ["quality", "toxic", "lang"])


@query("SELECT c AS \"column\", d::BIGINT AS \"distinct\" FROM (SELECT 'linenumber' AS c, count(DISTINCT l_linenumber) AS d, count(*) AS n FROM lineitem UNION ALL SELECT 'one' AS c, count(DISTINCT 1) AS d, count(*) AS n FROM lineitem) WHERE d = 1 AND n >= 10")
def constant_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("linenumber"), F.lit(1).alias("one"))
    return metrics.completeness(df, df.columns).where(F.expr("`distinct` = 1 AND rows >= 10")).select("column", "distinct")


@query("SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_keys(spark, sf_dir):
    return metrics.duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def duplicate_documents(spark, sf_dir):
    return metrics.duplicate_rows(table(spark, sf_dir, "documents"), ["text"])


def _outlier_sql(expr: str, name: str) -> str:
    return (
        f"WITH v AS (SELECT {expr} AS v FROM {name}), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM v)"
        " SELECT count(*) AS n, (count(*) FILTER (WHERE b > a AND (v < a - 3.0 * (b - a) OR v > b + 3.0 * (b - a))))::BIGINT AS outliers FROM v, q"
    )


@query(_outlier_sql("n_chars::DOUBLE", "documents"))
def iqr_outliers(spark, sf_dir):
    return metrics.outliers(table(spark, sf_dir, "documents"), "n_chars")


@query(_outlier_sql("(o_totalprice * o_totalprice * o_totalprice / 1e9)::DOUBLE", "orders"))
def iqr_outliers_derived(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((F.col("o_totalprice") * F.col("o_totalprice") * F.col("o_totalprice") / F.lit(1e9)).alias("v"))
    return metrics.outliers(df, "v")


@query("SELECT round(max(n) / sum(n)::DOUBLE, 3) AS top_value_share FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def top_value_share(spark, sf_dir):
    return metrics.top_share(table(spark, sf_dir, "documents"), "lang")


_HEAP = "WITH v AS (SELECT {e} AS v FROM {t}), m AS (SELECT CASE WHEN quantile_cont(abs(v), 0.5) >= 100 THEN pow(10.0, greatest(1, floor(log10(quantile_cont(abs(v), 0.5))) - 1)) END AS step FROM v) SELECT step, round(avg(CASE WHEN step IS NULL THEN NULL WHEN v - step * floor(v / step) = 0 THEN 1.0 ELSE 0.0 END), 3) AS share FROM v, m GROUP BY step"


@query(_HEAP.format(e="(floor(o_totalprice / 500) * 500)::DOUBLE", t="orders"))
def round_number_heaping(spark, sf_dir):
    return metrics.heaping(table(spark, sf_dir, "orders").select((F.floor(F.col("o_totalprice") / 500) * 500).alias("v")), "v")


@query("WITH r AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rv, rank() OVER (ORDER BY event_id) AS ro FROM events) SELECT count(*) AS n, round(covar_pop(rv::DOUBLE, ro::DOUBLE) / (stddev_pop(rv::DOUBLE) * stddev_pop(ro::DOUBLE)), 3) AS rho FROM r")
def row_order_trend(spark, sf_dir):
    return metrics.order_trend(table(spark, sf_dir, "events"), "value", "event_id")


@query("WITH v AS (SELECT event_id, floor(event_id / 7) + value / 1000 AS v FROM events), r AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv, rank() OVER (ORDER BY event_id) AS ro FROM v) SELECT count(*) AS n, round(covar_pop(rv::DOUBLE, ro::DOUBLE) / (stddev_pop(rv::DOUBLE) * stddev_pop(ro::DOUBLE)), 3) AS rho FROM r")
def row_order_trend_derived(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", (F.floor(F.col("event_id") / 7) + F.col("value") / 1000).alias("v"))
    return metrics.order_trend(df, "v", "event_id")


@query("SELECT user_id % 5 AS value, count(*) AS n, (sum(count(*)) OVER (ORDER BY user_id % 5) - count(*) + (count(*) + 1) / 2.0)::DOUBLE AS rank FROM events GROUP BY user_id % 5")
def average_ranks(spark, sf_dir):
    return metrics.average_rank(table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("u")), "u")


@query("SELECT event_type AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 3) AS share FROM events GROUP BY event_type")
def value_distribution(spark, sf_dir):
    return metrics.distribution(table(spark, sf_dir, "events"), "event_type")


_ENTROPY = "WITH n AS (SELECT count(*) AS n FROM {t} GROUP BY {c}), p AS (SELECT n / (sum(n) OVER ())::DOUBLE AS p FROM n) SELECT count(*) AS labels, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 1.0 END, 3) AS entropy FROM p"


@query(_ENTROPY.format(t="documents", c="lang"))
def normalized_entropy(spark, sf_dir):
    return metrics.entropy(table(spark, sf_dir, "documents"), "lang")


@query("SELECT round(0.5 * sum(abs(coalesce(s.share, 0.0) - t.target)), 3) AS tvd FROM (VALUES ('en', 0.5), ('de', 0.3), ('it', 0.2)) t(label, target) LEFT JOIN (SELECT lang, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 3) AS share FROM documents GROUP BY lang) s ON s.lang = t.label")
def label_distribution_tvd(spark, sf_dir):
    return metrics.total_variation(table(spark, sf_dir, "documents"), "lang", {"en": 0.5, "de": 0.3, "it": 0.2})


@query("SELECT label FROM (VALUES ('en'), ('it'), ('pt')) t(label) WHERE label NOT IN (SELECT lang FROM documents)")
def unused_enum_values(spark, sf_dir):
    return metrics.unused_labels(table(spark, sf_dir, "documents"), "lang", ["en", "it", "pt"])


@query("SELECT min(length(text))::BIGINT AS min_length, round(avg(length(text)), 1) AS mean_length, max(length(text))::BIGINT AS max_length FROM pages JOIN (SELECT page_id AS p, html AS text FROM pages) x ON x.p = page_id")
def length_profile(spark, sf_dir):
    return metrics.lengths(table(spark, sf_dir, "pages"), "html")


@query(r"SELECT min(n)::BIGINT AS min_words, round(avg(n), 2) AS mean_words, max(n)::BIGINT AS max_words FROM (SELECT len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS n FROM documents)")
def word_count_profile(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(F.size(text.words(F.col("text"))).alias("n"))
    return n.agg(F.min("n").cast("long").alias("min_words"), F.round(F.avg("n"), 2).alias("mean_words"), F.max("n").cast("long").alias("max_words"))


@query("WITH a AS (SELECT string_split(text, ' ') AS a FROM benchmark), e AS (SELECT unnest(a) AS e FROM a) SELECT (SELECT min(len(a)) FROM a)::BIGINT AS min_items, (SELECT round(avg(len(a)), 2) FROM a) AS mean_items, (SELECT max(len(a)) FROM a)::BIGINT AS max_items, (SELECT count(DISTINCT e) FROM e) AS distinct_elements")
def array_profile(spark, sf_dir):
    return metrics.arrays(table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("a")), "a")[0]


@query("SELECT e AS element, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS e FROM benchmark) GROUP BY e ORDER BY n DESC, element LIMIT 5")
def array_top_elements(spark, sf_dir):
    return metrics.arrays(table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("a")), "a")[1]


_WORDS = r"SELECT regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents"


@query(f"WITH w AS ({_WORDS}), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w), n AS (SELECT b, count(*) AS n FROM b GROUP BY b) SELECT sum(n)::BIGINT AS bigrams, count(*) AS distinct_bigrams, round(count(*) / sum(n)::DOUBLE, 3) AS distinct_2 FROM n")
def distinct_2(spark, sf_dir):
    return metrics.ngram_diversity(table(spark, sf_dir, "documents"), text.words(F.col("text")), F.length("text"))


@query(f"SELECT array_to_string(w[1:3], ' ') AS opening, count(*) AS n FROM ({_WORDS}) WHERE len(w) >= 3 GROUP BY 1 ORDER BY n DESC, opening LIMIT 3")
def text_openings(spark, sf_dir):
    return metrics.top_openings(table(spark, sf_dir, "documents"), text.opening(text.words(F.col("text"))))


_SENTENCES = r"SELECT lower(trim(unnest(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1))))) AS s FROM documents"


@query(f"WITH s AS ({_SENTENCES}), n AS (SELECT s, count(*) AS n FROM s WHERE len(string_split_regex(s, '[ \\t\\n\\r]+')) >= 5 GROUP BY s) SELECT sum(n)::BIGINT AS sentences, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS repeated, round(coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n)::DOUBLE, 3) AS share FROM n")
def repeated_sentences(spark, sf_dir):
    return metrics.repeated_sentences(table(spark, sf_dir, "documents"), text.sentences(F.col("text")))


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS near_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))")
def near_duplicate_text(spark, sf_dir):
    folded = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    return metrics.folded_duplicates(table(spark, sf_dir, "documents"), folded)


@query("SELECT 'o_totalprice' AS \"column\", round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(stddev_pop(v), 4) AS std, round((avg(v*v*v) - 3*avg(v)*avg(v*v) + 2*avg(v)*avg(v)*avg(v)) / pow(stddev_pop(v), 3), 4) AS skew, round(stddev_pop(ln(v)), 4) AS log_std FROM (SELECT o_totalprice AS v FROM orders)")
def numeric_moments(spark, sf_dir):
    return metrics.moments(table(spark, sf_dir, "orders"), ["o_totalprice"])


# Sampling ------------------------------------------------------------------------------------------------------------
def _u(*parts: str) -> str:
    return "(('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 13))::BIGINT / 4503599627370496.0)"


def _z(*parts: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_u(*parts, repr('a'))})) * cos(2 * 3.141592653589793 * {_u(*parts, repr('b'))}))"


_KEY = ("'7'", "'t'", "o_orderkey::VARCHAR")


def _key(salt: str = "t"):
    return ("7", salt, F.col("o_orderkey"))


@query(f"SELECT o_orderkey, floor({_u(*_KEY)} * 73)::BIGINT + 18 AS v FROM orders")
def sample_uniform_ints(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", rng.uniform_int(18, 90, *_key()).alias("v"))


@query(f"SELECT o_orderkey, strftime(DATE '2024-01-01' + floor({_u(*_KEY)} * 366)::INTEGER, '%Y-%m-%d') AS v FROM orders")
def sample_uniform_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(rng.uniform_date("2024-01-01", "2024-12-31", *_key()), "yyyy-MM-dd").alias("v"))


@query(f"SELECT o_orderkey, round(40 + 12 * {_z(*_KEY)}, 4) AS v FROM orders")
def sample_normal(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(rng.draw("normal", {"mean": 40.0, "std": 12.0}, *_key()), 4).alias("v"))


@query(f"SELECT o_orderkey, round(28 * exp(0.8 * {_z(*_KEY)}), 3) AS v FROM orders")
def sample_lognormal(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(rng.draw("lognormal", {"median": 28.0, "sigma": 0.8}, *_key()), 3).alias("v"))


@query(f"SELECT o_orderkey, round(-5 * ln(1 - {_u(*_KEY)}), 4) AS v FROM orders")
def sample_exponential(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(rng.draw("exponential", {"mean": 5.0}, *_key()), 4).alias("v"))


def _poly(x: str, factors: tuple) -> str:
    out = repr(factors[0])
    for f in factors[1:]:
        out = f"({out} * {x} + {f!r})"
    return out


def _inverse_sql(p: str) -> str:
    tail = lambda q: f"({_poly(f'sqrt(-2 * ln({q}))', rng.TAIL)} / {_poly(f'sqrt(-2 * ln({q}))', rng.TAIL_BELOW)})"
    x = f"(({p}) - 0.5)"
    return f"CASE WHEN {p} < {rng.TAIL_FROM} THEN {tail(p)} WHEN {p} > 1 - {rng.TAIL_FROM} THEN -{tail(f'(1 - ({p}))')} ELSE {_poly(f'({x} * {x})', rng.CENTRE)} * {x} / {_poly(f'({x} * {x})', rng.CENTRE_BELOW)} END"


# Probabilities below 18 and 60 of a normal of mean 40 and deviation 30.
_LOW, _HIGH = (0.5 * math.erfc((40 - x) / 30 / math.sqrt(2)) for x in (18, 60))


@query(f"SELECT o_orderkey, round(least(60.0, greatest(18.0, 40 + 30 * ({_inverse_sql('p')}))), 4) AS v FROM (SELECT o_orderkey, {_LOW!r} + {_u(*_KEY)} * {_HIGH - _LOW!r} AS p FROM orders)")
def sample_bounded_normal(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(rng.bounded("normal", {"mean": 40.0, "std": 30.0}, 18, 60, *_key()), 4).alias("v"))


@query(f"SELECT o_orderkey, round(-5 * ln(1 - ((1 - exp(-0.4)) + {_u(*_KEY)} * (exp(-0.4) - exp(-2.0)))), 4) AS v FROM orders")
def sample_bounded_exponential(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(rng.bounded("exponential", {"mean": 5.0}, 2, 10, *_key()), 4).alias("v"))


@query(f"SELECT o_orderkey, {_u(*_KEY)} < 0.25 AS is_null FROM orders")
def sample_nulls(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (rng.uniform(*_key()) < 0.25).alias("is_null"))


@query("WITH h AS (SELECT o_orderkey, md5('7|t|' || o_orderkey::VARCHAR) AS h FROM orders) SELECT o_orderkey, substr(h,1,8)||'-'||substr(h,9,4)||'-4'||substr(h,14,3)||'-a'||substr(h,18,3)||'-'||substr(h,21,12) AS v FROM h")
def uuid_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", slots.uuid_text(*_key()).alias("v"))


@query("WITH c AS (SELECT event_type AS label, row_number() OVER (ORDER BY event_type) AS idx, count(*) AS weight FROM events GROUP BY event_type), x AS (SELECT *, weight * 1000.0 / sum(weight) OVER () AS x FROM c), r AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, idx) AS k FROM x) SELECT label, idx::INTEGER AS idx, (f + CASE WHEN k <= 1000 - (SELECT sum(f) FROM r) THEN 1 ELSE 0 END)::BIGINT AS n FROM r")
def apportion_labels(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("weight"))
    return slots.apportion(counts.withColumn("idx", F.row_number().over(W.orderBy("label"))), 1000)


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|tier|' || o_orderkey::VARCHAR), o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey, CASE WHEN k < n // 5 THEN 'gold' WHEN k < n // 5 + n // 3 THEN 'silver' ELSE 'bronze' END AS label FROM r, (SELECT count(*) AS n FROM orders)")
def stratified_slots(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    n = orders.count()
    return slots.labelled(orders, "o_orderkey", [("gold", n // 5), ("silver", n // 3), ("bronze", n - n // 5 - n // 3)], "7", "tier")


_PARENTS = "SELECT c_custkey, row_number() OVER (ORDER BY md5('7|fk|popularity|' || c_custkey::VARCHAR), c_custkey) - 1 AS k FROM customer"


@query(f"WITH p AS ({_PARENTS}), s AS (SELECT o_orderkey, least(floor({_u(repr('7'), repr('fk'), 'o_orderkey::VARCHAR')} * (SELECT count(*) FROM p)), (SELECT count(*) - 1 FROM p))::BIGINT AS d FROM orders) SELECT o_orderkey, c_custkey FROM s JOIN p ON p.k = s.d")
def fk_uniform(spark, sf_dir):
    drawn = slots.pick_parents(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "customer"), "c_custkey", 0, "7", "fk", key_name="o_orderkey")
    return drawn.select("o_orderkey", "_parent.c_custkey")


@query(f"WITH p AS ({_PARENTS}), s AS (SELECT o_orderkey, {_u(repr('7'), repr('fk'), 'o_orderkey::VARCHAR')} AS u FROM orders), b AS (SELECT c_custkey, sum(1 / pow(k + 1, 1.1)) OVER (ORDER BY k) / (SELECT sum(1 / pow(k + 1, 1.1)) FROM p) AS hi, (1 / pow(k + 1, 1.1)) / (SELECT sum(1 / pow(k + 1, 1.1)) FROM p) AS w FROM p) SELECT c_custkey, count(*) AS n FROM s JOIN b ON u < hi AND u >= hi - w GROUP BY c_custkey")
def fk_zipf(spark, sf_dir):
    drawn = slots.pick_parents(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "customer"), "c_custkey", 1.1, "7", "fk", key_name="o_orderkey")
    return drawn.groupBy(F.col("_parent.c_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def fk_integrity(spark, sf_dir):
    from .operators.accept import orphans

    parents = table(spark, sf_dir, "customer").where("c_nationkey <> 3")
    return orphans(table(spark, sf_dir, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey")


# Validation and acceptance -------------------------------------------------------------------------------------------
def events_spec() -> spec.Table:
    document = {
        "name": "events",
        "fields": [
            {"name": "event_id", "type": "integer", "min": 10},
            {"name": "event_type", "type": "enum", "values": ["CLICK", "view", "purchase"]},
            {"name": "value", "type": "number", "min": 0, "max": 90},
            {"name": "user_id", "type": "integer", "unique": True},
        ],
        "checks": ["value < 80 or event_type != 'view'"],
    }
    return spec.from_dict(document).tables[0]


def _events(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    return validate.validate(validate.as_records(own).select(F.col("event_id").alias("row"), "_record"), events_spec())


_EVENTS_SQL = """WITH e AS (SELECT event_id AS row, event_id < 10 AS a, lower(event_type) NOT IN ('click', 'view', 'purchase') AS b, value < 0 AS c, value > 90 AS d, value >= 80 AND event_type = 'view' AS k FROM events),
x AS (SELECT row, CASE WHEN a THEN 'event_id: Input should be greater than or equal to 10' END AS c1, CASE WHEN b THEN 'event_type: not one of the allowed values' END AS c2,
CASE WHEN c THEN 'value: Input should be greater than or equal to 0' WHEN d THEN 'value: Input should be less than or equal to 90' END AS c3,
CASE WHEN NOT a AND NOT b AND NOT c AND NOT d AND k THEN 'check: failed: value < 80 or event_type != ''view''' END AS c4 FROM e)"""


@query(_EVENTS_SQL + " SELECT row, coalesce(c1, c2, c3, c4) AS first_error FROM x WHERE coalesce(c1, c2, c3, c4) IS NOT NULL")
def record_violations(spark, sf_dir):
    return _events(spark, sf_dir).select("row", validate.first_error(F.col("_errors")).alias("first_error")).where("first_error IS NOT NULL")


@query(_EVENTS_SQL + ", u AS (SELECT c1 AS category FROM x UNION ALL SELECT c2 FROM x UNION ALL SELECT c3 FROM x UNION ALL SELECT c4 FROM x) SELECT category, count(*) AS n FROM u WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category LIMIT 15")
def violation_rollup(spark, sf_dir):
    return validate.roll_up(_events(spark, sf_dir))


@query(_EVENTS_SQL + " SELECT count(*) AS rows, round(avg(CASE WHEN coalesce(c1, c2, c3, c4) IS NULL THEN 1.0 ELSE 0.0 END), 4) AS pass_rate FROM x")
def pass_rate(spark, sf_dir):
    ok = (F.size("_errors") == 0).cast("double")
    return _events(spark, sf_dir).agg(F.count("*").alias("rows"), F.round(F.avg(ok), 4).alias("pass_rate"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_discount <= 0.08 OR l_quantity > 10) OR NOT (l_returnflag IN ('A', 'N') OR l_linestatus = 'F')")
def checks_cross_field(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    c = Compiler(df.schema)
    ok = c.compile("l_discount <= 0.08 or l_quantity > 10") & c.compile("l_returnflag in ('A', 'N') or l_linestatus == 'F'")
    return df.where(~ok).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (l_shipdate >= o_orderdate) GROUP BY l_orderkey")
def parent_check(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    context = F.struct("o_orderdate")
    joined = items.join(orders.select("o_orderkey", context.alias("_parent")), F.col("l_orderkey") == F.col("o_orderkey"))
    c = Compiler(items.schema, {"l_orderkey": (F.col("_parent"), joined.schema["_parent"].dataType)})
    return joined.where(~c.compile("l_shipdate >= parent['l_orderkey']['o_orderdate']")).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def _one(kind: str, **keys) -> spec.Field:
    return spec.from_dict({"fields": [{"name": "v", "type": kind, **keys}]}).tables[0].fields[0]


@query("SELECT event_id, CASE lower(trim(' ' || upper(event_type))) WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' END AS v FROM events")
def enum_normalize(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.to_variant_object(F.array(F.concat(F.lit(" "), F.upper("event_type")))).alias("a"))
    v = F.try_variant_get("a", "$[0]", "variant")
    return df.select("event_id", validate.compile_field(_one("enum", values=["Click", "View"]), v, F.lit("v"))["value"].alias("v"))


@query(r"SELECT page_id, regexp_matches(url, '^https?://[^\s/$.?#][^\s]*$') AS url_ok, regexp_matches('p' || page_id || '@' || CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'a.org' END, '^[A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') AS email_ok FROM pages")
def email_url_valid(spark, sf_dir):
    mail = F.concat(F.lit("p"), F.col("page_id"), F.lit("@"), F.when(F.col("page_id") % 3 == 0, "a").otherwise("a.org"))
    df = table(spark, sf_dir, "pages").select("page_id", F.to_variant_object(F.struct(F.col("url").alias("u"), mail.alias("m"))).alias("r"))
    ok = {k: F.size(validate.compile_field(_one(t), F.try_variant_get("r", f"$.{k}", "variant"), F.lit("v"))["errors"]) == 0 for k, t in (("u", "url"), ("m", "email"))}
    return df.select("page_id", ok["u"].alias("url_ok"), ok["m"].alias("email_ok"))


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")
def first_wins_unique(spark, sf_dir):
    from .operators.accept import first_wins

    return first_wins(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey")


@query("WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) SELECT o_orderkey, o_orderpriority FROM r WHERE k <= CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 50 ELSE 0 END")
def quota_cap(spark, sf_dir):
    from .operators.accept import cap

    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return cap(df, "o_orderpriority", {"1-URGENT": 100, "2-HIGH": 50}, "o_orderkey")


@query("SELECT o_orderkey, 'ORD-' || lpad((100 + row_number() OVER (ORDER BY o_orderkey) - 1)::VARCHAR, 6, '0') AS id FROM orders")
def sequence_ids(spark, sf_dir):
    from .operators.accept import numbered

    df = table(spark, sf_dir, "orders").select("o_orderkey")
    return numbered(df, "o_orderkey", 100).select("o_orderkey", slots.sequence_text(F.col("_number"), "ORD-{:06d}", "string").alias("id"))


@query("SELECT count(*) AS records, count(DISTINCT key) AS keys FROM (SELECT lower(trim(regexp_replace(upper(text) || '  x', '[ \\t\\n\\r]+', ' ', 'g'))) AS key FROM conversations)")
def folded_keys(spark, sf_dir):
    key = text.collapsed(F.concat(F.upper("text"), F.lit("  x")))
    return table(spark, sf_dir, "conversations").select(key.alias("key")).agg(F.count("*").alias("records"), F.count_distinct("key").alias("keys"))


@query("SELECT conv_id, role, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id, role")
def conversation_shape(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"))


from . import queries_plans, queries_rules, queries_runs, queries_sources  # noqa: E402, F401  they enter their queries themselves
