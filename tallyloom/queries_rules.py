"""Driver queries of validation rules, checks and the quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.checks import Compiler
from .operators import report, validate
from .plans import spec
from .registry import query, table


def _judged(df: DataFrame, key: str, fields: dict, record: Column, checks: list[str] | None = None) -> DataFrame:
    """Records given as JSON text, validated; ``key`` stays."""
    own = spec.from_dict({"name": "t", "fields": fields | {"filler": "string"}, "checks": checks or []}).tables[0]
    own.fields = [f for f in own.fields if f.name != "filler"]
    rows = df.select(F.col(key).alias("row"), F.parse_json(record).alias("_record"))
    return validate.validate(rows, own)


def _said(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select("row", *columns, F.array_join(F.transform("_errors", lambda e: F.concat(e["path"], F.lit(": "), e["reason"])), "; ").alias("errors"))


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")


@query("SELECT event_id AS row, concat_ws('; ', CASE WHEN event_id % 3 = 0 THEN 'name: Field required' END, CASE WHEN event_id % 5 = 0 THEN 'other: Extra inputs are not permitted' END) AS errors FROM events")
def required_and_extra(spark, sf_dir):
    i = F.col("event_id")
    record = F.concat(F.lit('{"n":'), i, F.when(i % 3 != 0, ',"name":"x"').otherwise(""), F.when(i % 5 == 0, ',"other":1').otherwise(""), F.lit("}"))
    return _said(_judged(_events(spark, sf_dir), "event_id", {"n": "integer", "name": "string"}, record))


@query("""SELECT event_id AS row, CASE event_id % 8 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN event_id WHEN 3 THEN 1 WHEN 4 THEN event_id END AS v,
CASE event_id % 8 WHEN 5 THEN 'v: Input should be a valid integer, got a number with a fractional part' WHEN 6 THEN 'v: Input should be a valid integer, unable to parse string as an integer' WHEN 7 THEN 'v: Input should be a valid integer' ELSE '' END AS errors FROM events""")
def coerced_integers(spark, sf_dir):
    i = F.col("event_id")
    forms = {0: i, 1: F.concat(F.lit('" '), i, F.lit(' "')), 2: F.concat(i, F.lit(".0")), 3: F.lit("true"), 4: F.concat(F.lit('"'), i, F.lit('.00"')), 5: F.concat(i, F.lit(".5")), 6: F.lit('"many"')}
    value = F.lit("[1]")
    for k, c in forms.items():
        value = F.when(i % 8 == k, c.cast("string")).otherwise(value)
    return _said(_judged(_events(spark, sf_dir), "event_id", {"v": "integer"}, F.concat(F.lit('{"v":'), value, F.lit("}"))), "v")


@query("""SELECT event_id AS row, CASE WHEN event_id % 6 < 4 THEN event_id % 2 = 0 END AS v,
CASE WHEN event_id % 6 = 4 THEN 'v: Input should be a valid boolean, unable to interpret input' WHEN event_id % 6 = 5 THEN 'v: Input should be a valid boolean' ELSE '' END AS errors FROM events""")
def coerced_booleans(spark, sf_dir):
    i = F.col("event_id")
    value = F.element_at(F.array(*map(F.lit, ("true", '"No"', '"Y"', "0", '"perhaps"', "{}"))), (i % 6 + 1).cast("int"))
    return _said(_judged(_events(spark, sf_dir), "event_id", {"v": "boolean"}, F.concat(F.lit('{"v":'), value, F.lit("}"))), "v")


@query("""SELECT event_id AS row, CASE WHEN event_id % 4 < 2 THEN round_even(event_id / 8.0::DOUBLE, 2) END AS v,
CASE WHEN event_id % 4 = 2 THEN 'v: not a finite number' WHEN event_id % 4 = 3 THEN 'v: Input should be a valid number, unable to parse string as a number' ELSE '' END AS errors FROM events""")
def rounded_and_finite(spark, sf_dir):
    i = F.col("event_id")
    text = F.concat(F.lit('"'), (i / 8).cast("string"), F.lit('"'))
    value = F.when(i % 4 == 0, (i / 8).cast("string")).when(i % 4 == 1, text).when(i % 4 == 2, '"Infinity"').otherwise('"wide"')
    out = _judged(_events(spark, sf_dir), "event_id", {"v": {"type": "number", "decimals": 2}}, F.concat(F.lit('{"v":'), value, F.lit("}")))
    return _said(out, F.when(F.size("_errors") == 0, F.col("v")).alias("v"))


_DAY = "(DATE '2023-12-20' + (event_id % 40)::INTEGER)"


@query(f"""SELECT event_id AS row, CASE WHEN event_id % 7 > 0 THEN strftime({_DAY}, '%Y-%m-%d') END AS day, CASE WHEN event_id % 7 > 0 THEN strftime({_DAY} + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') END AS moment,
CASE WHEN event_id % 7 = 0 THEN 'day: not a valid date (ISO 8601); moment: not a valid datetime (ISO 8601)' ELSE concat_ws('; ', CASE WHEN {_DAY} < DATE '2024-01-01' THEN 'day: before min 2024-01-01' END, CASE WHEN {_DAY} + INTERVAL 90 MINUTE > TIMESTAMP '2024-01-20 12:00:00' THEN 'moment: after max 2024-01-20T12:00:00Z' END) END AS errors FROM events""")
def temporal_bounds(spark, sf_dir):
    i = F.col("event_id")
    day = F.date_format(F.date_add(F.lit("2023-12-20").cast("date"), (i % 40).cast("int")), "yyyy-MM-dd")
    shown = F.when(i % 7 > 0, day).otherwise("next week")
    moment = F.when(i % 2 == 0, F.concat(shown, F.lit("T03:30:00+02:00"))).otherwise(F.concat(shown, F.lit(" 01:30")))
    record = F.concat(F.lit('{"day":"'), shown, F.lit('","moment":"'), moment, F.lit('"}'))
    fields = {"day": {"type": "date", "min": "2024-01-01"}, "moment": {"type": "datetime", "max": "2024-01-20T12:00:00Z"}}
    return _said(_judged(_events(spark, sf_dir), "event_id", fields, record), F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("moment", "yyyy-MM-dd HH:mm").alias("moment"))


@query("""WITH s AS (SELECT event_id AS row, repeat('ab', (event_id % 6)::INTEGER) || CASE WHEN event_id % 5 = 0 THEN '7' ELSE '' END AS s FROM events)
SELECT row, s, CASE WHEN s = '' THEN 'v: empty string' WHEN length(s) < 3 THEN 'v: too short (min 3 characters)' WHEN length(s) > 9 THEN 'v: too long (max 9 characters)' WHEN NOT regexp_full_match(s, '[a-z]+') THEN 'v: does not match pattern [a-z]+' ELSE '' END AS errors FROM s""")
def string_rules(spark, sf_dir):
    i = F.col("event_id")
    s = F.concat(F.lit("  "), F.repeat(F.lit("ab"), (i % 6).cast("int")), F.when(i % 5 == 0, "7").otherwise(""), F.lit(" "))
    record = F.to_json(F.struct(s.alias("v")))
    return _said(_judged(_events(spark, sf_dir), "event_id", {"v": {"type": "string", "min_length": 3, "max_length": 9, "pattern": "[a-z]+"}}, record), F.col("v").alias("s"))


@query("""SELECT event_id AS row, lower(v) AS v, CASE WHEN bad THEN 'v: not a valid UUID' ELSE '' END AS errors FROM (SELECT event_id, event_id % 4 = 3 AS bad,
CASE WHEN event_id % 4 = 3 THEN 'not-a-uuid' ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS v FROM (SELECT event_id, md5(event_id::VARCHAR) AS h FROM events))""")
def uuid_forms(spark, sf_dir):
    i, h = F.col("event_id"), F.md5(F.col("event_id").cast("string"))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    value = F.when(i % 4 == 0, h).when(i % 4 == 1, F.concat(F.lit("urn:uuid:"), dashed)).when(i % 4 == 2, F.concat(F.lit("{"), F.upper(dashed), F.lit("}"))).otherwise("not-a-uuid")
    return _said(_judged(_events(spark, sf_dir), "event_id", {"v": "uuid"}, F.to_json(F.struct(value.alias("v")))), "v")


@query("""SELECT event_id AS row, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS n,
CASE event_id % 4 WHEN 0 THEN 'v: List should have at least 1 item after validation, not 0' WHEN 2 THEN 'v.1: Input should be greater than or equal to 0' WHEN 3 THEN 'v: List should have at most 3 items after validation, not 4' ELSE '' END AS errors FROM events""")
def array_rules(spark, sf_dir):
    """Sizes, and elements by their place."""
    i = F.col("event_id")
    value = F.element_at(F.array(*map(F.lit, ("[]", "[1,2]", '[0,-1,"5"]', "[1,2,3,4]"))), (i % 4 + 1).cast("int"))
    fields = {"v": {"type": "array", "items": {"type": "integer", "min": 0}, "min_items": 1, "max_items": 3}}
    return _said(_judged(_events(spark, sf_dir), "event_id", fields, F.concat(F.lit('{"v":'), value, F.lit("}"))), F.size("v").alias("n"))


@query("""SELECT event_id AS row, CASE WHEN event_id % 3 = 0 THEN 'Rome' END AS town,
CASE event_id % 3 WHEN 1 THEN 'at.geo.lat: Input should be less than or equal to 90; at.zip: Extra inputs are not permitted' WHEN 2 THEN 'at: Input should be a valid dictionary' ELSE '' END AS errors FROM events""")
def nested_objects(spark, sf_dir):
    value = F.element_at(F.array(*map(F.lit, ('{"town":"Rome","geo":{"lat":41.5}}', '{"town":"Oslo","geo":{"lat":99},"zip":1}', '"nowhere"'))), (F.col("event_id") % 3 + 1).cast("int"))
    geo = {"type": "object", "properties": {"lat": {"type": "number", "max": 90}}}
    out = _judged(_events(spark, sf_dir), "event_id", {"at": {"type": "object", "properties": {"town": "string", "geo": geo}}}, F.concat(F.lit('{"at":'), value, F.lit("}")))
    return _said(out, F.when(F.size("_errors") == 0, F.col("at.town")).alias("town"))


@query("SELECT event_id AS row, CASE WHEN event_id % 2 = 0 AND event_id % 3 > 0 THEN 'check: failed: n < 0' ELSE CASE WHEN event_id % 3 = 0 THEN 'n: Field required' ELSE CASE WHEN event_id % 2 = 1 THEN 'check: failed: n < 0' ELSE '' END END END AS errors FROM events")
def checks_wait_for_fields(spark, sf_dir):
    """Checks run where the fields are right; one that needs a parent is passed over without its context."""
    i = F.col("event_id")
    record = F.when(i % 3 == 0, "{}").otherwise('{"n":1}')
    own = spec.from_dict({"tables": {"p": {"fields": {"id": {"type": "integer", "generator": "sequence"}, "a": "string"}}, "c": {"fields": {"n": "integer", "p": {"ref": "p.id", "ref_context": ["a"]}}, "checks": ["n < 0", "parent['p']['a'] == 'x'"]}}}).table("c")
    own.fields = [f for f in own.fields if f.name == "n"]
    return _said(validate.validate(table(spark, sf_dir, "events").select(i.alias("row"), F.parse_json(record).alias("_record")), own))


# Checks --------------------------------------------------------------------------------------------------------------
def _passing(df: DataFrame, key: str, checks: list[str]) -> DataFrame:
    c = Compiler(df.schema)
    return df.select(key, *(c.compile(x).alias(f"c{i}") for i, x in enumerate(checks)))


@query("SELECT c_custkey, length(c_name) > 17 AS c0, upper(c_name) LIKE 'CUST%' AS c1, c_mktsegment LIKE '%E%' AND NOT ends_with(c_name, '1') AS c2, contains(c_name, c_custkey::VARCHAR) AS c3, len(string_split(c_name, '#')) = 2 AS c4, len(string_split_regex(trim(c_name), '\\s+')) = 1 AS c5 FROM customer")
def checks_on_text(spark, sf_dir):
    checks = ["len(c_name) > 17", "c_name.upper().startswith('CUST')", "'E' in c_mktsegment and not c_name.endswith('1')", "str(c_custkey) in c_name", "len(c_name.split('#')) == 2", "len(c_name.split()) == 1"]
    return _passing(table(spark, sf_dir, "customer"), "c_custkey", checks)


_WORDS = "SELECT item_id, string_split(text, ' ') AS w FROM benchmark"


@query(f"SELECT item_id, len(w) > 20 AS c0, len(list_distinct(w)) = len(w) AS c1, len(list_filter(w, lambda x: length(x) > 3)) > 12 AS c2, list_contains(w, 'the') AS c3, list_bool_and(list_transform(w, lambda x: x <> '')) AS c4, len(w[-1]) >= len(w[1]) AS c5, list_sum(list_transform(w, lambda x: length(x))) > 120 AS c6 FROM ({_WORDS})")
def checks_on_arrays(spark, sf_dir):
    df = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    checks = ["len(w) > 20", "len(set(w)) == len(w)", "len([x for x in w if len(x) > 3]) > 12", "'the' in w", "all(x != '' for x in w)", "len(w[-1]) >= len(w[0])", "sum(len(x) for x in w) > 120"]
    return _passing(df, "item_id", checks)


@query("SELECT o_orderkey, o_totalprice > CASE o_orderstatus WHEN 'F' THEN 100000 WHEN 'O' THEN 150000 WHEN 'P' THEN 50000 END AS c0, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice > 1000 ELSE o_totalprice < 200000 END AS c1, o_orderkey < 100 OR o_orderkey > 200 AND o_orderkey <= 300 AS c2, round_even(o_totalprice::DOUBLE / 1000, 1) >= 150.5 AS c3, o_orderdate >= DATE '1995-03-01' AS c4 FROM orders")
def checks_with_conditions(spark, sf_dir):
    checks = ["o_totalprice > {'F': 100000, 'O': 150000, 'P': 50000}[o_orderstatus]", "o_totalprice > 1000 if o_custkey % 2 == 0 else o_totalprice < 200000", "o_orderkey < 100 or 200 < o_orderkey <= 300", "round(o_totalprice / 1000, 1) >= 150.5", "o_orderdate >= date.fromisoformat('1995-03-01')"]
    df = table(spark, sf_dir, "orders").withColumns({"o_totalprice": F.col("o_totalprice").cast("double"), "o_orderdate": F.to_date("o_orderdate")})
    return _passing(df, "o_orderkey", checks)


@query(r"""SELECT o_orderkey, l_shipdate - o_orderdate <= 60 AS c0, date_diff('day', o_orderdate, l_shipdate) > 30 AS c1, l_receiptdate <= l_shipdate + INTERVAL 14 DAY AS c2, year(l_shipdate) = 1995 OR month(l_shipdate) IN (6, 7) AS c3,
isodow(o_orderdate) - 1 < 5 AS c4, regexp_full_match(o_orderpriority, '[1-3]-\w+') AS c5, regexp_matches(o_orderpriority, 'GH') AS c6, true AS c7, false AS c8 FROM (SELECT o_orderkey, o_orderdate::DATE AS o_orderdate, o_orderpriority, l_shipdate::DATE AS l_shipdate, (l_shipdate::DATE + (l_linenumber * 4)::INTEGER) AS l_receiptdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1)""")
def checks_on_dates(spark, sf_dir):
    checks = ["l_shipdate - o_orderdate <= timedelta(days=60)", "(l_shipdate - o_orderdate).days > 30", "l_receiptdate <= l_shipdate + timedelta(weeks=2)", "l_shipdate.year == 1995 or l_shipdate.month in (6, 7)", "o_orderdate.weekday() < 5", "re.fullmatch('[1-3]-\\w+', o_orderpriority)", "re.search('GH', o_orderpriority)", "isinstance(o_orderkey, int) and isinstance(l_shipdate, (date, str))", "isinstance(o_orderkey, str)"]
    items = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.to_date("l_shipdate").alias("l_shipdate"), "l_linenumber")
    df = table(spark, sf_dir, "orders").withColumns({"o_orderdate": F.to_date("o_orderdate"), "o_orderkey": F.col("o_orderkey").cast("long")}).join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    df = df.withColumn("l_receiptdate", F.date_add("l_shipdate", (F.col("l_linenumber") * 4).cast("int")))
    return _passing(df, "o_orderkey", checks)


# Report --------------------------------------------------------------------------------------------------------------
def _sample(spark, sf_dir) -> DataFrame:
    """Columns that each break one rule of the report, and one that breaks none."""
    i = F.col("event_id")
    return _events(spark, sf_dir).select(
        "event_id",
        F.lit("same").alias("fixed"),
        (i * 1000 + 100_000).alias("rising"),
        F.when(i % 50 == 0, 1e9).otherwise((i * 7919 % 101) + 1.5).alias("spiky"),
        F.when(i % 10 < 8, 5).otherwise(i % 97).alias("stuck"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(i % 20 == 0, "b").otherwise("a").alias("side"),
        F.concat(F.lit("k"), i % 30).alias("code"),
        ((i * 7919) % 1009 + 0.25).alias("fine"),
    )


def _sample_spec() -> spec.Table:
    return spec.from_dict(
        {
            "name": "sample",
            "fields": {
                "event_id": {"type": "integer", "unique": True},
                "fixed": "string",
                "rising": "integer",
                "spiky": "number",
                "stuck": "integer",
                "nothing": {"type": "string", "null_rate": 0.5},
                "side": {"type": "enum", "values": ["a", "b"], "weights": {"a": 0.5, "b": 0.5}},
                "code": "string",
                "fine": "number",
            },
        }
    ).tables[0]


_SAMPLE = """WITH s AS (SELECT event_id, event_id * 1000 + 100000 AS rising, CASE WHEN event_id % 50 = 0 THEN 1e9 ELSE event_id * 7919 % 101 + 1.5 END AS spiky, CASE WHEN event_id % 10 < 8 THEN 5 ELSE event_id % 97 END AS stuck,
CASE WHEN event_id % 20 = 0 THEN 'b' ELSE 'a' END AS side, 'k' || (event_id % 30) AS code FROM events), n AS (SELECT count(*) AS n FROM s),
q AS (SELECT quantile_cont(spiky, 0.25) AS a, quantile_cont(spiky, 0.75) AS b FROM s), o AS (SELECT count(*) AS k FROM s, q WHERE spiky < a - 3 * (b - a) OR spiky > b + 3 * (b - a)),
o2 AS (SELECT count(*) AS k FROM s, (SELECT quantile_cont(stuck, 0.25) AS a, quantile_cont(stuck, 0.75) AS b FROM s) WHERE b > a AND (stuck < a - 3 * (b - a) OR stuck > b + 3 * (b - a))),
t AS (SELECT round(max(k) / sum(k)::DOUBLE, 3) AS share FROM (SELECT count(*) AS k FROM s GROUP BY stuck)),
d AS (SELECT 0.5 * sum(abs(round(k / n::DOUBLE, 3) - 0.5)) AS tvd FROM (SELECT side, count(*) AS k FROM s GROUP BY side), n), c AS (SELECT count(DISTINCT code) AS k FROM s)"""


@query(_SAMPLE + """ SELECT * FROM (
SELECT 'low' AS severity, 'nothing' AS "column", 'null rate 100% vs target 50%' AS message
UNION ALL SELECT 'low', 'fixed', 'constant column (always ''same'')'
UNION ALL SELECT 'low', 'spiky', k || ' outliers beyond 3x IQR, e.g. [1000000000.0, 1000000000.0, 1000000000.0]' FROM o
UNION ALL SELECT 'medium', 'rising', 'values trend with row order (Spearman +1.00) - generation artefact'
UNION ALL SELECT 'medium', 'event_id', 'values trend with row order (Spearman +1.00) - generation artefact'
UNION ALL SELECT 'low', 'rising', '100% of values are multiples of ' || (SELECT pow(10, greatest(1, floor(log10(quantile_cont(rising, 0.5))) - 1))::BIGINT FROM s) || ' (round-number heaping)' WHERE false
UNION ALL SELECT 'medium', 'stuck', 'one value accounts for ' || round_even(100 * share, 0)::BIGINT || '% of rows' FROM t
UNION ALL SELECT 'high', 'side', 'label distribution is ' || round_even(100 * tvd, 0)::BIGINT || '% (TVD) away from target' FROM d
UNION ALL SELECT 'low', 'code', 'only ' || k || ' distinct values in ' || n || ' rows' FROM c, n)""")
def report_issues(spark, sf_dir):
    return report.as_rows(_report(spark, sf_dir), spark)


def _report(spark, sf_dir) -> dict:
    return report.quality_report(_sample(spark, sf_dir), _sample_spec(), order="event_id")


@query(_SAMPLE + """ SELECT n AS rows, n AS valid, 0::BIGINT AS duplicates, 100 - 12 - 3 * 5 - 4 * 1 AS score, 'C' AS grade FROM n""")
def quality_score(spark, sf_dir):
    """Score and grade: one issue of high, three of medium, four of low weight."""
    r = _report(spark, sf_dir)
    return spark.createDataFrame([(r["rows"], r["schema"]["valid_rows"], r["duplicate_rows"], r["score"], r["grade"])], "rows long, valid long, duplicates long, score int, grade string")


@query("SELECT 2 * count(*) AS rows, count(*)::BIGINT AS duplicates, (SELECT 100 - 12 - 20) AS score, 'C' AS grade, 0 AS empty_score, 'F' AS empty_grade FROM region")
def quality_of_copies(spark, sf_dir):
    """Every row twice: one issue and the most that duplicates cost; and an empty data set."""
    own = table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("n"), "r_regionkey").alias("name"))
    r, empty = report.quality_report(own.union(own)), report.quality_report(own.where("false"))
    return spark.createDataFrame([(r["rows"], r["duplicate_rows"], r["score"], r["grade"], empty["score"], empty["grade"])], "rows long, duplicates long, score int, grade string, empty_score int, empty_grade string")
