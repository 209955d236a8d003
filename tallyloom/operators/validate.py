"""Record validation as columns.

A record is a variant, so one plan serves JSON text, typed rows and text-only sources such as CSV.  Every field compiles to
two expressions, its typed value and an array of errors ``(path, reason)``; nested fields and array elements recurse
at planning time, so the executors run nothing but built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import Compiler, uses_parent
from ..functions.text import java_pattern, stripped
from ..plans.spec import STRINGS, TEMPORALS, Field, Table, temporal_text

# Reasons that rejection counts and feedback are keyed by, and the formats of text types.
REASONS = {
    "required": "Field required",
    "extra": "Extra inputs are not permitted",
    "string": "Input should be a valid string",
    "integer": "Input should be a valid integer",
    "integer_text": "Input should be a valid integer, unable to parse string as an integer",
    "integer_part": "Input should be a valid integer, got a number with a fractional part",
    "number": "Input should be a valid number",
    "number_text": "Input should be a valid number, unable to parse string as a number",
    "finite": "not a finite number",
    "boolean": "Input should be a valid boolean",
    "boolean_text": "Input should be a valid boolean, unable to interpret input",
    "list": "Input should be a valid list",
    "object": "Input should be a valid dictionary",
    "enum": "not one of the allowed values",
    "empty": "empty string",
    "email": "not a valid email address",
    "url": "not a valid http(s) URL",
    "uuid": "not a valid UUID",
    "record": "not an object",
}
EMAIL = r"\A[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"
URL = r"(?i)\Ahttps?://[^\s/$.?#][^\s]*\z"
UUID = r"(?i)\A(?:urn:)?(?:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?\z"
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")
_DATE, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?"

_ERRORS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("reason", T.StringType())]))


def _none() -> Column:
    return F.array().cast(_ERRORS)


def _error(path: Column, reason: str | Column) -> Column:
    return F.array(F.struct(path.alias("path"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason")))


def _first(path: Column, rules: list[tuple[Column, str | Column]]) -> Column:
    """The error of the first rule that is broken."""
    out = _none()
    for broken, reason in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), _error(path, reason)).otherwise(out)
    return out


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


class _Input:
    """A variant, possibly absent, with its kind and text."""

    def __init__(self, bound: Column):
        self.v, self.kind, self.text = bound["v"], bound["kind"], bound["text"]

    @staticmethod
    def of(v: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))
        return F.struct(v.alias("v"), kind.alias("kind"), F.try_variant_get(v, "$", "string").alias("text"))

    def is_(self, *kinds: str) -> Column:
        return reduce(lambda a, b: a | b, (self.kind.startswith(k) for k in kinds))


def _integer(f: Field, x: _Input, bound: Column | None = None) -> tuple[Column, list]:
    text = F.regexp_replace(F.trim(x.text), "_", "")
    good_text = text.rlike(r"\A[+-]?\d+(\.0*)?\z")
    real = x.is_("DOUBLE", "DECIMAL", "FLOAT")
    as_double = F.try_variant_get(x.v, "$", "double")
    value = (
        F.when(x.is_("BIGINT"), F.try_variant_get(x.v, "$", "bigint"))
        .when(x.is_("BOOLEAN"), F.try_variant_get(x.v, "$", "boolean").cast("bigint"))
        .when(real & (as_double == F.floor(as_double)), as_double.cast("bigint"))
        .when(x.is_("STRING") & good_text, F.split(text, r"\.")[0].try_cast("bigint"))
    )
    value = value if bound is None else bound
    rules = [
        (~x.is_("BIGINT", "BOOLEAN", "DOUBLE", "DECIMAL", "FLOAT", "STRING"), REASONS["integer"]),
        (x.is_("STRING") & value.isNull(), REASONS["integer_text"]),
        (real & value.isNull(), REASONS["integer_part"]),
        (value.isNull(), REASONS["integer"]),
    ]
    return value, rules + _bounds(f, value)


def _bounds(f: Field, value: Column) -> list:
    out = []
    if f.min is not None:
        out.append((value < f.min, f"Input should be greater than or equal to {f.min:g}"))
    if f.max is not None:
        out.append((value > f.max, f"Input should be less than or equal to {f.max:g}"))
    return out


def _number(f: Field, x: _Input, bound: Column | None = None) -> tuple[Column, list]:
    text = F.regexp_replace(F.trim(x.text), "_", "")
    value = F.when(x.is_("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(x.v, "$", "double")).when(x.is_("BOOLEAN"), F.try_variant_get(x.v, "$", "boolean").cast("double")).when(x.is_("STRING"), text.try_cast("double"))
    if bound is not None:
        value = bound  # rounded already, so bounds are judged on the unrounded value below
    plain = F.when(x.is_("STRING"), text.try_cast("double")).otherwise(F.try_variant_get(x.v, "$", "double")) if bound is not None and f.decimals is not None else value
    rules = [
        (~x.is_("BIGINT", "BOOLEAN", "DOUBLE", "DECIMAL", "FLOAT", "STRING"), REASONS["number"]),
        (value.isNull(), REASONS["number_text"]),
        (F.isnan(value) | (F.abs(value) == float("inf")), REASONS["finite"]),
        *_bounds(f, plain),
    ]
    return (value if f.decimals is None or bound is not None else F.bround(value, f.decimals)), rules


def _boolean(f: Field, x: _Input, bound: Column | None = None) -> tuple[Column, list]:
    word = F.lower(F.when(x.is_("STRING", "BIGINT"), x.text))
    value = F.when(x.is_("BOOLEAN"), F.try_variant_get(x.v, "$", "boolean")).when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    value = value if bound is None else bound
    return value, [(~x.is_("BOOLEAN", "STRING", "BIGINT", "DOUBLE", "DECIMAL"), REASONS["boolean"]), (value.isNull(), REASONS["boolean_text"])]


def _temporal(f: Field, x: _Input, bound: Column | None = None) -> tuple[Column, list]:
    text = F.when(x.is_("STRING"), F.trim(x.text))
    if f.type == "date":
        day = F.when(text.contains("T"), F.substring(text, 1, 10)).otherwise(text)
        value = F.when(day.rlike(rf"\A{_DATE}\z"), day.try_cast("date"))
        limit = lambda b: F.lit(b.isoformat()).cast("date")
    elif f.type == "datetime":
        good = text.rlike(rf"\A{_DATE}(?:[T ]{_TIME}(?:Z|[+-]\d{{2}}:?\d{{2}})?)?\z")
        zoned = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})\z") & text.rlike(r"[T ]")
        text = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(?![\d:])", "$1:00")  # Spark asks for seconds
        utc = F.when(zoned, text).otherwise(F.concat(F.when(text.rlike(r"[T ]"), text).otherwise(F.concat(text, F.lit("T00:00:00"))), F.lit("Z")))
        value = F.when(good, utc.try_cast("timestamp"))
        limit = lambda b: F.lit(temporal_text(b)).cast("timestamp")
    else:
        value = F.when(text.rlike(rf"\A{_TIME}\z") & (F.substring(text, 1, 2) < "24") & (F.substring(text, 4, 2) < "60"), F.when(F.length(text) == 5, F.concat(text, F.lit(":00"))).otherwise(text))
        limit = lambda b: F.lit(b.isoformat())
    value = value if bound is None else bound
    rules = [(value.isNull(), f"not a valid {f.type} (ISO 8601)")]
    if f.min is not None:
        rules.append((value < limit(f.min), f"before min {temporal_text(f.min)}"))
    if f.max is not None:
        rules.append((value > limit(f.max), f"after max {temporal_text(f.max)}"))
    return value, rules


def _string(f: Field, x: _Input, bound: Column | None = None) -> tuple[Column, list]:
    number = x.is_("BIGINT", "DOUBLE", "DECIMAL") if f.generator == "sequence" else F.lit(False)
    value = F.when(x.is_("STRING") | number, stripped(x.text)) if bound is None else bound
    rules: list = [(value.isNull(), REASONS["string"])]
    if f.min_length != 0:
        rules.append((value == "", REASONS["empty"]))
    formats = {"email": EMAIL, "url": URL, "uuid": UUID}
    if f.type in formats:
        rules.append((~value.rlike(formats[f.type]), REASONS[f.type]))
    if f.type == "uuid" and bound is None:
        h = F.lower(F.regexp_replace(value, r"(?i)urn:|uuid:|[{}-]", ""))
        value = F.when(value.rlike(UUID), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))).otherwise(value)
    if f.min_length is not None:
        rules.append((F.length(value) < f.min_length, f"too short (min {f.min_length} characters)"))
    if f.max_length is not None:
        rules.append((F.length(value) > f.max_length, f"too long (max {f.max_length} characters)"))
    if f.pattern:
        rules.append((~value.rlike(rf"\A(?:{java_pattern(f.pattern)})\z"), f"does not match pattern {f.pattern}"))
    return value, rules


def _enum(f: Field, x: _Input, bound: Column | None = None) -> tuple[Column, list]:
    key, value = F.lower(F.trim(x.text)), F.lit(None).cast(f.spark_type())
    for v in reversed(f.values):
        value = F.when(key == str(v).strip().lower(), F.lit(v).cast(f.spark_type())).otherwise(value)
    value = value if bound is None else bound
    return value, [(value.isNull(), REASONS["enum"])]


def _parsed(x: _Input, opener: str, kind: str) -> Column:
    """The variant, or what its text holds if that is JSON of the kind."""
    inner = F.try_parse_json(F.when(x.is_("STRING") & F.trim(x.text).startswith(opener), x.text))
    return F.when(F.coalesce(F.schema_of_variant(inner).startswith(kind), F.lit(False)), inner).otherwise(x.v)


def compile_field(f: Field, v: Column, path: Column) -> Column:
    """``struct(value, errors)`` of a field whose variant is ``v``."""

    def body(bound: Column) -> Column:
        x = _Input(bound)
        if f.type == "array":
            out = _array(f, x, path)
        elif f.type == "object":
            out = _object(f, x, path)
        else:
            by_type = {"integer": _integer, "number": _number, "boolean": _boolean, "enum": _enum}
            handler = by_type.get(f.type) or (_temporal if f.type in TEMPORALS else _string)
            assert f.type in by_type or f.type in TEMPORALS or f.type in STRINGS, f.type
            value = handler(f, x)[0]
            out = let(value, lambda y: F.struct(y.alias("value"), _first(path, _rules(f, x, y)).alias("errors")))
        absent = x.kind == "ABSENT"
        if f.nullable:
            errors = F.when(absent | (x.kind == "VOID"), _none())
        else:
            errors = F.when(absent, _error(path, REASONS["required"]))
        return let(out, lambda o: F.struct(o["value"].alias("value"), errors.otherwise(o["errors"]).alias("errors")))

    return let(_Input.of(v), body)


def _rules(f: Field, x: _Input, value: Column) -> list:
    """The rules of a scalar, on its bound value."""
    by_type = {"integer": _integer, "number": _number, "boolean": _boolean, "enum": _enum}
    return (by_type.get(f.type) or (_temporal if f.type in TEMPORALS else _string))(f, x, value)[1]


def _array(f: Field, x: _Input, path: Column) -> Column:
    def body(v: Column) -> Column:
        is_list = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
        items = F.when(is_list, F.try_variant_get(v, "$", "array<variant>"))
        each = F.transform(items, lambda i, n: compile_field(f.items, i, F.concat(path, F.lit("."), n.cast("string"))))

        def sized(done: Column) -> Column:
            n = F.size(done)

            def say(bound: int, side: str) -> Column:
                return F.concat(F.lit(f"List should have at {side} {bound} item{'' if bound == 1 else 's'} after validation, not "), n.cast("string"))

            sizes: list = [(done.isNull(), REASONS["list"])]
            if f.min_items is not None:
                sizes.append((n < f.min_items, say(f.min_items, "least")))
            if f.max_items is not None:
                sizes.append((n > f.max_items, say(f.max_items, "most")))
            inner = F.coalesce(F.flatten(F.transform(done, lambda d: d["errors"])), _none())
            errors = let(inner, lambda e: F.when(F.size(e) > 0, e).otherwise(_first(path, sizes)))
            return F.struct(F.transform(done, lambda d: d["value"]).alias("value"), errors.alias("errors"))

        return let(each, sized)

    return let(_parsed(x, "[", "ARRAY"), body)


def _object(f: Field, x: _Input, path: Column) -> Column:
    def body(v: Column) -> Column:
        is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        done = compile_fields(f.properties, F.when(is_object, v), F.concat(path, F.lit(".")))
        return let(done, lambda d: F.struct(F.when(is_object, d["value"]).alias("value"), F.when(is_object, d["errors"]).otherwise(_error(path, REASONS["object"])).alias("errors")))

    return let(_parsed(x, "{", "OBJECT"), body)


def compile_fields(fields: list[Field], v: Column, prefix: Column) -> Column:
    """``struct(value, errors)`` of an object: a struct of its fields and all errors, extra keys last."""
    each = F.struct(*(compile_field(f, F.try_variant_get(v, _json_path(f.name), "variant"), F.concat(prefix, F.lit(f.name))).alias(f"f{i}") for i, f in enumerate(fields)))
    extra = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*(F.lit(f.name) for f in fields)))
    unknown = F.coalesce(F.transform(extra, lambda k: F.struct(F.concat(prefix, k).alias("path"), F.lit(REASONS["extra"]).alias("reason"))), _none())
    return let(
        each,
        lambda e: F.struct(
            F.struct(*(e[f"f{i}"]["value"].alias(f.name) for i, f in enumerate(fields))).alias("value"),
            F.flatten(F.array(*(e[f"f{i}"]["errors"] for i in range(len(fields))), unknown)).alias("errors"),
        ),
    )


def _json_path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def as_records(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``_record``: each row as a variant; nulls stay keys, so a null differs from an absent key only in JSON sources.

    Values go over as they are; only rows with dates and the like, or with maps, take the way through JSON text.
    """
    names = columns or df.columns
    cols = F.struct(*(F.col(f"`{c}`").alias(c) for c in names))
    if all(_plain(df.schema[c].dataType) for c in names):
        return df.withColumn("_record", F.to_variant_object(cols))
    return df.withColumn("_record", F.parse_json(F.to_json(cols, {"ignoreNullFields": "false"})))


def _plain(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_plain(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    return isinstance(kind, T.StringType | T.IntegralType | T.DoubleType | T.BooleanType)


def validate(records: DataFrame, table: Table, parents: dict[str, tuple[Column, T.StructType]] | None = None) -> DataFrame:
    """``records`` with a ``_record`` variant -> its other columns, the table's typed fields and ``_errors``.

    Checks run where the fields have no errors; those that use ``parent`` run only if ``parents`` gives the context.
    """
    keep = [c for c in records.columns if c != "_record"]
    v = F.col("_record")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    schema = T.StructType([T.StructField(f.name, f.spark_type()) for f in table.fields])
    sources = [c for c in table.checks if parents is not None or not uses_parent(c)]

    def judged(done: Column) -> Column:
        """Checks see the bound record, so nothing is computed again for them."""
        compiler = Compiler(schema, parents, record=done["value"])
        failed = [F.when(~compiler.compile(c), F.struct(F.lit("check").alias("path"), F.lit(f"failed: {c}").alias("reason"))) for c in sources]
        late = F.array_compact(F.array(*failed)).cast(_ERRORS) if failed else _none()
        errors = let(done["errors"], lambda e: F.when(F.size(e) > 0, e).otherwise(late))
        return F.struct(done["value"].alias("value"), errors.alias("errors"))

    done = let(compile_fields(table.fields, F.when(is_object, v), F.lit("")), judged)
    rows = records.select(*(F.col(f"`{c}`") for c in keep), done.alias("_done"), is_object.alias("_ok"))
    errors = F.when(F.col("_ok"), F.col("_done.errors")).otherwise(_error(F.lit("record"), REASONS["record"]))
    return rows.select(*(F.col(f"`{c}`") for c in keep), *(F.col("_done")["value"][f.name].alias(f.name) for f in table.fields), errors.alias("_errors"))


def category(path: Column, reason: Column) -> Column:
    """Key that rejections are counted by: element numbers become ``[]``."""
    return F.concat(F.regexp_replace(path, r"\.\d+(?=\.|$)", "[]"), F.lit(": "), reason)


def roll_up(validated: DataFrame, k: int = 15) -> DataFrame:
    """``(category, n)`` of the commonest violations, ties by text."""
    e = validated.select(F.explode("_errors").alias("e"))
    return e.select(category(F.col("e.path"), F.col("e.reason")).alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def first_error(errors: Column) -> Column:
    return let(errors, lambda e: F.when(F.size(e) > 0, F.concat(e[0]["path"], F.lit(": "), e[0]["reason"])))


