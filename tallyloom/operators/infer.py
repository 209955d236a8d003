"""Specification from sample data: one aggregation of flags and moments over all columns decides each column's type.

No free text and no identifiers leave the data: only bounds, moments, shares and the values of low-cardinality labels.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import validate
from .accept import numbered
from .metrics import frequencies, present, quantiles

MAX_ENUM = 20
_INT, _REAL = r"\A-?(?:0|[1-9]\d*)\z", r"\A-?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?\z"
_DATE, _MOMENT = r"\A\d{4}-\d{2}-\d{2}\z", r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?\z"


def rounded(x: float, digits: int = 4) -> float:
    """To significant digits."""
    return float(f"{x:.{digits}g}")


def parsed(df: DataFrame) -> DataFrame:
    """Text columns whose values are all booleans, integers or numbers get that type (one pass)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    flags = []
    for i, c in enumerate(text):
        v = F.trim(present(df, c))
        for kind, ok in (("b", F.lower(v).isin("true", "false")), ("i", v.rlike(_INT) & (F.length(v) <= 18)), ("r", v.rlike(_REAL) & (v.rlike(_INT) | ~v.rlike(r"\A-?0\d")))):
            flags.append(F.bool_and(ok).alias(f"{kind}{i}"))
    got = df.agg(*flags).first().asDict()
    out = df
    for i, c in enumerate(text):
        kind = next((k for k, f in (("boolean", "b"), ("bigint", "i"), ("double", "r")) if got[f"{f}{i}"]), None)
        if kind:
            out = out.withColumn(c, F.trim(present(df, c)).try_cast(kind))
    return out


def _stats(df: DataFrame, names: list[str]) -> dict[str, Any]:
    out: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        kind, v = df.schema[c].dataType, present(df, c)
        out.append(F.count(v).alias(f"n{i}"))
        if isinstance(kind, T.ArrayType):
            out += [F.min(F.size(v)).alias(f"lo{i}"), F.max(F.size(v)).alias(f"hi{i}")]
        elif isinstance(kind, T.NumericType):
            x = v.cast("double")
            step = F.count(F.when(x != F.round(x, 0), 1))
            places = [F.count(F.when(F.abs(x - F.round(x, d)) > 1e-9, 1)).alias(f"p{d}_{i}") for d in range(4)]
            out += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(x).alias(f"mean{i}"), step.alias(f"frac{i}"), *places]
            out += [F.stddev_pop(x).alias(f"std{i}"), F.skewness(x).alias(f"skew{i}"), F.stddev_pop(F.when(x > 0, F.log(x))).alias(f"log{i}")]
        elif isinstance(kind, T.StringType):
            for flag, ok in (("date", v.rlike(_DATE) & v.try_cast("date").isNotNull()), ("moment", v.rlike(_MOMENT)), ("uuid", v.rlike(validate.UUID)), ("email", v.rlike(validate.EMAIL)), ("url", v.rlike(validate.URL))):
                out.append(F.bool_and(ok).alias(f"{flag}{i}"))
            out += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(F.length(v)).alias(f"mean{i}"), F.max(F.length(v)).alias(f"max{i}")]
        elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            out += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    got = df.agg(*out).first().asDict()
    numbers = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    counted = numbers + [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    seen = frequencies(df, {c: present(df, c) for c in counted}) if counted else {}
    middle = quantiles(df, {c: present(df, c) for c in numbers}, (0.5,)) if numbers else {}
    for i, c in enumerate(names):
        if c in seen:
            got[f"d{i}"] = seen[c]["distinct"]
        if c in middle:
            got[f"mid{i}"] = middle[c][0]
    return got


def _labels(df: DataFrame, name: str) -> list[tuple]:
    """Values by frequency, ties by value; asked only of columns known to have few."""
    rows = df.select(present(df, name).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").collect()
    return [(r.v, r.n) for r in rows]


def in_row_order(df: DataFrame, name: str, order: str | None) -> bool:
    """Whether a value less the first is the row's position throughout; ``order`` names the rows' order, else files give it."""
    rows = df.select(present(df, name).cast("long").alias("v"), (F.col(f"`{order}`") if order else F.monotonically_increasing_id()).alias("o"))
    at = F.when(F.col("v").isNotNull(), F.col("o"))
    ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.min_by("v", at).alias("first"), F.max_by("v", at).alias("last")).first()
    if (ends.low, ends.high) != (ends.first, ends.last):  # the ends are cheap to tell; only then are rows numbered
        return False
    own = numbered(rows, "o", 0)
    low = own.agg(F.min("v")).first()[0]
    return low is not None and own.where(F.col("v") - low != F.col("_number")).isEmpty()


def _number(df: DataFrame, c: str, got: dict, i: int, n: int, order: str | None) -> dict[str, Any]:
    whole = got[f"frac{i}"] == 0
    low, high, distinct = got[f"lo{i}"], got[f"hi{i}"], got[f"d{i}"]
    if whole and n >= 10 and distinct == n and high - low + 1 == n and in_row_order(df, c, order):
        return {"type": "integer", "generator": "sequence", "start": int(low)}
    if whole and n >= 20 and distinct <= min(MAX_ENUM // 2, 8) and distinct / n < 0.2:
        labels = sorted(_labels(df, c))
        return {"type": "enum", "values": [int(v) for v, _ in labels], "weights": [round(k / n, 4) for _, k in labels]}
    out: dict[str, Any] = {"type": "integer", "min": int(low), "max": int(high)} if whole else {"type": "number", "min": rounded(low), "max": rounded(high)}
    if not whole:
        out["min"], out["max"] = min(out["min"], low), max(out["max"], high)
        out["decimals"] = next((d for d in range(4) if not got[f"p{d}_{i}"]), 4)
    if n >= 10 and distinct > 5 and got[f"std{i}"]:
        if low > 0 and got[f"mid{i}"] > 0 and (got[f"skew{i}"] or 0) > 1:
            out["distribution"] = {"type": "lognormal", "median": rounded(got[f"mid{i}"]), "sigma": rounded(got[f"log{i}"])}
        else:
            out["distribution"] = {"type": "normal", "mean": rounded(got[f"mean{i}"]), "std": rounded(got[f"std{i}"])}
    return out


def _text(df: DataFrame, c: str, got: dict, i: int, n: int) -> dict[str, Any]:
    if got[f"date{i}"]:
        return {"type": "date", "min": got[f"lo{i}"], "max": got[f"hi{i}"], "distribution": "uniform"}
    if got[f"moment{i}"]:
        return {"type": "datetime", "min": got[f"lo{i}"].replace(" ", "T"), "max": got[f"hi{i}"].replace(" ", "T"), "distribution": "uniform"}
    for kind in ("uuid", "email", "url"):
        if got[f"{kind}{i}"]:
            return {"type": kind, "unique": True} if got[f"d{i}"] == n and n >= 10 else {"type": kind}
    distinct = got[f"d{i}"]
    if n >= 10 and distinct <= MAX_ENUM and distinct / n <= 0.5 and got[f"mean{i}"] < 60:
        labels = _labels(df, c)
        if len({v.strip().lower() for v, _ in labels}) == len(labels):
            return {"type": "enum", "values": [v for v, _ in labels], "weights": [round(k / n, 4) for _, k in labels]}
    out: dict[str, Any] = {"type": "text" if got[f"mean{i}"] > 80 else "string", "max_length": int(got[f"max{i}"] * 1.2) + 1}
    return out | ({"unique": True} if distinct == n and n >= 10 else {})


def fields_of(df: DataFrame, top: bool = True, order: str | None = None) -> list[dict[str, Any]]:
    """Field documents of a frame's columns, nested ones by recursion into exploded or selected frames."""
    df = parsed(df)
    names = df.columns
    got = _stats(df, [c for c in names])
    out = []
    for i, c in enumerate(names):
        kind, n = df.schema[c].dataType, got[f"n{i}"]
        if isinstance(kind, T.StructType):
            doc: dict[str, Any] = {"type": "object", "properties": fields_of(df.where(F.col(f"`{c}`").isNotNull()).select(f"`{c}`.*"), False)}
        elif isinstance(kind, T.ArrayType):
            items = fields_of(df.select(F.explode(f"`{c}`").alias("item")), False)[0]
            items.pop("name")
            doc = {"type": "array", "items": {k: v for k, v in items.items() if k not in ("distribution", "generator", "weights", "unique")}, "min_items": got[f"lo{i}"] or 0, "max_items": max(1, got[f"hi{i}"] or 1)}
        elif not n:
            doc = {"type": "string", "nullable": True}
        elif isinstance(kind, T.BooleanType):
            doc = {"type": "boolean"}
        elif isinstance(kind, T.DateType):
            doc = {"type": "date", "min": got[f"lo{i}"].isoformat(), "max": got[f"hi{i}"].isoformat(), "distribution": "uniform"}
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            doc = {"type": "datetime", "min": got[f"lo{i}"].isoformat() + "Z", "max": got[f"hi{i}"].isoformat() + "Z", "distribution": "uniform"}
        else:
            doc = _number(df, c, got, i, n, order) if isinstance(kind, T.NumericType) else _text(df, c, got, i, n)
        if not top:
            for key in ("distribution", "generator", "weights", "start"):
                doc.pop(key, None)
        missing = 1 - n / got["rows"] if got["rows"] else 0
        if missing > 0 and not doc.get("generator"):
            doc |= {"null_rate": round(missing, 3)} if top else {"nullable": True}
        out.append({"name": c, **doc})
    return out


def infer(df: DataFrame, name: str = "records", about: str = "", count: int | None = None, order: str | None = None) -> dict[str, Any]:
    """A specification document for data like ``df``; it parses, or this raises."""
    from ..plans.spec import from_dict

    doc: dict[str, Any] = {"name": name, "description": about, "count": count or 100, "fields": fields_of(df, order=order)}
    if all(f.get("generator") for f in doc["fields"]):
        doc["fields"][-1] = {"name": doc["fields"][-1]["name"], "type": "integer"}
    from_dict(doc)
    return doc
