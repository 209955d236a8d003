"""Column and dataset metrics as aggregations.

Fixed-shape metrics of all columns share one aggregation; the grouped ones shuffle partial counts only.  Values are
compared exactly; ``approximate`` variants are for the caller to ask for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from ..sources.shared import written

SUMMARY = 4_000  # accuracy of the summaries that bracket exact quantiles
FEW_VALUES = 100_000  # ranks of so many values are broadcast
TASK_CHARS = 1 << 24  # of text whose parts a task counts
HOT_ROWS = 1_000_000  # of one value; more are not ordered in one task


def missing(df: DataFrame, name: str) -> Column:
    """Null, NaN or the empty string."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, DoubleType | FloatType):
        return c.isNull() | F.isnan(c)
    return c.isNull() | (c == "") if isinstance(kind, StringType) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, or null where it counts as missing."""
    return F.when(~missing(df, name), F.col(f"`{name}`"))


def long_form(df: DataFrame, columns: list[str], metrics: dict[str, Column]) -> DataFrame:
    """One aggregation over ``df``; ``metrics`` by ``metric:column`` become a row a column."""
    names = list(dict.fromkeys(k.split(":")[0] for k in metrics))
    one = df.agg(*(v.alias(k) for k, v in metrics.items()))
    rows = [F.struct(F.lit(c).alias("column"), *(F.col(f"`{m}:{c}`").alias(m) for m in names)) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def completeness(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """``(column, rows, null_rate, distinct)``; ``approximate`` counts distinct values by sketches, without expanding rows."""
    metrics: dict[str, Column] = {}
    for c in columns:
        v = present(df, c)
        metrics[f"rows:{c}"] = F.count(F.lit(1))
        metrics[f"null_rate:{c}"] = F.round(F.try_divide(F.count(F.lit(1)) - F.count(v), F.count(F.lit(1))), 3)
        metrics[f"distinct:{c}"] = F.approx_count_distinct(v) if approximate else F.count_distinct(v)
    return long_form(df, columns, metrics)


def quantiles(df: DataFrame, values: dict[str, Column], at: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of each value, nulls left out; no task holds all distinct values.

    Summaries of bounded size give two values around each quantile, which a second pass counts up to.  Only what lies
    between them is grouped and ordered, a few thousandths of the rows; what a bracket lacks is looked for in all values.
    """
    names = list(values)
    x = df.select(*(values[c].cast("double").alias(f"x{i}") for i, c in enumerate(names)))
    probes = [F.lit(min(1.0, max(0.0, p + d / SUMMARY))) for p in at for d in (-3, 3)]
    out = []
    for i in range(len(names)):
        v = F.col(f"x{i}")
        out += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.percentile_approx(v, F.array(*probes), SUMMARY).alias(f"b{i}")]
    got = x.agg(*out).first()
    want, found = {}, {}  # by column and quantile: the ranks asked for, the values that stand there
    brackets: dict[tuple[int, int], tuple[float, float]] = {}
    for i in range(len(names)):
        for k, p in enumerate(at if got[f"n{i}"] else ()):
            place = (got[f"n{i}"] - 1) * p
            want[i, k] = (math.floor(place), math.ceil(place))
            brackets[i, k] = (got[f"b{i}"][2 * k], got[f"b{i}"][2 * k + 1])
    for again in (False, True):
        left = {b: (got[f"lo{b[0]}"], got[f"hi{b[0]}"]) if again else brackets[b] for b in want if any((b, r) not in found for r in want[b])}
        if left:
            _between(x, left, want, found)
    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        result[c] = []
        for k, p in enumerate(at):
            if (i, k) not in want:
                result[c].append(None)
                continue
            (a, b), place = want[i, k], (got[f"n{i}"] - 1) * p
            low, high = found[(i, k), a], found[(i, k), b]
            result[c].append(low if low == high else (b - place) * low + (place - a) * high)
    return result


def _between(x: DataFrame, brackets: dict[tuple[int, int], tuple[float, float]], want: dict, found: dict) -> None:
    """Enters into ``found`` the values that stand at the ranks asked for, as far as a bracket or its next values have them."""
    keys, out = list(brackets), []
    for j, (i, _) in enumerate(keys):
        v, (lo, hi) = F.col(f"x{i}"), map(F.lit, brackets[keys[j]])
        out += [F.count_if(v < lo).alias(f"a{j}"), F.count_if(v <= hi).alias(f"b{j}"), F.max(F.when(v < lo, v)).alias(f"p{j}"), F.min(F.when(v > hi, v)).alias(f"s{j}")]
    got = x.agg(*out).first()
    inside = []
    for j, key in enumerate(keys):
        (lo, hi), below, upto = brackets[key], got[f"a{j}"], got[f"b{j}"]
        for r in want[key]:
            if r == below - 1 or r == upto:
                found[key, r] = got[f"p{j}"] if r < below else got[f"s{j}"]
            elif below <= r < upto:
                if lo == hi:
                    found[key, r] = lo
                elif j not in inside:
                    inside.append(j)
    if not inside:
        return
    hit = {j: F.col(f"x{keys[j][0]}").between(*map(F.lit, brackets[keys[j]])) for j in inside}
    each = F.array(*(F.when(hit[j], F.struct(F.lit(j).alias("j"), F.col(f"x{keys[j][0]}").alias("v"))) for j in inside))
    n = x.select(F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).groupBy("e.j", "e.v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("j").orderBy("v").rowsBetween(W.unboundedPreceding, 0))  # of a bracket's values
    first = F.create_map(*(F.lit(y) for j in inside for y in (j, got[f"a{j}"])))
    ranked = n.withColumn("end", upto + first[F.col("j")])
    asked = [(F.col("j") == j) & (F.col("end") > r) & (F.col("end") - F.col("n") <= r) for j in inside for r in set(want[keys[j]])]
    any_of = asked[0]
    for a in asked[1:]:
        any_of = any_of | a
    for row in ranked.where(any_of).collect():  # two a quantile at most
        for r in want[keys[row.j]]:
            if row.end - row.n <= r < row.end:
                found[keys[row.j], r] = row.v


def frequencies(df: DataFrame, values: dict[str, Column]) -> dict[str, dict[str, Any]]:
    """For each value ``distinct``, ``top`` (rows of the commonest) and its ``share``, exact; columns are counted one by one, not over copies of rows."""
    parts = []
    for i, v in enumerate(values.values()):
        n = df.select(v.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
        parts.append(n.agg(F.count("*").alias("distinct"), F.coalesce(F.max("n"), F.lit(0)).alias("top"), F.round(F.try_divide(F.max("n"), F.sum("n")), 3).alias("share")).withColumn("i", F.lit(i)))
    names, rows = list(values), []
    for at in range(0, len(parts), 8):  # a few at a time side by side
        rows += reduce(DataFrame.unionByName, parts[at : at + 8]).collect()
    return {names[r.i]: {"distinct": r["distinct"], "top": r.top, "share": r.share} for r in rows}


def numeric(df: DataFrame, columns: list[str], digits: int = 4, approximate: bool = False) -> DataFrame:
    """``(column, n, min, p5, p50, p95, max, mean, std)``; interpolated quantiles, population deviation.

    Exact quantiles take three passes; ``approximate`` ones hold a summary of bounded size.
    """
    metrics: dict[str, Column] = {}
    at = (0.05, 0.5, 0.95)
    exact = {} if approximate else quantiles(df, {c: present(df, c) for c in columns}, at)
    for c in columns:
        v = present(df, c).cast("double")
        q = F.percentile_approx(v, F.array(*map(F.lit, at))) if approximate else [F.lit(x).cast("double") for x in exact[c]]
        metrics[f"n:{c}"] = F.count(v)
        for name, value in (("min", F.min(v)), ("p5", q[0]), ("p50", q[1]), ("p95", q[2]), ("max", F.max(v)), ("mean", F.avg(v)), ("std", F.stddev_pop(v))):
            metrics[f"{name}:{c}"] = F.round(value, digits)
    return long_form(df, columns, metrics)


def moments(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """``(column, mean, median, std, skew, log_std)`` for inference; log_std only of positive columns."""
    metrics: dict[str, Column] = {}
    median = quantiles(df, {c: present(df, c) for c in columns}, (0.5,))
    for c in columns:
        v = present(df, c).cast("double")
        positive = F.when(F.min(v) > 0, F.stddev_pop(F.when(v > 0, F.log(v))))
        for name, value in (("mean", F.avg(v)), ("median", F.lit(median[c][0]).cast("double")), ("std", F.stddev_pop(v)), ("skew", F.skewness(v)), ("log_std", positive)):
            metrics[f"{name}:{c}"] = F.round(value, digits)
    return long_form(df, columns, metrics)


def outliers(df: DataFrame, column: str, factor: float = 3.0) -> DataFrame:
    """``(n, outliers)`` beyond factor times the interquartile range; none where the range is zero."""
    v = df.select(present(df, column).cast("double").alias("v")).where("v IS NOT NULL")
    q1, q3 = (F.lit(x).cast("double") for x in quantiles(v, {"v": F.col("v")}, (0.25, 0.75))["v"])
    spread = q3 - q1
    out = (spread > 0) & ((F.col("v") < q1 - factor * spread) | (F.col("v") > q3 + factor * spread))
    return v.agg(F.count("v").alias("n"), F.count_if(out).alias("outliers"))


def top_share(df: DataFrame, column: str) -> DataFrame:
    """``(top_value_share)``."""
    n = df.select(present(df, column).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.try_divide(F.max("n"), F.sum("n")), 3).alias("top_value_share"))


def heaping(df: DataFrame, column: str, median: float | None = None) -> DataFrame:
    """``(step, share)`` of multiples of the power of ten one below the magnitudes' median; null under a median of 100."""
    v = df.select(present(df, column).cast("double").alias("v")).where("v IS NOT NULL")
    median = quantiles(v, {"v": F.abs("v")}, (0.5,))["v"][0] if median is None else median
    m = F.lit(median).cast("double")
    step = F.when(m >= 100, F.pow(F.lit(10.0), F.greatest(F.lit(1), F.floor(F.log10(m)) - 1)))
    return v.withColumn("step", step).groupBy("step").agg(F.round(F.avg((F.pmod("v", F.col("step")) == 0).cast("double")), 3).alias("share"))


def average_rank(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, rank)`` from value frequencies: ranks need the sorted distinct values, not the sorted rows.

    Cumulative counts go over range partitions in two levels, so no task sees all values.
    """
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    n = written(n.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "ranks")
    inside = W.partitionBy("part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    parts = n.groupBy("part").agg(F.sum("n").alias("total"))  # a row a partition
    before = parts.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    n = n.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return n.join(F.broadcast(before), "part").select("value", "n", (F.col("before") + F.col("own") + (F.col("n") + 1) / 2).alias("rank"))


def ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the average rank of a value that no great part of the rows shares: rows are ranged and written, equal values stay together."""
    own = written(df.repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.rank().over(W.partitionBy("_part").orderBy(column))
    equal = F.count("*").over(W.partitionBy("_part", column))
    out = own.withColumn(name, inside).withColumn("_equal", equal).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col(name) + (F.col("_equal") - 1) / 2).drop("_part", "_before", "_equal")


def order_trend(df: DataFrame, column: str, order: str, rank: str | None = None, seen: dict[str, Any] | None = None) -> DataFrame:
    """``(n, rho)``: Spearman correlation of a column with an explicit row order (distinct); null under 20 rows or 6 values.

    ``rank`` names a column of the orders' ranks among the rows that have a value, ``seen`` says how many values there are
    (see ``frequencies``); without them both are found here.
    """
    v = present(df, column).cast("double").alias("v")
    if rank and seen:
        rows = df.select(v, F.col(rank).alias("ro")).where("v IS NOT NULL")
        if seen["distinct"] > FEW_VALUES and seen["top"] <= HOT_ROWS:
            both = ranked(rows, "v", "rv")
        else:
            a = average_rank(rows, "v").select("value", F.col("rank").alias("rv"))
            both = rows.join(F.broadcast(a) if seen["distinct"] <= FEW_VALUES else a, rows.v == a.value)
        many = F.lit(seen["distinct"] > 5)
    else:
        rows = df.select(F.col(order).cast("double").alias("o"), v).where("v IS NOT NULL AND o IS NOT NULL")
        rows = written(rows, "trend")
        a, b = average_rank(rows, "v").select("value", F.col("rank").alias("rv")), average_rank(rows, "o").select("value", F.col("rank").alias("ro"))
        both = rows.join(a, rows.v == a.value).drop("value").join(b, F.col("o") == b.value)
        many = F.count_distinct("v") > 5
    rho = F.try_divide(F.covar_pop("rv", "ro"), F.stddev_pop("rv") * F.stddev_pop("ro"))
    return both.agg(F.count("*").alias("n"), F.when((F.count("*") >= 20) & many, F.round(rho, 3)).alias("rho"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """``(label, n, share)``."""
    n = df.select(present(df, column).cast("string").alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 3).alias("share"))


def entropy(df: DataFrame, column: str, declared: int | None = None) -> DataFrame:
    """``(labels, entropy)`` normalised by the declared or observed number of labels; one label gives 1."""
    n = df.select(present(df, column).cast("string").alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    k = F.lit(declared) if declared else F.count("*")
    return n.join(F.broadcast(total)).agg(
        F.count("*").alias("labels"), F.when(F.count("*") > 0, F.round(F.coalesce(F.try_divide(-F.sum(p * F.log(p)), F.log(k)), F.lit(1.0)), 3)).alias("entropy")
    )


def label_targets(df: DataFrame, column: str, targets: dict[str, float]) -> DataFrame:
    """``(label, share, target)`` for the target labels, absent ones with share 0."""
    goal = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets.items()], "label string, target double")
    seen = distribution(df, column).select("label", "share")
    return goal.join(seen, "label", "left").select("label", F.coalesce("share", F.lit(0.0)).alias("share"), "target")


def total_variation(df: DataFrame, column: str, targets: dict[str, float]) -> DataFrame:
    """``(tvd)``: half the summed distance between shares and targets."""
    return label_targets(df, column, targets).agg(F.round(0.5 * F.sum(F.abs(F.col("share") - F.col("target"))), 3).alias("tvd"))


def unused_labels(df: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """``(label)`` declared and never seen."""
    goal = df.sparkSession.createDataFrame([(str(v),) for v in declared], "label string")
    return goal.join(df.select(F.col(column).cast("string").alias("label")).distinct(), "label", "left_anti")


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(rows, duplicates)``: rows beyond the first of each distinct row."""
    n = df.groupBy(*(F.col(f"`{c}`") for c in columns or df.columns)).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def lengths(df: DataFrame, column: str) -> DataFrame:
    """``(min_length, mean_length, max_length)`` in characters."""
    n = F.length(present(df, column))
    return df.agg(F.min(n).cast("long").alias("min_length"), F.round(F.avg(n), 1).alias("mean_length"), F.max(n).cast("long").alias("max_length"))


def arrays(df: DataFrame, column: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Sizes and distinct elements in one row; the ``k`` commonest elements (ties by element)."""
    size = F.size(column)
    sizes = df.where(F.col(column).isNotNull()).agg(F.min(size).cast("long").alias("min_items"), F.round(F.avg(size), 2).alias("mean_items"), F.max(size).cast("long").alias("max_items"))
    n = df.select(F.explode(column).alias("element")).groupBy("element").agg(F.count("*").alias("n"))
    distinct = n.agg(F.count("*").alias("distinct_elements"))
    return sizes.join(F.broadcast(distinct)), n.orderBy(F.desc("n"), "element").limit(k)


def spread(df: DataFrame, size: Column) -> DataFrame:
    """Rows dealt over tasks by their sizes' sum, where a task would get more than ``TASK_CHARS`` else."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return df.repartition(int(total // TASK_CHARS) + 1) if total > TASK_CHARS else df


def ngram_diversity(df: DataFrame, tokens: Column, size: Column | None = None) -> DataFrame:
    """``(bigrams, distinct_bigrams, distinct_2)``; by ``size``, characters of a row, tasks are kept small, as their partial counts grow with them."""
    from ..functions.text import bigrams

    df = df if size is None else spread(df, size)
    pair = df.select(F.explode(bigrams(tokens)).alias("b"))
    pairs = pair.groupBy(F.xxhash64("b").alias("k1"), F.xxhash64(F.lit("b"), "b").alias("k2")).agg(F.count("*").alias("n"))  # 128 bits for the text
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bigrams"), F.count("*").alias("distinct_bigrams"), F.round(F.try_divide(F.count("*"), F.sum("n")), 3).alias("distinct_2"))


def top_openings(df: DataFrame, opening: Column, k: int = 3) -> DataFrame:
    """``(opening, n)`` of the commonest openings (ties by text)."""
    return df.select(opening.alias("opening")).where("opening IS NOT NULL").groupBy("opening").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "opening").limit(k)


def repeated_sentences(df: DataFrame, sentences: Column, least_words: int = 5) -> DataFrame:
    """``(sentences, repeated, share)``: occurrences of sentences that occur twice or more, among those of five words or more."""
    s = df.select(F.explode(sentences).alias("s")).where(F.size(F.split("s", r"\s+")) >= least_words).groupBy("s").agg(F.count("*").alias("n"))
    repeated = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sentences"), F.coalesce(repeated, F.lit(0)).alias("repeated"), F.round(F.try_divide(repeated, F.sum("n")), 3).alias("share"))


def folded_duplicates(df: DataFrame, folded: Column) -> DataFrame:
    """``(near_duplicates)``: values beyond the first that are equal after folding."""
    n = df.select(folded.alias("f")).where("f IS NOT NULL").groupBy("f").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("near_duplicates"))
