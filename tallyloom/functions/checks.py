"""Cross-field checks: a subset of Python expressions compiled to Spark columns.

Nothing is evaluated in Python.  The compiler walks the expression's syntax tree with the columns' types at hand and
refuses what it doesn't know with the position of the offending part.  A check that is null, or that could not be
computed, has failed; equality, ``is None`` and membership are null-safe, as they are in Python.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import java_pattern, stripped


class CheckError(ValueError):
    """The expression is outside of the subset."""


class Value:
    """A compiled expression: a column and what is known of its type."""

    def __init__(self, col: Column, kind: T.DataType | None = None, choices: list | None = None):
        self.col, self.kind, self.choices = col, kind, choices
        self.constant: object = None  # of a literal

    @property
    def is_array(self) -> bool:
        return isinstance(self.kind, T.ArrayType)

    @property
    def is_text(self) -> bool:
        return isinstance(self.kind, T.StringType)


class Span(T.DoubleType):
    """Type of a difference of times, in seconds."""


_SPAN = Span()
#: Keywords of ``timedelta`` in seconds.
_UNITS = {"weeks": 604800.0, "days": 86400.0, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0, "milliseconds": 1e-3, "microseconds": 1e-6}
_TEXT, _LONG, _DOUBLE, _BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def uses_parent(source: str) -> bool:
    return any(isinstance(n, ast.Name) and n.id == "parent" for n in ast.walk(ast.parse(source, mode="eval")))


class Compiler:
    """``schema`` names the record's columns; ``parents`` maps a reference field to the struct column with its context."""

    def __init__(self, schema: T.StructType, parents: dict[str, tuple[Column, T.StructType]] | None = None, record: Column | None = None):
        self.schema, self.parents, self.record = schema, parents or {}, record
        self.bound: list[dict[str, Value]] = []

    def compile(self, source: str) -> Column:
        """Boolean column, false where the check fails."""
        try:
            tree = ast.parse(source, mode="eval").body
        except SyntaxError as e:
            raise CheckError(f"invalid check {source!r}: {e.msg}") from None
        try:
            return F.coalesce(self.truth(self.value(tree)), F.lit(False))
        except CheckError as e:
            raise CheckError(f"check {source!r}: {e}") from None

    # values ---------------------------------------------------------------------------------------------------------
    def value(self, node: ast.AST) -> Value:
        handler: Callable | None = getattr(self, "on_" + type(node).__name__.lower(), None)
        if handler is None:
            raise CheckError(f"{type(node).__name__} is not supported (column {getattr(node, 'col_offset', 0)})")
        return handler(node)

    def truth(self, v: Value) -> Column:
        """Python's truth of a value."""
        if isinstance(v.kind, T.BooleanType):
            return v.col
        if v.is_array:
            return F.size(v.col) > 0
        if v.is_text:
            return F.length(v.col) > 0
        return v.col.cast("double") != 0

    def on_constant(self, node: ast.Constant) -> Value:
        v = node.value
        kinds = {bool: _BOOL, int: _LONG, float: _DOUBLE, str: _TEXT, type(None): T.NullType()}
        if type(v) not in kinds:
            raise CheckError(f"constant {v!r} is not supported")
        out = Value(F.lit(v), kinds[type(v)])
        out.constant = v
        return out

    def on_name(self, node: ast.Name) -> Value:
        for scope in reversed(self.bound):
            if node.id in scope:
                return scope[node.id]
        if node.id in self.schema.names:
            col = self.record[node.id] if self.record is not None else F.col(f"`{node.id}`")
            return Value(col, self.schema[node.id].dataType)
        raise CheckError(f"unknown name '{node.id}'")

    def on_subscript(self, node: ast.Subscript) -> Value:
        base = node.value
        key = node.slice
        if isinstance(base, ast.Name) and base.id in ("record", "parent") and isinstance(key, ast.Constant):
            if base.id == "record":
                return self.on_name(ast.Name(key.value))
            if key.value not in self.parents:
                raise CheckError(f"no parent context for '{key.value}'")
            return Value(*self.parents[key.value])
        if isinstance(base, ast.Dict):
            return self.lookup(base, self.value(key))
        v = self.value(base)
        if isinstance(v.kind, T.StructType) and isinstance(key, ast.Constant) and key.value in v.kind.names:
            return Value(v.col[key.value], v.kind[key.value].dataType)
        if v.is_array:
            i = self.value(key)
            return Value(F.try_element_at(v.col, F.when(i.col < 0, i.col).otherwise(i.col + 1).cast("int")), v.kind.elementType)
        raise CheckError("only records, parents, arrays and dictionary literals can be indexed")

    def lookup(self, table: ast.Dict, key: Value) -> Value:
        pairs = [(self.value(k), self.value(v)) for k, v in zip(table.keys, table.values, strict=True)]
        out = F.lit(None)
        for k, v in reversed(pairs):
            out = F.when(key.col.eqNullSafe(k.col), v.col).otherwise(out)
        return Value(out, pairs[0][1].kind if pairs else None)

    def on_unaryop(self, node: ast.UnaryOp) -> Value:
        v = self.value(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~self.truth(v), _BOOL)
        if isinstance(node.op, ast.USub):
            return Value(-v.col, v.kind)
        raise CheckError("unsupported operator")

    def on_boolop(self, node: ast.BoolOp) -> Value:
        out = None
        for part in node.values:
            t = F.coalesce(self.truth(self.value(part)), F.lit(False))
            out = t if out is None else (out & t if isinstance(node.op, ast.And) else out | t)
        return Value(out, _BOOL)

    def on_binop(self, node: ast.BinOp) -> Value:
        a, b = self.value(node.left), self.value(node.right)
        if isinstance(node.op, ast.Add) and a.is_text:
            return Value(F.concat(a.col, b.col), _TEXT)
        if isinstance(a.kind, T.DateType | T.TimestampType) and isinstance(node.op, ast.Add | ast.Sub):
            return self.moved(a, b, 1 if isinstance(node.op, ast.Add) else -1)
        if isinstance(a.kind, Span) or isinstance(b.kind, Span):
            return self.spans(node.op, a, b)
        whole = isinstance(a.kind, T.LongType) and isinstance(b.kind, T.LongType)
        x, y = (a.col, b.col) if whole else (a.col.cast("double"), b.col.cast("double"))
        ops: dict[type, Callable[[], Column]] = {
            ast.Add: lambda: x + y,
            ast.Sub: lambda: x - y,
            ast.Mult: lambda: x * y,
            ast.Div: lambda: F.try_divide(a.col.cast("double"), b.col.cast("double")),
            ast.FloorDiv: lambda: F.floor(F.try_divide(x.cast("double"), y.cast("double"))),
            ast.Mod: lambda: x - y * F.floor(F.try_divide(x.cast("double"), y.cast("double"))),
            ast.Pow: lambda: F.pow(x, y),
        }
        if type(node.op) not in ops:
            raise CheckError("unsupported operator")
        return Value(ops[type(node.op)](), _LONG if whole and not isinstance(node.op, ast.Div | ast.Pow) else _DOUBLE)

    @staticmethod
    def moved(a: Value, b: Value, sign: int) -> Value:
        """A time with a span added or taken away, or the span between two times."""
        whole = isinstance(a.kind, T.DateType)
        if isinstance(b.kind, Span):
            if whole:  # parts of days do not move a date
                return Value(F.date_add(a.col, (sign * F.floor(b.col / 86400)).cast("int")), a.kind)
            return Value(F.timestamp_micros(F.unix_micros(a.col) + sign * F.round(b.col * 1_000_000).cast("long")), a.kind)
        if sign > 0 or type(a.kind) is not type(b.kind):
            raise CheckError("only a timedelta can be added to a time")
        apart = F.datediff(a.col, b.col) * 86400.0 if whole else (F.unix_micros(a.col) - F.unix_micros(b.col)) / 1_000_000
        return Value(apart.cast("double"), _SPAN)

    @staticmethod
    def spans(op: ast.AST, a: Value, b: Value) -> Value:
        x, y = a.col.cast("double"), b.col.cast("double")
        both = isinstance(a.kind, Span) and isinstance(b.kind, Span)
        if isinstance(b.kind, T.DateType | T.TimestampType) and isinstance(op, ast.Add):
            return Compiler.moved(b, a, 1)
        if isinstance(op, ast.Add | ast.Sub) and both:
            return Value(x + y if isinstance(op, ast.Add) else x - y, _SPAN)
        if isinstance(op, ast.Div):
            return Value(F.try_divide(x, y), _DOUBLE if both else _SPAN)
        if isinstance(op, ast.Mult) and not both:
            return Value(x * y, _SPAN)
        raise CheckError("unsupported operator for a timedelta")

    def on_attribute(self, node: ast.Attribute) -> Value:
        v = self.value(node.value)
        if isinstance(v.kind, Span) and node.attr == "days":
            return Value(F.floor(v.col / 86400), _LONG)
        if isinstance(v.kind, T.DateType | T.TimestampType) and node.attr in ("year", "month", "day", "hour", "minute", "second"):
            if isinstance(v.kind, T.DateType) and node.attr in ("hour", "minute", "second"):
                raise CheckError(f"a date has no '{node.attr}'")
            return Value(getattr(F, node.attr)(v.col).cast("long"), _LONG)
        raise CheckError(f"attribute '{node.attr}' is not supported")

    def is_kind(self, node: ast.Call) -> Value:
        """``isinstance`` by the column's type: known when the check is compiled, but for null."""
        if len(node.args) != 2:
            raise CheckError("isinstance takes two arguments")
        v, kinds = self.value(node.args[0]), node.args[1].elts if isinstance(node.args[1], ast.Tuple) else [node.args[1]]
        known = {"str": T.StringType, "int": T.LongType | T.BooleanType, "float": T.DoubleType, "bool": T.BooleanType, "list": T.ArrayType, "dict": T.StructType, "date": T.DateType | T.TimestampType, "datetime": T.TimestampType}
        names = [k.id if isinstance(k, ast.Name) else "" for k in kinds]
        if unknown := [n for n in names if n not in known]:
            raise CheckError(f"isinstance of {unknown[0] or 'that'} is not supported")
        return Value(v.col.isNotNull() & F.lit(any(isinstance(v.kind, known[n]) for n in names)), _BOOL)

    def span(self, node: ast.Call) -> Value:
        given = [("days", node.args[0])] if len(node.args) == 1 else []
        given += [(k.arg, k.value) for k in node.keywords]
        if len(node.args) > 1 or not given or any(k not in _UNITS for k, _ in given):
            raise CheckError("timedelta takes days or keywords like hours")
        total = F.lit(0.0)
        for k, x in given:
            total = total + self.value(x).col.cast("double") * _UNITS[k]
        return Value(total, _SPAN)

    def on_compare(self, node: ast.Compare) -> Value:
        out, left = None, self.value(node.left)
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            right = self.value(right_node)
            one = self.compare(op, left, right)
            out = one if out is None else out & one
            left = right
        return Value(out, _BOOL)

    def compare(self, op: ast.AST, a: Value, b: Value) -> Column:
        if isinstance(op, ast.In | ast.NotIn):
            hit = self.member(a, b)
            return hit if isinstance(op, ast.In) else ~hit
        x, y = self.alike(a, b)
        if isinstance(op, ast.Eq | ast.Is):
            return x.eqNullSafe(y)
        if isinstance(op, ast.NotEq | ast.IsNot):
            return ~x.eqNullSafe(y)
        return {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]

    @staticmethod
    def alike(a: Value, b: Value) -> tuple[Column, Column]:
        """Dates compare with ISO text, numbers with numbers."""
        for u, v in ((a, b), (b, a)):
            if isinstance(u.kind, T.DateType | T.TimestampType) and v.is_text:
                cast = v.col.try_cast("date" if isinstance(u.kind, T.DateType) else "timestamp")
                return (u.col, cast) if u is a else (cast, u.col)
        return a.col, b.col

    @staticmethod
    def member(a: Value, b: Value) -> Column:
        if b.choices is not None:
            out = F.lit(False)
            for c in b.choices:
                out = out | a.col.eqNullSafe(c.col)
            return out
        if b.is_text:
            return b.col.contains(a.col)
        if b.is_array:
            return F.coalesce(F.exists(b.col, lambda x: x.eqNullSafe(a.col)), F.lit(False))
        raise CheckError("'in' needs a tuple, text or array")

    def on_ifexp(self, node: ast.IfExp) -> Value:
        test, a, b = self.truth(self.value(node.test)), self.value(node.body), self.value(node.orelse)
        return Value(F.when(F.coalesce(test, F.lit(False)), a.col).otherwise(b.col), a.kind)

    def on_tuple(self, node: ast.Tuple) -> Value:
        parts = [self.value(x) for x in node.elts]
        kind = T.StructType([T.StructField(f"_{i}", p.kind or _TEXT) for i, p in enumerate(parts)])
        return Value(F.struct(*(p.col.alias(f"_{i}") for i, p in enumerate(parts))) if parts else F.lit(None), kind, parts)

    on_list = on_set = lambda self, node: self.sequence(node)

    def sequence(self, node: ast.List | ast.Set) -> Value:
        parts = [self.value(x) for x in node.elts]
        return Value(F.array(*(p.col for p in parts)), T.ArrayType(parts[0].kind if parts else _TEXT), parts)

    # comprehensions ---------------------------------------------------------------------------------------------------
    def each(self, node: ast.AST) -> Value:
        """A list, set or generator comprehension over one array."""
        if len(node.generators) != 1 or not isinstance(node.generators[0].target, ast.Name):
            raise CheckError("only comprehensions with one loop and one name are supported")
        loop = node.generators[0]
        source = self.value(loop.iter)
        if not source.is_array:
            raise CheckError("loops need an array")
        item = source.kind.elementType
        kind: list[T.DataType | None] = [None]

        def inside(x: Column, part: ast.AST) -> Value:
            self.bound.append({loop.target.id: Value(x, item)})
            try:
                return self.value(part)
            finally:
                self.bound.pop()

        arr = source.col
        def passes(test: ast.AST) -> Callable[[Column], Column]:  # Spark counts a lambda's parameters, so none for the test
            return lambda x: F.coalesce(self.truth(inside(x, test)), F.lit(False))

        for test in loop.ifs:
            arr = F.filter(arr, passes(test))

        def element(x: Column) -> Column:
            v = inside(x, node.elt)
            kind[0] = v.kind
            return v.col

        arr = F.transform(arr, element)
        return Value(F.array_distinct(arr) if isinstance(node, ast.SetComp) else arr, T.ArrayType(kind[0] or _TEXT))

    on_listcomp = on_setcomp = on_generatorexp = each

    # calls --------------------------------------------------------------------------------------------------------------
    def on_call(self, node: ast.Call) -> Value:
        if isinstance(node.func, ast.Name) and node.func.id == "timedelta":
            return self.span(node)
        if isinstance(node.func, ast.Name) and node.func.id == "isinstance":
            return self.is_kind(node)
        if node.keywords:
            raise CheckError("keyword arguments are not supported")
        if isinstance(node.func, ast.Attribute):
            return self.method(node)
        if not isinstance(node.func, ast.Name):
            raise CheckError("unsupported call")
        name = node.func.id
        args = [self.value(a) for a in node.args]
        handler = _CALLS.get(name)
        if handler is None or not args:
            raise CheckError(f"function '{name}' is not supported")
        return handler(self, args)

    def matches(self, name: str, args: list[ast.AST]) -> Value:
        """``re.match``, ``re.search`` and ``re.fullmatch``, as conditions."""
        around = {"match": ("\\A(?:", ")"), "search": ("", ""), "fullmatch": ("\\A(?:", ")\\z")}
        if name not in around or len(args) != 2:
            raise CheckError(f"re.{name} is not supported")
        head, tail = around[name]
        return Value(self.value(args[1]).col.rlike(head + _pattern_of(args[0]) + tail), _BOOL)

    def method(self, node: ast.Call) -> Value:
        f = node.func
        if isinstance(f.value, ast.Name) and f.value.id in ("date", "datetime") and f.attr == "fromisoformat":
            v = self.value(node.args[0])
            kind = "date" if f.value.id == "date" else "timestamp"
            return Value(v.col.try_cast(kind), T.DateType() if kind == "date" else T.TimestampType())
        if isinstance(f.value, ast.Name) and f.value.id == "re":
            return self.matches(f.attr, node.args)
        v, args = self.value(f.value), [self.value(a) for a in node.args]
        if isinstance(v.kind, Span) and f.attr == "total_seconds" and not args:
            return Value(v.col, _DOUBLE)
        if isinstance(v.kind, T.DateType | T.TimestampType) and f.attr in ("date", "weekday", "isoweekday", "isoformat") and not args:
            day = F.weekday(v.col).cast("long")  # Monday is 0
            made = {"date": (v.col.cast("date"), T.DateType()), "weekday": (day, _LONG), "isoweekday": (day + 1, _LONG), "isoformat": (F.date_format(v.col, "yyyy-MM-dd" if isinstance(v.kind, T.DateType) else "yyyy-MM-dd'T'HH:mm:ssXXX"), _TEXT)}
            return Value(*made[f.attr])
        simple = {"lower": F.lower, "upper": F.upper, "strip": F.trim}
        if f.attr in simple and not args:
            return Value(simple[f.attr](v.col), _TEXT)
        if f.attr in ("startswith", "endswith") and len(args) == 1:
            return Value(getattr(v.col, f.attr)(args[0].col), _BOOL)
        if f.attr == "count" and v.is_array:
            return Value(F.size(F.filter(v.col, lambda x: x.eqNullSafe(args[0].col))).cast("long"), _LONG)
        if f.attr == "split" and not args:  # runs of white space part, those at the ends do not count
            words = F.split(stripped(v.col), r"(?U)\s+")
            return Value(F.filter(words, lambda w: w != ""), T.ArrayType(_TEXT))
        if f.attr == "split" and len(args) == 1:
            return Value(F.split(v.col, F.concat(F.lit("\\Q"), args[0].col, F.lit("\\E")), -1), T.ArrayType(_TEXT))
        raise CheckError(f"method '{f.attr}' is not supported")


def _pattern_of(node: ast.AST) -> str:
    if not (isinstance(node, ast.Constant) and isinstance(node.value, str)):
        raise CheckError("a pattern must be written out")
    try:
        return java_pattern(node.value)
    except ValueError as e:
        raise CheckError(str(e)) from None


def _len(c: Compiler, a: list[Value]) -> Value:
    # arrays and text; the length of None is an error, so null
    return Value((F.when(a[0].col.isNotNull(), F.size(a[0].col)) if a[0].is_array else F.length(a[0].col)).cast("long"), _LONG)


def _sum(c: Compiler, a: list[Value]) -> Value:
    kind = a[0].kind.elementType if a[0].is_array else None
    if isinstance(kind, T.BooleanType):
        return Value(F.size(F.filter(a[0].col, lambda x: x)).cast("long"), _LONG)
    zero = F.lit(0).cast("long") if isinstance(kind, T.LongType) else F.lit(0.0)
    return Value(F.aggregate(a[0].col, zero, lambda s, x: s + x), _LONG if isinstance(kind, T.LongType) else _DOUBLE)


def _extreme(array: Callable, row: Callable) -> Callable:
    def run(c: Compiler, a: list[Value]) -> Value:
        if len(a) == 1:
            return Value(array(a[0].col), a[0].kind.elementType)
        return Value(row(*(x.col for x in a)), a[0].kind)

    return run


def _round(c: Compiler, a: list[Value]) -> Value:
    if len(a) == 1:
        return Value(F.bround(a[0].col, 0).cast("long"), _LONG)
    if len(a) == 2 and isinstance(a[1].constant, int) and not isinstance(a[1].constant, bool):
        return Value(F.bround(a[0].col, a[1].constant), a[0].kind)
    raise CheckError("round takes a number of digits that is written out")


def _set(c: Compiler, a: list[Value]) -> Value:
    return Value(F.array_distinct(a[0].col), a[0].kind)


_CALLS: dict[str, Callable[[Compiler, list[Value]], Value]] = {
    "len": _len,
    "sum": _sum,
    "abs": lambda c, a: Value(F.abs(a[0].col), a[0].kind),
    "min": _extreme(F.array_min, F.least),
    "max": _extreme(F.array_max, F.greatest),
    "round": _round,
    "any": lambda c, a: Value(F.exists(a[0].col, lambda x: F.coalesce(c.truth(Value(x, a[0].kind.elementType)), F.lit(False))), _BOOL),
    "all": lambda c, a: Value(F.forall(a[0].col, lambda x: F.coalesce(c.truth(Value(x, a[0].kind.elementType)), F.lit(False))), _BOOL),
    "set": _set,
    "list": lambda c, a: a[0],
    "sorted": lambda c, a: Value(F.array_sort(a[0].col), a[0].kind),
    "str": lambda c, a: Value(a[0].col.cast("string"), _TEXT),
    "int": lambda c, a: Value(a[0].col.try_cast("double").cast("long"), _LONG),
    "float": lambda c, a: Value(a[0].col.try_cast("double"), _DOUBLE),
    "bool": lambda c, a: Value(c.truth(a[0]), _BOOL),
}
