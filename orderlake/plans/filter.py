"""The filter language: tree to a Spark column.

Lowered once on the driver. Documents are either structs, whose schema tells
the leaves, or JSON text, whose leaves an Arrow function lists once a row. All
predicates are two-valued: null leaves and missing paths match nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import date_seconds, parse_date
from .syntax import Expr, Group, Item, Range, Scoped, Term, parse

NUMBER = re.compile(r"[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\Z", re.I)
NUMBER_JAVA = r"^(?i)[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"
EPSILON = 2.220446049250313e-16
NOT_TOKEN = r"[^\p{IsAlphabetic}\p{N}]+"
DEFAULT_SLOP = 2

#: Given a leaf's kind ('text', 'number', 'bool') and value column, whether it matches.
Leaf = Callable[[str, Column], Column]


def to_number(text: str) -> float | None:
    return float(text) if NUMBER.match(text) else None


def tokens(text: Column) -> Column:
    """Runs of letters and digits, case kept."""
    return F.filter(F.split(text, NOT_TOKEN), lambda x: x != "")


def _java_pattern(pattern: str) -> str | None:
    """The pattern, or None where the dialect has none such: look-around, back references, syntax errors."""
    if re.search(r"\(\?(<?[=!]|>)|\\[1-9]|\\k<", pattern):
        return None
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}|\\[zZ]", "x", re.sub(r"\(\?<(\w+)>", r"(?P<\1>", pattern)))
    except re.error:
        return None
    return pattern


def _glob(pattern: str) -> str:
    return r"(?s)\A" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.\[\]{}()+\-^$|&#~])", r"\\\1", c) for c in pattern) + r"\z"


def text_rule(term: Term) -> Callable[[Column], Column]:
    """How a term matches a text leaf."""
    if term.regex:
        pattern = _java_pattern(term.value)
        return (lambda s: F.lit(False)) if pattern is None else (lambda s: s.rlike(pattern))
    low = term.value.lower()
    if term.quoted:
        return lambda s: F.contains(F.lower(s), F.lit(low))
    if term.slop is None and ("*" in low or "?" in low):
        return lambda s: F.lower(s).rlike(_glob(low))
    slop = DEFAULT_SLOP if term.slop is None else term.slop
    return lambda s: F.exists(tokens(s), lambda x: F.levenshtein(F.lit(low), x, slop) >= 0)


def term_leaf(term: Term) -> Leaf:
    rule = text_rule(term)
    precise = not term.regex and (term.quoted or term.slop is not None or not re.search(r"[*?]", term.value))
    number = to_number(term.value.lower()) if precise else None

    def leaf(kind: str, value: Column) -> Column:
        if kind == "text":
            return rule(value)
        if kind == "number" and number is not None:
            if math.isnan(number) or math.isinf(number):
                return F.lit(False)
            return F.abs(value.cast("double") - F.lit(number)) < EPSILON
        return rule(value.cast("string"))

    return leaf


def date_leaf(start: int, after: int) -> Leaf:
    def leaf(kind: str, value: Column) -> Column:
        if kind != "text":
            return F.lit(False)
        at = date_seconds(value)
        return (at >= start) & (at < after)

    return leaf


def range_leaf(r: Range) -> Leaf:
    low, high = to_number(r.low), to_number(r.high)

    def within(v: Column, a: object, b: object) -> Column:
        return (v >= F.lit(a)) & (v <= F.lit(b)) if r.inclusive else (v > F.lit(a)) & (v < F.lit(b))

    def leaf(kind: str, value: Column) -> Column:
        if low is not None and high is not None:
            if kind == "number":
                return within(value.cast("double"), low, high)
            if kind == "text":
                return within(F.when(value.rlike(NUMBER_JAVA), value.try_cast("double")), low, high)
            return F.lit(False)
        if low is None and high is None and kind == "text":
            return within(value, r.low, r.high)
        return F.lit(False)  # one bound a number, the other text: nothing fits

    return leaf


def lower_leaf(expr: Term | Range) -> Leaf:
    """The predicate of a term or range; calendar literals become intervals."""
    if isinstance(expr, Term):
        day = None if expr.quoted or expr.regex or expr.slop is not None else parse_date(expr.value)
        return date_leaf(day.start, day.after) if day and not day.only_year else term_leaf(expr)
    low, high = parse_date(expr.low), parse_date(expr.high)
    if low and high:
        return date_leaf(low.start, high.after) if expr.inclusive else date_leaf(low.after, high.start)
    return range_leaf(expr)


class Documents:
    """Where leaves come from."""

    def any_leaf(self, path: tuple[str, ...], leaf: Leaf) -> Column:
        raise NotImplementedError


_KINDS = {T.StringType: "text", T.BooleanType: "bool", T.ByteType: "number", T.ShortType: "number", T.IntegerType: "number", T.LongType: "number", T.FloatType: "number", T.DoubleType: "number", T.DecimalType: "number"}


class TypedDocuments(Documents):
    """Documents whose fields are columns, structs, maps and arrays of known types."""

    def __init__(self, schema: T.StructType, root: Column | None = None) -> None:
        self.schema, self.root = schema, root

    def any_leaf(self, path: tuple[str, ...], leaf: Leaf) -> Column:
        def scalar(kind: T.DataType, value: Column) -> Column | None:
            if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
                return F.coalesce(leaf("text", value), F.lit(False))
            name = next((n for t, n in _KINDS.items() if isinstance(kind, t)), None)
            return None if name is None else F.coalesce(leaf(name, value), F.lit(False))

        def child(value: Column | None, name: str) -> Column:
            return F.col(f"`{name}`") if value is None else value.getField(name)

        def walk(kind: T.DataType, value: Column | None, keys: tuple[str, ...], scoped: bool) -> Column | None:
            if isinstance(kind, T.StructType):
                if scoped and not keys:
                    return None
                own = [f for f in kind.fields if not scoped or f.name == keys[0]]
                return any_of([walk(f.dataType, child(value, f.name), keys[1:] if scoped else (), scoped) for f in own])
            if isinstance(kind, T.ArrayType):
                if scoped and not keys and isinstance(kind.elementType, (T.ArrayType, T.StructType)):
                    return None  # only direct elements are leaves at the end of a path
                if walk(kind.elementType, F.lit(None), keys, scoped) is None:
                    return None
                return F.coalesce(F.exists(value, lambda x: F.coalesce(walk(kind.elementType, x, keys, scoped), F.lit(False))), F.lit(False))
            if isinstance(kind, T.MapType):
                if scoped and not keys:
                    return None
                if scoped:
                    return walk(kind.valueType, F.try_element_at(value, F.lit(keys[0])), keys[1:], scoped)
                return walk(T.ArrayType(kind.valueType), F.map_values(value), (), scoped)
            return scalar(kind, value) if not scoped or not keys else None

        got = walk(self.schema, self.root, path, bool(path))
        return F.lit(False) if got is None else got


def any_of(columns: list[Column | None]) -> Column | None:
    some = [c for c in columns if c is not None]
    return reduce(lambda a, b: a | b, some) if some else None


LEAVES = "array<struct<path:array<string>,direct:boolean,kind:string,text:string,number:double>>"


def json_leaves(text: str | None) -> list[tuple] | None:
    """Scalar leaves of a JSON text, or None if it isn't one.

    ``direct``: at the end of its path, or an element of an array that is there.
    """
    try:
        root = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if text is None:
        return None
    out: list[tuple] = []
    todo = [(root, (), 0)]
    while todo:
        value, path, arrays = todo.pop()
        if isinstance(value, dict):
            todo += [(v, (*path, k), 0) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(v, path, arrays + 1) for v in value]
        elif isinstance(value, bool):
            out.append((list(path), arrays <= 1, "bool", "true" if value else "false", None))
        elif isinstance(value, (int, float)):
            out.append((list(path), arrays <= 1, "number", json.dumps(value), float(value)))
        elif isinstance(value, str):
            out.append((list(path), arrays <= 1, "text", value, None))
    return out


def leaves(text: Column) -> Column:
    """Leaves of JSON text; null for what isn't JSON."""
    names = ("path", "direct", "kind", "text", "number")

    @F.pandas_udf(LEAVES)
    def listed(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if (got := json_leaves(x)) is None else [dict(zip(names, leaf)) for leaf in got])

    return listed(text.cast("string"))


class JsonDocuments(Documents):
    """Documents as a column made by ``leaves``."""

    def __init__(self, column: Column) -> None:
        self.column = column

    def any_leaf(self, path: tuple[str, ...], leaf: Leaf) -> Column:
        def fits(x: Column) -> Column:
            ok = F.when(x["kind"] == "text", leaf("text", x["text"]))
            # a number is compared as one, or by its text
            rendered = leaf("number", x["number"]) if _numeric(leaf) else leaf("text", x["text"])
            ok = ok.when(x["kind"] == "number", rendered).when(x["kind"] == "bool", leaf("bool", x["text"]))
            here = F.lit(True) if not path else x["direct"] & (x["path"] == F.array(*map(F.lit, path)))
            return F.coalesce(here & ok, F.lit(False))

        return F.coalesce(F.exists(self.column, fits), F.lit(False))


def _numeric(leaf: Leaf) -> bool:
    """Whether the predicate compares numbers as numbers."""
    return getattr(leaf, "numeric", True)


def lower(expr: Expr, docs: Documents, path: tuple[str, ...] = ()) -> Column:
    """The column of a tree, looking for leaves under ``path``."""
    if isinstance(expr, Scoped):
        return lower(expr.expr, docs, (*path, *expr.path))
    if isinstance(expr, (Term, Range)):
        leaf = lower_leaf(expr)
        if isinstance(expr, Term):
            leaf.numeric = to_number(expr.value.lower()) is not None and not expr.regex and (expr.quoted or expr.slop is not None or not re.search(r"[*?]", expr.value))
        return docs.any_leaf(path, leaf)
    if not expr.items:
        return F.lit(True)
    matched = [(item, lower(item.expr, docs, path)) for item in expr.items]
    return _linked(matched) if any(i.link for i in expr.items) else _occurring(matched)


def _linked(matched: list[tuple[Item, Column]]) -> Column:
    """Groups with an operator: alternatives of conjunctions; items without an operator between them belong together."""
    clauses: list[list[Column]] = [[]]
    for item, column in matched:
        clauses[-1].append(~column if item.sign == "-" else column)
        if item.link == "or":
            clauses.append([])
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, c) for c in clauses])


def _occurring(matched: list[tuple[Item, Column]]) -> Column:
    """Groups without operators: all required, none forbidden, one of the optional if there are any."""
    out = [column if item.sign == "+" else ~column for item, column in matched if item.sign]
    optional = any_of([column for item, column in matched if not item.sign])
    return reduce(lambda a, b: a & b, out + ([optional] if optional is not None else []))


def compile_filter(query: str, docs: Documents) -> Column:
    return lower(parse(query), docs)


def where(frame: DataFrame, query: str) -> DataFrame:
    """Rows of a typed frame that match."""
    return frame.where(compile_filter(query, TypedDocuments(frame.schema)))


def where_json(frame: DataFrame, query: str, column: str = "value") -> DataFrame:
    """Rows whose JSON text matches; rows without JSON are skipped."""
    read = frame.withColumn("__leaves", leaves(F.col(column)))
    return read.where(F.col("__leaves").isNotNull() & compile_filter(query, JsonDocuments(F.col("__leaves")))).drop("__leaves")
