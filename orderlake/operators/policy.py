"""Policies: typed row predicates that deny whatever they cannot decide.

A tree is compiled into one expression of (status, reason). It never relies on
three-valued logic: a missing field or a comparison across types is a fault,
and a fault denies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN, PARTIAL, STEPS, DEPTH, MEMORY = "UnknownField", "NotTotal", "StepBudget", "DepthBudget", "MemoryBudget"

#: The largest tree that a policy may have.
MOST_NODES, MOST_LEVELS = 4096, 128


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Path:
    root: str
    name: str


@dataclass(frozen=True)
class Exists:
    path: Path


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class In:
    value: object
    options: tuple


class PolicyError(ValueError):
    """A tree that no policy may have."""


_OPS = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}


def children(tree: object) -> list:
    if isinstance(tree, (Compare, And, Or)):
        return [tree.left, tree.right]
    return [tree.inner] if isinstance(tree, Not) else [tree.value] if isinstance(tree, In) else []


def measure(tree: object) -> tuple[int, int]:
    """(nodes, depth) of a tree; each option of a set is a node below it."""
    if not isinstance(tree, (Literal, Path, Exists, Compare, And, Or, Not, In)):
        raise PolicyError(f"not part of a policy: {tree!r}")
    below = [measure(c) for c in children(tree)]
    options = len(tree.options) if isinstance(tree, In) else 0
    return 1 + options + sum(s for s, _ in below), 1 + max([d for _, d in below] + [int(options > 0)])


def _weight(value: object) -> int:
    return len(value.encode()) if isinstance(value, str) else len(value) if isinstance(value, (bytes, bytearray)) else 1


def step_cost(tree: object) -> int:
    """Steps, and bytes of the arena, that entering a node takes; names and texts count by their bytes."""
    if isinstance(tree, Literal):
        return 1 + _weight(tree.value)
    if isinstance(tree, (Path, Exists)):
        return 1 + sum(len(part.encode()) for part in (tree.path if isinstance(tree, Exists) else tree).name.split("."))
    if isinstance(tree, In):
        return 1 + len(tree.options) + sum(map(_weight, tree.options))
    return 1


def worst(tree: object, depth: int = 0) -> tuple[int, int]:
    """(steps, depth) if every node is entered; the root is at depth 0."""
    below = [worst(c, depth + 1) for c in children(tree)]
    return step_cost(tree) + sum(s for s, _ in below), max([depth] + [d for _, d in below])


def paths(tree: object) -> set[Path]:
    if isinstance(tree, Path):
        return {tree}
    if isinstance(tree, Exists):
        return {tree.path}
    return set().union(*[paths(c) for c in children(tree)]) if children(tree) else set()


def validate(tree: object, schema: T.StructType) -> None:
    """Fails on paths that the before and after structs don't declare."""
    for p in paths(tree):
        if p.root not in ("before", "after") or p.root not in schema.fieldNames() or p.name not in schema[p.root].dataType.fieldNames():
            raise PolicyError(f"unknown field: {p.root}.{p.name}")


def _kind(value: object, schema: T.StructType) -> str:
    if isinstance(value, Literal):
        return "bool" if isinstance(value.value, bool) else "number" if isinstance(value.value, int) else "text"
    if isinstance(value, Path):
        t = schema[value.root].dataType[value.name].dataType
        return "bool" if isinstance(t, T.BooleanType) else "number" if isinstance(t, (T.IntegralType, T.DecimalType)) else "text" if isinstance(t, T.StringType) else "other"
    return "bool"


@dataclass(frozen=True)
class _Part:
    value: Column
    fault: Column  # text or null
    steps: Column  # of the ledger


class _Sum:
    """Counts the steps of the nodes that are entered."""

    def enter(self, tree: object, depth: int) -> Column:
        return F.lit(step_cost(tree))

    def then(self, a: Column, b: Column, goes: Column | None = None) -> Column:
        return a + (b if goes is None else F.when(goes, b).otherwise(0))


class _Trace:
    """Lists the nodes that are entered, in order, for budgets that may end on the way."""

    def enter(self, tree: object, depth: int) -> Column:
        return F.array(F.struct(F.lit(step_cost(tree)).cast("long").alias("cost"), F.lit(depth).alias("depth")))

    def then(self, a: Column, b: Column, goes: Column | None = None) -> Column:
        return F.concat(a, b if goes is None else F.when(goes, b).otherwise(F.array().cast("array<struct<cost:bigint,depth:int>>")))

    @staticmethod
    def spend(trace: Column, max_steps: int, max_arena: int, max_depth: int) -> Column:
        """used, stop: steps before the first node that a budget refuses, and which budget that is."""
        start = F.struct(F.lit(0).cast("long").alias("used"), _text(None).alias("stop"))

        def enter(acc: Column, node: Column) -> Column:
            total = acc["used"] + node["cost"]
            stop = F.when(node["depth"] > max_depth, DEPTH).when(total > max_steps, STEPS).when(total > max_arena, MEMORY)
            after = F.struct(F.when(stop.isNull(), total).otherwise(acc["used"]).alias("used"), stop.alias("stop"))
            return F.when(acc["stop"].isNotNull(), acc).otherwise(after)

        return F.aggregate(trace, start, enter)


def _text(reason: str | None) -> Column:
    return F.lit(reason).cast("string")


def _eval(tree: object, schema: T.StructType, ledger: _Sum | _Trace, depth: int = 0) -> _Part:
    one = ledger.enter(tree, depth)
    if isinstance(tree, Literal):
        return _Part(F.lit(tree.value), _text(None), one)
    if isinstance(tree, Path):
        c = F.col(f"{tree.root}.{tree.name}")
        return _Part(c, F.when(c.isNull(), _text(UNKNOWN)), one)
    if isinstance(tree, Exists):
        return _Part(F.col(f"{tree.path.root}.{tree.path.name}").isNotNull(), _text(None), one)
    if isinstance(tree, Compare):
        a, b = _eval(tree.left, schema, ledger, depth + 1), _eval(tree.right, schema, ledger, depth + 1)
        ka, kb = _kind(tree.left, schema), _kind(tree.right, schema)
        total = ka == kb and ka != "other" and (ka != "bool" or tree.op in ("eq", "ne"))
        value = F.coalesce(_OPS[tree.op](a.value, b.value), F.lit(False)) if total else F.lit(False)
        fault = F.coalesce(a.fault, b.fault) if total else F.coalesce(a.fault, b.fault, _text(PARTIAL))
        return _Part(value, fault, ledger.then(ledger.then(one, a.steps), b.steps, a.fault.isNull()))
    if isinstance(tree, In):
        a = _eval(tree.value, schema, ledger, depth + 1)
        # options of another kind equal nothing: a long 2 isn't the text '2'
        kind = _kind(tree.value, schema)
        same = [o for o in tree.options if o is not None and kind != "other" and _kind(Literal(o), schema) == kind]
        return _Part(F.coalesce(a.value.isin(*same), F.lit(False)) if same else F.lit(False), a.fault, ledger.then(one, a.steps))
    if isinstance(tree, Not):
        a = _bool(tree.inner, schema, ledger, depth + 1)
        return _Part(~a.value, a.fault, ledger.then(one, a.steps))
    if isinstance(tree, (And, Or)):
        a, b = _bool(tree.left, schema, ledger, depth + 1), _bool(tree.right, schema, ledger, depth + 1)
        goes = a.fault.isNull() & (a.value if isinstance(tree, And) else ~a.value)
        fault = F.when(a.fault.isNotNull(), a.fault).when(goes, b.fault)
        value = F.when(goes, b.value).otherwise(F.lit(isinstance(tree, Or)))
        return _Part(value, fault, ledger.then(ledger.then(one, a.steps), b.steps, goes))
    raise PolicyError(f"not part of a policy: {tree!r}")


def _bool(tree: object, schema: T.StructType, ledger: _Sum | _Trace, depth: int) -> _Part:
    part = _eval(tree, schema, ledger, depth)
    if _kind(tree, schema) != "bool":
        return _Part(F.lit(False), F.coalesce(part.fault, _text(PARTIAL)), part.steps)
    return _Part(F.coalesce(part.value, F.lit(False)), part.fault, part.steps)


def evaluate(rows: DataFrame, tree: object, max_steps: int = 10_000, max_depth: int = 64, max_arena: int = 1 << 20) -> DataFrame:
    """Adds verdict (allow or deny), reason and steps.

    Entering a node costs steps and as many bytes of the arena; the first node
    beyond a budget, or deeper than it allows, denies the row with the budget's
    name, and steps are those before it. A budget that no row can use up isn't watched.
    """
    nodes, levels = measure(tree)
    if nodes > MOST_NODES or levels > MOST_LEVELS:
        raise PolicyError(f"a tree of {nodes} nodes and {levels} levels is too large")
    steps, depth = worst(tree)
    watched = steps > min(max_steps, max_arena) or depth > max_depth
    part = _bool(tree, rows.schema, _Trace() if watched else _Sum(), 0)
    used, fault = part.steps.cast("long") if not watched else None, part.fault
    if watched:
        spent = _Trace.spend(part.steps, max_steps, max_arena, max_depth)
        used, fault = spent["used"], F.coalesce(spent["stop"], part.fault)
    verdict = F.when(fault.isNull() & part.value, "allow").otherwise("deny")
    return rows.withColumns({"verdict": verdict, "reason": F.coalesce(fault, F.when(part.value, "").otherwise("False")), "steps": used})


def evaluate_batch(rows: DataFrame, tree: object, batch: str) -> DataFrame:
    """batch, verdict: allow only if every row of the batch is."""
    each = evaluate(rows, tree)
    return each.groupBy(batch).agg(F.when(F.bool_and(F.col("verdict") == "allow"), "allow").otherwise("deny").alias("verdict"), F.count_if(F.col("verdict") == "deny").alias("denied"))


def gate_reads(reads: DataFrame, tree: object, authenticated: Column) -> DataFrame:
    """The access log of reads: read_id, allowed, reason; a reader who isn't authenticated is refused first."""
    each = evaluate(reads, tree)
    reason = F.when(~F.coalesce(authenticated, F.lit(False)), "Unauthenticated").otherwise(F.col("reason"))
    return each.select("read_id", (reason == "").alias("allowed"), reason.alias("reason"))


def dry_run(rows: DataFrame, old: object, new: object, keys: list[str]) -> DataFrame:
    """Rows whose verdict flips between two policies: keys, from_verdict, to_verdict."""
    both = evaluate(evaluate(rows, old).withColumnRenamed("verdict", "from_verdict").drop("reason", "steps"), new)
    return both.where("from_verdict <> verdict").select(*keys, "from_verdict", F.col("verdict").alias("to_verdict"))


def structural_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """rule_id, change (added, removed, changed) between two tables (rule_id, body)."""
    a, b = old.select("rule_id", F.col("body").alias("a")), new.select("rule_id", F.col("body").alias("b"))
    both = a.join(b, "rule_id", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("rule_id", change.alias("change")).where("change is not null")


def path_diff(old: list[object], new: list[object]) -> tuple[list[str], list[str]]:
    """Paths that the new trees read and the old ones don't, and the other way round."""
    a, b = ({f"{p.root}.{p.name}" for t in trees for p in paths(t)} for trees in (old, new))
    return sorted(b - a), sorted(a - b)


def reject_regex(query: object) -> None:
    """Contract searches have no regular expressions."""
    from ..plans.syntax import Group, Scoped, Term

    if isinstance(query, Term) and query.regex:
        raise PolicyError("regular expressions are not part of the search contract")
    if isinstance(query, Scoped):
        reject_regex(query.expr)
    if isinstance(query, Group):
        for item in query.items:
            reject_regex(item.expr)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
