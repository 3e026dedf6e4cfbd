"""From scan definitions to staged DataFrame plans.

Operands become ``Value``s: a Column, the level at which it can be computed,
and a key under which equal sub-expressions are shared. A window over a value
that itself holds windows is staged as a column one level up; path-dependent
kernels are staged likewise. A plan runs level by level: all window columns of
a level in one projection, then all its kernels in one grouped pass over the
partition. Windows see the whole frame; the filter comes last.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barsift.functions.kernels import KERNELS
from barsift.functions.registry import INDICATORS, STAGED
from barsift.plans.catalog import PROPERTY_CATALOG
from barsift.plans.validation import validate



def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ieee_div(a: Column, b: Column) -> Column:
    """Division of doubles as IEEE has it: x/0 is an infinity, 0/0 is NaN, and nothing raises."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


@dataclass(frozen=True)
class Value:
    """A column expression. ``level``: the stage after which its inputs exist. ``bare``: it holds no column, so it has no past."""

    col: Column
    level: int
    bare: bool
    key: str

    def _with(self, other, op: str, f: Callable[[Column, Column], Column]) -> Value:
        other = value(other)
        return Value(f(number(self.col), number(other.col)), max(self.level, other.level), self.bare and other.bare, f"({self.key}{op}{other.key})")

    def __add__(self, o):
        return self._with(o, "+", lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, "-", lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, "*", lambda a, b: a * b)

    def __truediv__(self, o):
        return self._with(o, "/", ieee_div)

    def __radd__(self, o):
        return value(o) + self

    def __rsub__(self, o):
        return value(o) - self

    def __rmul__(self, o):
        return value(o) * self

    def __neg__(self):
        return Value(-number(self.col), self.level, self.bare, f"(-{self.key})")


def number(c: Column) -> Column:
    return c.cast("double")


def value(x) -> Value:
    return x if isinstance(x, Value) else Value(F.lit(x), 0, True, f"lit:{type(x).__name__}:{x!r}")


def combine(label: str, f: Callable[..., Column], *values) -> Value:
    """A row-wise expression of values."""
    vs = [value(v) for v in values]
    return Value(f(*[v.col for v in vs]), max((v.level for v in vs), default=0), all(v.bare for v in vs), f"{label}({','.join(v.key for v in vs)})")


@dataclass
class Stage:
    level: int
    name: str
    key: str
    col: Column | None = None
    kernel: tuple[str, list[str], tuple] | None = None


@dataclass
class Context:
    """What builders work with: the partition's window, and staging."""

    partition: str | Sequence[str] = "symbol"
    order_column: str = "session"
    seed: str = "first"
    lookback: bool = False  # candlesticks have no value on a series' first bars, as in SQL engines
    stages: list[Stage] = field(default_factory=list)
    known: dict[str, Value] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    #: staged columns are named after the context, so that no column of a frame can have such a name by chance
    prefix: str = field(default_factory=lambda: f"__stage_{uuid.uuid4().hex}_")

    @property
    def keys(self) -> list[str]:
        return [self.partition] if isinstance(self.partition, str) else list(self.partition)

    @property
    def window(self):
        return Window.partitionBy(*map(column, self.keys)).orderBy(column(self.order_column))

    def rows(self, n: int):
        return self.window.rowsBetween(1 - n, 0)

    def column(self, name: str) -> Value:
        return Value(column(name), 0, False, f"col:{name}")

    def number(self, name: str) -> Value:
        return combine("double", number, self.column(name))

    def _stage(self, key: str, level: int, **what) -> Value:
        if key not in self.known:
            name = f"{self.prefix}{len(self.stages)}"
            self.stages.append(Stage(level, name, key, **what))
            self.known[key] = Value(F.col(name), level, False, key)
            self.names[key] = name
        return self.known[key]

    def over(self, label: str, f: Callable[..., Column], *values) -> Value:
        """A window expression of values, staged."""
        vs = [value(v) for v in values]
        key = f"{label}[{','.join(v.key for v in vs)}]"
        return self._stage(key, 1 + max((v.level for v in vs), default=0), col=f(*[v.col for v in vs]))

    def lag(self, x: Value, n: int = 1) -> Value:
        return self.over(f"lag{n}", lambda c: F.lag(c, n).over(self.window), x)

    def full(self, kind: str, x: Value, n: int) -> Value:
        """An aggregate of n rows, null until n of them have values."""
        agg = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop}[kind]
        w = self.rows(n)
        return self.over(f"{kind}{n}", lambda c: F.when(F.count(c).over(w) == n, agg(c).over(w)), x)

    def index(self) -> Value:
        return self.over("index", lambda: (F.row_number().over(self.window) - 1).cast("double"))

    def kernel(self, name: str, inputs: Sequence[Value], *params) -> Value:
        """A path-dependent series of staged inputs."""
        vs = [self._named(v) for v in inputs]
        key = f"{name}{params}[{','.join(v.key for v in vs)}]"
        return self._stage(key, 1 + max(v.level for v in vs), kernel=(name, [self._name_of(v) for v in vs], params))

    def _named(self, v: Value) -> Value:
        if v.key.startswith("col:") or v.key in self.known:
            return v
        return self._stage(f"as[{v.key}]", v.level + 1, col=number(v.col))

    def _name_of(self, v: Value) -> str:
        return self.names[v.key] if v.key in self.names else v.key[4:]


FOLDS = {"+": Value.__add__, "-": Value.__sub__, "*": Value.__mul__, "/": Value.__truediv__}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


class Planner:
    def __init__(self, ctx: Context, catalog: dict):
        self.ctx, self.catalog = ctx, catalog
        self.staged: list[tuple[str, Value]] = []

    def operand(self, spec) -> Value:
        if not isinstance(spec, dict):
            return value(spec)
        if "col" in spec:
            return self.ctx.column(spec["col"])
        if "fn" in spec:
            slots, build, _ = INDICATORS[spec["fn"]]
            got = build(self.ctx, *[a if s == "int" else self.operand(a) for s, a in zip(slots, spec["args"], strict=True)])
            if spec["fn"] in STAGED:
                self.staged.append((f"__{spec['fn']}_{len(self.staged)}", got))
            return got
        op = next(k for k in spec if k in FOLDS)
        items = [self.operand(x) for x in spec[op]]
        return -items[0] if len(items) == 1 else reduce(FOLDS[op], items)

    def node(self, node: dict) -> Column:
        for key, join in (("all", Column.__and__), ("any", Column.__or__)):
            if key in node:
                return reduce(join, map(self.node, node[key]))
        return ~self.node(node["not"]) if "not" in node else self.leaf(node)

    def leaf(self, leaf: dict) -> Column:
        prop, op, right = leaf["property"], leaf["op"], leaf["value"]
        left = self.operand(prop) if isinstance(prop, dict) else self.ctx.column(prop)
        if op in ("cross_above", "cross_below"):
            return self.crossing(op, left, self.operand(right))
        if isinstance(prop, str) and self.catalog[prop]["dtype"] == "date":
            dates = [dt.date.fromisoformat(v) for v in ([right] if isinstance(right, str) else right)] if isinstance(right, (str, list, tuple)) else None
            right = right if dates is None else dates[0] if isinstance(right, str) else dates
        if op == "between":
            return left.col.between(F.lit(right[0]), F.lit(right[1]))
        if op == "in":
            return left.col.isin(list(right))
        if op == "contains":
            return F.contains(left.col, F.lit(right))
        return COMPARE[op](left.col, self.operand(right).col)

    def crossing(self, op: str, a: Value, b: Value) -> Column:
        """a over (under) b now and not on the bar before. A side without columns has no past and stands for itself."""
        was_a, was_b = (v if v.bare else self.ctx.lag(v) for v in (a, b))
        if op == "cross_above":
            return (a.col > b.col) & (was_a.col <= was_b.col)
        return (a.col < b.col) & (was_a.col >= was_b.col)


def run_stages(df: DataFrame, ctx: Context) -> DataFrame:
    """Level by level; kernels wait until something needs them (a key holds the keys of its inputs), so that as many as can share one grouped pass, and windows go before it in the exchange that is there."""
    waiting: list[Stage] = []

    def pass_over(df: DataFrame, ready: list[Stage]) -> DataFrame:
        return run_kernels(df, [(s.name, *s.kernel) for s in ready], ctx.keys, ctx.order_column) if ready else df

    for level in sorted({s.level for s in ctx.stages}):
        now = [s for s in ctx.stages if s.level == level]
        if any(w.key in s.key for w in waiting for s in now):
            df, waiting = pass_over(df, waiting), []
        if plain := {s.name: s.col for s in now if s.col is not None}:
            df = df.withColumns(plain)
        waiting += [s for s in now if s.kernel]
    return pass_over(df, waiting)


def run_kernels(df: DataFrame, kernels: list[tuple[str, str, list[str], tuple]], keys: list[str], order: str) -> DataFrame:
    """One grouped pass computing all kernels of a level; a group is one partition's rows, in order."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(k[0], T.DoubleType()) for k in kernels)])

    def run(table: pa.Table) -> pa.Table:
        at = table.column(order)
        if len(at) > 1 and (at.null_count or not pc.all(pc.less_equal(at[:-1], at[1:])).as_py()):
            table = table.take(pc.sort_indices(table, [(order, "ascending")], null_placement="at_start"))
        series: dict[str, np.ndarray] = {}
        for name, kernel, inputs, params in kernels:
            xs = []
            for i in inputs:
                if i not in series:
                    series[i] = table.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False)
                xs.append(series[i])
            out = KERNELS[kernel](*xs, *params)
            table = table.append_column(name, pa.array(np.where(np.isnan(out), np.nan, out), pa.float64(), from_pandas=True))
        return table

    return df.groupBy(*map(column, keys)).applyInArrow(run, schema)


def conjuncts(nodes: list[dict]) -> list[dict]:
    """The parts that all must hold."""
    return [part for n in nodes for part in (conjuncts(n["all"]) if "all" in n else [n])]


def columns_alone(x) -> set[str] | None:
    """Columns of a node or operand; None if it looks at other bars."""
    if isinstance(x, (list, tuple)):
        found = [columns_alone(i) for i in x]
        return None if None in found else set().union(*found)
    if not isinstance(x, dict):
        return set()
    if "fn" in x or x.get("op") in ("cross_above", "cross_below"):
        return None
    if "col" in x:
        return {x["col"]}
    if "property" in x:
        prop = {x["property"]} if isinstance(x["property"], str) else columns_alone(x["property"])
        right = columns_alone(x["value"]) if isinstance(x["value"], dict) else set()
        return None if prop is None or right is None else prop | right
    return columns_alone(list(x.values()))


@dataclass
class CompiledScan:
    """A plan that can be applied to any frame with the catalog's columns."""

    ctx: Context
    predicate: Column
    early: Column | None  # the part of it that holds for whole partitions, and so can go before their windows
    staged: list[tuple[str, Value]]
    order_by: list[tuple[str, bool]]
    limit: int | None

    def stage(self, df: DataFrame) -> DataFrame:
        return run_stages(df, self.ctx)

    def apply(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        out = self.stage(df if self.early is None else df.filter(self.early)).filter(self.predicate)
        out = out.select(*map(column, kept), *[v.col.alias(name) for name, v in self.staged])
        if self.order_by:
            ties = [k for k in [*self.ctx.keys, self.ctx.order_column] if k in kept and k not in [p for p, _ in self.order_by]]
            out = out.orderBy(*[column(p).asc_nulls_first() if up else column(p).desc_nulls_first() for p, up in self.order_by], *[column(k).asc_nulls_first() for k in ties])
        return out if self.limit is None else out.limit(self.limit)


def compile(scan_def: dict, *, catalog: dict = PROPERTY_CATALOG, partition="symbol", order_column: str = "session", engine: str = "spark", seed: str | None = None) -> CompiledScan:
    """Validate a definition and plan it. ``seed``: how exponential means begin, "first" (first value) or "sma" (mean of the first n; the default of the "duckdb" profile)."""
    if faults := validate(scan_def, catalog=catalog, engine=engine):
        raise ValueError(faults[0])
    ctx = Context(partition, order_column, seed or ("sma" if engine == "duckdb" else "first"), engine == "duckdb")
    planner = Planner(ctx, catalog)
    parts = conjuncts(scan_def.get("filters") or [])
    whole = [(c := columns_alone(p)) is not None and bool(c) and c <= set(ctx.keys) for p in parts]
    predicate = reduce(Column.__and__, map(planner.node, parts), F.lit(True))
    early = [planner.node(p) for p, w in zip(parts, whole, strict=True) if w]
    order = [(o["property"], o.get("dir", "asc") == "asc") for o in scan_def.get("order_by") or []]
    return CompiledScan(ctx, predicate, reduce(Column.__and__, early) if early else None, planner.staged, order, scan_def.get("limit"))
