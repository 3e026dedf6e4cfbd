"""The analyzer: every fault of a scan definition, each with the path of the offending field."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from barsift.functions.registry import ENGINES, INDICATORS, available
from barsift.plans.catalog import PROPERTY_CATALOG

COMPARISONS = (">=", "<=", ">", "<", "==", "!=")
LISTED = ("in", "between", "contains")
CROSSES = ("cross_above", "cross_below")
ARITHMETIC = ("+", "-", "*", "/")


def is_number(v: object, whole: bool = False) -> bool:
    return isinstance(v, int if whole else (int, float)) and not isinstance(v, bool)


def is_iso_date(v: object) -> bool:
    try:
        return isinstance(v, str) and bool(dt.date.fromisoformat(v))
    except ValueError:
        return False


FITS = {
    "int": lambda v: is_number(v, whole=True),
    "float": is_number,
    "bool": lambda v: isinstance(v, bool),
    "str": lambda v: isinstance(v, str),
    "date": is_iso_date,
}


class Analyzer:
    """Walks a definition and yields messages in document order."""

    def __init__(self, catalog: dict, engine: str):
        self.catalog, self.engine = catalog, engine

    def definition(self, scan) -> Iterator[str]:
        if not isinstance(scan, dict):
            yield f"scan definition must be an object, got {scan!r}"
            return
        yield from self.listed(scan, "filters", lambda i, n: self.node(n, f"filters[{i}]"))
        yield from self.listed(scan, "order_by", lambda _, o: self.ordering(o))
        limit = scan.get("limit")
        if limit is not None and not (is_number(limit, whole=True) and limit >= 0):
            yield "limit must be a nonnegative integer"

    @staticmethod
    def listed(scan: dict, key: str, each) -> Iterator[str]:
        items = scan.get(key) or []
        if isinstance(items, list):
            for i, item in enumerate(items):
                yield from each(i, item)
        else:
            yield f"{key} must be a list"

    def ordering(self, entry) -> Iterator[str]:
        if not isinstance(entry, dict):
            yield f"order entry must be an object, got {entry!r}"
            return
        name, way = entry.get("property"), entry.get("dir", "asc")
        if not isinstance(name, str) or name not in self.catalog:
            yield f"unknown property: {name!r}"
        if way not in ("asc", "desc"):
            yield f"unknown direction: {way!r}"

    def node(self, node, at: str) -> Iterator[str]:
        if not isinstance(node, dict):
            yield f"{at}: node must be an object, got {node!r}"
            return
        group = next((k for k in ("all", "any", "not") if k in node), None)
        if group is None:
            yield from self.leaf(node, at)
        elif group == "not":
            if isinstance(node["not"], dict):
                yield from self.node(node["not"], f"{at}.not")
            else:
                yield f"{at}.not must be an object"
        elif isinstance(node[group], list) and node[group]:
            for i, child in enumerate(node[group]):
                yield from self.node(child, f"{at}.{group}[{i}]")
        else:
            yield f"{at}.{group} must be a nonempty list"

    def leaf(self, leaf: dict, at: str) -> Iterator[str]:
        prop, op, value = leaf.get("property"), leaf.get("op"), leaf.get("value")
        column = self.catalog.get(prop) if isinstance(prop, str) else None
        if isinstance(prop, dict):
            yield from self.operand(prop, f"{at}.property")
        elif column is None:
            yield f"{at}: unknown property: {prop!r}"
        if op in CROSSES:
            yield from self.operand(value, f"{at}.value")
        elif op in LISTED:
            if isinstance(prop, dict):
                yield f"{at}: computed left side not supported for {op!r}"
            if column is not None:
                yield from (f"{at}: {m}" for m in self.list_value(op, value, column["dtype"]))
        elif op not in COMPARISONS:
            yield f"{at}: unknown operator: {op!r}"
        elif isinstance(value, dict):
            yield from self.operand(value, f"{at}.value")
        elif value is None:
            yield f"{at}: value must not be null"
        elif column is not None and not FITS[column["dtype"]](value):
            wanted = "an ISO date string" if column["dtype"] == "date" else column["dtype"]
            yield f"{at}: value for {prop!r} ({column['dtype']}) must be {wanted}, got {value!r}"

    @staticmethod
    def list_value(op: str, value, kind: str) -> Iterator[str]:
        fits = FITS[kind]
        if op == "contains":
            if kind != "str" or not isinstance(value, str):
                yield "'contains' needs a string value on a string property"
        elif op == "between":
            if not isinstance(value, (list, tuple)) or len(value) != 2:
                yield "'between' needs [lo, hi]"
            elif not all(map(fits, value)):
                yield f"'between' bounds must be {kind} values"
        elif not isinstance(value, list) or not value:
            yield "'in' needs a nonempty list of values"
        elif not all(map(fits, value)):
            yield f"'in' values must be {kind} values"

    def operand(self, spec, at: str) -> Iterator[str]:
        if spec is None:
            yield f"{at}: operand must not be null"
        elif isinstance(spec, dict):
            arithmetic = [k for k in spec if k in ARITHMETIC]
            if "col" in spec:
                if not isinstance(spec["col"], str) or spec["col"] not in self.catalog:
                    yield f"{at}.col: unknown column: {spec['col']!r}"
            elif "fn" in spec:
                yield from self.call(spec["fn"], spec.get("args"), at)
            elif len(arithmetic) == 1:
                yield from self.fold(arithmetic[0], spec[arithmetic[0]], at)
            else:
                yield f"{at}: operand must be col, fn, or arithmetic, got keys {sorted(spec)}"
        elif not isinstance(spec, (bool, int, float, str)):
            yield f"{at}: operand must be scalar, col, fn, or arithmetic, got {spec!r}"

    def fold(self, op: str, items, at: str) -> Iterator[str]:
        if not isinstance(items, list) or not items:
            yield f"{at}.{op} must be a nonempty list"
        elif len(items) == 1 and op != "-":
            yield f"{at}.{op} must have >= 2 operands"
        else:
            for i, item in enumerate(items):
                yield from self.operand(item, f"{at}.{op}[{i}]")

    def call(self, name, args, at: str) -> Iterator[str]:
        entry = INDICATORS.get(name) if isinstance(name, str) else None
        if entry is None:
            yield f"{at}.fn: unknown indicator: {name!r}"
            return
        if not available(name, self.engine):
            yield f"{at}: indicator {name!r} " + ("is not available on the duckdb engine" if self.engine == "duckdb" else "requires engine='duckdb'")
        slots, _, required = entry
        if not isinstance(args, list) or len(args) != len(slots):
            yield f"{at}: {name!r} takes {len(slots)} args, got {len(args) if isinstance(args, list) else args}"
            return
        for i, (slot, arg) in enumerate(zip(slots, args, strict=True)):
            if slot != "int":
                yield from self.operand(arg, f"{at}.args[{i}]")
            elif not is_number(arg, whole=True) or arg < 1:
                yield f"{at}.args[{i}]: must be an int >= 1, got {arg!r}"
        for column in required:
            if column not in self.catalog:
                yield f"{at}: indicator {name!r} requires column {column!r}"


def validate(scan_def, *, catalog: dict = PROPERTY_CATALOG, engine: str = "spark") -> list[str]:
    """All faults of a definition; an empty list means it is valid. Engine "spark" takes every indicator; "polars" and "duckdb" are portability profiles that take the names those take."""
    if engine not in ENGINES:
        raise ValueError(f"unknown engine: {engine!r}")
    return list(Analyzer(catalog, engine).definition(scan_def))
