"""Running screens: on frames, on named relations, and bound to a frame."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsift.functions.registry import INDICATORS, STAGED
from barsift.plans.catalog import PROPERTY_CATALOG, catalog_from_schema
from barsift.plans.language import parse
from barsift.plans.planner import Context, Planner, column, compile, run_stages

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def apply(frame: DataFrame, scan_def: dict, *, catalog: dict = PROPERTY_CATALOG, partition="symbol", order_column: str = "session", engine: str = "spark", seed: str | None = None) -> DataFrame:
    """Rows of ``frame`` that the screen keeps, sorted and limited as it says, with one column for each call of a staged indicator."""
    return compile(scan_def, catalog=catalog, partition=partition, order_column=order_column, engine=engine, seed=seed).apply(frame)


def apply_relation(spark: SparkSession, scan_def: dict, *, relation: str, catalog: dict = PROPERTY_CATALOG, partition="symbol", order_column: str = "session", engine: str = "spark", seed: str | None = None) -> DataFrame:
    """``apply`` on a table or view of the session, by its plain name."""
    plan = compile(scan_def, catalog=catalog, partition=partition, order_column=order_column, engine=engine, seed=seed)
    if not isinstance(relation, str) or not IDENTIFIER.fullmatch(relation):
        raise ValueError(f"relation must be a plain identifier matching [A-Za-z_][A-Za-z0-9_]*, got {relation!r}")
    return plan.apply(spark.table(relation))


def apply_sql(spark: SparkSession, scan_def: dict, *, relation: str = "bars", **options) -> DataFrame:
    """``apply_relation`` with the conventions of SQL engines: exponential means begin with the mean of their first n values, and only names that those engines have are taken."""
    return apply_relation(spark, scan_def, relation=relation, **({"engine": "duckdb"} | options))


def calls(node) -> list[dict]:
    """Indicator calls of a definition, outermost first; those inside arithmetic are the predicate's own."""
    if not isinstance(node, dict):
        return []
    if "fn" in node:
        return [node, *(c for a in node["args"] for c in calls(a))]
    children = node.get("filters") or node.get("all") or node.get("any") or [node.get("not"), node.get("property"), node.get("value")]
    return [c for child in children for c in calls(child)]


def materialize(frame: DataFrame, scan_def: dict | str, *, catalog: dict | None = None, partition="symbol", order_column: str = "session", seed: str = "first") -> DataFrame:
    """``frame`` with a column ``<name>_<n>`` for each indicator call of the screen, n being its first int; the first of equal names counts."""
    catalog = catalog_from_schema(frame) if catalog is None else catalog
    scan = parse(scan_def, catalog=catalog) if isinstance(scan_def, str) else scan_def
    ctx = Context(partition, order_column, seed)
    planner = Planner(ctx, catalog)
    named: dict = {}
    for call in calls(scan):
        ints = [a for slot, a in zip(INDICATORS[call["fn"]][0], call["args"], strict=True) if slot == "int"]
        name = f"{call['fn']}_{ints[0] if ints else ''}"
        if name in named:
            continue
        if call["fn"] in STAGED:
            raise ValueError(f"indicator {call['fn']!r} (talib seam) cannot be materialized; use apply()")
        named[name] = planner.operand(call)
    staged = run_stages(frame, ctx)
    return staged.select(*map(column, frame.columns), *[v.col.alias(name) for name, v in named.items()])


def last_bars(frame: DataFrame, n: int, *, partition="symbol", order_column: str = "session") -> DataFrame:
    """Each partition's last ``n`` rows; each input split keeps no more than n of a partition before the shuffle."""
    w = Window.partitionBy(*([partition] if isinstance(partition, str) else partition)).orderBy(F.col(order_column).desc())
    place = f"__place_{uuid.uuid4().hex}"
    return frame.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n).drop(place)


class Scan:
    """A frame with its catalog: screens are parsed and run without repeating either."""

    def __init__(self, frame: DataFrame, *, partition="symbol", catalog: dict | None = None, order_column: str = "session"):
        self.data, self.partition, self.order_column = frame, partition, order_column
        self.catalog = catalog_from_schema(frame) if catalog is None else catalog
        self.result: DataFrame | None = None
        self._last: dict | None = None

    def apply(self, scan_def: dict | str, **options) -> DataFrame:
        self._last = parse(scan_def, catalog=self.catalog) if isinstance(scan_def, str) else scan_def
        self.result = apply(self.data, self._last, catalog=self.catalog, partition=self.partition, order_column=self.order_column, **options)
        return self.result

    @property
    def materialized(self) -> DataFrame:
        if self._last is None:
            raise ValueError("apply() a screen before reading .materialized")
        return materialize(self.data, self._last, catalog=self.catalog, partition=self.partition, order_column=self.order_column)
