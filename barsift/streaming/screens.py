"""Screens over streams: what needs no past runs on the stream itself, and the rest on micro-batches with a bounded lookback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsift.operators.scan import apply
from barsift.plans.catalog import PROPERTY_CATALOG
from barsift.plans.planner import compile


def apply_stream(stream: DataFrame, scan_def: dict, *, catalog: dict = PROPERTY_CATALOG) -> DataFrame:
    """Rows of a stream that the screen keeps. Indicators and crossings look back over rows, which a stream has none of; sorting and limits have no end to wait for."""
    plan = compile(scan_def, catalog=catalog)
    if plan.ctx.stages or plan.order_by or plan.limit is not None:
        raise ValueError("a stream takes screens without windows, sorting or limits; use screen_batches")
    return stream.filter(plan.predicate)


def screen_batches(history: Callable[[], DataFrame], scan_def: dict, write: Callable[[DataFrame, int], None], *, catalog: dict = PROPERTY_CATALOG, partition: str = "symbol", order_column: str = "session"):
    """A foreachBatch function: each batch's bars are laid over those of ``history`` (recent bars of the symbols, by whatever bound the caller keeps), screened, and only hits among the batch's bars written."""

    def run(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("__new", F.lit(True))
        past = history().select(*batch.columns).withColumn("__new", F.lit(False))
        keys = batch.select(partition).distinct()
        both = past.join(keys, partition, "left_semi").unionByName(new)
        write(apply(both, scan_def, catalog=catalog, partition=partition, order_column=order_column).where("__new").drop("__new"), number)

    return run
