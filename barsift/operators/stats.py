"""Forward returns of past runs, as DataFrame operations and as plain functions."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Label and bars ahead.
HORIZONS = (("5d", 5), ("10d", 10), ("20d", 20))


def forward_stats(sessions: list[dt.date], closes: list[float], ran_on: dt.date) -> dict[str, float] | None:
    """Returns, in percent, from the first session on or after ``ran_on``; None before the longest horizon has passed."""
    at = bisect_left(sessions, ran_on)
    if at + max(n for _, n in HORIZONS) >= len(closes):
        return None
    return {label: 100 * (closes[at + n] / closes[at] - 1) for label, n in HORIZONS}


def backtest_summary(runs: list[dict], stats_fn: Callable) -> dict:
    """Hit rate and mean return by horizon over all symbols of all runs. ``total`` is the number of runs, ``included`` that of picks with a result."""
    found = [s for run in runs for symbol in run["symbols"] if (s := stats_fn(symbol, dt.date.fromisoformat((run["ran_at"] or " ")[:10]))) is not None]
    rows = []
    for label, _ in HORIZONS:
        got = [s[label] for s in found if label in s]
        n = len(got)
        rows.append((label, 100 * sum(r > 0 for r in got) / n if n else 0.0, sum(got) / n if n else 0.0, n))
    return {"included": len(found), "total": len(runs), "horizons": rows}


def forward_returns(bars: DataFrame, runs: DataFrame, *, partition: str = "symbol", order_column: str = "session") -> DataFrame:
    """One row a pick with a result: run columns, entry session, and a return for each horizon.

    ``runs``: symbol, ran_on. The entry is the first bar on or after ``ran_on``:
    picks are laid among the bars, and each takes the next bar's values, so no
    pick meets more than one row.
    """
    w = Window.partitionBy(partition).orderBy(order_column)
    ahead = bars.select(partition, F.col(order_column).alias("at"), "close", *[F.lead("close", n).over(w).alias(label) for label, n in HORIZONS])
    entry = F.struct(F.col("at").alias("entry_session"), "close", *[label for label, _ in HORIZONS])
    marks = ahead.select(partition, "at", F.lit(1).alias("is_bar"), entry.alias("e"), F.lit(None).cast(runs.schema["ran_on"].dataType).alias("ran_on"))
    asked = runs.select(partition, F.col("ran_on").cast(bars.schema[order_column].dataType).alias("at"), F.lit(0).alias("is_bar"), F.lit(None).cast(marks.schema["e"].dataType).alias("e"), "ran_on")
    # backwards in time, so that the next bar is the last one met: a running value, linear in the bars
    met_so_far = Window.partitionBy(partition).orderBy(F.desc("at"), F.desc("is_bar")).rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(asked).withColumn("e", F.last("e", ignorenulls=True).over(met_so_far)).where("is_bar = 0")
    longest = HORIZONS[-1][0]
    returns = [((F.col(f"e.{label}") / F.col("e.close") - 1) * 100).alias(label) for label, _ in HORIZONS]
    return met.where(F.col(f"e.`{longest}`").isNotNull()).select(partition, "ran_on", F.col("e.entry_session").alias("entry_session"), *[r for r in returns])


def backtest(bars: DataFrame, runs: DataFrame, *, partition: str = "symbol", order_column: str = "session") -> DataFrame:
    """Horizon, hit rate, mean return and number of picks, over all picks."""
    r = forward_returns(bars, runs, partition=partition, order_column=order_column)
    pairs = F.array(*[F.struct(F.lit(label).alias("horizon"), F.col(f"`{label}`").alias("ret")) for label, _ in HORIZONS])
    return r.select(F.explode(pairs).alias("x")).groupBy("x.horizon").agg((F.avg((F.col("x.ret") > 0).cast("double")) * 100).alias("hit_rate"), F.avg("x.ret").alias("mean_return"), F.count("*").alias("n"))
