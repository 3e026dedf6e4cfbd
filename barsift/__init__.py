"""A Spark-native market screener: text or dictionary screens compiled to DataFrame plans."""

from barsift.functions import candles, indicators  # noqa: F401  (they fill the registry)
from barsift.functions.registry import INDICATORS
from barsift.operators.scan import Scan, apply, apply_relation, apply_sql, last_bars, materialize
from barsift.operators.scoring import score_bars
from barsift.operators.stats import HORIZONS, backtest, backtest_summary, forward_returns, forward_stats
from barsift.plans.catalog import PROPERTY_CATALOG, catalog_from_schema
from barsift.plans.language import parse
from barsift.plans.planner import CompiledScan, compile
from barsift.plans.validation import validate

__all__ = [
    "HORIZONS",
    "INDICATORS",
    "PROPERTY_CATALOG",
    "CompiledScan",
    "Scan",
    "apply",
    "apply_relation",
    "apply_sql",
    "backtest",
    "backtest_summary",
    "catalog_from_schema",
    "compile",
    "forward_returns",
    "forward_stats",
    "last_bars",
    "materialize",
    "parse",
    "score_bars",
    "validate",
]
