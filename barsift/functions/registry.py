"""The indicator registry: name -> (argument slots, builder, required columns).

A builder gets the planner's context and the call's arguments (``Value`` for an
"expr" slot, int for an "int" slot) and returns a ``Value``. Inserting an entry
makes the name usable at once from text and from dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable

INDICATORS: dict[str, tuple[tuple[str, ...], Callable, tuple[str, ...]]] = {}

#: Engine profiles: "spark" takes all names, the others the names those engines take.
ENGINES = ("spark", "polars", "duckdb")
SQL_ONLY = {"ht_trendline", "stoch_k", "stoch_d"}
NOT_IN_SQL = {"stochrsi", "apo", "ppo", "mfi", "adosc", "t3", "accbands_upper", "accbands_lower", "ultosc", "obv", "sar"}
#: Names whose output column stays in the result of ``apply`` as ``__<name>_<j>``.
STAGED: set[str] = set()


def indicator(name: str, *slots: str, needs: str = "", staged: bool = False):
    """Register a builder under ``name``."""

    def put(builder):
        INDICATORS[name] = (slots, builder, tuple(needs.split()))
        if staged:
            STAGED.add(name)
        return builder

    return put


def available(name: str, engine: str) -> bool:
    if engine == "duckdb":
        return name not in NOT_IN_SQL
    return engine == "spark" or name not in SQL_ONLY


def sql_indicators() -> dict[str, tuple[tuple[str, ...], Callable, tuple[str, ...]]]:
    """The entries that screens with the conventions of SQL engines may use."""
    return {name: entry for name, entry in INDICATORS.items() if available(name, "duckdb")}
