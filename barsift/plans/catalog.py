"""What a screen may refer to: column name -> {"label", "dtype"}."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns of score_bars, their labels and kinds.
PROPERTY_CATALOG: dict[str, dict[str, str]] = {
    "symbol": {"label": "Symbol", "dtype": "str"},
    "session": {"label": "Session", "dtype": "date"},
    "close": {"label": "Close", "dtype": "float"},
    "score": {"label": "Score", "dtype": "int"},
    "phase": {"label": "Phase", "dtype": "str"},
    "vol_ratio": {"label": "Vol Ratio", "dtype": "float"},
    "atr_ratio": {"label": "ATR Ratio", "dtype": "float"},
    "rsi": {"label": "RSI", "dtype": "float"},
    "acc_score": {"label": "Accumulation", "dtype": "float"},
    "spring": {"label": "Spring", "dtype": "bool"},
    "ema_stack": {"label": "EMA Stack", "dtype": "bool"},
    "recent_cross": {"label": "Recent Cross", "dtype": "bool"},
    "upper_wick_pct": {"label": "Upper Wick %", "dtype": "float"},
    "near_52w_low": {"label": "Near 52w Low", "dtype": "bool"},
    "bars": {"label": "Bars", "dtype": "int"},
}

KINDS: list[tuple[type, str]] = [
    (T.BooleanType, "bool"),
    (T.IntegralType, "int"),
    (T.DoubleType, "float"),
    (T.FloatType, "float"),
    (T.StringType, "str"),
    (T.CharType, "str"),
    (T.VarcharType, "str"),
    (T.DateType, "date"),
    (T.TimestampType, "date"),
    (T.TimestampNTZType, "date"),
]


def catalog_from_schema(frame: DataFrame | T.StructType) -> dict[str, dict[str, str]]:
    """Catalog of a frame's columns; columns of other kinds (nested, decimal, binary, intervals) are left out."""
    schema = frame if isinstance(frame, T.StructType) else frame.schema
    out = {}
    for field in schema.fields:
        kind = next((name for cls, name in KINDS if isinstance(field.dataType, cls)), None)
        if kind:
            out[field.name] = {"label": field.name, "dtype": kind}
    return out
