"""Registered queries of the screening engine, each with its SQL where SQL can say it.

Both sides round alike: to four places after adding a little, so that values
with few decimals never sit on a tie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsift.functions.registry import INDICATORS
from barsift.operators.scan import Scan, apply, apply_relation, materialize
from barsift.operators.scoring import score_bars
from barsift.operators.stats import backtest, forward_returns
from barsift.plans.catalog import catalog_from_schema
from barsift.plans.language import parse
from barsift.plans.planner import Context, Planner, run_stages
from barsift.sources.bars import bars_event, bars_nation, bars_priority

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BARS = """bars AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS session, arg_min(o_totalprice, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY ALL)"""
NATION = """bars AS (
  SELECT n_name AS symbol, CAST(o_orderdate AS DATE) AS session, arg_min(o_totalprice, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
EVENT = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS session, arg_min(value, (ts, event_id)) AS open,
         max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY ALL)"""
W = "PARTITION BY symbol ORDER BY session"


def r4(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * 10000 + 0.13) / 10000


def sql_r4(x: str) -> str:
    return f"round(({x}) * 10000 + 0.13) / 10000"


def over(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {agg}({x}) {over(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def ewm(x: str, alpha: str) -> str:
    seen = f"list_filter(list({x}) OVER ({W} ROWS UNBOUNDED PRECEDING), lambda v: v IS NOT NULL)"
    return f"CASE WHEN ({x}) IS NOT NULL THEN list_reduce({seen}, lambda a, b: (1 - {alpha}) * a + {alpha} * b) END"


def chain(*stages: dict[str, str], final: str, base: str = BARS) -> str:
    """SELECT symbol, session, final over stages of computed columns."""
    ctes, source = [base], "bars"
    for i, stage in enumerate(stages):
        ctes.append(f"s{i} AS (SELECT *, {', '.join(f'{x} AS {name}' for name, x in stage.items())} FROM {source})")
        source = f"s{i}"
    return f"WITH {', '.join(ctes)} {final.replace('@', source)}"


def values(*stages: dict[str, str], value: str) -> str:
    return chain(*stages, final=f"SELECT symbol, session, {sql_r4(value)} AS value FROM @")


# -- every indicator on the priority bars

CLOSE = {"col": "close"}
ARGS = {("expr", "int"): [CLOSE, 10], ("int",): [10], (): [], ("int", "int", "int"): [5, 3, 3]}
TR = {"pc": lag("close")}
RANGE = {"tr": "greatest(high - low, abs(high - pc), abs(pc - low))"}
TYPICAL = {"tp": "(high + low + close) / 3"}
INDEX = {"i": f"CAST(row_number() OVER ({W}) - 1 AS DOUBLE)"}
EMA10 = {"e1": ewm("close", "(2.0 / 11)")}
EMA10_2 = {"e2": ewm("e1", "(2.0 / 11)")}
Z = "CASE WHEN sd IS NULL THEN NULL WHEN sd < 1e-6 THEN 100 ELSE least(120, greatest(80, 100 + 5 * (x - mean) / sd)) END"
Z_PARTS = {"sd": full("stddev_pop", "x", 10), "mean": full("avg", "x", 10)}
FLOW = {"flow": "CASE WHEN high <> low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END"}
INDICATOR_SQL: dict[str, str] = {
    "sma": values({"v": full("avg", "close", 10)}, value="v"),
    "rmin": values({"v": full("min", "close", 10)}, value="v"),
    "rmax": values({"v": full("max", "close", 10)}, value="v"),
    "shift": values({"v": lag("close", 10)}, value="v"),
    "mom": values({"v": lag("close", 10)}, value="close - v"),
    "roc": values({"v": lag("close", 10)}, value="(close / v - 1) * 100"),
    "ema": values(EMA10, value="e1"),
    "dema": values(EMA10, EMA10_2, value="2 * e1 - e2"),
    "tema": values(EMA10, EMA10_2, {"e3": ewm("e2", "(2.0 / 11)")}, value="3 * e1 - 3 * e2 + e3"),
    "wma": values(INDEX, {"sy": full("sum", "close", 10), "sry": full("sum", "i * close", 10)}, value="(sry - (i - 10) * sy) / 55"),
    "trima": values({"a": full("avg", "close", 5)}, {"v": full("avg", "a", 6)}, value="v"),
    "slope": values(INDEX, {"v": f"CASE WHEN count(close) {over(10)} = 10 THEN regr_slope(close, i) {over(10)} END"}, value="v"),
    "atr": values(TR, RANGE, {"v": ewm("tr", "0.1")}, value="v"),
    "natr": values(TR, RANGE, {"v": ewm("tr", "0.1")}, value="v / close * 100"),
    "adr": values(TR, RANGE, {"v": full("avg", "tr / close * 100", 10)}, value="v"),
    "trange": values(TR, RANGE, value="CASE WHEN pc IS NOT NULL THEN tr END"),
    "rsi": values({"d": f"close - {lag('close')}"}, {"g": ewm("CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "0.1"), "l": ewm("CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", "0.1")}, value="CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END"),
    "rs_ratio": values({"x": ewm("close", "(2.0 / 6)")}, Z_PARTS, value=Z),
    "rs_momentum": values({"d": f"close - {lag('close', 4)}"}, {"x": ewm("d", "0.5")}, Z_PARTS, value=Z),
    "midprice": values({"a": full("max", "high", 10), "b": full("min", "low", 10)}, value="(a + b) / 2"),
    "midpoint": values({"a": full("max", "close", 10), "b": full("min", "close", 10)}, value="(a + b) / 2"),
    "cci": values(TYPICAL, {"m": full("avg", "tp", 10), "seen": f"CASE WHEN count(tp) {over(10)} = 10 THEN list(tp) {over(10)} END"}, {"mad": "list_sum(list_transform(seen, lambda x: abs(x - m))) / 10"}, value="CASE WHEN mad = 0 THEN 0 ELSE (tp - m) / (0.015 * mad) END"),
    "willr": values({"a": full("max", "high", 10), "b": full("min", "low", 10)}, value="-100 * (a - close) / (a - b)"),
    "ad": values(FLOW, {"v": f"sum(flow) OVER ({W} ROWS UNBOUNDED PRECEDING)"}, value="v"),
    "bbands_upper": values({"m": full("avg", "close", 10), "s": full("stddev_pop", "close", 10)}, value="m + 2 * s"),
    "bbands_lower": values({"m": full("avg", "close", 10), "s": full("stddev_pop", "close", 10)}, value="m - 2 * s"),
    "aroon": values(INDEX, {"a": f"CASE WHEN count(high) {over(11)} = 11 THEN arg_max(i, (high, i)) {over(11)} END"}, value="100 * (10 - (i - a)) / 10"),
    "apo": values({"a": full("avg", "close", 10), "b": full("avg", "close", 26)}, value="a - b"),
    "ppo": values({"a": full("avg", "close", 10), "b": full("avg", "close", 26)}, value="(a - b) * 100 / b"),
    "mfi": values(TYPICAL, {"pt": lag("tp")}, {"g": full("sum", "CASE WHEN pt IS NOT NULL THEN CASE WHEN tp > pt THEN tp * volume ELSE 0 END END", 10), "l": full("sum", "CASE WHEN pt IS NOT NULL THEN CASE WHEN tp < pt THEN tp * volume ELSE 0 END END", 10)}, value="CASE WHEN g + l < 1 THEN 0 ELSE 100 * g / (g + l) END"),
    "adosc": values(FLOW, {**INDEX, "x": f"sum(flow) OVER ({W} ROWS UNBOUNDED PRECEDING)"}, {"a": ewm("x", "(2.0 / 11)")}, value="CASE WHEN i >= 9 THEN a - a END"),
    "accbands_upper": values({"v": full("avg", "high * (1 + 4 * (high - low) / (high + low))", 10)}, value="v"),
    "accbands_lower": values({"v": full("avg", "low * (1 - 4 * (high - low) / (high + low))", 10)}, value="v"),
    "ultosc": values(TR, {"bp": "CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END", "re": "CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END"}, {f"{k}{n}": full("sum", k, n) for n in (7, 14, 28) for k in ("bp", "re")}, value="100 * (4 * bp7 / re7 + 2 * bp14 / re14 + bp28 / re28) / 7"),
    "obv": values(TR, {"v": f"sum(CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING)"}, value="v"),
    "stoch_k": values({"a": full("max", "high", 5), "b": full("min", "low", 5)}, {"raw": "CASE WHEN a - b = 0 THEN 0 ELSE 100 * (close - b) / (a - b) END"}, {"k": full("avg", "raw", 3)}, {"d": full("avg", "k", 3)}, value="CASE WHEN d IS NOT NULL THEN k END"),
    "stoch_d": values({"a": full("max", "high", 5), "b": full("min", "low", 5)}, {"raw": "CASE WHEN a - b = 0 THEN 0 ELSE 100 * (close - b) / (a - b) END"}, {"k": full("avg", "raw", 3)}, {"d": full("avg", "k", 3)}, value="d"),
}
BAR3 = {f"{k[0]}{n}": lag(k, n) for k in ("open", "high", "low", "close") for n in (1, 2, 3)}
MEANS = {"body10": f"CASE WHEN count(*) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) = 10 THEN avg(abs(close - open)) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END", "range10": f"CASE WHEN count(*) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) = 10 THEN avg(high - low) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END"}
INDICATOR_SQL |= {
    "cdlengulfing": values(BAR3, value="CASE WHEN o2 IS NULL THEN 0 WHEN close >= open AND c1 < o1 AND ((close >= o1 AND open < c1) OR (close > o1 AND open <= c1)) THEN CASE WHEN open <> c1 AND close <> o1 THEN 100 ELSE 80 END WHEN close < open AND c1 >= o1 AND ((open >= c1 AND close < o1) OR (open > c1 AND close <= o1)) THEN CASE WHEN open <> c1 AND close <> o1 THEN -100 ELSE -80 END ELSE 0 END"),
    "cdl3outside": values(BAR3, value="CASE WHEN o3 IS NULL THEN 0 WHEN c1 >= o1 AND c2 < o2 AND c1 > o2 AND o1 < c2 AND close > c1 THEN 100 WHEN c1 < o1 AND c2 >= o2 AND o1 > c2 AND c1 < o2 AND close < c1 THEN -100 ELSE 0 END"),
    "cdlxsidegap3methods": values(BAR3, {"inside": "open > least(o1, c1) AND open < greatest(o1, c1) AND close > least(o2, c2) AND close < greatest(o2, c2)"}, value="CASE WHEN inside AND c2 >= o2 AND c1 >= o1 AND close < open AND least(o1, c1) > greatest(o2, c2) THEN 100 WHEN inside AND c2 < o2 AND c1 < o1 AND close >= open AND greatest(o1, c1) < least(o2, c2) THEN -100 ELSE 0 END"),
    "cdlgravestonedoji": values(MEANS, value="CASE WHEN abs(close - open) <= 0.1 * range10 AND least(open, close) - low < 0.1 * range10 AND high - greatest(open, close) > 0.1 * range10 THEN 100 ELSE 0 END"),
    "cdl2crows": values({**BAR3, **MEANS}, {"long2": lag("body10", 2)}, value="CASE WHEN c2 >= o2 AND c2 - o2 > long2 AND c1 < o1 AND c1 > c2 AND close < open AND open < o1 AND open > c1 AND close > o2 AND close < c2 THEN -100 ELSE 0 END"),
    "cdlupsidegap2crows": values({**BAR3, **MEANS}, {"long2": lag("body10", 2), "short1": lag("body10", 1)}, value="CASE WHEN c2 >= o2 AND c2 - o2 > long2 AND c1 < o1 AND o1 - c1 <= short1 AND c1 > c2 AND close < open AND open > o1 AND close < c1 AND close > c2 THEN -100 ELSE 0 END"),
    "cdlhomingpigeon": values({**BAR3, **MEANS}, {"long1": lag("body10", 1)}, value="CASE WHEN c1 < o1 AND close < open AND o1 - c1 > long1 AND open - close <= body10 AND open < o1 AND close > c1 THEN 100 ELSE 0 END"),
    "cdlunique3river": values({**BAR3, **MEANS}, {"long2": lag("body10", 2)}, value="CASE WHEN c2 < o2 AND o2 - c2 > long2 AND c1 < o1 AND c1 > c2 AND o1 <= o2 AND l1 < l2 AND close >= open AND close - open < body10 AND open > l1 THEN 100 ELSE 0 END"),
}
INDICATOR_SQL["adosc"] = values(FLOW, {**INDEX, "x": f"sum(flow) OVER ({W} ROWS UNBOUNDED PRECEDING)"}, {"a": ewm("x", "0.5"), "b": ewm("x", "(2.0 / 11)")}, value="CASE WHEN i >= 9 THEN a - b END")


# -- path-dependent indicators with seeds: fold over a partition's values so far


def seen(x: str, skip: int = 0) -> str:
    got = f"list_filter(list({x}) OVER ({W} ROWS UNBOUNDED PRECEDING), lambda v: v IS NOT NULL)"
    return f"({got})[{skip + 1}:]" if skip else got


def seeded(s: str, n: int, alpha: str) -> str:
    """Mean of the first n values of list column s, then an exponential mean."""
    return f"CASE WHEN len({s}) >= {n} THEN list_reduce(list_concat([list_avg({s}[1:{n}])], {s}[{n + 1}:]), lambda a, b: a + {alpha} * (b - a)) END"


def chained(x: str, n: int, times: int, alpha: str) -> list[dict[str, str]]:
    """Stages e1, e2, ...: seeded means of seeded means."""
    out = []
    for k in range(1, times + 1):
        before = x if k == 1 else f"e{k - 1}"
        out += [{f"s{k}_": seen(before)}, {f"e{k}": f"CASE WHEN {before} IS NOT NULL THEN {seeded(f's{k}_', n, alpha)} END"}]
    return out


MOVES = [
    {"d": f"close - {lag('close')}"},
    {"up": "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "down": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END"},
    {"us": seen("up"), "ds": seen("down")},
    {"g": f"CASE WHEN d IS NOT NULL THEN {seeded('us', 10, '0.1')} END", "l": f"CASE WHEN d IS NOT NULL THEN {seeded('ds', 10, '0.1')} END"},
]


def wilder_sum(s: str) -> str:
    return f"CASE WHEN len({s}) >= 10 THEN list_reduce(list_concat([list_sum({s}[1:9])], {s}[10:]), lambda a, b: a - a / 10 + b) END"


ADX = [
    {"ph": lag("high"), "pl": lag("low"), "pc": lag("close")},
    {"u": "high - ph", "v": "pl - low", "r": "CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END"},
    {"pd": "CASE WHEN u IS NOT NULL THEN CASE WHEN u > v AND u > 0 THEN u ELSE 0 END END", "md": "CASE WHEN u IS NOT NULL THEN CASE WHEN v > u AND v > 0 THEN v ELSE 0 END END"},
    {"ps": seen("pd"), "ms": seen("md"), "rs": seen("r")},
    {"pw": wilder_sum("ps"), "mw": wilder_sum("ms"), "rw": wilder_sum("rs")},
    {"a": "CASE WHEN rw > 0 THEN 100 * pw / rw WHEN rw IS NOT NULL THEN 0 END", "b": "CASE WHEN rw > 0 THEN 100 * mw / rw WHEN rw IS NOT NULL THEN 0 END"},
    {"dx": "CASE WHEN a + b > 0 THEN 100 * abs(a - b) / (a + b) END"},
    {"xs": seen("dx")},
    {"x": f"CASE WHEN dx IS NOT NULL THEN {seeded('xs', 10, '0.1')} END"},
]
T3 = {"c1": -(0.7**3), "c2": 3 * 0.7**2 + 3 * 0.7**3, "c3": -6 * 0.7**2 - 3 * 0.7 - 3 * 0.7**3, "c4": 1 + 3 * 0.7 + 0.7**3 + 3 * 0.7**2}
INDICATOR_SQL |= {
    "cmo": values(*MOVES, value="CASE WHEN g + l = 0 THEN 0 ELSE 100 * (g - l) / (g + l) END"),
    "stochrsi": values(*MOVES, {"r": "CASE WHEN g + l = 0 THEN 0 ELSE 100 * g / (g + l) END"}, {"hi": full("max", "r", 14), "lo": full("min", "r", 14)}, {"k": "CASE WHEN hi > lo THEN 100 * (r - lo) / (hi - lo) WHEN hi = lo THEN 0 END"}, {"ok": lag("k", 2)}, value="CASE WHEN ok IS NOT NULL THEN k END"),
    "trix": values(*chained("close", 10, 3, "(2.0 / 11)"), {"p": lag("e3")}, value="100 * (e3 / p - 1)"),
    "t3": values(*chained("close", 10, 6, "(2.0 / 11)"), value=f"{T3['c1']} * e6 + {T3['c2']} * e5 + {T3['c3']} * e4 + {T3['c4']} * e3"),
    "macd": values({"s": seen("close"), "f": seen("close", 16)}, {"m": f"{seeded('f', 10, '(2.0 / 11)')} - {seeded('s', 26, '(2.0 / 27)')}", "i": f"row_number() OVER ({W}) - 1"}, value="CASE WHEN i >= 33 THEN m END"),
    "adx": values(*ADX, value="x"),
    "adxr": values(*ADX, {"x9": lag("x", 9)}, value="(x + x9) / 2"),
    "kama": values(
        {"d": f"abs(close - {lag('close')})", "c10": lag("close", 10), "i": f"row_number() OVER ({W}) - 1"},
        {"noise": full("sum", "d", 10)},
        {"er": "CASE WHEN noise <= abs(close - c10) OR noise <= 0 THEN 1 ELSE abs(close - c10) / noise END"},
        {"step": "CASE WHEN i = 9 THEN [0.0, close] WHEN i > 9 THEN [(er * (2.0 / 3 - 2.0 / 31) + 2.0 / 31) ** 2, close] END"},
        {"steps": seen("step")},
        value="CASE WHEN i >= 10 THEN list_reduce(steps, lambda a, b: [0.0, a[2] + b[1] * (b[2] - a[2])])[2] END",
    ),
}

# -- the remaining candlesticks, in SQL terms: bars a (oldest) to e


class SqlBar:
    """The bar k bars ago, as SQL text."""

    def __init__(self, k: int):
        self.k = k
        self.o, self.h, self.l, self.c = (f"{x}{k}" for x in "ohlc")
        self.top, self.bottom = f"greatest(o{k}, c{k})", f"least(o{k}, c{k})"
        self.body, self.white, self.black = f"abs(c{k} - o{k})", f"c{k} >= o{k}", f"c{k} < o{k}"
        self.upper, self.lower = f"(h{k} - {self.top})", f"({self.bottom} - l{k})"
        self.sign = f"(CASE WHEN c{k} >= o{k} THEN 1 ELSE -1 END)"
        self.mean, self.very_short, self.near, self.far, self.equal = f"b10_{k}", f"(0.1 * r10_{k})", f"(0.2 * r5_{k})", f"(0.6 * r5_{k})", f"(0.05 * r5_{k})"
        self.long, self.short = f"{self.body} > {self.mean}", f"{self.body} < {self.mean}"
        self.no_top, self.no_foot = f"{self.upper} < {self.very_short}", f"{self.lower} < {self.very_short}"
        self.marubozu = f"{self.long} AND {self.no_top} AND {self.no_foot}"

    def over(self, x: SqlBar) -> str:
        return f"{self.bottom} > {x.top}"

    def under(self, x: SqlBar) -> str:
        return f"{self.top} < {x.bottom}"


def trailing(x: str, n: int) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN avg({x}) {frame} END"


PAST = [
    {"b10_0": trailing("abs(close - open)", 10), "r10_0": trailing("high - low", 10), "r5_0": trailing("high - low", 5), **{f"{n[0]}0": n for n in ("open", "high", "low", "close")}},
    {f"{x}{k}": lag(f"{x}0", k) for k in range(1, 5) for x in ("o", "h", "l", "c", "b10_", "r10_", "r5_")},
]


def candle(sign: str, *conditions: str) -> str:
    return values(*PAST, value=f"CASE WHEN {' AND '.join(f'({c})' for c in conditions)} THEN {sign} ELSE 0 END")


A, B, C, D, E = (SqlBar(k) for k in (4, 3, 2, 1, 0))


def near_equal(x: str, y: str, by: str) -> str:
    return f"{x} >= {y} - {by} AND {x} <= {y} + {by}"


def within(x: str, lo: str, hi: str) -> str:
    return f"{x} > {lo} AND {x} < {hi}"


LONG_BLACK = (D.black, D.long, E.white, f"{E.o} < {D.l}")
KICK = (f"{D.sign} = -{E.sign}", D.marubozu, E.marubozu, f"({D.black} AND {E.l} > {D.h}) OR ({D.white} AND {E.h} < {D.l})")
INDICATOR_SQL |= {
    "cdl3blackcrows": candle("-100", B.white, *[f"{x.black} AND {x.no_foot}" for x in (C, D, E)], within(D.o, C.c, C.o), within(E.o, D.c, D.o), f"{B.h} > {C.c} AND {C.c} > {D.c} AND {D.c} > {E.c}"),
    "cdl3linestrike": candle(
        f"{D.sign} * 100", f"{B.sign} = {C.sign} AND {C.sign} = {D.sign} AND {E.sign} = -{D.sign}", *[f"{y.o} >= {x.bottom} - {x.near} AND {y.o} <= {x.top} + {x.near}" for x, y in ((B, C), (C, D))],
        f"({D.white} AND {D.c} > {C.c} AND {C.c} > {B.c} AND {E.o} > {D.c} AND {E.c} < {B.o}) OR ({D.black} AND {D.c} < {C.c} AND {C.c} < {B.c} AND {E.o} < {D.c} AND {E.c} > {B.o})",
    ),
    "cdl3starsinsouth": candle("100", C.black, C.long, f"{C.lower} > {C.body}", D.black, f"{D.body} < {C.body} AND {D.o} > {C.c} AND {D.o} <= {C.h} AND {D.l} < {C.c} AND {D.l} >= {C.l} AND {D.lower} > {D.very_short}", E.black, E.short, E.no_foot, E.no_top, f"{E.l} > {D.l} AND {E.h} < {D.h}"),
    "cdl3whitesoldiers": candle("100", *[f"{x.white} AND {x.no_top}" for x in (C, D, E)], f"{E.c} > {D.c} AND {D.c} > {C.c}", *[f"{y.o} > {x.o} AND {y.o} <= {x.c} + {x.near}" for x, y in ((C, D), (D, E))], f"{D.body} > {C.body} - {C.far} AND {E.body} > {D.body} - {D.far}", f"{E.body} > {E.mean}"),
    "cdlbreakaway": candle(
        f"{E.sign} * 100", A.long, f"{A.sign} = {B.sign} AND {B.sign} = {D.sign} AND {D.sign} = -{E.sign}",
        f"({A.black} AND {B.under(A)} AND {C.h} < {B.h} AND {C.l} < {B.l} AND {D.h} < {C.h} AND {D.l} < {C.l} AND {within(E.c, B.o, A.c)}) OR ({A.white} AND {B.over(A)} AND {C.h} > {B.h} AND {C.l} > {B.l} AND {D.h} > {C.h} AND {D.l} > {C.l} AND {within(E.c, A.c, B.o)})",
    ),
    "cdlconcealbabyswall": candle("100", *[x.black for x in (B, C, D, E)], *[f"{x.no_top} AND {x.no_foot}" for x in (B, C)], D.under(C), f"{D.upper} > {D.very_short} AND {D.h} > {C.c} AND {E.h} > {D.h} AND {E.l} < {D.l}"),
    "cdlidentical3crows": candle("-100", *[f"{x.black} AND {x.no_foot}" for x in (C, D, E)], f"{C.c} > {D.c} AND {D.c} > {E.c}", near_equal(D.o, C.c, C.equal), near_equal(E.o, D.c, D.equal)),
    "cdlinneck": candle("-100", *LONG_BLACK, f"{E.c} <= {D.c} + {D.equal} AND {E.c} >= {D.c}"),
    "cdlonneck": candle("-100", *LONG_BLACK, near_equal(E.c, D.l, D.equal)),
    "cdlthrusting": candle("-100", *LONG_BLACK, f"{E.c} > {D.c} + {D.equal} AND {E.c} <= {D.c} + {D.body} * 0.5"),
    "cdlkicking": candle(f"{E.sign} * 100", *KICK),
    "cdlkickingbylength": candle(f"(CASE WHEN {E.body} > {D.body} THEN {E.sign} ELSE {D.sign} END) * 100", *KICK),
    "cdlladderbottom": candle("100", A.black, B.black, C.black, f"{A.o} > {B.o} AND {B.o} > {C.o} AND {A.c} > {B.c} AND {B.c} > {C.c}", D.black, f"{D.upper} > {D.very_short}", E.white, f"{E.o} > {D.o} AND {E.c} > {D.h}"),
    "cdlrisefall3methods": candle(
        f"{A.sign} * 100", A.long, B.short, C.short, D.short, E.long, *[f"{x.sign} = -{A.sign}" for x in (B, C, D)], f"{E.sign} = {A.sign}", *[f"{x.bottom} < {A.h} AND {x.top} > {A.l}" for x in (B, C, D)],
        f"{C.c} * {A.sign} < {B.c} * {A.sign} AND {D.c} * {A.sign} < {C.c} * {A.sign} AND {E.o} * {A.sign} > {D.c} * {A.sign} AND {E.c} * {A.sign} > {A.c} * {A.sign}",
    ),
    "cdlseparatinglines": candle(f"{E.sign} * 100", f"{D.sign} = -{E.sign}", near_equal(E.o, D.o, D.equal), E.long, f"({E.white} AND {E.no_foot}) OR ({E.black} AND {E.no_top})"),
    "cdlstalledpattern": candle("-100", C.white, D.white, E.white, f"{E.c} > {D.c} AND {D.c} > {C.c}", C.long, D.long, D.no_top, f"{D.o} > {C.o} AND {D.o} <= {C.c} + {C.near}", E.short, f"{E.o} >= {D.c} - {E.body} - {D.near}"),
    "cdltasukigap": candle(
        f"{D.sign} * 100", f"abs({D.body} - {E.body}) < {D.near}",
        f"({D.over(C)} AND {D.white} AND {E.black} AND {within(E.o, D.o, D.c)} AND {E.c} < {D.o} AND {E.c} > {C.top}) OR ({D.under(C)} AND {D.black} AND {E.white} AND {within(E.o, D.c, D.o)} AND {E.c} > {D.o} AND {E.c} < {C.bottom})",
    ),
}



def hikkake_sql() -> str:
    """Signs of the pattern by age, and confirmation by the first close beyond the inside bar within three bars."""
    sign = "CASE WHEN h1 < h2 AND l1 > l2 THEN CASE WHEN high < h1 AND low < l1 THEN 1 WHEN high > h1 AND low > l1 THEN -1 ELSE 0 END ELSE 0 END"
    ages = {f"{x}{k}": lag(y, k) for k in (1, 2, 3) for x, y in (("s", "s"), ("hi", "h1"), ("lo", "l1"), ("q", "close"))}
    ages["z5"] = lag("close", 5)

    def beyond(close: str, age: int) -> str:
        return f"((s{age} = 1 AND {close} > hi{age}) OR (s{age} = -1 AND {close} < lo{age}))"

    whens = []
    for age in (1, 2, 3):
        quiet = "".join(f" AND s{k} = 0 AND NOT {beyond(f'q{k}', age)}" for k in range(1, age))
        whens.append(f"WHEN s{age} <> 0{quiet} AND {beyond('close', age)} THEN 200 * s{age}")
    return values({f"{x}{k}": lag(n, k) for k in (1, 2) for x, n in (("h", "high"), ("l", "low"))}, {"s": sign}, ages, value=f"CASE WHEN z5 IS NULL THEN 0 WHEN s <> 0 THEN 100 * s {' '.join(whens)} ELSE 0 END")


INDICATOR_SQL["cdlhikkake"] = hikkake_sql()


def indicator_values(bars: DataFrame, name: str, args: list, seed: str = "first") -> DataFrame:
    ctx = Context("symbol", "session", seed)
    got = Planner(ctx, catalog_from_schema(bars)).operand({"fn": name, "args": args})
    return run_stages(bars, ctx).select("symbol", "session", r4(got.col.cast("double")).alias("value"))


def _register_indicators() -> None:
    for name, (slots, _, _) in INDICATORS.items():
        args = [3] if name == "adosc" else ARGS[slots]
        QUERIES[f"ind_{name}"] = lambda spark, d, name=name, args=args: indicator_values(bars_priority(spark, d), name, args)
        if name in INDICATOR_SQL:
            SQL[f"ind_{name}"] = INDICATOR_SQL[name]


_register_indicators()

# -- screens


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


PRICES = "symbol, session, open, high, low, close, volume"
OVER_SMA = {"m": full("avg", "close", 20)}


def screen(bars: DataFrame, text: str | dict, **more) -> DataFrame:
    catalog = catalog_from_schema(bars)
    scan = parse(text, catalog=catalog) if isinstance(text, str) else text
    return apply(bars, scan | more, catalog=catalog)


@query("scan_sma_cross", chain(OVER_SMA, {"c1": lag("close"), "m1": lag("m")}, final=f"SELECT {PRICES} FROM @ WHERE close > m AND c1 <= m1"))
def scan_sma_cross(spark, d):
    return screen(bars_priority(spark, d), "cross_above(close, sma(20))")


@query("scan_cross_constant", chain({"c1": lag("close")}, final=f"SELECT {PRICES} FROM @ WHERE close < 100000 AND c1 >= 100000"))
def scan_cross_constant(spark, d):
    return screen(bars_priority(spark, d), "cross_below(close, 100000)")


@query("scan_ema_cross_nation", chain({"a": ewm("close", "(2.0 / 6)"), "b": ewm("close", "(2.0 / 21)")}, {"a1": lag("a"), "b1": lag("b")}, final=f"SELECT {PRICES} FROM @ WHERE a > b AND a1 <= b1", base=NATION))
def scan_ema_cross_nation(spark, d):
    return screen(bars_nation(spark, d), "cross_above(ema(5), ema(20))")


@query("scan_groups", chain({"m": full("avg", "close", 5), "x": full("max", "high", 10)}, final=f"SELECT {PRICES} FROM @ WHERE (close > m AND NOT volume > 3) OR (symbol IN ('1-URGENT', '5-LOW') AND high >= x)"))
def scan_groups(spark, d):
    return screen(bars_priority(spark, d), "close > sma(5) and not volume > 3 or symbol in ['1-URGENT', '5-LOW'] and high >= rmax(high, 10)")


@query("scan_list_operators", f"WITH {BARS} SELECT {PRICES} FROM bars WHERE session BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND contains(symbol, 'E') AND close BETWEEN 50000 AND 150000")
def scan_list_operators(spark, d):
    nodes = [{"property": "session", "op": "between", "value": ["1995-01-01", "1996-12-31"]}, {"property": "symbol", "op": "contains", "value": "E"}, {"property": "close", "op": "between", "value": [50000, 150000]}]
    return screen(bars_priority(spark, d), {"filters": nodes})


@query("scan_top", f"WITH {BARS} SELECT {PRICES} FROM bars WHERE volume >= 2 ORDER BY volume DESC NULLS FIRST, symbol, session LIMIT 50")
def scan_top(spark, d):
    return screen(bars_priority(spark, d), "volume >= 2", order_by=[{"property": "volume", "dir": "desc"}], limit=50)


@query("scan_arithmetic", chain({"h2": lag("high", 2), "m": full("avg", "volume", 20)}, final=f"SELECT {PRICES} FROM @ WHERE (high - low) / close > 0.5 AND high > h2 * 1.01 AND -2 * m < close - open"))
def scan_arithmetic(spark, d):
    node = {"property": {"*": [{"-": [2]}, {"fn": "sma", "args": [{"col": "volume"}, 20]}]}, "op": "<", "value": {"-": [{"col": "close"}, {"col": "open"}]}}
    bars = bars_priority(spark, d)
    text = parse("high > high[2] * 1.01", catalog=catalog_from_schema(bars))
    spread = {"property": {"/": [{"-": [{"col": "high"}, {"col": "low"}]}, {"col": "close"}]}, "op": ">", "value": 0.5}
    return screen(bars, {"filters": [spread, *text["filters"], node]})


@query("scan_events_hourly", chain({"m": full("avg", "close", 24), "n": full("min", "low", 24)}, final=f"SELECT {PRICES} FROM @ WHERE close > m AND low > n", base=EVENT))
def scan_events_hourly(spark, d):
    return screen(bars_event(spark, d), "close > sma(24) and low > rmin(low, 24)")


@query("scan_relation", chain({"a": full("avg", "close", 10), "b": full("avg", "close", 50)}, final=f"SELECT {PRICES} FROM @ WHERE a > b", base=NATION))
def scan_relation(spark, d):
    bars = bars_nation(spark, d)
    bars.createOrReplaceTempView("barsift_relation_bars")
    catalog = catalog_from_schema(bars)
    return apply_relation(spark, parse("sma(10) > sma(50)", catalog=catalog), relation="barsift_relation_bars", catalog=catalog)


@query("scan_nested", chain({"m": full("avg", "close", 5)}, {"x": full("max", "m", 10), "m1": lag("m")}, {"x1": lag("x", 2)}, final=f"SELECT {PRICES} FROM @ WHERE m >= x AND m > m1 AND x > x1"))
def scan_nested(spark, d):
    return screen(bars_priority(spark, d), "sma(5) >= rmax(sma(5), 10) and sma(5) > sma(5)[1] and rmax(sma(5), 10) > shift(rmax(sma(5), 10), 2)")


@query("scan_staged", chain(INDEX, {"a": f"CASE WHEN count(high) {over(15)} = 15 THEN arg_max(i, (high, i)) {over(15)} END"}, final=f"SELECT {PRICES}, {sql_r4('100.0 * (14 - (i - a)) / 14')} AS aroon FROM @ WHERE 100.0 * (14 - (i - a)) / 14 > 70"))
def scan_staged(spark, d):
    got = screen(bars_priority(spark, d), "aroon(14) > 70")
    return got.withColumn("aroon", r4("__aroon_0")).drop("__aroon_0")


@query("scan_bound", chain({"a": full("avg", "close", 20), "b": full("avg", "close", 50)}, final="SELECT symbol, session, close FROM @ WHERE a > b AND close > a"))
def scan_bound(spark, d):
    return Scan(bars_priority(spark, d)).apply("sma(20) > sma(50) and close > sma(20)").select("symbol", "session", "close")


@query("materialized", chain({"a": full("avg", "close", 20), "b": full("min", "low", 7), "c": lag("close", 3)}, final=f"SELECT symbol, session, {sql_r4('a')} AS sma_20, b AS rmin_7, c AS shift_3 FROM @"))
def materialized(spark, d):
    return materialize(bars_priority(spark, d), "sma(20) > rmin(low, 7) and close[3] > 0").select("symbol", "session", r4("sma_20").alias("sma_20"), "rmin_7", "shift_3")


@query("trend_template", chain({"a": full("avg", "close", 20), "b": full("avg", "close", 50), "lo": full("min", "low", 100), "hi": full("max", "high", 100)}, {"b1": lag("b", 10)}, final=f"SELECT {PRICES} FROM @ WHERE close > a AND a > b AND b > b1 AND close >= lo * 1.3 AND close >= hi * 0.75"))
def trend_template(spark, d):
    return screen(bars_priority(spark, d), "close > sma(20) and sma(20) > sma(50) and sma(50) > sma(50)[10] and close >= rmin(low, 100) * 1.3 and close >= rmax(high, 100) * 0.75")


SIX = "rsi(close, 14) > 30 and ema(20) > ema(50) and atr(14) > 0 and close > sma(20) and roc(10) > 0 and natr(14) > 0"


@query(
    "six_indicators",
    chain(
        {"d": f"close - {lag('close')}", "pc": lag("close"), "e20": ewm("close", "(2.0 / 21)"), "e50": ewm("close", "(2.0 / 51)"), "m": full("avg", "close", 20), "c10": lag("close", 10)},
        {"g": ewm("CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "(1.0 / 14)"), "l": ewm("CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", "(1.0 / 14)"), **RANGE},
        {"atr": ewm("tr", "(1.0 / 14)")},
        final=f"SELECT {PRICES} FROM @ WHERE CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END > 30 AND e20 > e50 AND atr > 0 AND close > m AND close / c10 > 1 AND atr / close > 0",
    ),
)
def six_indicators(spark, d):
    return screen(bars_priority(spark, d), SIX)


def points(*steps: tuple[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {n}" for c, n in steps) + " ELSE 0 END"


def rint(x: str, places: int) -> str:
    return f"round_even(({x}) * {10**places}, 0) / {10**places}"


SCORE = " + ".join(
    [
        points(("spring", 15)), points(("acc_score > 0.10", 10)), points(("vol_ratio > 1.5", 15), ("vol_ratio > 1.0", 5)), points(("ema_stack", 20), ("ema5 > ema20", 10)), points(("recent_cross", 15)),
        points(("ema50_rising", 10)), points(("close > ema5", 5)), points(("atr_ratio > 2.0", 15), ("atr_ratio > 1.5", 10)), points(("rng > 2 * coalesce(atr, baseline)", 5)), points(("rsi > 70", 5)), points(("wick > 0.4", 10)), points(("near_52w_low", 5)),
    ]
)
SCORED = (
    {"ema5": ewm("close", "(2.0 / 6)"), "ema20": ewm("close", "(2.0 / 21)"), "ema50": ewm("close", "(2.0 / 51)"), "pc": lag("close"), "po": lag("open"), "l1": lag("low", 1), "l2": lag("low", 2), "n": "count(*) OVER (PARTITION BY symbol)", "last": "max(session) OVER (PARTITION BY symbol)", "avg_vol": f"avg(volume) {over(20)}", "up_vol": f"avg(CASE WHEN close > open THEN volume END) {over(20)}", "down_vol": f"avg(CASE WHEN close < open THEN volume END) {over(20)}", "downs": f"sum(CASE WHEN close < open THEN 1 ELSE 0 END) {over(20)}", "low52": f"min(low) {over(252)}", "rng": "high - low"},
    {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))", "d": "close - pc", "e5p": lag("ema5"), "e20p": lag("ema20"), "ema50_rising": f"ema50 > {lag('ema50')}", "spring": "l1 < l2 AND pc > po AND pc > l2"},
    {"atr": full("avg", "tr", 14), "gain": full("avg", "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", 14), "loss": full("avg", "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", 14), "crossed": "coalesce(ema5 > ema20 AND e5p <= e20p, false)"},
    {"baseline": f"avg(atr) {over(20)}", "recent_cross": f"bool_or(crossed) {over(5)}"},
    {"acc_score": "CASE WHEN avg_vol = 0 THEN 0 WHEN downs = 0 THEN 1 ELSE (coalesce(up_vol, 0) - coalesce(down_vol, 0)) / avg_vol END", "rsi": "coalesce(100 - 100 / (1 + gain / loss), 50)", "vol_ratio": "CASE WHEN avg_vol > 0 THEN volume / avg_vol ELSE 1 END", "atr_ratio": "CASE WHEN baseline > 0 THEN coalesce(atr, baseline) / baseline ELSE 1 END", "ema_stack": "ema5 > ema20 AND ema20 > ema50", "wick": "CASE WHEN rng > 0 THEN (high - greatest(close, open)) / rng ELSE 0 END", "near_52w_low": "low52 > 0 AND close < low52 * 1.30"},
    {"score": SCORE},
    {"phase": "CASE WHEN score >= 70 AND (vol_ratio > 3 OR atr_ratio > 2.5 OR rsi > 85) THEN 'CLIMAX' WHEN score >= 60 AND ema_stack AND atr_ratio > 1.5 THEN 'TREND' WHEN score >= 50 AND (vol_ratio > 1.5 OR spring) AND ema5 > ema20 THEN 'BREAKOUT' WHEN score >= 40 THEN 'BASE' ELSE 'NONE' END"},
)


def scores(days: int, where: str = "true") -> str:
    shown = f"symbol, session, close, CAST(score AS SMALLINT) AS score, phase, {rint('vol_ratio', 2)} AS vol_ratio, {rint('atr_ratio', 2)} AS atr_ratio, {rint('rsi', 1)} AS rsi, {rint('acc_score', 3)} AS acc_score, spring, ema_stack, recent_cross, {rint('wick', 2)} AS upper_wick_pct, near_52w_low, n AS bars"
    latest = "SELECT *, max(session) OVER () AS newest FROM @ WHERE session = last AND n >= 30"
    return chain(*SCORED, final=f"SELECT {shown} FROM ({latest}) WHERE date_diff('day', session, newest) <= {days} AND {where}", base=NATION)


@query("score_bars", scores(5))
def scored(spark, d):
    return score_bars(bars_nation(spark, d))


@query("scored_screen", scores(400, "score >= 20"))
def scored_screen(spark, d):
    return apply(score_bars(bars_nation(spark, d), freshness_days=400), parse("score >= 20 and phase in [BASE, NONE, TREND, BREAKOUT, CLIMAX]"))


RUNS = "runs AS (SELECT DISTINCT symbol, date_trunc('month', session) AS ran_on FROM bars)"
RETURNS = f"""ahead AS (SELECT symbol, session, close, lead(close, 5) OVER ({W}) AS d5, lead(close, 10) OVER ({W}) AS d10, lead(close, 20) OVER ({W}) AS d20 FROM bars),
entries AS (SELECT r.symbol, r.ran_on, min(b.session) AS entry_session FROM runs r JOIN bars b ON b.symbol = r.symbol AND b.session >= r.ran_on GROUP BY ALL),
returns AS (SELECT e.*, (d5 / close - 1) * 100 AS r5, (d10 / close - 1) * 100 AS r10, (d20 / close - 1) * 100 AS r20 FROM entries e JOIN ahead a ON a.symbol = e.symbol AND a.session = e.entry_session WHERE d20 IS NOT NULL)"""


def monthly_runs(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.trunc("session", "month").alias("ran_on")).distinct()


@query("forward_returns", f"WITH {BARS}, {RUNS}, {RETURNS} SELECT symbol, CAST(ran_on AS DATE) AS ran_on, entry_session, {sql_r4('r5')} AS r5, {sql_r4('r10')} AS r10, {sql_r4('r20')} AS r20 FROM returns")
def forward(spark, d):
    bars = bars_priority(spark, d)
    return forward_returns(bars, monthly_runs(bars)).select("symbol", "ran_on", "entry_session", *[r4(f"{n}d").alias(f"r{n}") for n in (5, 10, 20)])


@query(
    "backtest",
    f"WITH {BARS}, {RUNS}, {RETURNS} SELECT horizon, {sql_r4('100.0 * avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate, {sql_r4('avg(r)')} AS mean_return, count(*) AS n FROM (SELECT '5d' AS horizon, r5 AS r FROM returns UNION ALL SELECT '10d', r10 FROM returns UNION ALL SELECT '20d', r20 FROM returns) GROUP BY horizon",
)
def backtested(spark, d):
    bars = bars_priority(spark, d)
    return backtest(bars, monthly_runs(bars)).select("horizon", r4("hit_rate").alias("hit_rate"), r4("mean_return").alias("mean_return"), "n")


for _name, _base, _source in (("bars_priority", BARS, bars_priority), ("bars_nation", NATION, bars_nation), ("bars_event", EVENT, bars_event)):
    QUERIES[_name], SQL[_name] = _source, f"WITH {_base} SELECT {PRICES} FROM bars"
