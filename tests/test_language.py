"""Text screens to dictionaries, and faults with their places."""

import pytest

from barsift import parse, validate
from barsift.plans.catalog import PROPERTY_CATALOG

CATALOG = PROPERTY_CATALOG | {n: {"label": n, "dtype": "float"} for n in ("open", "high", "low", "volume", "rs", "market_cap")}
CLOSE = {"col": "close"}


def p(text):
    return parse(text, catalog=CATALOG)["filters"][0]


def fn(name, *args):
    return {"fn": name, "args": list(args)}


def leaf(prop, op, value):
    return {"property": prop, "op": op, "value": value}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("close > 10", leaf("close", ">", 10)),
        ("close>.5", leaf("close", ">", 0.5)),
        ("close <= 5.", leaf("close", "<=", 5.0)),
        ("close = -3", leaf("close", "==", -3)),
        ("5 > close", leaf("close", "<", 5)),
        ("5 <= ema(20)", leaf(fn("ema", CLOSE, 20), ">=", 5)),
        ("phase == 'TREND'", leaf("phase", "==", "TREND")),
        ("phase in [BASE, 'TREND',]", leaf("phase", "in", ["BASE", "TREND"])),
        ("score BETWEEN [1, 2.5]", leaf("score", "between", [1, 2.5])),
        ("spring", leaf("spring", "==", True)),
        ("spring != TRUE", leaf("spring", "!=", True)),
        ("not not spring", {"not": {"not": leaf("spring", "==", True)}}),
        ("close[1] > open", leaf(fn("shift", CLOSE, 1), ">", {"col": "open"})),
        ("ema(20)[1][2] > 0", leaf(fn("shift", fn("shift", fn("ema", CLOSE, 20), 1), 2), ">", 0)),
        ("sma(200, close(22)) > 1", leaf(fn("sma", fn("shift", CLOSE, 22), 200), ">", 1)),
        ("sma(high, 5) > min(low, 3)", leaf(fn("sma", {"col": "high"}, 5), ">", fn("rmin", {"col": "low"}, 3))),
        ("max(5) > 0", leaf(fn("rmax", CLOSE, 5), ">", 0)),
        ("ad() > 0", leaf(fn("ad"), ">", 0)),
        ("cross_above(ema(5), 3.5)", leaf(fn("ema", CLOSE, 5), "cross_above", 3.5)),
        ("cross_below(close, open)", leaf(CLOSE, "cross_below", {"col": "open"})),
        ("close + 1 + open > 2", leaf({"+": [CLOSE, 1, {"col": "open"}]}, ">", 2)),
        ("close + 1 - open > 2", leaf({"-": [{"+": [CLOSE, 1]}, {"col": "open"}]}, ">", 2)),
        ("close - open * 2 / 3 > 2", leaf({"-": [CLOSE, {"/": [{"*": [{"col": "open"}, 2]}, 3]}]}, ">", 2)),
        ("stoch_k(5, 3, 3) > 80", leaf(fn("stoch_k", 5, 3, 3), ">", 80)),
    ],
)
def test_leaves(text, want):
    assert p(text) == want


def test_groups():
    a, b, c = (leaf("close", ">", n) for n in (1, 2, 3))
    assert p("close>1 or close>2 and close>3") == {"any": [a, {"all": [b, c]}]}
    assert p("(close>1 || close>2) && close>3") == {"all": [{"any": [a, b]}, c]}
    assert p("not (close>1 and close>2) AND close>3") == {"all": [{"not": {"all": [a, b]}}, c]}
    assert p("((close>1))") == a and p("close>1 and close>2 and close>3") == {"all": [a, b, c]}


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("close >", "unexpected None at position 8"),
        ("close > 'abc", "unterminated string at position 9"),
        ("close > 1.2.3", "invalid number '1.2.3' at position 9"),
        ("close ? 1", "unexpected character '\\?' at position 7"),
        ("close > 10 trailing", "unexpected 'trailing' at position 12"),
        ("nosuch > 5", "unknown column 'nosuch' at position 1"),
        ("nosuch(3) > 5", "unknown indicator or column 'nosuch' at position 1"),
        ("close(1, 2) > 5", "'close' lookback must be one int at position 1"),
        ("close[x] > 5", "lookback must be an int at position 7"),
        ("close", "column 'close' needs a comparison at position 1"),
        ("ema(20)", "expected a comparison at position 8"),
        ("5 > 3", "comparison needs a column or expression at position 6"),
        ("5 in [1]", "invalid comparison left side at position"),
        ("close in [1 2]", "expected ',' or '\\]' at position 13"),
        ("close in [-1]", "expected a literal at position 11"),
        ("close between [1]", "expected 2 values at position"),
        ("(close > 1", "expected '\\)' at position 11"),
        ("(close + 1) * 2 > 5", "position 11"),
        ("-close > 1", "unexpected '-' at position 1"),
        ("phase == BREAKOUT", "unknown column 'BREAKOUT' at position 10"),
        ("close > cross_above(ema(5), ema(9))", "cross call not allowed here at position 9"),
        ("1 + cross_above(ema(5), ema(9)) > 5", "cross call not allowed here at position 5"),
        ("ema(cross_above(ema(5), ema(9)), 20) > 5", "cross call not allowed here at position 5"),
        ("cross_above(close)", "cross_above\\(\\) takes 2 args at position 1"),
        ("close contains 'A'", "position"),
    ],
)
def test_syntax_errors(text, message):
    with pytest.raises(SyntaxError, match=message):
        parse(text, catalog=CATALOG)


def scan(*nodes, **more):
    return {"filters": list(nodes)} | more


@pytest.mark.parametrize(
    ("definition", "want"),
    [
        (scan(), []),
        ({}, []),
        ([], ["scan definition must be an object, got []"]),
        ({"filters": "x"}, ["filters must be a list"]),
        ({"order_by": {"property": "x"}}, ["order_by must be a list"]),
        (scan(order_by=["x", {"property": "nope", "dir": "up"}]), ["order entry must be an object, got 'x'", "unknown property: 'nope'", "unknown direction: 'up'"]),
        (scan(limit=True), ["limit must be a nonnegative integer"]),
        (scan(limit=-1), ["limit must be a nonnegative integer"]),
        (scan(3), ["filters[0]: node must be an object, got 3"]),
        (scan({"all": []}), ["filters[0].all must be a nonempty list"]),
        (scan({"any": [{"not": 1}]}), ["filters[0].any[0].not must be an object"]),
        (scan(leaf("nope", "~", 1)), ["filters[0]: unknown property: 'nope'", "filters[0]: unknown operator: '~'"]),
        (scan(leaf(CLOSE, "in", [1])), ["filters[0]: computed left side not supported for 'in'"]),
        (scan(leaf("close", "contains", "x")), ["filters[0]: 'contains' needs a string value on a string property"]),
        (scan(leaf("score", "between", [1])), ["filters[0]: 'between' needs [lo, hi]"]),
        (scan(leaf("session", "between", ["2026-01-01", "x"])), ["filters[0]: 'between' bounds must be date values"]),
        (scan(leaf("phase", "in", [])), ["filters[0]: 'in' needs a nonempty list of values"]),
        (scan(leaf("phase", "in", [1])), ["filters[0]: 'in' values must be str values"]),
        (scan(leaf("close", ">", None)), ["filters[0]: value must not be null"]),
        (scan(leaf("session", ">", "soon")), ["filters[0]: value for 'session' (date) must be an ISO date string, got 'soon'"]),
        (scan(leaf("score", ">", 1.5)), ["filters[0]: value for 'score' (int) must be int, got 1.5"]),
        (scan(leaf("score", ">", True)), ["filters[0]: value for 'score' (int) must be int, got True"]),
        (scan(leaf("close", "cross_above", None)), ["filters[0].value: operand must not be null"]),
        (scan(leaf("close", "cross_above", [1])), ["filters[0].value: operand must be scalar, col, fn, or arithmetic, got [1]"]),
        (scan(leaf("close", ">", {"x": 1, "b": 2})), ["filters[0].value: operand must be col, fn, or arithmetic, got keys ['b', 'x']"]),
        (scan(leaf("close", ">", {"col": "nope"})), ["filters[0].value.col: unknown column: 'nope'"]),
        (scan(leaf("close", ">", fn("nope"))), ["filters[0].value.fn: unknown indicator: 'nope'"]),
        (scan(leaf("close", ">", fn("sma", CLOSE))), ["filters[0].value: 'sma' takes 2 args, got 1"]),
        (scan(leaf("close", ">", {"fn": "sma"})), ["filters[0].value: 'sma' takes 2 args, got None"]),
        (scan(leaf("close", ">", fn("sma", {"col": "x"}, 0))), ["filters[0].value.args[0].col: unknown column: 'x'", "filters[0].value.args[1]: must be an int >= 1, got 0"]),
        (scan(leaf("close", ">", fn("obv", 3))), []),
        (scan(leaf("close", ">", {"+": []})), ["filters[0].value.+ must be a nonempty list"]),
        (scan(leaf("close", ">", {"*": [1]})), ["filters[0].value.* must have >= 2 operands"]),
        (scan(leaf("close", ">", {"-": [None]})), ["filters[0].value.-[0]: operand must not be null"]),
    ],
)
def test_validation(definition, want):
    assert validate(definition, catalog=CATALOG) == want


def test_missing_columns_and_profiles():
    atr = scan(leaf("close", ">", fn("atr", 14)))
    assert validate(atr) == ["filters[0].value: indicator 'atr' requires column 'high'", "filters[0].value: indicator 'atr' requires column 'low'"]
    for name, args in (("stoch_k", [5, 3, 3]), ("ht_trendline", [1])):
        assert validate(scan(leaf("close", ">", fn(name, *args))), catalog=CATALOG, engine="polars") == [f"filters[0].value: indicator {name!r} requires engine='duckdb'"]
        assert validate(scan(leaf("close", ">", fn(name, *args))), catalog=CATALOG, engine="duckdb") == []
    assert validate(scan(leaf("close", ">", fn("sar", 1))), catalog=CATALOG, engine="duckdb") == ["filters[0].value: indicator 'sar' is not available on the duckdb engine"]
    assert "takes 2 args" in validate(parse("rsi(14) > 70"), catalog=CATALOG)[0]
    assert "'sma' takes 2 args, got 3" in validate(parse("sma(200, close(22), 7) > 5"), catalog=CATALOG)[0]
    with pytest.raises(ValueError, match="unknown engine"):
        validate({}, engine="other")
