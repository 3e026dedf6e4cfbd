"""Screens on frames: hits, nulls, sorting, errors."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

import barsift
from barsift import apply, catalog_from_schema, compile, parse
from barsift.operators.scan import Scan, materialize
from tests import bars

CLOSE = {"col": "close"}


def fn(name, *args):
    return {"fn": name, "args": list(args)}


def leaf(prop, op, value):
    return {"property": prop, "op": op, "value": value}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(bars.trend_and_flat()).cache()


def run(frame, *nodes, **more):
    order = {k: more.pop(k) for k in ("order_by", "limit") if k in more}
    return apply(frame, {"filters": list(nodes), **order}, catalog=catalog_from_schema(frame), **more)


def test_crossings(frame):
    got = run(frame, leaf(fn("ema", CLOSE, 5), "cross_above", fn("ema", CLOSE, 20))).collect()
    assert [(r.symbol, r.session) for r in got] == [("AAA", dt.date(2026, 1, 2))]
    for level in (11.0, {"+": [10.5, 0.5]}):
        got = run(frame, leaf("close", "cross_above", level)).collect()
        assert [(r.symbol, r.session) for r in got] == [("AAA", dt.date(2026, 1, 3))]
    assert run(frame, leaf("close", "cross_below", 11.0)).count() == 0


def test_rsi_seeds_and_nulls(frame):
    assert run(frame, leaf(fn("rsi", CLOSE, 14), ">", 0)).count() == 118
    flat = run(frame, leaf("symbol", "==", "BBB"), leaf(fn("rsi", CLOSE, 14), "==", 100)).count()
    assert flat == 59
    sma = run(frame, leaf(fn("rsi", CLOSE, 14), ">=", 0), seed="sma")
    assert sma.count() == 2 * (60 - 14)
    assert run(frame, leaf("symbol", "==", "BBB"), leaf(fn("rsi", CLOSE, 14), ">", 0), seed="sma").count() == 0


def test_boolean_groups(frame):
    up, early = leaf("close", ">", 40), leaf("session", "<=", "2026-01-05")
    assert run(frame, {"any": [{"all": [up, leaf("symbol", "==", "AAA")]}, early]}).count() == 29 + 10
    assert run(frame, {"not": leaf("symbol", "in", ["AAA"])}).count() == 60
    # not over null stays null
    assert run(frame, {"not": leaf(fn("shift", CLOSE, 1), ">", 0)}).count() == 0
    assert run(frame).count() == 120


def test_list_operators(frame):
    assert run(frame, leaf("close", "between", [12, 14])).count() == 3
    assert run(frame, leaf("session", "between", ["2026-01-02", "2026-01-03"])).count() == 4
    assert run(frame, leaf("symbol", "contains", "A.")).count() == 0
    assert run(frame, leaf("symbol", "contains", "AA")).count() == 60


def test_arithmetic_is_ieee(frame):
    zero = {"-": [CLOSE, CLOSE]}
    assert run(frame, leaf({"/": [CLOSE, zero]}, ">", 1e300)).count() == 120
    assert run(frame, leaf({"/": [zero, zero]}, ">", 1e300)).count() == 120, "NaN is above all numbers"
    assert run(frame, leaf({"-": [CLOSE]}, "<", -49.5)).count() == 60 + 20
    assert run(frame, leaf({"/": [7, 2]}, "==", 3.5)).count() == 120


def test_sort_and_limit(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 1, None), ("c", 1, 3.0)], "symbol string, session int, x double")
    catalog = catalog_from_schema(rows)
    for way, want in (("asc", ["b", "a", "c"]), ("desc", ["b", "c", "a"])):
        got = apply(rows, {"order_by": [{"property": "x", "dir": way}]}, catalog=catalog).collect()
        assert [r.symbol for r in got] == want
    assert apply(rows, {"order_by": [{"property": "x"}], "limit": 2}, catalog=catalog).count() == 2
    assert apply(rows, {"limit": 0}, catalog=catalog).count() == 0


def test_windows_see_rows_that_filters_drop(frame):
    # the mean of 20 exists on bar 20, although the filter keeps only that bar
    assert run(frame, leaf("session", "==", "2026-01-20"), leaf(fn("sma", CLOSE, 20), ">", 0)).count() == 2


def test_staged_columns_and_no_others(frame):
    got = run(frame, leaf(fn("adx", 5), ">", 0), leaf(fn("aroon", 5), ">", 0), leaf(fn("sma", CLOSE, 3), ">", 0))
    assert got.columns == [*frame.columns, "__adx_0", "__aroon_1"]


def test_other_keys_and_unordered_input(spark):
    rows = bars.up_and_down().rename(columns={"symbol": "name", "session": "day"}).sample(frac=1, random_state=1)
    df = spark.createDataFrame(rows)
    got = apply(df, parse("close > sma(20)", catalog=catalog_from_schema(df)), catalog=catalog_from_schema(df), partition="name", order_column="day")
    assert sorted({r.name for r in got.select("name").distinct().collect()}) == ["AAA"]
    assert got.count() == 41


def test_errors(frame):
    with pytest.raises(ValueError, match="unknown property: 'nope'"):
        compile({"filters": [leaf("nope", ">", 1)]})
    with pytest.raises(ValueError, match="plain identifier"):
        barsift.apply_relation(frame.sparkSession, {"filters": []}, relation="a.b")
    frame.createOrReplaceTempView("bars_view")
    assert barsift.apply_relation(frame.sparkSession, {"filters": [leaf("close", ">", 60)]}, relation="bars_view").count() == 9


def test_sql_conventions(frame):
    frame.createOrReplaceTempView("bars")
    catalog, spark = catalog_from_schema(frame), frame.sparkSession
    ema = {"filters": [leaf(fn("ema", CLOSE, 20), ">", 0)]}
    assert barsift.apply_sql(spark, ema, catalog=catalog).count() == 2 * 41
    assert barsift.apply_relation(spark, ema, relation="bars", catalog=catalog).count() == 120
    with pytest.raises(ValueError, match="not available on the duckdb engine"):
        barsift.apply_sql(spark, {"filters": [leaf(fn("obv", 1), ">", 0)]}, catalog=catalog)


def test_custom_indicator(frame):
    barsift.INDICATORS["twice"] = (("expr",), lambda ctx, e: e * 2, ())
    try:
        scan = parse("twice(close) > 130", catalog=catalog_from_schema(frame))
        assert apply(frame, scan, catalog=catalog_from_schema(frame)).count() == 4
    finally:
        del barsift.INDICATORS["twice"]


def test_scan_and_materialize(frame):
    scan = Scan(frame)
    with pytest.raises(ValueError, match="apply"):
        scan.materialized  # noqa: B018
    got = scan.apply("sma(20) > sma(50) and ema(close[1], 20) > 0")
    assert scan.result is got and got.count() == 11
    assert scan.materialized.columns == [*frame.columns, "sma_20", "sma_50", "ema_20", "shift_1"]
    twice = materialize(frame, "sma(5) > 0 and sma(open, 5) > 0 and close + rmax(7) > 0")
    assert twice.columns == [*frame.columns, "sma_5"]
    with pytest.raises(ValueError, match="cannot be materialized"):
        materialize(frame, "adx(14) > 20")


def test_plan_shape(frame):
    """One exchange for any number of windows; a filter on the partition key goes below them."""
    scan = parse("symbol in [AAA] and close > sma(20) and cross_above(close, rmax(5)) and slope(9) > 0", catalog=catalog_from_schema(frame))
    plan = apply(frame, scan, catalog=catalog_from_schema(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ArrowEvalPython" not in plan


def test_plan_shape_of_kernels(frame, spark, tmp_path):
    """Kernels of several levels share one grouped pass; a filter on the partition key reaches the scan below it."""
    frame.write.parquet(f"{tmp_path}/bars")
    stored = spark.read.parquet(f"{tmp_path}/bars")
    catalog = catalog_from_schema(stored)
    scan = parse("symbol == 'AAA' and ema(20) > ema(50) and rsi(close, 14) > 30 and atr(14) > 0", catalog=catalog)
    got = apply(stored, scan, catalog=catalog)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Exchange") == 1 and "EqualTo(symbol,AAA)" in plan
    whole = apply(stored, parse("ema(20) > ema(50) and rsi(close, 14) > 30 and atr(14) > 0", catalog=catalog), catalog=catalog).where("symbol = 'AAA'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) != []


def test_columns_named_like_staged_ones(frame):
    odd = frame.withColumn("__s0", F.lit(7.0)).withColumn("__stage_0", F.lit(8.0))
    got = apply(odd, parse("ema(5) > 0 and close >= sma(3)", catalog=catalog_from_schema(odd)), catalog=catalog_from_schema(odd))
    assert got.columns == odd.columns and {(r[0], r[1]) for r in got.select("__s0", "__stage_0").collect()} == {(7.0, 8.0)}


def test_screen_batches(frame, spark):
    from barsift.streaming.screens import apply_stream, screen_batches

    scan = parse("close > sma(5) and symbol in [AAA]", catalog=catalog_from_schema(frame))
    old, new, written = frame.where("session < '2026-02-20'"), frame.where("session >= '2026-02-20'"), []
    run_batch = screen_batches(lambda: old, scan, lambda df, n: written.append((n, sorted(map(tuple, df.collect())))), catalog=catalog_from_schema(frame))
    run_batch(new, 3)
    want = apply(frame, scan, catalog=catalog_from_schema(frame)).where("session >= '2026-02-20'")
    assert written == [(3, sorted(map(tuple, want.collect())))] and written[0][1]
    plain = apply_stream(frame, parse("symbol == 'AAA' and close > 15", catalog=catalog_from_schema(frame)), catalog=catalog_from_schema(frame))
    assert plain.count() == frame.where("symbol = 'AAA' AND close > 15").count() > 0


def test_candles_of_sql_engines(frame):
    scan = {"filters": [{"property": fn("cdlbreakaway", 1), "op": ">=", "value": -200}]}
    counts = [run_on.groupBy("symbol").count().collect() for run_on in (apply(frame, scan, engine=e, catalog=catalog_from_schema(frame)) for e in ("spark", "duckdb"))]
    assert {r["count"] for r in counts[0]} == {60} and {r["count"] for r in counts[1]} == {60 - 14}


def test_empty_frame(spark):
    df = spark.createDataFrame(bars.trend_and_flat()).limit(0)
    got = run(df, leaf(fn("ema", CLOSE, 5), "cross_above", fn("sma", CLOSE, 20)), leaf(fn("adx", 14), ">", 1))
    assert got.count() == 0


def test_null_keys_and_prices(spark):
    rows = bars.trend_and_flat()
    rows.loc[rows.index % 7 == 3, "close"] = None
    rows["symbol"] = rows["symbol"].where(rows["symbol"] != "BBB", None)
    df = spark.createDataFrame(rows)
    got = run(df, leaf(fn("ema", CLOSE, 5), ">", 0), leaf(fn("adx", 5), ">=", 0)).agg(F.count("*"), F.count("close")).first()
    assert got[0] == got[1]
    assert isinstance(rows, pd.DataFrame)
