"""Scoring and forward returns, sources, and what is registered."""

import datetime as dt

import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from barsift import apply, backtest, backtest_summary, catalog_from_schema, forward_returns, forward_stats, parse, score_bars
from barsift.sources.bars import read_bars
from barsift.streaming.screens import apply_stream
from tests import bars


def test_golden_scores(spark):
    got = score_bars(spark.createDataFrame(bars.up_and_down())).collect()
    assert [(r.symbol, r.score, r.phase, r.session, r.bars) for r in got] == [("AAA", 60, "BASE", dt.date(2026, 3, 1), 60), ("BBB", 20, "NONE", dt.date(2026, 3, 1), 60)]
    assert apply(score_bars(spark.createDataFrame(bars.up_and_down())), parse("score > 50 and phase in [BASE] and not spring")).count() == 1


def test_row_filters(spark):
    short = bars.table("CCC", [5.0] * 29)
    old = bars.table("DDD", [5.0 + i for i in range(50)])
    df = spark.createDataFrame(bars.pd.concat([bars.up_and_down(), short, old]))
    assert {r.symbol for r in score_bars(df).collect()} == {"AAA", "BBB"}
    assert {r.symbol for r in score_bars(df, freshness_days=10).collect()} == {"AAA", "BBB", "DDD"}
    # freshness is measured among symbols that have enough bars
    late = bars.table("EEE", [1.0] * 5)
    late["session"] += dt.timedelta(days=300)
    df = spark.createDataFrame(bars.pd.concat([bars.up_and_down(), late]))
    assert score_bars(df).count() == 2 and score_bars(df, min_bars=5).count() == 1
    assert score_bars(df.limit(0)).count() == 0


def test_flat_series_has_nan_rsi(spark):
    r = score_bars(spark.createDataFrame(bars.trend_and_flat())).where("symbol = 'BBB'").first()
    assert r.rsi != r.rsi


def test_forward_stats():
    sessions = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    closes = [128.0 + 16.0 * i for i in range(30)]
    assert forward_stats(sessions, closes, dt.date(2026, 1, 1)) == {"5d": 62.5, "10d": 125.0, "20d": 250.0}
    assert forward_stats(sessions, closes, dt.date(2026, 1, 20)) is None
    runs = [{"ran_at": "2026-01-01T22:00", "symbols": ["A", "B"]}, {"ran_at": "2026-01-25", "symbols": ["A"]}]
    got = backtest_summary(runs, lambda s, d: forward_stats(sessions, closes, d))
    assert got["included"] == 2 and got["total"] == 2 and got["horizons"][0] == ("5d", 100.0, 62.5, 2)
    assert backtest_summary([], None)["horizons"] == [("5d", 0.0, 0.0, 0), ("10d", 0.0, 0.0, 0), ("20d", 0.0, 0.0, 0)]


def test_frames_agree_with_functions(spark):
    table = bars.up_and_down()
    df = spark.createDataFrame(table)
    runs = spark.createDataFrame([(s, d) for s in ("AAA", "BBB", "ZZZ") for d in (dt.date(2025, 12, 1), dt.date(2026, 1, 9), dt.date(2026, 2, 9), dt.date(2026, 2, 10))], "symbol string, ran_on date")
    want = {}
    for s, g in table.groupby("symbol"):
        for r in runs.where(f"symbol = '{s}'").collect():
            if stats := forward_stats(list(g.session), list(g.close), r.ran_on):
                want[s, r.ran_on] = stats
    got = {(r.symbol, r.ran_on): {k: r[k] for k in ("5d", "10d", "20d")} for r in forward_returns(df, runs).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    summary = {r.horizon: r for r in backtest(df, runs).collect()}
    assert summary["10d"].n == len(want) and summary["10d"].mean_return == pytest.approx(sum(v["10d"] for v in want.values()) / len(want))


def test_catalog():
    schema = T.StructType([T.StructField(n, t) for n, t in (("b", T.BooleanType()), ("i", T.ByteType()), ("f", T.FloatType()), ("s", T.StringType()), ("d", T.DateType()), ("t", T.TimestampNTZType()), ("tags", T.ArrayType(T.StringType())), ("m", T.DecimalType(9, 2)))])
    assert {k: v["dtype"] for k, v in catalog_from_schema(schema).items()} == {"b": "bool", "i": "int", "f": "float", "s": "str", "d": "date", "t": "date"}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame(bars.trend_and_flat())
    for kind, options in (("parquet", {}), ("json", {}), ("csv", {"header": True, "inferSchema": True})):
        df.write.format(kind).options(header=True).save(f"{tmp_path}/{kind}")
        assert read_bars(spark, f"{tmp_path}/{kind}", kind, **options).count() == 120
    with pytest.raises(ValueError, match="lack columns: volume"):
        df.drop("volume").write.parquet(f"{tmp_path}/less")
        read_bars(spark, f"{tmp_path}/less")


def test_stream(spark, tmp_path):
    df = spark.createDataFrame(bars.trend_and_flat())
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = apply_stream(stream, parse("close > 60", catalog=catalog_from_schema(df)), catalog=catalog_from_schema(df)).writeStream.format("memory").queryName("barsift_kept").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("barsift_kept").count() == 9
    with pytest.raises(ValueError, match="windows"):
        apply_stream(stream, parse("close > sma(5)", catalog=catalog_from_schema(df)), catalog=catalog_from_schema(df))


def test_registry_of_queries():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and {f"ind_{n}" for n in ("sma", "adx", "cdlengulfing")} <= names and "scan_sma_cross" in sql
