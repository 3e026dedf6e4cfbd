"""SQL of the indicators that carry a state from bar to bar, and queries of what the other screens leave out.

A state is one row a symbol in a recursive query, taken from bar to bar.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsift.functions.registry import INDICATORS, indicator
from barsift.operators.scan import apply, apply_sql, last_bars
from barsift.plans.catalog import catalog_from_schema
from barsift.plans.language import parse
from barsift.queries import BARS, INDICATOR_SQL, PRICES, QUERIES, SQL, TR, W, chain, full, lag, query, r4, screen, seen, seeded, sql_r4
from barsift.sources.bars import bars_priority

NUMBERED = "CAST(row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS INTEGER) AS i"

SQL["ind_sar"] = f"""WITH RECURSIVE {BARS},
x AS (SELECT symbol, session, high, low, {NUMBERED}, {lag('high')} AS ph, {lag('low')} AS pl FROM bars),
r AS (
  SELECT a.symbol, 0 AS i, NOT (a.low - b.low > b.high - a.high AND a.low - b.low > 0) AS rising,
         CASE WHEN NOT (a.low - b.low > b.high - a.high AND a.low - b.low > 0) THEN a.low ELSE a.high END AS stop,
         CASE WHEN NOT (a.low - b.low > b.high - a.high AND a.low - b.low > 0) THEN b.high ELSE b.low END AS peak,
         CAST(0.02 AS DOUBLE) AS af, CAST(NULL AS DOUBLE) AS value
  FROM x a JOIN x b ON a.symbol = b.symbol AND a.i = 0 AND b.i = 1
  UNION ALL
  SELECT symbol, i, rising <> turned AS rising,
         CASE WHEN turned AND rising THEN greatest(value + CAST(0.02 AS DOUBLE) * (low - value), top)
              WHEN turned THEN least(value + CAST(0.02 AS DOUBLE) * (high - value), bottom)
              WHEN rising THEN least(stop + af2 * (peak2 - stop), bottom) ELSE greatest(stop + af2 * (peak2 - stop), top) END,
         CASE WHEN turned AND rising THEN low WHEN turned THEN high ELSE peak2 END,
         CASE WHEN turned THEN CAST(0.02 AS DOUBLE) ELSE af2 END, value
  FROM (
    SELECT *, CASE WHEN turned AND rising THEN greatest(peak, top) WHEN turned THEN least(peak, bottom) ELSE stop END AS value,
           CASE WHEN rising THEN greatest(peak, high) ELSE least(peak, low) END AS peak2,
           CASE WHEN (rising AND high > peak) OR (NOT rising AND low < peak) THEN least(af + CAST(0.02 AS DOUBLE), CAST(0.2 AS DOUBLE)) ELSE af END AS af2
    FROM (
      SELECT r.symbol, x.i, r.rising, r.stop, r.peak, r.af, x.high, x.low,
             CASE WHEN x.i = 1 THEN x.high ELSE greatest(x.high, x.ph) END AS top, CASE WHEN x.i = 1 THEN x.low ELSE least(x.low, x.pl) END AS bottom,
             CASE WHEN r.rising THEN x.low <= r.stop ELSE x.high >= r.stop END AS turned
      FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1)))
SELECT x.symbol, x.session, {sql_r4('r.value')} AS value FROM x LEFT JOIN r ON x.symbol = r.symbol AND x.i = r.i"""

#: The homodyne discriminator: period and smoothed period at each bar from the twelfth on. Lists hold the last six values, newest first.
HILBERT = f"""WITH RECURSIVE {BARS},
w AS (SELECT symbol, session, close, {NUMBERED}, (4 * close + 3 * {lag('close')} + 2 * {lag('close', 2)} + {lag('close', 3)}) / 10 AS raw FROM bars),
y AS (SELECT symbol, session, close, i, CASE WHEN i >= 3 THEN raw ELSE CAST(0 AS DOUBLE) END AS s FROM w),
x AS (SELECT *, lag(s, 2) OVER ({W}) AS s2, lag(s, 4) OVER ({W}) AS s4, lag(s, 6) OVER ({W}) AS s6, list(s) OVER ({W} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS past, list(close) OVER ({W} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS closes FROM y),
r AS (
  SELECT symbol, i, CAST([0, 0, 0, 0, 0, 0] AS DOUBLE[]) AS d, CAST([0, 0, 0, 0, 0, 0] AS DOUBLE[]) AS q, CAST([0, 0, 0, 0, 0, 0] AS DOUBLE[]) AS n,
         CAST(0 AS DOUBLE) AS i2, CAST(0 AS DOUBLE) AS q2, CAST(0 AS DOUBLE) AS re, CAST(0 AS DOUBLE) AS im, CAST(0 AS DOUBLE) AS period, CAST(0 AS DOUBLE) AS steady
  FROM x WHERE i = 11
  UNION ALL
  SELECT symbol, i, [det] || d[1:5], [quad] || q[1:5], [phase] || n[1:5], i2n, q2n, ren, imn, 0.2::DOUBLE * p + 0.8::DOUBLE * period,
         0.33::DOUBLE * (0.2::DOUBLE * p + 0.8::DOUBLE * period) + 0.67::DOUBLE * steady
  FROM (SELECT *, CASE WHEN p2 < 6 THEN 6.0::DOUBLE WHEN p2 > 50 THEN 50.0::DOUBLE ELSE p2 END AS p
  FROM (SELECT *, CASE WHEN p1 < 0.67::DOUBLE * period THEN 0.67::DOUBLE * period ELSE p1 END AS p2
  FROM (SELECT *, CASE WHEN p0 > 1.5::DOUBLE * period THEN 1.5::DOUBLE * period ELSE p0 END AS p1
  FROM (SELECT *, CASE WHEN ren <> 0 AND imn <> 0 THEN 2 * pi() / atan(imn / ren) ELSE period END AS p0
  FROM (SELECT *, 0.2::DOUBLE * (i2n * i2 + q2n * q2) + 0.8::DOUBLE * re AS ren, 0.2::DOUBLE * (i2n * q2 - q2n * i2) + 0.8::DOUBLE * im AS imn
  FROM (SELECT *, 0.2::DOUBLE * (phase - (0.0962::DOUBLE * (quad - q[6]) + 0.5769::DOUBLE * (q[2] - q[4])) * k) + 0.8::DOUBLE * i2 AS i2n,
                  0.2::DOUBLE * (quad + (0.0962::DOUBLE * (phase - n[6]) + 0.5769::DOUBLE * (n[2] - n[4])) * k) + 0.8::DOUBLE * q2 AS q2n
  FROM (SELECT *, (0.0962::DOUBLE * (det - d[6]) + 0.5769::DOUBLE * (d[2] - d[4])) * k AS quad
  FROM (SELECT *, (0.0962::DOUBLE * (s - s6) + 0.5769::DOUBLE * (s2 - s4)) * k AS det
  FROM (SELECT r.symbol, x.i, x.s, x.s2, x.s4, x.s6, r.d, r.q, r.n, r.d[3] AS phase, r.i2, r.q2, r.re, r.im, r.period, r.steady, 0.075::DOUBLE * r.period + 0.54::DOUBLE AS k
        FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1)))))))))),
z AS (SELECT x.symbol, x.session, x.close, x.i, x.past, x.closes, coalesce(r.steady, 0) AS steady, CAST(floor(coalesce(r.steady, 0) + 0.5) AS INTEGER) AS span FROM x LEFT JOIN r ON x.symbol = r.symbol AND x.i = r.i)"""

SQL["ind_ht_dcperiod"] = f"{HILBERT} SELECT symbol, session, {sql_r4('CASE WHEN i >= 32 THEN steady END')} AS value FROM z"
SQL["ind_ht_trendline"] = f"""{HILBERT},
m AS (SELECT *, CASE WHEN span > 0 THEN list_sum(closes[-span:]) / span ELSE close END AS mean FROM z)
SELECT symbol, session, {sql_r4(f"CASE WHEN i >= 63 THEN (4 * mean + 3 * {lag('mean')} + 2 * {lag('mean', 2)} + {lag('mean', 3)}) / 10 END")} AS value FROM m"""
SQL["ind_ht_dcphase"] = f"""{HILBERT},
a AS (SELECT *, list_sum(list_transform(range(span), lambda j: sin(2 * pi() * j / span) * past[len(past) - j])) AS re, list_sum(list_transform(range(span), lambda j: cos(2 * pi() * j / span) * past[len(past) - j])) AS im FROM z WHERE i >= 63),
b AS (SELECT symbol, session, (CASE WHEN abs(im) > 0 THEN degrees(atan(re / im)) WHEN re > 0 THEN 90 WHEN re < 0 THEN -90 ELSE 0 END) + 90 + (CASE WHEN steady <> 0 THEN 360 / steady ELSE 0 END) + (CASE WHEN im < 0 THEN 180 ELSE 0 END) AS phase FROM a)
SELECT z.symbol, z.session, {sql_r4('CASE WHEN phase > 315 THEN phase - 360 ELSE phase END')} AS value FROM z LEFT JOIN b ON z.symbol = b.symbol AND z.session = b.session"""

# -- screens of what the others leave out


@query("scan_equality", f"WITH {BARS} SELECT {PRICES} FROM bars WHERE symbol = '1-URGENT' AND volume <> 2 AND open = close")
def scan_equality(spark, d):
    return screen(bars_priority(spark, d), "symbol == '1-URGENT' and volume != 2 and open == close")


@query("scan_boolean_column", f"WITH {BARS} SELECT {PRICES}, close > open AS up, CASE WHEN volume > 1 THEN volume > 2 END AS busy FROM bars WHERE close > open AND NOT (CASE WHEN volume > 1 THEN volume > 2 END)")
def scan_boolean_column(spark, d):
    return screen(bars_priority(spark, d).withColumn("up", F.expr("close > open")).withColumn("busy", F.expr("CASE WHEN volume > 1 THEN volume > 2 END")), "up and not busy")


@query("scan_flipped", chain({"m": full("avg", "close", 20), "x": full("max", "high", 5), "n": full("min", "low", 5), "x1": lag("close", 3)}, final=f"SELECT {PRICES} FROM @ WHERE 100000 < m AND (2 <= volume OR 150000 >= close) AND x - n > 1000 AND close > x1"))
def scan_flipped(spark, d):
    return screen(bars_priority(spark, d), "100000 < sma(20) and (2 <= volume or 150000 >= close) and max(high, 5) - min(low, 5) > 1000 and close > close(3)")


@query("scan_bare_right", chain({"m": full("avg", "close", 20), "v": full("avg", "volume", 10)}, final=f"SELECT {PRICES} FROM @ WHERE (close + open) / 2 > m AND volume >= v AND NOT (high = close OR low = open)"))
def scan_bare_right(spark, d):
    bars = bars_priority(spark, d)
    catalog = catalog_from_schema(bars)
    middle = {"property": {"/": [{"+": [{"col": "close"}, {"col": "open"}]}, 2]}, "op": ">", "value": {"fn": "sma", "args": [{"col": "close"}, 20]}}
    rest = parse("volume >= sma(volume, 10) and not (high == close or low == open)", catalog=catalog)
    return apply(bars, {"filters": [middle, *rest["filters"]]}, catalog=catalog)


@query("scan_nulls_sorted", chain({"big": "CASE WHEN volume > 2 THEN close END"}, final=f"SELECT {PRICES}, big FROM @ WHERE session >= DATE '1995-06-01' ORDER BY big ASC NULLS FIRST, volume DESC NULLS FIRST, symbol, session LIMIT 3000"))
def scan_nulls_sorted(spark, d):
    bars = bars_priority(spark, d).withColumn("big", F.expr("CASE WHEN volume > 2 THEN close END"))
    scan = {"filters": [{"property": "session", "op": ">=", "value": "1995-06-01"}], "order_by": [{"property": "big", "dir": "asc"}, {"property": "volume", "dir": "desc"}], "limit": 3000}
    return screen(bars, scan)


SMALL_ROWS = [("A" if i % 2 else "B", dt.date(2026, 1, 1) + dt.timedelta(days=i // 2), 10.0 + i % 7, 12.0 + i % 7, 9.0 + i % 5, 10.5 + (i * i) % 11, 100.0 + i) for i in range(80)]


def literal_bars(rows: list[tuple]) -> str:
    listed = ", ".join(f"('{s}', DATE '{t}', {', '.join(f'CAST({x!r} AS DOUBLE)' for x in numbers)})" for s, t, *numbers in rows)
    return f"bars AS (SELECT * FROM (VALUES {listed}) AS v({PRICES}))"


def frame_of(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "symbol string, session date, open double, high double, low double, close double, volume double")


@query("scan_in_memory", chain({"m": full("avg", "close", 5), "c1": lag("close")}, {"m1": lag("m")}, final=f"SELECT {PRICES} FROM @ WHERE close > m AND c1 <= m1", base=literal_bars(SMALL_ROWS)))
def scan_in_memory(spark, d):
    return screen(frame_of(spark, SMALL_ROWS), "cross_above(close, sma(5))")


@query("scan_own_indicator", chain({"a": full("avg", "high", 10), "b": full("avg", "low", 10)}, final=f"SELECT {PRICES} FROM @ WHERE close > a - (a - b) / 4"))
def scan_own_indicator(spark, d):
    """An entry put into the registry is at once a name of the language."""
    if "channel_top" not in INDICATORS:

        @indicator("channel_top", "int", needs="high low")
        def channel_top(ctx, n):
            top, bottom = (ctx.full("avg", ctx.number(x), n) for x in ("high", "low"))
            return top - (top - bottom) / 4

    try:
        return screen(bars_priority(spark, d), "close > channel_top(10)")
    finally:
        INDICATORS.pop("channel_top", None)


@query("last_bars", f"WITH {BARS} SELECT {PRICES} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session DESC) <= 5")
def last_five(spark, d):
    return last_bars(bars_priority(spark, d), 5)


# -- the conventions of SQL engines


def sql_relation(spark, d, text: str) -> DataFrame:
    bars = bars_priority(spark, d)
    bars.createOrReplaceTempView("barsift_sql_bars")
    catalog = catalog_from_schema(bars)
    return apply_sql(spark, parse(text, catalog=catalog), relation="barsift_sql_bars", catalog=catalog)


@query("sql_seeded_means", chain({"s": seen("close")}, {"a": seeded("s", 10, "(2.0 / 11)"), "b": seeded("s", 30, "(2.0 / 31)")}, final=f"SELECT {PRICES} FROM @ WHERE a > b"))
def sql_seeded_means(spark, d):
    return sql_relation(spark, d, "ema(10) > ema(30)")


@query("sql_seeded_atr", chain(TR, {"tr": "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END"}, {"s": seen("tr")}, {"a": f"CASE WHEN tr IS NOT NULL THEN {seeded('s', 14, '(1.0 / 14)')} END"}, final=f"SELECT {PRICES} FROM @ WHERE a > 60000"))
def sql_seeded_atr(spark, d):
    return sql_relation(spark, d, "atr(14) > 60000")


@query("sql_candle_lookback", f"WITH {BARS} SELECT {PRICES} FROM bars QUALIFY row_number() OVER ({W}) > 14")
def sql_candle_lookback(spark, d):
    """Candlesticks have no value on the bars that they look back over, so a condition that all values meet drops these."""
    return sql_relation(spark, d, "cdlbreakaway(1) >= -200 and cdl2crows(1) >= -200").drop("__cdlbreakaway_0", "__cdl2crows_1")


# -- candlesticks that the tables hold no example of: made-up bars, in both forms

CALM = [(100, 101.5, 99.5, 101) if i % 2 else (101, 101.5, 99.5, 100) for i in range(14)]
MADE = {
    "cdl3starsinsouth": [(106, 106.1, 100, 103.5), (104.9, 105, 100.8, 103), (102.5, 102.55, 101.95, 102)],
    "cdlbreakaway": [(110, 110.2, 104.8, 105), (104, 104.2, 102.9, 103), (103, 103.1, 102, 102.5), (102.4, 102.6, 101, 101.2), (101, 104.8, 100.9, 104.5)],
    "cdlconcealbabyswall": [(110, 110, 106, 106), (106, 106, 103, 103), (102.5, 104, 101, 101.5), (105, 105.1, 100, 100.2)],
    "cdlidentical3crows": [(106, 106.1, 103, 103), (103, 103.1, 101, 101), (101, 101.1, 99, 99)],
    "cdlinneck": [(104, 104.2, 99.9, 100), (99, 100.2, 98.8, 100.02)],
    "cdlladderbottom": [(106, 106.2, 103.8, 104), (105, 105.2, 102.8, 103), (104, 104.2, 101.8, 102), (102, 103, 100.8, 101), (102.5, 104.5, 102.4, 104)],
    "cdlupsidegap2crows": [(100, 104, 99.9, 103.5), (104.9, 105.2, 104.1, 104.2), (105.1, 105.3, 103.6, 103.8)],
}
MADE_ROWS = [(name, dt.date(2026, 1, 1) + dt.timedelta(days=i), *map(float, bar), 1000.0) for name, tail in MADE.items() for i, bar in enumerate([*CALM, *tail, *CALM])]


def _register_made() -> None:
    base = literal_bars(MADE_ROWS)
    for name in MADE:

        def made(spark, d, name=name) -> DataFrame:
            bars = frame_of(spark, MADE_ROWS)
            got = apply(bars, {"filters": [{"property": {"fn": name, "args": [1]}, "op": "!=", "value": 0}]}, catalog=catalog_from_schema(bars))
            return got.select("symbol", "session", r4(f"__{name}_0").alias("value"))

        QUERIES[f"made_{name}"] = made
        SQL[f"made_{name}"] = f"SELECT * FROM ({INDICATOR_SQL[name].replace(BARS, base)}) WHERE value <> 0"


_register_made()
