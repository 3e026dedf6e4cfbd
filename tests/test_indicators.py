"""Indicators against plain re-computations, pinned warm-ups and pinned hits."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barsift import INDICATORS, apply, catalog_from_schema
from barsift.functions import kernels as K
from barsift.plans.planner import Context, Planner, column, run_stages
from tests import bars

CLOSE = {"col": "close"}
# Name -> arguments, leading nulls of each symbol.
WARM = {
    "wma": ([CLOSE, 14], 13), "trima": ([CLOSE, 14], 13), "kama": ([14], 14), "mom": ([CLOSE, 14], 14),
    "midprice": ([14], 13), "cci": ([14], 13), "willr": ([14], 13), "trange": ([14], 1), "ad": ([], 0), "adx": ([14], 27), "adxr": ([14], 40),
    "cmo": ([14], 14), "trix": ([14], 40), "stochrsi": ([14], 29), "apo": ([12], 25), "ppo": ([12], 25), "mfi": ([14], 14), "adosc": ([3], 9),
    "ultosc": ([14], 28), "obv": ([14], 0), "midpoint": ([14], 13), "t3": ([14], 78), "sar": ([14], 1), "accbands_upper": ([14], 13),
    "accbands_lower": ([14], 13), "ht_dcperiod": ([14], 32), "ht_dcphase": ([14], 63), "ht_trendline": ([14], 63), "macd": ([12], 33), "bbands_upper": ([20], 19),
    "bbands_lower": ([20], 19), "aroon": ([14], 14), "stoch_k": ([5, 3, 3], 8), "stoch_d": ([5, 3, 3], 8), "sma": ([CLOSE, 14], 13), "rmin": ([CLOSE, 14], 13),
    "rmax": ([CLOSE, 14], 13), "shift": ([CLOSE, 14], 14), "roc": ([CLOSE, 14], 14), "slope": ([CLOSE, 14], 13), "adr": ([CLOSE, 14], 13),
}
FIRST = {"ema": 0, "dema": 0, "tema": 0, "rsi": 1, "natr": 0, "rs_ratio": 13, "rs_momentum": 17}
SMA = {"ema": 13, "dema": 26, "tema": 39, "rsi": 14, "natr": 14, "rs_ratio": 17}


def compute(df, specs, seed="first"):
    """All calls as columns, sorted."""
    ctx = Context("symbol", "session", seed)
    planner = Planner(ctx, catalog_from_schema(df))
    named = {k: planner.operand(v) for k, v in specs.items()}
    out = run_stages(df, ctx).select(*map(column, df.columns), *[v.col.cast("double").alias(k) for k, v in named.items()])
    return out.toPandas().sort_values(["symbol", "session"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def varied(spark):
    return spark.createDataFrame(bars.three_series(True)).cache()


@pytest.fixture(scope="module")
def table(varied):
    specs = {k: {"fn": k, "args": a} for k, (a, _) in WARM.items()}
    specs |= {k: {"fn": k, "args": [CLOSE, 14]} for k in FIRST} | {"atr": {"fn": "atr", "args": [14]}}
    return compute(varied, specs)


def test_all_names():
    assert len(INDICATORS) == 75 and sum(n.startswith("cdl") for n in INDICATORS) == 26


def test_warm_up(table, varied):
    got = {}
    for name in [*WARM, *FIRST]:
        first = table.groupby("symbol")[name].apply(lambda x: int(x.notna().to_numpy().argmax()))
        after = table.groupby("symbol")[name].apply(lambda x: bool(x[x.notna().to_numpy().argmax() :].notna().all()))
        got[name] = set(first)
        assert after.all(), name
    want = {k: {w} for k, (_, w) in WARM.items()} | {k: {w} for k, w in FIRST.items()}
    assert got == want
    sma = compute(varied, {k: {"fn": k, "args": [CLOSE, 14]} for k in SMA}, "sma")
    assert {k: int(sma[sma.symbol == "BBB"][k].notna().to_numpy().argmax()) for k in SMA} == SMA


def one(table, symbol="BBB"):
    return table[table.symbol == symbol].reset_index(drop=True)


def same(a, b, tol=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    np.testing.assert_allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=tol, atol=tol)


def test_closed_forms(table):
    for s in ("AAA", "BBB", "CCC"):
        t = one(table, s)
        c, h, lo, v = t.close, t.high, t.low, t.volume
        same(t.sma, c.rolling(14).mean())
        same(t.wma, c.rolling(14).apply(lambda x: (x * np.arange(1, 15)).sum() / 105))
        same(t.trima, c.rolling(7).mean().rolling(8).mean())
        same(t.slope, c.rolling(14).apply(lambda x: np.polyfit(np.arange(14), x, 1)[0]), 1e-7)
        same(t.midprice, (h.rolling(14).max() + lo.rolling(14).min()) / 2)
        tp = (h + lo + c) / 3
        mad = tp.rolling(14).apply(lambda x: np.abs(x - x.mean()).mean())
        same(t.cci, (tp - tp.rolling(14).mean()) / (0.015 * mad), 1e-7)
        same(t.bbands_upper, c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0), 1e-7)
        same(t.apo, c.rolling(12).mean() - c.rolling(26).mean(), 1e-7)
        pc = c.shift()
        bp, tr = c - np.minimum(lo, pc), np.maximum(h, pc) - np.minimum(lo, pc)
        a = [bp.rolling(n).sum() / tr.rolling(n).sum() for n in (7, 14, 28)]
        same(t.ultosc, 100 * (4 * a[0] + 2 * a[1] + a[2]) / 7, 1e-7)
        up, down = (tp * v).where(tp > tp.shift(), 0.0), (tp * v).where(tp < tp.shift(), 0.0)
        up[0] = down[0] = np.nan
        same(t.mfi, 100 * up.rolling(14).sum() / (up.rolling(14).sum() + down.rolling(14).sum()), 1e-7)
        same(t.ema, c.ewm(span=14, adjust=False).mean())
        same(t.dema, 2 * c.ewm(span=14, adjust=False).mean() - c.ewm(span=14, adjust=False).mean().ewm(span=14, adjust=False).mean())
        full = pd.concat([h - lo, (h - pc).abs(), (lo - pc).abs()], axis=1).max(axis=1)
        same(t.atr, full.ewm(alpha=1 / 14, adjust=False).mean())
        same(t.natr, full.ewm(alpha=1 / 14, adjust=False).mean() / c * 100)
        same(t.adr, (full / c * 100).rolling(14).mean())


def test_z_scores(table):
    t = one(table)

    def z(x):
        sd = x.rolling(14).std(ddof=0)
        return (100 + 5 * (x - x.rolling(14).mean()) / sd).clip(80, 120)

    same(t.rs_ratio, z(t.close.ewm(span=5, adjust=False).mean()), 1e-6)
    same(t.rs_momentum, z(t.close.diff(4).ewm(span=3, adjust=False, ignore_na=False).mean()), 1e-6)


def test_pinned_hits(varied):
    def hits(name, op, x, *args):
        return apply(varied, {"filters": [{"property": {"fn": name, "args": list(args)}, "op": op, "value": x}]}, catalog=catalog_from_schema(varied))

    assert hits("cci", ">", 100, 14).count() == 179
    heads = hits("aroon", ">=", 0, 14).toPandas().sort_values(["symbol", "session"]).groupby("symbol").head(3)
    assert [round(x * 14 / 100, 9) for x in heads["__aroon_0"]] == [12, 11, 10, 8, 7, 6, 12, 11, 10]


def test_kernels_on_hard_input():
    flat, rise = np.full(60, 42.0), np.arange(1.0, 61.0)
    assert (K.cmo(flat, 14)[14:] == 0).all() and (K.rsi_wilder(rise, 14)[14:] == 100).all()
    assert (K.adx(flat, flat, flat, 14)[27:] == 0).all()
    assert np.allclose(K.adx(rise + 1, rise - 1, rise, 14)[27:], 100)
    assert (K.kama(flat, 14)[14:] == 42).all() and (K.stochrsi(flat, 14)[29:] == 0).all()
    assert np.allclose(K.t3(flat, 5)[24:], 42) and np.allclose(K.trix(flat, 5)[13:], 0)
    stop = K.sar(rise + 1, rise - 1)
    assert np.isnan(stop[0]) and (np.diff(stop[1:]) >= 0).all() and (stop[1:] < rise[1:]).all()
    for f in (K.cmo, K.rsi_wilder, K.kama, K.macd, K.trix, K.stochrsi, K.t3):
        assert len(f(np.zeros(0), 5)) == 0 and np.isnan(f(np.ones(3), 5)).all()
    wave = 100 + 5 * np.sin(2 * np.pi * np.arange(300) / 20)
    assert np.allclose(K.ht_dcperiod(wave)[150:], 20, atol=1)
    assert np.allclose(K.ht_trendline(wave)[150:], 100, atol=0.8)
    gap = np.array([np.nan, 1.0, np.nan, 3.0])
    same(K.ewm(gap, 0.5), pd.Series(gap).ewm(alpha=0.5, adjust=False).mean().where(~np.isnan(gap)))


def test_wilder_convergence():
    x, s = 42, []
    for _ in range(300):
        x = (x * 1103515245 + 12345) % 2**31
        s.append(100 + (x % 1000) / 100)
    d = pd.Series(s).diff()
    first = 100 - 100 / (1 + d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean() / (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean())
    assert np.abs(first.to_numpy() - K.rsi_wilder(np.array(s), 14))[112:].max() < 0.5


CRAFTED = {
    "S_ENGULF": [(100, 100.4, 99.6, 100.2), (99.5, 99.6, 99.0, 99.05), (99.0, 99.1, 98.5, 98.55), (98.0, 98.4, 97.6, 97.7), (97.0, 97.4, 96.6, 96.7), (97.2, 97.3, 96.6, 96.65), (96.5, 97.5, 96.4, 97.4)],
    "S_OUTSIDE": [(100, 100.5, 95, 95.5), (97, 97.5, 92, 92.5), (94, 94.5, 89, 89.5), (88.8, 97, 88.7, 96.5), (96.6, 98, 96, 97.5)],
    "S_GAP": [(10, 10.2, 9.8, 9.9), (10, 11, 9.9, 10.9), (11.2, 12, 11.1, 11.9), (11.5, 11.6, 10.2, 10.4)],
}
LONG = [(100, 101.5, 99.5, 101) if i % 2 else (101, 101.5, 99.5, 100) for i in range(14)]
LATE = {  # after 14 bars of body 1 and range 2: bars, and the value on the last of them
    "cdl2crows": ([(100, 104, 99.9, 103.9), (105, 105.5, 104.3, 104.4), (104.9, 105, 101.9, 102)], -100),
    "cdl3blackcrows": ([(100, 104, 99.9, 103), (102.5, 102.6, 101, 101), (102, 102.1, 99.5, 99.5), (101, 101.1, 98, 98)], -100),
    "cdl3whitesoldiers": ([(100, 102, 99.8, 102), (101, 103.5, 100.8, 103.5), (102.5, 105, 102.3, 105)], 100),
    "cdl3linestrike": ([(100, 102, 99.8, 102), (101, 103.5, 100.8, 103.5), (102.5, 105, 102.3, 105), (105.5, 105.6, 99, 99.5)], 100),
    "cdlbreakaway": ([(110, 110.2, 104.8, 105), (104, 104.2, 102.9, 103), (103, 103.1, 102, 102.5), (102.4, 102.6, 101, 101.2), (101, 104.8, 100.9, 104.5)], 100),
    "cdlgravestonedoji": ([(100, 103, 100, 100.05)], 100),
    "cdlhomingpigeon": ([(104, 104.2, 99.9, 100), (102, 102.2, 101.1, 101.2)], 100),
    "cdlidentical3crows": ([(106, 106.1, 103, 103), (103, 103.1, 101, 101), (101, 101.1, 99, 99)], -100),
    "cdlinneck": ([(104, 104.2, 99.9, 100), (99, 100.2, 98.8, 100.02)], -100),
    "cdlonneck": ([(104, 104.2, 99.5, 100), (99, 99.8, 98.8, 99.5)], -100),
    "cdlthrusting": ([(104, 104.2, 99.5, 100), (99, 101.8, 98.8, 101.5)], -100),
    "cdlkicking": ([(104, 104, 100, 100), (105, 108, 105, 108)], 100),
    "cdlkickingbylength": ([(104, 104, 99, 99), (105, 108, 105, 108)], -100),
    "cdlladderbottom": ([(106, 106.2, 103.8, 104), (105, 105.2, 102.8, 103), (104, 104.2, 101.8, 102), (102, 103, 100.8, 101), (102.5, 104.5, 102.4, 104)], 100),
    "cdlrisefall3methods": ([(100, 105.2, 99.8, 105), (104, 104.1, 103.4, 103.5), (103.5, 103.6, 102.9, 103), (103, 103.1, 102.4, 102.5), (102.8, 107, 102.7, 106.5)], 100),
    "cdlseparatinglines": ([(103, 103.2, 100.9, 101), (103, 106, 103, 105.8)], 100),
    "cdlstalledpattern": ([(100, 102.2, 99.8, 102), (101.5, 104, 101.3, 104), (103.9, 104.8, 103.7, 104.3)], -100),
    "cdltasukigap": ([(100, 102, 99.9, 101.5), (102.5, 104, 102.4, 103.8), (103.2, 103.4, 101.9, 102)], 100),
    "cdlunique3river": ([(104, 104.2, 99.9, 100), (103, 103.2, 98, 101), (99, 99.9, 98.9, 99.5)], 100),
    "cdlupsidegap2crows": ([(100, 104, 99.9, 103.5), (104.9, 105.2, 104.1, 104.2), (105.1, 105.3, 103.6, 103.8)], -100),
    "cdlconcealbabyswall": ([(110, 110, 106, 106), (106, 106, 103, 103), (102.5, 104, 101, 101.5), (105, 105.1, 100, 100.2)], 100),
    "cdl3starsinsouth": ([(106, 106.1, 100, 103.5), (104.9, 105, 100.8, 103), (102.5, 102.55, 101.95, 102)], 100),
}


def test_candles(spark):
    names = sorted(n for n in INDICATORS if n.startswith("cdl"))
    parts = [bars.walk("AAA", 11), bars.walk("BBB", 11, 50.0)] + [bars.walk(f"W{s}", s) for s in (11, 777, 2026, 31, 4242)]
    parts += [bars.candles(k, v) for k, v in CRAFTED.items()] + [bars.candles(f"L_{k}", LONG + v) for k, (v, _) in LATE.items()]
    got = compute(spark.createDataFrame(pd.concat(parts)), {n: {"fn": n, "args": [1]} for n in names})
    assert got[names].notna().all().all() and set(np.unique(got[names])) <= {-200, -100, -80, 0, 80, 100, 200}
    bar = {s: (g.session - dt.date(2026, 1, 1)).map(lambda d: d.days).to_numpy() for s, g in got.groupby("symbol")}

    def hits(symbol, name):
        x = got[got.symbol == symbol][name].to_numpy()
        return [(int(bar[symbol][i]), int(x[i])) for i in np.flatnonzero(x)]

    first = {s: hits(s, "cdlhikkake")[0] for s in ("AAA", "BBB", "W11", "W2026", "W31", "W4242", "W777")}
    assert first == {"AAA": (12, -100), "BBB": (12, -100), "W11": (12, -100), "W2026": (24, -100), "W31": (19, 100), "W4242": (6, -100), "W777": (13, -100)}
    assert hits("S_ENGULF", "cdlengulfing") == [(6, 100)] and hits("S_OUTSIDE", "cdlengulfing") == [(3, 100)]
    assert hits("S_OUTSIDE", "cdl3outside") == [(4, 100)] and hits("S_GAP", "cdlxsidegap3methods") == [(3, 100)]
    missing = {n: hits(f"L_{n}", n) for n, (v, want) in LATE.items() if (13 + len(v), want) not in hits(f"L_{n}", n)}
    assert not missing
    pinned = ("cdl3outside", "cdlengulfing", "cdlhikkake", "cdlxsidegap3methods")
    walks = [s for s in bar if s[0] == "W"]
    assert not [(s, n) for s in walks for n in names if n not in pinned and hits(s, n)]
