"""Small deterministic price tables.

Fixed values: the price formulas and the seeds of the walks are those on which the
pinned facts of the tests hold (warm-ups, hit counts, bars of candlesticks).
"""

import datetime as dt

import numpy as np
import pandas as pd

T0 = dt.date(2026, 1, 1)


def table(symbol, closes, *, open=lambda i, c: c - 0.5, high=lambda i, c: c + 1.0, low=lambda i, c: c - 1.0, volume=lambda i: 1000.0):
    n = len(closes)
    return pd.DataFrame(
        {
            "symbol": [symbol] * n,
            "session": [T0 + dt.timedelta(days=i) for i in range(n)],
            "open": [open(i, c) for i, c in enumerate(closes)],
            "high": [high(i, c) for i, c in enumerate(closes)],
            "low": [low(i, c) for i, c in enumerate(closes)],
            "close": [float(c) for c in closes],
            "volume": [volume(i) for i in range(n)],
        }
    )


def trend_and_flat():
    return pd.concat([table("AAA", [10.0 + i for i in range(60)]), table("BBB", [50.0] * 60)])


def up_and_down():
    return pd.concat([table("AAA", [10.0 + i for i in range(60)]), table("BBB", [60.0 - i for i in range(60)])])


def three_series(varied: bool):
    n = 300
    series = {"AAA": [10.0 + 0.05 * i for i in range(n)], "BBB": [50.0 + 8.0 * (i % 9 - 4) + 0.1 * i for i in range(n)], "CCC": [30.0 + 0.25 * (i % 7) for i in range(n)]}
    wide = {"high": lambda i, c: c + 1.0 + 0.3 * ((2 * i) % 5), "low": lambda i, c: c - 1.0 - 0.3 * ((3 * i) % 5)} if varied else {}
    return pd.concat([table(s, x, open=lambda i, c: c - 0.2, **wide) for s, x in series.items()])


def walk(symbol, seed, shift=0.0):
    """A seeded random walk of 150 bars, rounded to cents."""
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 2, 150))
    o = np.round(close - rng.uniform(0.5, 1.5, 150), 2)
    h = np.round(np.maximum(o, close) + rng.uniform(0.2, 2.0, 150), 2)
    lo = np.round(np.minimum(o, close) - rng.uniform(0.2, 2.0, 150), 2)
    return candles(symbol, list(zip(o, h, lo, np.round(close, 2), strict=True)), shift)


def candles(symbol, rows, shift=0.0):
    o, h, lo, c = (np.array(x, float) + shift for x in zip(*rows, strict=True))
    return pd.DataFrame({"symbol": symbol, "session": [T0 + dt.timedelta(days=i) for i in range(len(o))], "open": o, "high": h, "low": lo, "close": c, "volume": 1000.0})
