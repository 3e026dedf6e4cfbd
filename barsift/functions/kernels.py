"""Path-dependent series, in numpy: plain functions of one partition's values in order.

NaN stands for a missing value, in and out. Inputs may begin with missing
values; each kernel starts at the first bar where all its inputs are present,
and a missing value inside the series gives a missing output there.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np

NAN = float("nan")
TURN = 2 * math.pi


def _first(*xs: np.ndarray) -> int:
    """Number of leading bars where some input is missing."""
    ok = ~np.isnan(np.vstack(xs)).any(0)
    return int(ok.argmax()) if ok.any() else len(xs[0])


def _after(n: int, body: np.ndarray, length: int) -> np.ndarray:
    out = np.full(length, NAN)
    out[n : n + len(body)] = body
    return out


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean seeded with the first value. Across a gap the old value's weight decays by one step a bar, and the weights are then brought to sum 1."""
    start = _first(x)
    body = x[start:]
    keep = 1 - alpha
    if not np.isnan(body).any():
        return _after(start, np.fromiter(accumulate(body.tolist(), lambda a, v: keep * a + alpha * v), float, len(body)), len(x))
    out, mean, weight = [], NAN, 1.0
    for v in body.tolist():
        weight *= keep
        if v != v:
            out.append(NAN)
            continue
        mean = v if mean != mean else (weight * mean + alpha * v) / (weight + alpha)
        weight = 1.0
        out.append(mean)
    return _after(start, np.array(out), len(x))


def smoothed(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Exponential mean seeded with the mean of the first n values, at bar n - 1."""
    start = _first(x)
    body = x[start:]
    if len(body) < n:
        return np.full(len(x), NAN)
    seed = float(body[:n].mean())
    return _after(start + n - 1, np.fromiter(accumulate(body[n:].tolist(), lambda a, v: a + alpha * (v - a), initial=seed), float, len(body) - n + 1), len(x))


def ema_sma(x: np.ndarray, n: int) -> np.ndarray:
    return smoothed(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smoothed(x, n, 1 / n)


def ema(x, n, seed):
    return ewm(x, 2 / (n + 1)) if seed == "first" else ema_sma(x, n)


def mean_wilder(x, n, seed):
    return ewm(x, 1 / n) if seed == "first" else wilder(x, n)


def _dm_tr(high, low, close):
    up, down = np.diff(high), -np.diff(low)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    tr = np.maximum(high[1:], close[:-1]) - np.minimum(low[1:], close[:-1])
    return plus, minus, tr


def _decayed(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's running sum: n - 1 values summed, then s - s / n + x."""
    seed = float(x[: n - 1].sum())
    return np.fromiter(accumulate(x[n - 1 :].tolist(), lambda s, v: s - s / n + v, initial=seed), float, len(x) - n + 2)[1:]


def adx(high, low, close, n):
    """Directional index smoothed by Wilder's mean; first value at bar 2n - 1."""
    start = _first(high, low, close)
    length = len(high)
    h, lo, c = high[start:], low[start:], close[start:]
    if len(h) < 2 * n:
        return np.full(length, NAN)
    if n == 1:
        plus, minus, tr = _dm_tr(h, lo, c)
    else:
        plus, minus, tr = (_decayed(x, n) for x in _dm_tr(h, lo, c))
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(tr > 0, 100 * plus / tr, 0.0), np.where(tr > 0, 100 * minus / tr, 0.0)
        dx = np.where(a + b > 0, 100 * np.abs(a - b) / (a + b), NAN)
    # a bar without movement repeats the index before it
    for i in range(len(dx)):
        if dx[i] != dx[i]:
            dx[i] = dx[i - 1] if i else 0.0
    out = wilder(dx, n)
    return _after(start + length - start - len(dx), out, length)


def adxr(high, low, close, n):
    x = adx(high, low, close, n)
    out = np.full(len(x), NAN)
    if len(x) >= n:
        out[n - 1 :] = (x[n - 1 :] + x[: len(x) - n + 1]) / 2
    return out


def kama(x, n):
    """Kaufman's adaptive mean, fast 2, slow 30; seeded with bar n - 1, first output at bar n."""
    start = _first(x)
    body = x[start:]
    out = np.full(len(x), NAN)
    if len(body) <= n:
        return out
    moves = np.concatenate([[0.0], np.cumsum(np.abs(np.diff(body)))])
    noise = moves[n:] - moves[:-n]
    change = np.abs(body[n:] - body[:-n])
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where((noise <= change) | (noise <= 0), 1.0, change / noise)
    k = (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    mean = float(body[n - 1])
    vals = []
    for v, a in zip(body[n:].tolist(), k.tolist(), strict=True):
        mean += a * (v - mean)
        vals.append(mean)
    out[start + n :] = vals
    return out


def macd(x, n, slow=26, signal=9):
    """MACD line: both means begin at bar slow - 1, output once the signal would."""
    fast, slow = min(n, slow), max(n, slow)
    start = _first(x)
    body = x[start:]
    if len(body) < slow + signal - 1:
        return np.full(len(x), NAN)
    quick = ema_sma(body[slow - fast :], fast)[fast - 1 :]
    line = quick - ema_sma(body, slow)[slow - 1 :]
    return _after(start + slow + signal - 2, line[signal - 1 :], len(x))


def cmo(x, n):
    """Chande momentum on Wilder's means of gains and losses; no movement gives 0."""
    d = np.diff(x, prepend=NAN)
    g, lo = wilder(np.where(np.isnan(d), NAN, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), NAN, np.maximum(-d, 0)), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(g + lo == 0, 0.0, 100 * (g - lo) / (g + lo))


def rsi_wilder(x, n):
    """RSI on Wilder's means seeded with simple means; no movement gives 0."""
    d = np.diff(x, prepend=NAN)
    g, lo = wilder(np.where(np.isnan(d), NAN, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), NAN, np.maximum(-d, 0)), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(g + lo == 0, 0.0, 100 * g / (g + lo))


def trix(x, n):
    """One-bar change of a triple exponential mean, in percent."""
    e = ema_sma(ema_sma(ema_sma(x, n), n), n)
    before = np.concatenate([[NAN], e[:-1]])
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(before == 0, np.where(np.isnan(e), NAN, 0.0), 100 * (e / before - 1))


def stochrsi(x, n, fastk=14, fastd=3):
    """Fast %K of the RSI over ``fastk`` bars, once %D would exist; a flat window gives 0."""
    r = rsi_wilder(x, n)
    start = _first(r)
    body = r[start:]
    out = np.full(len(x), NAN)
    if len(body) >= fastk + fastd - 1:
        w = np.lib.stride_tricks.sliding_window_view(body, fastk)
        lo, hi = w.min(1), w.max(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            k = np.where(hi > lo, 100 * (body[fastk - 1 :] - lo) / (hi - lo), 0.0)
        out[start + fastk - 1 + fastd - 1 :] = k[fastd - 1 :]
    return out


def adosc(ad, n, slow=10):
    """Difference of two means of the accumulation line, both seeded with its first value."""
    out = ewm(ad, 2 / (n + 1)) - ewm(ad, 2 / (slow + 1))
    out[: _first(ad) + max(n, slow) - 1] = NAN
    return out


def t3(x, n, v=0.7):
    """Tillson's T3 of six chained exponential means."""
    e, chain = x, []
    for _ in range(6):
        e = ema_sma(e, n)
        chain.append(e)
    c1, c2, c3 = -(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3
    return c1 * chain[5] + c2 * chain[4] + c3 * chain[3] + (1 + 3 * v + v**3 + 3 * v**2) * chain[2]


def sar(high, low, step=0.02, most=0.2):
    """Wilder's parabolic stop; the first side is that of the first bar's directional movement."""
    start = _first(high, low)
    h, lo = high[start:].tolist(), low[start:].tolist()
    out = [NAN] * len(high)
    if len(h) < 2:
        return np.array(out)
    up, down = h[1] - h[0], lo[0] - lo[1]
    long = not (down > up and down > 0)
    stop, peak = (lo[0], h[1]) if long else (h[0], lo[1])
    af = step
    for i in range(1, len(h)):
        before = slice(max(0, i - 1), i + 1) if i > 1 else slice(1, 2)
        hi2, lo2 = max(h[before]), min(lo[before])
        if long:
            if lo[i] <= stop:
                long, stop = False, max(peak, hi2)
                out[start + i] = stop
                af, peak = step, lo[i]
                stop = max(stop + af * (peak - stop), hi2)
            else:
                out[start + i] = stop
                if h[i] > peak:
                    peak, af = h[i], min(af + step, most)
                stop = min(stop + af * (peak - stop), lo2)
        elif h[i] >= stop:
            long, stop = True, min(peak, lo2)
            out[start + i] = stop
            af, peak = step, h[i]
            stop = min(stop + af * (peak - stop), lo2)
        else:
            out[start + i] = stop
            if lo[i] < peak:
                peak, af = lo[i], min(af + step, most)
            stop = max(stop + af * (peak - stop), hi2)
    return np.array(out)


def _hilbert(x: np.ndarray):
    """Ehlers' homodyne discriminator: smoothed price, and period and smoothed period at each bar. Plain floats, as each bar needs the one before."""
    n = len(x)
    smooth = np.zeros(n)
    smooth[3:] = (4 * x[3:] + 3 * x[2:-1] + 2 * x[1:-2] + x[:-3]) / 10
    s, det, q1, i1 = smooth.tolist(), [0.0] * n, [0.0] * n, [0.0] * n
    period, steady = [0.0] * n, [0.0] * n
    i2 = q2 = re = im = 0.0
    a, b, atan = 0.0962, 0.5769, math.atan
    for i in range(12, n):
        last = period[i - 1]
        k = 0.075 * last + 0.54
        det[i] = (a * (s[i] - s[i - 6]) + b * (s[i - 2] - s[i - 4])) * k
        q1[i] = (a * (det[i] - det[i - 6]) + b * (det[i - 2] - det[i - 4])) * k
        i1[i] = det[i - 3]
        ji = (a * (i1[i] - i1[i - 6]) + b * (i1[i - 2] - i1[i - 4])) * k
        jq = (a * (q1[i] - q1[i - 6]) + b * (q1[i - 2] - q1[i - 4])) * k
        was_i, was_q = i2, q2
        i2 = 0.2 * (i1[i] - jq) + 0.8 * i2
        q2 = 0.2 * (q1[i] + ji) + 0.8 * q2
        re = 0.2 * (i2 * was_i + q2 * was_q) + 0.8 * re
        im = 0.2 * (i2 * was_q - q2 * was_i) + 0.8 * im
        p = TURN / atan(im / re) if re and im else last
        if p > 1.5 * last:
            p = 1.5 * last
        if p < 0.67 * last:
            p = 0.67 * last
        p = 6.0 if p < 6 else 50.0 if p > 50 else p
        period[i] = 0.2 * p + 0.8 * last
        steady[i] = 0.33 * period[i] + 0.67 * steady[i - 1]
    return smooth, np.array(period), np.array(steady)


def _cycle(x: np.ndarray, warm: int, value) -> np.ndarray:
    start = _first(x)
    body = x[start:]
    out = np.full(len(x), NAN)
    if len(body) > warm:
        out[start + warm :] = value(body)[warm:]
    return out


def ht_dcperiod(x):
    return _cycle(x, 32, lambda b: _hilbert(b)[2])


def ht_dcphase(x):
    """Phase of the dominant cycle, in degrees."""

    def value(b):
        s, _, steady = _hilbert(b)
        out = np.zeros(len(b))
        for i in range(12, len(b)):
            span = int(steady[i] + 0.5)
            j = np.arange(span)
            past = s[np.maximum(i - j, 0)] * (i - j >= 0)
            angle = 2 * np.pi * j / max(span, 1)
            real, imag = float((np.sin(angle) * past).sum()), float((np.cos(angle) * past).sum())
            if abs(imag) > 0:
                phase = np.degrees(np.arctan(real / imag))
            else:
                phase = 90.0 if real > 0 else -90.0 if real < 0 else 0.0
            phase += 90
            if steady[i]:
                phase += 360 / steady[i]
            if imag < 0:
                phase += 180
            out[i] = phase - 360 if phase > 315 else phase
        return out

    return _cycle(x, 63, value)


def ht_trendline(x):
    """Mean price over the dominant cycle, smoothed over four bars."""

    def value(b):
        steady = _hilbert(b)[2]
        sums = np.concatenate([[0.0], np.cumsum(b)])
        at = np.arange(len(b))
        span = (steady + 0.5).astype(np.int64)
        mean = np.where(span > 0, (sums[at + 1] - sums[np.maximum(0, at + 1 - span)]) / np.maximum(span, 1), b)
        out = mean.copy()
        out[3:] = (4 * mean[3:] + 3 * mean[2:-1] + 2 * mean[1:-2] + mean[:-3]) / 10
        return out

    return _cycle(x, 63, value)


#: What the planner may ask for by name: function of (inputs..., parameters...).
KERNELS = {f.__name__: f for f in (adosc, adx, adxr, cmo, ema, ema_sma, ewm, ht_dcperiod, ht_dcphase, ht_trendline, kama, macd, mean_wilder, rsi_wilder, sar, stochrsi, t3, trix)}
