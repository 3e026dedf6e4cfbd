"""Candlestick patterns, from their published definitions, as window expressions.

A bar is compared with averages of the bars before it. Until a pattern's bars
and averages exist its value is 0; in the profile of SQL engines those bars have
no value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from barsift.functions.registry import indicator
from barsift.plans.planner import Context, Value, combine

OHLC = "open high low close"

# What is averaged, over how many bars before, times what.
SETTINGS = {
    "BodyLong": ("body", 10, 1.0),
    "BodyShort": ("body", 10, 1.0),
    "BodyDoji": ("range", 10, 0.1),
    "ShadowLong": ("body", 0, 1.0),
    "ShadowVeryShort": ("range", 10, 0.1),
    "Near": ("range", 5, 0.2),
    "Far": ("range", 5, 0.6),
    "Equal": ("range", 5, 0.05),
}


class Bar:
    """The bar ``k`` bars ago."""

    def __init__(self, ctx: Context, k: int):
        self.ctx, self.k = ctx, k
        self.open, self.high, self.low, self.close = (self._past(n) for n in OHLC.split())

    def _past(self, name: str) -> Column:
        x = self.ctx.number(name)
        return (self.ctx.lag(x, self.k) if self.k else self.ctx.over("now", lambda c: c, x)).col

    @property
    def top(self) -> Column:
        return F.greatest(self.open, self.close)

    @property
    def bottom(self) -> Column:
        return F.least(self.open, self.close)

    @property
    def body(self) -> Column:
        return F.abs(self.close - self.open)

    @property
    def upper(self) -> Column:
        return self.high - self.top

    @property
    def lower(self) -> Column:
        return self.bottom - self.low

    @property
    def white(self) -> Column:
        return self.close >= self.open

    @property
    def black(self) -> Column:
        return self.close < self.open

    @property
    def sign(self) -> Column:
        return F.when(self.white, 1).otherwise(-1)

    def than(self, setting: str) -> Column:
        """The setting's measure for this bar: an average over the bars before it."""
        kind, n, factor = SETTINGS[setting]
        if not n:
            return self.body * factor
        w = self.ctx.window.rowsBetween(-self.k - n, -self.k - 1)

        def mean(o, h, lo, c):
            x = F.abs(c - o) if kind == "body" else h - lo
            return F.when(F.count(x).over(w) == n, F.avg(x).over(w))

        return self.ctx.over(f"mean {kind} {n} before {self.k}", mean, *map(self.ctx.number, OHLC.split())).col * factor

    def long(self) -> Column:
        return self.body > self.than("BodyLong")

    def short(self) -> Column:
        return self.body < self.than("BodyShort")

    def bare_top(self) -> Column:
        return self.upper < self.than("ShadowVeryShort")

    def bare_foot(self) -> Column:
        return self.lower < self.than("ShadowVeryShort")

    def marubozu(self) -> Column:
        return both(self.long(), self.bare_top(), self.bare_foot())

    def above(self, other: Bar) -> Column:
        """Its body lies over the other's body."""
        return self.bottom > other.top

    def below(self, other: Bar) -> Column:
        return self.top < other.bottom


def both(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions)


def inside(x: Column, lo: Column, hi: Column) -> Column:
    return (x > lo) & (x < hi)


def around(x: Column, y: Column, by: Column) -> Column:
    return (x >= y - by) & (x <= y + by)


# Bars that SQL engines leave without a value at a series' start.
LOOKBACK = {
    "cdl2crows": 12, "cdl3blackcrows": 13, "cdl3linestrike": 8, "cdl3outside": 3, "cdl3starsinsouth": 12, "cdl3whitesoldiers": 12, "cdlbreakaway": 14, "cdlconcealbabyswall": 13, "cdlengulfing": 2,
    "cdlgravestonedoji": 10, "cdlhikkake": 5, "cdlhomingpigeon": 11, "cdlidentical3crows": 12, "cdlinneck": 11, "cdlkicking": 11, "cdlkickingbylength": 11, "cdlladderbottom": 14, "cdlonneck": 11,
    "cdlrisefall3methods": 14, "cdlseparatinglines": 11, "cdlstalledpattern": 12, "cdltasukigap": 7, "cdlthrusting": 11, "cdlunique3river": 12, "cdlupsidegap2crows": 12, "cdlxsidegap3methods": 2,
}


def looked_back(ctx: Context, name: str, v: Value) -> Value:
    """``v``, without a value on the first bars where the context is that of an SQL engine."""
    if not ctx.lookback:
        return v
    return combine(f"{name} looked back", lambda x, i: F.when(i >= LOOKBACK[name], x), v, ctx.index())


def pattern(name: str, bars: int):
    """Register a function of bars, oldest first, returning (condition, value)."""

    def put(f: Callable[..., tuple[Column, Column | int]]):
        @indicator(f"cdl{name}", "int", needs=OHLC, staged=True)
        def build(ctx: Context, _) -> Value:
            met, sign = f(*[Bar(ctx, k) for k in range(bars - 1, -1, -1)])
            return looked_back(ctx, f"cdl{name}", Value(F.when(met, sign).otherwise(0).cast("double"), 1, False, f"cdl{name}"))

        return f

    return put


@pattern("2crows", 3)
def _(a, b, c):
    return both(a.white, a.long(), b.black, b.above(a), c.black, inside(c.open, b.close, b.open), inside(c.close, a.open, a.close)), -100


@pattern("3blackcrows", 4)
def _(z, a, b, c):
    falling = both(z.high > a.close, a.close > b.close, b.close > c.close)
    return both(z.white, *[x.black & x.bare_foot() for x in (a, b, c)], inside(b.open, a.close, a.open), inside(c.open, b.close, b.open), falling), -100


@pattern("3linestrike", 4)
def _(a, b, c, d):
    same = both(a.sign == b.sign, b.sign == c.sign, d.sign == -c.sign)
    near = both(*[(y.open >= x.bottom - x.than("Near")) & (y.open <= x.top + x.than("Near")) for x, y in ((a, b), (b, c))])
    up = both(c.white, c.close > b.close, b.close > a.close, d.open > c.close, d.close < a.open)
    down = both(c.black, c.close < b.close, b.close < a.close, d.open < c.close, d.close > a.open)
    return same & near & (up | down), c.sign * 100


@pattern("3outside", 4)
def _(_z, a, b, c):
    up = both(b.white, a.black, b.close > a.open, b.open < a.close, c.close > b.close)
    down = both(b.black, a.white, b.open > a.close, b.close < a.open, c.close < b.close)
    return both(_z.open.isNotNull(), up | down), b.sign * 100


@pattern("3starsinsouth", 3)
def _(a, b, c):
    first = both(a.black, a.long(), a.lower > a.than("ShadowLong"))
    second = both(b.black, b.body < a.body, b.open > a.close, b.open <= a.high, b.low < a.close, b.low >= a.low, b.lower > b.than("ShadowVeryShort"))
    third = both(c.black, c.short(), c.bare_foot(), c.bare_top(), c.low > b.low, c.high < b.high)
    return first & second & third, 100


@pattern("3whitesoldiers", 3)
def _(a, b, c):
    rising = both(c.close > b.close, b.close > a.close)
    opens = both(*[(y.open > x.open) & (y.open <= x.close + x.than("Near")) for x, y in ((a, b), (b, c))])
    sized = both(b.body > a.body - a.than("Far"), c.body > b.body - b.than("Far"), c.body > c.than("BodyShort"))
    return both(*[x.white & x.bare_top() for x in (a, b, c)], rising, opens, sized), 100


@pattern("breakaway", 5)
def _(a, b, c, d, e):
    colours = both(a.long(), a.sign == b.sign, b.sign == d.sign, d.sign == -e.sign)
    down = both(a.black, b.below(a), c.high < b.high, c.low < b.low, d.high < c.high, d.low < c.low, inside(e.close, b.open, a.close))
    up = both(a.white, b.above(a), c.high > b.high, c.low > b.low, d.high > c.high, d.low > c.low, inside(e.close, a.close, b.open))
    return colours & (down | up), e.sign * 100


@pattern("concealbabyswall", 4)
def _(a, b, c, d):
    plain = both(*[x.bare_top() & x.bare_foot() for x in (a, b)])
    third = both(c.below(b), c.upper > c.than("ShadowVeryShort"), c.high > b.close)
    return both(a.black, b.black, c.black, d.black, plain, third, d.high > c.high, d.low < c.low), 100


@pattern("engulfing", 3)
def _(_z, a, b):
    up = both(b.white, a.black, ((b.close >= a.open) & (b.open < a.close)) | ((b.close > a.open) & (b.open <= a.close)))
    down = both(b.black, a.white, ((b.open >= a.close) & (b.close < a.open)) | ((b.open > a.close) & (b.close <= a.open)))
    return both(_z.open.isNotNull(), up | down), b.sign * F.when((b.open != a.close) & (b.close != a.open), 100).otherwise(80)


@pattern("gravestonedoji", 1)
def _(a):
    return both(a.body <= a.than("BodyDoji"), a.bare_foot(), a.upper > a.than("ShadowVeryShort")), 100


@pattern("hikkake", 6)
def _(*bars):
    """A false break of an inside bar, confirmed within three bars by a close beyond it."""
    bars = bars[::-1]  # by age

    def sign_at(k: int) -> Column:
        now, mid, out = bars[k : k + 3]
        held = (mid.high < out.high) & (mid.low > out.low)
        return F.when(held & (now.high < mid.high) & (now.low < mid.low), 1).when(held & (now.high > mid.high) & (now.low > mid.low), -1).otherwise(0)

    def beyond(k: int, since: int) -> Column:
        """The bar k ago closes beyond the inside bar of the pattern since bars ago."""
        mid, s = bars[since + 1], sign_at(since)
        return ((s == 1) & (bars[k].close > mid.high)) | ((s == -1) & (bars[k].close < mid.low))

    confirmed = F.lit(0)
    for age in (3, 2, 1):
        quiet = [sign_at(k) == 0 for k in range(1, age)] + [~beyond(k, age) for k in range(1, age)]
        confirmed = F.when(both(sign_at(age) != 0, *quiet, beyond(0, age)), 2 * sign_at(age)).otherwise(confirmed)
    value = F.when(sign_at(0) != 0, sign_at(0)).otherwise(confirmed)
    return bars[5].open.isNotNull(), value * 100


@pattern("homingpigeon", 2)
def _(a, b):
    return both(a.black, b.black, a.long(), b.body <= b.than("BodyShort"), b.open < a.open, b.close > a.close), 100


@pattern("identical3crows", 3)
def _(a, b, c):
    opens = both(around(b.open, a.close, a.than("Equal")), around(c.open, b.close, b.than("Equal")))
    return both(*[x.black & x.bare_foot() for x in (a, b, c)], a.close > b.close, b.close > c.close, opens), -100


def after_long_black(a: Bar, b: Bar) -> Column:
    return both(a.black, a.long(), b.white, b.open < a.low)


@pattern("inneck", 2)
def _(a, b):
    return both(after_long_black(a, b), b.close <= a.close + a.than("Equal"), b.close >= a.close), -100


@pattern("onneck", 2)
def _(a, b):
    return both(after_long_black(a, b), around(b.close, a.low, a.than("Equal"))), -100


@pattern("thrusting", 2)
def _(a, b):
    return both(after_long_black(a, b), b.close > a.close + a.than("Equal"), b.close <= a.close + a.body * 0.5), -100


def kicks(a: Bar, b: Bar) -> Column:
    gap = (a.black & (b.low > a.high)) | (a.white & (b.high < a.low))
    return both(a.sign == -b.sign, a.marubozu(), b.marubozu(), gap)


@pattern("kicking", 2)
def _(a, b):
    return kicks(a, b), b.sign * 100


@pattern("kickingbylength", 2)
def _(a, b):
    return kicks(a, b), F.when(b.body > a.body, b.sign).otherwise(a.sign) * 100


@pattern("ladderbottom", 5)
def _(a, b, c, d, e):
    falling = both(a.open > b.open, b.open > c.open, a.close > b.close, b.close > c.close)
    return both(a.black, b.black, c.black, falling, d.black, d.upper > d.than("ShadowVeryShort"), e.white, e.open > d.open, e.close > d.high), 100


@pattern("risefall3methods", 5)
def _(a, b, c, d, e):
    s = a.sign
    colours = both(b.sign == -s, c.sign == -s, d.sign == -s, e.sign == s)
    held = both(*[(x.bottom < a.high) & (x.top > a.low) for x in (b, c, d)])
    steps = both(c.close * s < b.close * s, d.close * s < c.close * s, e.open * s > d.close * s, e.close * s > a.close * s)
    return both(a.long(), b.short(), c.short(), d.short(), e.long(), colours, held, steps), s * 100


@pattern("separatinglines", 2)
def _(a, b):
    belt = (b.white & b.bare_foot()) | (b.black & b.bare_top())
    return both(a.sign == -b.sign, around(b.open, a.open, a.than("Equal")), b.long(), belt), b.sign * 100


@pattern("stalledpattern", 3)
def _(a, b, c):
    rising = both(a.white, b.white, c.white, c.close > b.close, b.close > a.close)
    second = both(a.long(), b.long(), b.bare_top(), b.open > a.open, b.open <= a.close + a.than("Near"))
    return both(rising, second, c.short(), c.open >= b.close - c.body - b.than("Near")), -100


@pattern("tasukigap", 3)
def _(a, b, c):
    near = F.abs(b.body - c.body) < b.than("Near")
    up = both(b.above(a), b.white, c.black, inside(c.open, b.open, b.close), c.close < b.open, c.close > a.top)
    down = both(b.below(a), b.black, c.white, inside(c.open, b.close, b.open), c.close > b.open, c.close < a.bottom)
    return near & (up | down), b.sign * 100


@pattern("unique3river", 3)
def _(a, b, c):
    return both(a.long(), a.black, b.black, b.close > a.close, b.open <= a.open, b.low < a.low, c.short(), c.white, c.open > b.low), 100


@pattern("upsidegap2crows", 3)
def _(a, b, c):
    return both(a.white, a.long(), b.black, b.body <= b.than("BodyShort"), b.above(a), c.black, c.open > b.open, c.close < b.close, c.close > a.close), -100


@pattern("xsidegap3methods", 3)
def _(a, b, c):
    gap = (a.white & b.above(a)) | (a.black & b.below(a))
    return both(a.sign == b.sign, b.sign == -c.sign, inside(c.open, b.bottom, b.top), inside(c.close, a.bottom, a.top), gap), a.sign * 100
