"""Builders of the technical indicators. Importing this module fills the registry.

Windows are Spark window functions over the partition in order; only what
depends on its own past (exponential means and the like) is a kernel. ``full``
windows give null until they hold n values, so warm-up rows are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barsift.functions.registry import indicator
from barsift.plans.planner import Context, Value, combine, ieee_div

HLC, OHLC, HLCV = "high low close", "open high low close", "high low close volume"

# The relative-strength series.
RS_SPAN, RS_LAG, RS_LEAD_SPAN, RS_SCALE, RS_FLAT = 5, 4, 3, 5.0, 1e-6


def prices(ctx: Context, *names: str) -> list[Value]:
    return [ctx.number(n) for n in names]


def lagged(ctx: Context, x: Value, n: int = 1) -> Value:
    return ctx.lag(x, n)


def true_range(ctx: Context) -> Value:
    """Largest of the bar's range and its reach from the last close; the first bar has its range."""
    h, lo, c = prices(ctx, "high", "low", "close")
    return combine("tr", lambda h, lo, pc: F.greatest(h - lo, F.abs(h - pc), F.abs(pc - lo)), h, lo, lagged(ctx, c))


def zero_if_flat(label: str, top: Value, bottom: Value, flat: float = 0.0) -> Value:
    """top / bottom, ``flat`` where the bottom is 0, null where either is."""
    return combine(label, lambda a, b: F.when(a.isNull() | b.isNull(), None).when(b == 0, F.lit(flat)).otherwise(a / b), top, bottom)


def running(ctx: Context, label: str, x: Value) -> Value:
    """Running sum; null where the addend is."""
    w = ctx.window.rowsBetween(-(2**63), 0)
    return ctx.over(f"running {label}", lambda c: F.when(c.isNotNull(), F.sum(c).over(w)), x)


def masked(ctx: Context, x: Value, n: int) -> Value:
    """Null on the partition's first n bars."""
    return combine(f"from{n}", lambda c, i: F.when(i >= n, c), x, ctx.index())


# -- means and their kin


@indicator("sma", "expr", "int")
def sma(ctx, e, n):
    return ctx.full("avg", e, n)


@indicator("rmin", "expr", "int")
def rmin(ctx, e, n):
    return ctx.full("min", e, n)


@indicator("rmax", "expr", "int")
def rmax(ctx, e, n):
    return ctx.full("max", e, n)


@indicator("shift", "expr", "int")
def shift(ctx, e, n):
    return ctx.lag(e, n)


@indicator("ema", "expr", "int")
def ema(ctx, e, n):
    return ctx.kernel("ema", [e], n, ctx.seed)


@indicator("dema", "expr", "int")
def dema(ctx, e, n):
    one = ema(ctx, e, n)
    return 2 * one - ema(ctx, one, n)


@indicator("tema", "expr", "int")
def tema(ctx, e, n):
    one = ema(ctx, e, n)
    two = ema(ctx, one, n)
    return 3 * one - 3 * two + ema(ctx, two, n)


@indicator("wma", "expr", "int")
def wma(ctx, e, n):
    """Weights 1 to n: the sum over (bar number * value) less that of the bars before, by two sums."""
    i = ctx.index()
    return (ctx.full("sum", i * e, n) - (i - n) * ctx.full("sum", e, n)) / (n * (n + 1) / 2)


@indicator("trima", "expr", "int")
def trima(ctx, e, n):
    a = (n + 1) // 2
    return ctx.full("avg", ctx.full("avg", e, a), n - a + 1)


@indicator("slope", "expr", "int")
def slope(ctx, e, n):
    """Least-squares slope against the bar number."""
    w = ctx.rows(n)
    return ctx.over(f"slope{n}", lambda c, i: F.when((F.count(c).over(w) == n) & F.lit(n > 1), F.regr_slope(c, i).over(w)), combine("double", lambda c: c.cast("double"), e), ctx.index())


@indicator("roc", "expr", "int")
def roc(ctx, e, n):
    return (e / ctx.lag(e, n) - 1) * 100


@indicator("mom", "expr", "int")
def mom(ctx, e, n):
    return e - ctx.lag(e, n)


# -- ranges


@indicator("atr", "int", needs=HLC)
def atr(ctx, n):
    tr = true_range(ctx)
    if ctx.seed == "sma":
        # the mean of n ranges that have a bar before them
        tr = masked(ctx, tr, 1)
    return ctx.kernel("mean_wilder", [tr], n, ctx.seed)


@indicator("natr", "expr", "int", needs=HLC)
def natr(ctx, _, n):
    return atr(ctx, n) / ctx.column("close") * 100


@indicator("adr", "expr", "int", needs=HLC)
def adr(ctx, _, n):
    return ctx.full("avg", true_range(ctx) / ctx.column("close") * 100, n)


@indicator("trange", "int", needs=HLC)
def trange(ctx, _):
    return combine("after first", lambda t, pc: F.when(pc.isNotNull(), t), true_range(ctx), lagged(ctx, ctx.number("close")))


# -- oscillators


@indicator("rsi", "expr", "int")
def rsi(ctx, e, n):
    if ctx.seed == "sma":
        return ctx.kernel("rsi_wilder", [e], n)
    d = e - ctx.lag(e)
    up = combine("gain", lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))), d)
    down = combine("loss", lambda c: F.when(c.isNotNull(), F.greatest(-c, F.lit(0.0))), d)
    gain, loss = (ctx.kernel("ewm", [x], 1 / n) for x in (up, down))
    return combine("rsi", lambda g, lo: F.when(lo == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + ieee_div(g, lo))), gain, loss)


def z_score(ctx: Context, x: Value, n: int) -> Value:
    """100 plus five standard scores within the last n bars, held to 80 and 120; a flat window is 100."""
    sd, mean = ctx.full("std", x, n), ctx.full("avg", x, n)

    def f(x, sd, mean):
        z = F.when(sd < RS_FLAT, F.lit(0.0)).otherwise(ieee_div(x - mean, sd))
        return F.when(sd.isNotNull() & z.isNotNull(), F.greatest(F.lit(80.0), F.least(F.lit(120.0), 100.0 + RS_SCALE * z)))

    return combine("z", f, x, sd, mean)


@indicator("rs_ratio", "expr", "int")
def rs_ratio(ctx, e, n):
    return z_score(ctx, ema(ctx, e, RS_SPAN), n)


@indicator("rs_momentum", "expr", "int")
def rs_momentum(ctx, e, n):
    return z_score(ctx, ema(ctx, e - ctx.lag(e, RS_LAG), RS_LEAD_SPAN), n)


@indicator("midprice", "int", needs="high low")
def midprice(ctx, n):
    h, lo = prices(ctx, "high", "low")
    return (ctx.full("max", h, n) + ctx.full("min", lo, n)) / 2


@indicator("cci", "int", needs=HLC)
def cci(ctx, n):
    """Distance of the typical price from its mean, in mean absolute deviations; a flat window is 0."""
    h, lo, c = prices(ctx, "high", "low", "close")
    typical = (h + lo + c) / 3
    w = ctx.rows(n)

    def spread(t: Column) -> Column:
        seen = F.collect_list(t).over(w)
        mean = F.avg(t).over(w)
        return F.when(F.count(t).over(w) == n, F.aggregate(seen, F.lit(0.0), lambda s, x: s + F.abs(x - mean)) / n)

    mad, mean = ctx.over(f"mad{n}", spread, typical), ctx.full("avg", typical, n)
    return combine("cci", lambda t, m, d: F.when(d.isNull(), None).when(d == 0, F.lit(0.0)).otherwise((t - m) / (0.015 * d)), typical, mean, mad)


@indicator("willr", "int", needs=HLC)
def willr(ctx, n):
    h, lo, c = prices(ctx, "high", "low", "close")
    top, bottom = ctx.full("max", h, n), ctx.full("min", lo, n)
    return -100 * (top - c) / (top - bottom)


def accumulation(ctx: Context) -> Value:
    h, lo, c, v = prices(ctx, *HLCV.split())
    flow = combine("clv", lambda h, lo, c, v: F.when(h != lo, ((c - lo) - (h - c)) / (h - lo)).otherwise(0.0) * v, h, lo, c, v)
    return running(ctx, "ad", flow)


@indicator("ad", needs=HLCV)
def ad(ctx):
    return accumulation(ctx)


# -- names with columns of their own in the result


@indicator("adx", "int", needs=HLC, staged=True)
def adx(ctx, n):
    return ctx.kernel("adx", prices(ctx, "high", "low", "close"), n)


@indicator("adxr", "int", needs=HLC, staged=True)
def adxr(ctx, n):
    return ctx.kernel("adxr", prices(ctx, "high", "low", "close"), n)


@indicator("kama", "int", needs="close", staged=True)
def kama(ctx, n):
    return ctx.kernel("kama", prices(ctx, "close"), n)


@indicator("macd", "int", needs="close", staged=True)
def macd(ctx, n):
    return ctx.kernel("macd", prices(ctx, "close"), n)


def band(ctx: Context, n: int, side: int) -> Value:
    c = ctx.number("close")
    return ctx.full("avg", c, n) + 2 * side * ctx.full("std", c, n)


@indicator("bbands_upper", "int", needs="close", staged=True)
def bbands_upper(ctx, n):
    return band(ctx, n, 1)


@indicator("bbands_lower", "int", needs="close", staged=True)
def bbands_lower(ctx, n):
    return band(ctx, n, -1)


@indicator("aroon", "int", needs="high low", staged=True)
def aroon(ctx, n):
    """100 * (n - bars since the highest high of n + 1 bars, the latest of equals) / n."""
    w = ctx.rows(n + 1)
    h = ctx.number("high")
    return ctx.over(f"aroon{n}", lambda h, i: F.when(F.count(h).over(w) == n + 1, 100.0 * (n - (i - F.max(F.struct(h.alias("h"), i.alias("i"))).over(w).getField("i"))) / n), h, ctx.index())


@indicator("cmo", "int", needs="close", staged=True)
def cmo(ctx, n):
    return ctx.kernel("cmo", prices(ctx, "close"), n)


@indicator("trix", "int", needs="close", staged=True)
def trix(ctx, n):
    return ctx.kernel("trix", prices(ctx, "close"), n)


@indicator("stochrsi", "int", needs="close", staged=True)
def stochrsi(ctx, n):
    return ctx.kernel("stochrsi", prices(ctx, "close"), n)


def two_means(ctx: Context, n: int) -> tuple[Value, Value]:
    c, (fast, slow) = ctx.number("close"), sorted((n, 26))
    return ctx.full("avg", c, fast), ctx.full("avg", c, slow)


@indicator("apo", "int", needs="close", staged=True)
def apo(ctx, n):
    fast, slow = two_means(ctx, n)
    return fast - slow


@indicator("ppo", "int", needs="close", staged=True)
def ppo(ctx, n):
    fast, slow = two_means(ctx, n)
    return zero_if_flat("ppo", (fast - slow) * 100, slow)


@indicator("mfi", "int", needs=HLCV, staged=True)
def mfi(ctx, n):
    """Share of n bars' money flow that rose with the typical price; without flow 0."""
    h, lo, c, v = prices(ctx, *HLCV.split())
    typical = (h + lo + c) / 3
    before = ctx.lag(typical)
    up = combine("up flow", lambda t, b, v: F.when(b.isNotNull(), F.when(t > b, t * v).otherwise(0.0)), typical, before, v)
    down = combine("down flow", lambda t, b, v: F.when(b.isNotNull(), F.when(t < b, t * v).otherwise(0.0)), typical, before, v)
    gain, loss = ctx.full("sum", up, n), ctx.full("sum", down, n)
    return combine("mfi", lambda g, d: F.when(g + d < 1.0, F.lit(0.0)).otherwise(100 * g / (g + d)), gain, loss)


@indicator("adosc", "int", needs=HLCV, staged=True)
def adosc(ctx, n):
    return ctx.kernel("adosc", [accumulation(ctx)], n)


@indicator("midpoint", "int", needs="close", staged=True)
def midpoint(ctx, n):
    c = ctx.number("close")
    return (ctx.full("max", c, n) + ctx.full("min", c, n)) / 2


@indicator("t3", "int", needs="close", staged=True)
def t3(ctx, n):
    return ctx.kernel("t3", prices(ctx, "close"), n)


def channel(ctx: Context, n: int, name: str, side: int) -> Value:
    h, lo = prices(ctx, "high", "low")
    widened = combine(f"acc{side}", lambda x, h, lo: F.when(h + lo == 0, x).otherwise(x * (1 + side * 4 * (h - lo) / (h + lo))), ctx.number(name), h, lo)
    return ctx.full("avg", widened, n)


@indicator("accbands_upper", "int", needs=HLC, staged=True)
def accbands_upper(ctx, n):
    return channel(ctx, n, "high", 1)


@indicator("accbands_lower", "int", needs=HLC, staged=True)
def accbands_lower(ctx, n):
    return channel(ctx, n, "low", -1)


@indicator("ultosc", "int", needs=HLC, staged=True)
def ultosc(ctx, _):
    """Buying pressure over true range in 7, 14 and 28 bars, weighted 4, 2, 1."""
    h, lo, c = prices(ctx, "high", "low", "close")
    pc = ctx.lag(c)
    pressure = combine("bp", lambda lo, c, pc: F.when(pc.isNotNull(), c - F.least(lo, pc)), lo, c, pc)
    reach = combine("reach", lambda h, lo, pc: F.when(pc.isNotNull(), F.greatest(h, pc) - F.least(lo, pc)), h, lo, pc)
    a, b, d = (zero_if_flat("share", ctx.full("sum", pressure, n), ctx.full("sum", reach, n)) for n in (7, 14, 28))
    return 100 * (4 * a + 2 * b + d) / 7


@indicator("obv", "int", needs="close volume", staged=True)
def obv(ctx, _):
    """Volume added on rising and taken off on falling closes; the first bar counts in full."""
    c, v = prices(ctx, "close", "volume")
    signed = combine("signed volume", lambda c, pc, v: F.when(pc.isNull(), v).when(c > pc, v).when(c < pc, -v).otherwise(0.0), c, ctx.lag(c), v)
    return running(ctx, "obv", signed)


@indicator("sar", "int", needs="high low", staged=True)
def sar(ctx, _):
    return ctx.kernel("sar", prices(ctx, "high", "low"))


@indicator("ht_dcperiod", "int", needs="close", staged=True)
def ht_dcperiod(ctx, _):
    return ctx.kernel("ht_dcperiod", prices(ctx, "close"))


@indicator("ht_dcphase", "int", needs="close", staged=True)
def ht_dcphase(ctx, _):
    return ctx.kernel("ht_dcphase", prices(ctx, "close"))


@indicator("ht_trendline", "int", needs="close")
def ht_trendline(ctx, _):
    return ctx.kernel("ht_trendline", prices(ctx, "close"))


def stochastic(ctx: Context, fast: int, slow: int, signal: int) -> tuple[Value, Value]:
    """%K and %D, both from the bar on which %D exists; a flat window gives 0."""
    h, lo, c = prices(ctx, "high", "low", "close")
    top, bottom = ctx.full("max", h, fast), ctx.full("min", lo, fast)
    k = ctx.full("avg", zero_if_flat("raw %K", (c - bottom) * 100, top - bottom), slow)
    d = ctx.full("avg", k, signal)
    return combine("with %D", lambda k, d: F.when(d.isNotNull(), k), k, d), d


@indicator("stoch_k", "int", "int", "int", needs=HLC)
def stoch_k(ctx, fast, slow, signal):
    return stochastic(ctx, fast, slow, signal)[0]


@indicator("stoch_d", "int", "int", "int", needs=HLC)
def stoch_d(ctx, fast, slow, signal):
    return stochastic(ctx, fast, slow, signal)[1]
