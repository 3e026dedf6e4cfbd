"""Scoring: one row a symbol, from its latest bar, with about two dozen features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsift.plans.planner import Context, ieee_div, run_kernels

# Bars of the windows.
ATR_BARS, MEAN_BARS, YEAR_BARS, CROSS_BARS = 14, 20, 252, 5


def rounded(x: Column, places: int) -> Column:
    """Rounding of a double, ties to even."""
    return F.rint(x * 10**places) / 10**places


def points(*steps: tuple[Column, int]) -> Column:
    """The first step met gives its points, none gives 0."""
    out = F.when(steps[0][0], steps[0][1])
    for met, n in steps[1:]:
        out = out.when(met, n)
    return out.otherwise(0)


def score_features(bars: DataFrame, tail: int | None = None) -> DataFrame:
    """All features, score and phase of every bar, or of the last bars only: with ``tail``, the windows see that many bars of each symbol (the exponential means all)."""
    ctx = Context("symbol", "session")
    w = ctx.window
    c = F.col
    df = bars.select("symbol", "session", *[c(x).cast("double").alias(x) for x in ("open", "high", "low", "close", "volume")])
    means = [(f"ema{n}", "ewm", ["close"], (2 / (n + 1),)) for n in (5, 20, 50)]
    df = run_kernels(df, means, ["symbol"], "session")

    whole = Window.partitionBy("symbol")
    df = df.withColumns({"n": F.count("close").over(whole), "last_session": F.max("session").over(whole), "from_end": F.count("*").over(whole) - F.row_number().over(w)})
    if tail is not None:
        df = df.where(c("from_end") < tail)

    def last(n: int):
        return ctx.rows(n)

    def full(x: Column, n: int) -> Column:
        return F.when(F.count(x).over(last(n)) == n, F.avg(x).over(last(n)))

    prev = F.lag("close").over(w)
    up, down = c("close") > c("open"), c("close") < c("open")
    df = df.withColumns(
        {
            "tr": F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev)),
            "change": c("close") - prev,
            "avg_vol": F.avg("volume").over(last(MEAN_BARS)),
            "up_vol": F.avg(F.when(up, c("volume"))).over(last(MEAN_BARS)),
            "down_vol": F.avg(F.when(down, c("volume"))).over(last(MEAN_BARS)),
            "downs": F.sum(down.cast("int")).over(last(MEAN_BARS)),
            "low52": F.min("low").over(last(YEAR_BARS)),
            "ema5_was": F.lag("ema5").over(w),
            "ema20_was": F.lag("ema20").over(w),
            "ema50_rising": c("ema50") > F.lag("ema50").over(w),
            "spring": (F.lag("low", 1).over(w) < F.lag("low", 2).over(w)) & (prev > F.lag("open").over(w)) & (prev > F.lag("low", 2).over(w)),
            "bar_range": c("high") - c("low"),
        }
    )
    df = df.withColumns(
        {
            "atr": full(c("tr"), ATR_BARS),
            "gain": full(F.when(c("change").isNotNull(), F.greatest(c("change"), F.lit(0.0))), ATR_BARS),
            "loss": full(F.when(c("change").isNotNull(), F.greatest(-c("change"), F.lit(0.0))), ATR_BARS),
            "crossed": F.coalesce((c("ema5") > c("ema20")) & (c("ema5_was") <= c("ema20_was")), F.lit(False)),
        }
    )
    df = df.withColumns({"baseline": F.avg("atr").over(last(MEAN_BARS)), "recent_cross": F.max("crossed").over(last(CROSS_BARS))})
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "acc_score": F.when(c("avg_vol") == 0, 0.0).when(c("downs") == 0, 1.0).otherwise(ieee_div(F.coalesce("up_vol", zero) - F.coalesce("down_vol", zero), c("avg_vol"))),
            "rsi": F.coalesce(100 - ieee_div(F.lit(100.0), 1 + ieee_div(c("gain"), c("loss"))), F.lit(50.0)),
            "vol_ratio": F.when(c("avg_vol") > 0, c("volume") / c("avg_vol")).otherwise(1.0),
            "atr_ratio": F.when(c("baseline") > 0, F.coalesce("atr", "baseline") / c("baseline")).otherwise(1.0),
            "ema_stack": (c("ema5") > c("ema20")) & (c("ema20") > c("ema50")),
            "upper_wick_pct": F.when(c("bar_range") > 0, (c("high") - F.greatest("close", "open")) / c("bar_range")).otherwise(0.0),
            "near_52w_low": (c("low52") > 0) & (c("close") < c("low52") * 1.30),
        }
    )
    score = (
        points((c("spring"), 15))
        + points((c("acc_score") > 0.10, 10))
        + points((c("vol_ratio") > 1.5, 15), (c("vol_ratio") > 1.0, 5))
        + points((c("ema_stack"), 20), (c("ema5") > c("ema20"), 10))
        + points((c("recent_cross"), 15))
        + points((c("ema50_rising"), 10))
        + points((c("close") > c("ema5"), 5))
        + points((c("atr_ratio") > 2.0, 15), (c("atr_ratio") > 1.5, 10))
        + points((c("bar_range") > 2 * F.coalesce("atr", "baseline"), 5))
        + points((c("rsi") > 70, 5))
        + points((c("upper_wick_pct") > 0.4, 10))
        + points((c("near_52w_low"), 5))
    )
    df = df.withColumn("score", score.cast("short"))
    hot = (c("vol_ratio") > 3) | (c("atr_ratio") > 2.5) | (c("rsi") > 85)
    phase = (
        F.when((c("score") >= 70) & hot, "CLIMAX")
        .when((c("score") >= 60) & c("ema_stack") & (c("atr_ratio") > 1.5), "TREND")
        .when((c("score") >= 50) & ((c("vol_ratio") > 1.5) | c("spring")) & (c("ema5") > c("ema20")), "BREAKOUT")
        .when(c("score") >= 40, "BASE")
        .otherwise("NONE")
    )
    return df.withColumn("phase", phase)


def score_bars(bars: DataFrame, *, min_bars: int = 30, freshness_days: int = 5) -> DataFrame:
    """Score each symbol's latest bar. Kept are symbols of at least ``min_bars`` bars whose latest is within ``freshness_days`` of the latest among those kept so far."""
    c = F.col
    latest = score_features(bars, tail=YEAR_BARS + MEAN_BARS + ATR_BARS).where((c("session") == c("last_session")) & (c("n") >= min_bars))
    # their latest session, from a pass of its own over two columns; no window or kernel is run for it
    ends = bars.groupBy("symbol").agg(F.count("close").alias("n"), F.max("session").alias("last")).where(c("n") >= min_bars)
    newest = ends.agg(F.max("last").alias("newest"))  # one row
    fresh = latest.join(F.broadcast(newest), F.datediff("newest", "session") <= freshness_days)
    return fresh.select(
        "symbol",
        "session",
        "close",
        "score",
        "phase",
        rounded(c("vol_ratio"), 2).alias("vol_ratio"),
        rounded(c("atr_ratio"), 2).alias("atr_ratio"),
        rounded(c("rsi"), 1).alias("rsi"),
        rounded(c("acc_score"), 3).alias("acc_score"),
        "spring",
        "ema_stack",
        "recent_cross",
        rounded(c("upper_wick_pct"), 2).alias("upper_wick_pct"),
        "near_52w_low",
        c("n").alias("bars"),
    ).orderBy(c("score").desc(), c("symbol").asc())
