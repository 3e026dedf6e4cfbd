"""Price bars from files, tables, and the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("symbol", "session", "open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Bars from any format that Spark reads; a missing bar column is an error at once."""
    df = spark.read.format(format).options(**options).load(path)
    if missing := [c for c in BAR_COLUMNS if c not in df.columns]:
        raise ValueError(f"bars lack columns: {', '.join(missing)}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resample(df: DataFrame, symbol, session, price: str, by: list[str]) -> DataFrame:
    """One bar a symbol and session: first and last price by ``by``, extremes, count."""
    at = F.struct(*by)
    return df.groupBy(symbol.alias("symbol"), session.alias("session")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def bars_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals by order priority: few long series."""
    return resample(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.to_date("o_orderdate"), "o_totalprice", ["o_orderkey"])


def bars_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals by the customer's nation. Customers and nations join by key; nations are 25 rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    named = customers.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return resample(orders.join(named, "o_custkey"), F.col("n_name"), F.to_date("o_orderdate"), "o_totalprice", ["o_orderkey"])


def bars_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by event type, with a timestamp as session."""
    return resample(table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", "ts"), "value", ["ts", "event_id"])
