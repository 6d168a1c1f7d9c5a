"""Market-shaped frames from the star-schema tables: bars, articles, headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: a symbol for each order priority, prices from the orders of a day."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored articles: a symbol for each event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 100))
    confidence = F.get_json_object("props", "$.k").cast("double") / 100
    out = e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("article_id"), F.col("ts").cast("timestamp").alias("article_ts"), score.alias("sentiment_score"), confidence.alias("sentiment_confidence"), "value")
    label = F.when(F.col("sentiment_score") > 0.1, "bullish").when(F.col("sentiment_score") < -0.1, "bearish").otherwise("neutral")
    return out.withColumn("sentiment_signal", label)


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short headlines made from event values."""
    text = (
        F.when(F.col("value") >= 120, "Company beats estimates, stock soars after upgrade")
        .when(F.col("value") >= 60, "Strong growth and record profit for the quarter")
        .when(F.col("value") >= 30, "Shares hold steady before results")
        .when(F.col("value") >= 10, "Weak guidance and layoffs hurt shares")
        .otherwise("ok")
    )
    return articles(spark, sf_dir).select("symbol", "article_id", "article_ts", text.alias("headline"))


BARS_SQL = """bars AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open,
 max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM orders GROUP BY 1, 2)"""
ARTICLES_SQL = """articles AS (SELECT *, CASE WHEN sentiment_score > 0.1 THEN 'bullish' WHEN sentiment_score < -0.1 THEN 'bearish' ELSE 'neutral' END AS sentiment_signal
 FROM (SELECT event_type AS symbol, event_id AS article_id, ts AS article_ts, greatest(-1.0, least(1.0, (value - 50) / 100)) AS sentiment_score,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS sentiment_confidence, value FROM events))"""
