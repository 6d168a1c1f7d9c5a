"""Daily sentiment as a stream: the same figures as the batch aggregation, per event-time day with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECAY = 0.6931471805599453 / 24


def daily_stream(articles: DataFrame, lateness: str = "1 day") -> DataFrame:
    """``articles`` (batch or stream) with ``symbol, article_ts, sentiment_score, sentiment_confidence`` to day rows.

    All figures are sums, so the state of a day is one row. Weights count from the day's end, which a row knows itself.
    """
    day = F.window("article_ts", "1 day")
    hours = (F.unix_micros(F.date_trunc("day", "article_ts") + F.expr("INTERVAL 1 DAY")) - F.unix_micros("article_ts")) / 3.6e9
    rows = articles.withColumn("_w", F.exp(-DECAY * hours)).withWatermark("article_ts", lateness)
    x = F.col("sentiment_score")
    out = rows.groupBy("symbol", day.alias("day")).agg(
        (F.sum(F.col("_w") * x) / F.sum("_w")).alias("sentiment_score"),
        F.avg("sentiment_confidence").alias("sentiment_confidence"),
        F.count("*").alias("article_count"),
        F.avg((x > 0.1).cast("double")).alias("bullish_ratio"),
        F.avg((x < -0.1).cast("double")).alias("bearish_ratio"),
        F.stddev_pop("sentiment_score").alias("sentiment_std"),
    )
    return out.withColumn("date", F.to_date("day.start")).drop("day")
