"""Sentiment: aggregation of scored articles, cross-sectional signals, feature columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import above_running_quantile
from ..functions.windows import average_rank, ewm_mean, flag, frame, full, lag, rolling

THRESHOLD = 0.1
EPS = 1e-6


def _aggregate(df: DataFrame, key: str, end, half_life: float, min_articles: int, min_confidence: float) -> DataFrame:
    decay = 0.6931471805599453 / half_life
    hours = (F.unix_micros(end.cast("timestamp")) - F.unix_micros("article_ts")) / 3.6e9
    weight = F.exp(-decay * hours)
    bull, bear = F.col("sentiment_score") > THRESHOLD, F.col("sentiment_score") < -THRESHOLD
    if "sentiment_signal" in df.columns:
        bull, bear = F.col("sentiment_signal") == "bullish", F.col("sentiment_signal") == "bearish"
    confidence = F.avg("sentiment_confidence") if "sentiment_confidence" in df.columns else F.lit(0.5)
    out = df.withColumn("_w", weight).groupBy("symbol", key).agg(
        (F.sum(F.col("_w") * F.col("sentiment_score")) / F.sum("_w")).alias("sentiment_score"),
        confidence.alias("sentiment_confidence"),
        F.count("*").alias("article_count"),
        F.avg(bull.cast("double")).alias("bullish_ratio"),
        F.avg(bear.cast("double")).alias("bearish_ratio"),
        F.stddev_pop("sentiment_score").alias("sentiment_std"),
    )
    return out.withColumn("signal_valid", (F.col("article_count") >= min_articles) & (F.col("sentiment_confidence") >= min_confidence))


def aggregate_daily(df: DataFrame, half_life: float = 24.0, min_articles: int = 3, min_confidence: float = 0.3) -> DataFrame:
    """Articles of a symbol and day: time-weighted score, mean confidence, count, shares, deviation, validity."""
    df = df.withColumn("date", F.to_date("article_ts"))
    return _aggregate(df, "date", F.date_add("date", 1), half_life, min_articles, min_confidence)


def aggregate_weekly(df: DataFrame, half_life: float = 24.0, min_articles: int = 3, min_confidence: float = 0.3) -> DataFrame:
    """The same over weeks from Monday, with the change from the week before as ``sentiment_momentum``."""
    df = df.withColumn("week_start", F.date_trunc("week", "article_ts").cast("date"))
    out = _aggregate(df, "week_start", F.date_add("week_start", 7), half_life, min_articles, min_confidence)
    before = F.lag("sentiment_score").over(Window.partitionBy("symbol").orderBy("week_start"))
    return out.withColumn("sentiment_momentum", F.col("sentiment_score") - before)


def _labelled(df: DataFrame, up, down, strength) -> DataFrame:
    label = F.when(up, "bullish").when(down, "bearish").otherwise("neutral")
    return df.withColumns({"signal": label, "signal_strength": strength})


def signals_absolute(df: DataFrame, bullish: float = 0.5, bearish: float = -0.5) -> DataFrame:
    x = F.col("sentiment_score")
    df = df.withColumn("normalized_score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    return _labelled(df, x > bullish, x < bearish, F.abs("normalized_score"))


def signals_zscore(df: DataFrame) -> DataFrame:
    """Score against the day's symbols, in sample deviations; 0 where these don't differ."""
    day = Window.partitionBy("date")
    dev = F.stddev_samp("sentiment_score").over(day)
    z = F.when(dev > 0, (F.col("sentiment_score") - F.avg("sentiment_score").over(day)) / dev).otherwise(F.lit(0.0))
    df = df.withColumn("normalized_score", F.coalesce(z, F.lit(0.0)))
    z = F.col("normalized_score")
    return _labelled(df, z > 1, z < -1, F.least(F.abs(z) / 3, F.lit(1.0)))


def signals_rank(df: DataFrame) -> DataFrame:
    """Share of the day's symbols ranked up to this one, ties averaged; one half for a single symbol."""
    alone = F.count("*").over(Window.partitionBy("date")) == 1
    df = df.withColumn("normalized_score", F.when(alone, F.lit(0.5)).otherwise(average_rank("date", "sentiment_score")))
    r = F.col("normalized_score")
    return _labelled(df, r > 0.75, r < 0.25, 2 * F.abs(r - 0.5))


def generate_signals(df: DataFrame, method: str = "zscore", **options) -> DataFrame:
    ways = {"absolute": signals_absolute, "zscore": signals_zscore, "rank": signals_rank}
    if method not in ways:
        raise ValueError(f"unknown signal method: {method}")
    return ways[method](df, **options)


def score_momentum(df: DataFrame, lookback: int = 5) -> DataFrame:
    df = df.withColumn("sentiment_momentum", F.col("sentiment_score") - lag(F.col("sentiment_score"), lookback))
    return df.withColumn("sentiment_acceleration", F.col("sentiment_momentum") - lag(F.col("sentiment_momentum")))


def merge_with_prices(sentiment: DataFrame, bars: DataFrame) -> DataFrame:
    """Sentiment rows with the bar of their symbol and day, where there is one."""
    return sentiment.join(bars, ["symbol", "date"], "left")


def lags(df: DataFrame, periods: tuple[int, ...] = (1, 2, 3, 5, 7)) -> DataFrame:
    return df.withColumns({f"sentiment_lag_{k}": lag(F.col("sentiment_score"), k) for k in periods})


def changes(df: DataFrame, windows: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    x, out = F.col("sentiment_score"), {}
    for n in windows:
        out[f"sentiment_change_{n}"] = x - lag(x, n)
        out[f"sentiment_pct_change_{n}"] = (x - lag(x, n)) / (F.abs(lag(x, n)) + 0.001)
    return df.withColumns(out)


def moving_averages(df: DataFrame, windows: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    df = df.withColumns({f"sentiment_sma_{n}": rolling(F.avg, F.col("sentiment_score"), n) for n in windows})
    return ewm_mean(df, {f"sentiment_ema_{n}": ("sentiment_score", n) for n in windows})


def disagreement(df: DataFrame) -> DataFrame:
    df = above_running_quantile(df, {"disagreement_high": ("sentiment_std", 0.5)})
    return df.withColumns(
        {
            "sentiment_range": F.col("bullish_ratio") - F.col("bearish_ratio"),
            "sentiment_spread": F.col("bullish_ratio") + F.col("bearish_ratio"),
        }
    )


def zscore(df: DataFrame, window: int = 21) -> DataFrame:
    x = F.col("sentiment_score")
    below = F.aggregate(F.collect_list(x).over(frame(window)), F.lit(0), lambda n, v: n + (v < F.col("sentiment_score")).cast("int"))
    z = (x - rolling(F.avg, x, window)) / (rolling(F.stddev_samp, x, window) + EPS)
    return df.withColumns({"sentiment_zscore": z, "sentiment_percentile": full(below / F.lit(float(window)), x, window)})


def article_counts(df: DataFrame) -> DataFrame:
    n = F.col("article_count").cast("double")
    df = df.withColumns({"article_count_sma_5": rolling(F.avg, n, 5), "article_count_sma_21": rolling(F.avg, n, 21), "_sd": rolling(F.stddev_samp, n, 21)})
    return df.withColumns(
        {
            "article_count_zscore": (n - F.col("article_count_sma_21")) / (F.col("_sd") + EPS),
            "high_attention": flag(n > F.col("article_count_sma_21")),
            "article_count_change": n - lag(n),
            "article_count_pct_change": F.try_divide(n, lag(n)) - 1,
        }
    ).drop("_sd")


def confidence(df: DataFrame) -> DataFrame:
    c = F.col("sentiment_confidence")
    df = above_running_quantile(df, {"high_confidence": ("sentiment_confidence", 0.5)})
    return df.withColumns({"confidence_sma_5": rolling(F.avg, c, 5), "weighted_sentiment": F.col("sentiment_score") * c})


def signal_flags(df: DataFrame) -> DataFrame:
    x = F.col("sentiment_score")
    return df.withColumns(
        {"signal_valid": F.col("signal_valid").cast("int"), "bullish_signal": flag(x > THRESHOLD), "bearish_signal": flag(x < -THRESHOLD), "neutral_signal": flag((x >= -THRESHOLD) & (x <= THRESHOLD))}
    )


def interactions(df: DataFrame) -> DataFrame:
    x, n = F.col("sentiment_score"), F.col("article_count").cast("double")
    step = x - lag(x)
    return df.withColumns(
        {"sent_x_conf": x * F.col("sentiment_confidence"), "sent_x_attention": x * (n / (rolling(F.avg, n, 21) + 1)), "sentiment_acceleration": step - (lag(x) - lag(x, 2))}
    )


def build_all(df: DataFrame) -> DataFrame:
    for step in (lags, changes, moving_averages, disagreement, zscore, article_counts, confidence, signal_flags, interactions):
        df = step(df)
    return df
