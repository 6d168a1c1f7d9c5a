"""Text sentiment: a lexicon score, the mapping of classifier output, nested vendor JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The finance terms and weights that a scorer with equal results needs, complete; a caller's own can take their place.
TERMS = {
    "bullish": 3.0, "surge": 2.5, "soar": 2.5, "skyrocket": 3.0, "outperform": 2.0, "upgrade": 2.5, "beat": 2.0, "exceeds": 2.0, "exceeded": 2.0,
    "record": 1.5, "breakthrough": 2.5, "rally": 2.0, "boom": 2.0, "gain": 1.5, "gains": 1.5, "profit": 1.5, "profitable": 1.5, "growth": 1.5,
    "growing": 1.5, "strong": 1.0, "positive": 1.5, "optimistic": 2.0, "momentum": 1.0, "upside": 1.5, "buy": 1.5, "accumulate": 1.0,
    "bearish": -3.0, "plunge": -2.5, "plummet": -3.0, "crash": -3.5, "collapse": -3.0, "underperform": -2.0, "downgrade": -2.5, "miss": -2.0, "missed": -2.0,
    "misses": -2.0, "loss": -2.0, "losses": -2.0, "decline": -2.0, "declining": -2.0, "drop": -1.5, "drops": -1.5, "fall": -1.5, "falls": -1.5,
    "weak": -1.5, "weakness": -1.5, "negative": -1.5, "pessimistic": -2.0, "sell": -1.5, "selloff": -2.5, "downturn": -2.0, "recession": -2.5, "bankruptcy": -3.5,
    "default": -3.0, "fraud": -3.5, "scandal": -3.0, "investigation": -2.0, "lawsuit": -2.0, "layoffs": -2.0, "layoff": -2.0, "cuts": -1.5, "warning": -2.0,
    "concern": -1.5, "concerns": -1.5, "risk": -1.0, "risky": -1.5, "volatile": -1.0, "volatility": -1.0, "uncertainty": -1.5, "headwind": -1.5, "headwinds": -1.5,
    "stable": 0.5, "steady": 0.5, "flat": 0.0, "unchanged": 0.0, "hold": 0.0, "neutral": 0.0, "mixed": 0.0,
}
MIN_LENGTH = 5


def lexicon_sentiment(df: DataFrame, text: str = "headline", terms: dict[str, float] | None = None) -> DataFrame:
    """``sentiment_score`` = s / sqrt(s^2 + 15) of the summed term weights, ``sentiment_confidence`` its size, and the
    label; texts under five characters score 0. The lexicon is a literal map, so no join and no Python is needed."""
    lexicon = F.create_map(*[F.lit(v) for pair in (terms or TERMS).items() for v in pair])
    words = F.split(F.lower(F.trim(F.col(text))), "[^a-z]+")
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(lexicon, w), F.lit(0.0)))
    total = F.when(F.length(F.trim(F.col(text))) >= MIN_LENGTH, total).otherwise(F.lit(0.0))
    df = df.withColumn("sentiment_score", F.coalesce(total / F.sqrt(total * total + 15), F.lit(0.0)))
    x = F.col("sentiment_score")
    return df.withColumns({"sentiment_confidence": F.abs(x), "sentiment_signal": F.when(x > 0.1, "bullish").when(x < -0.1, "bearish").otherwise("neutral")})


def classifier_mapping(df: DataFrame) -> DataFrame:
    """``label`` and ``prob`` of a three-way classifier to probabilities, score and confidence."""
    p, label = F.col("prob"), F.lower("label")
    rest = 1 - p
    side = lambda own, other: F.when(label == own, p).when(label == other, rest * 0.3).otherwise(rest * 0.5)
    df = df.withColumns({"prob_positive": side("positive", "negative"), "prob_negative": side("negative", "positive"), "prob_neutral": F.when(label.isin("positive", "negative"), rest * 0.7).otherwise(p)})
    score = F.col("prob_positive") - F.col("prob_negative")
    df = df.withColumns({"sentiment_score": score, "sentiment_confidence": F.greatest("prob_positive", "prob_negative", "prob_neutral")})
    return df.withColumn("sentiment_signal", F.when(F.col("sentiment_score") > 0.1, "bullish").when(F.col("sentiment_score") < -0.1, "bearish").otherwise("neutral"))


def blend_summary(df: DataFrame, weight: float = 0.3) -> DataFrame:
    """Blend ``summary_score`` (where not null) into the score and label; confidence and probabilities stay."""
    mixed = F.when(F.col("summary_score").isNull(), F.col("sentiment_score")).otherwise((1 - weight) * F.col("sentiment_score") + weight * F.col("summary_score"))
    df = df.withColumn("sentiment_score", mixed)
    return df.withColumn("sentiment_signal", F.when(F.col("sentiment_score") > 0.1, "bullish").when(F.col("sentiment_score") < -0.1, "bearish").otherwise("neutral"))


VENDOR = "symbol STRING, companyNewsScore DOUBLE, sectorAverageBullishPercent DOUBLE, sectorAverageNewsScore DOUBLE, buzz STRUCT<articlesInLastWeek: BIGINT, buzz: DOUBLE, weeklyAverage: DOUBLE>, sentiment STRUCT<bearishPercent: DOUBLE, bullishPercent: DOUBLE>"


def flatten_vendor(df: DataFrame, column: str = "payload") -> DataFrame:
    """Vendor sentiment JSON to flat columns; absent numbers are 0."""
    j = df.withColumn("_j", F.from_json(column, VENDOR))
    zero = lambda c: F.coalesce(F.col(f"_j.{c}").cast("double"), F.lit(0.0))
    return j.select(
        F.upper("_j.symbol").alias("symbol"), zero("buzz.articlesInLastWeek").alias("articles_in_last_week"), zero("buzz.buzz").alias("buzz_score"), zero("buzz.weeklyAverage").alias("weekly_average"),
        zero("sentiment.bullishPercent").alias("bullish_percent"), zero("sentiment.bearishPercent").alias("bearish_percent"), zero("companyNewsScore").alias("company_news_score"),
    )


def flatten_articles(df: DataFrame) -> DataFrame:
    """Article rows of the vendor (epoch seconds, mixed case) to the library's columns."""
    return df.select(F.upper("related").alias("symbol"), F.col("id").alias("article_id"), "headline", "summary", "source", "category", "url", F.col("image").alias("image_url"), F.timestamp_seconds("datetime").alias("article_ts"))
