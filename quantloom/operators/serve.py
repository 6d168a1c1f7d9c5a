"""Latest rows, summaries and counts behind reports and pages; upserts and symbol sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str = "symbol", time: str = "date") -> DataFrame:
    """The last row of each key, in one aggregation with map-side combine."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), time).alias("r")).select(key, "r.*")


def last_rows(df: DataFrame, n: int, key: str = "symbol", time: str = "date") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))
    return df.withColumn("_k", place).filter(F.col("_k") <= n).drop("_k")


def between(df: DataFrame, start=None, end=None, time: str = "date") -> DataFrame:
    """Rows of an inclusive range; either bound may be missing."""
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start))
    return df if end is None else df.filter(F.col(time) <= F.lit(end))


def recent(df: DataFrame, days: int, time: str = "date") -> DataFrame:
    """Rows of the last days before the newest row. The newest date is found first, so that the filter is a literal
    that reaches the scan."""
    newest = df.agg(F.max(time)).first()[0]
    return df.filter(F.col(time) >= F.date_sub(F.lit(newest), days))


def active(symbols: DataFrame) -> DataFrame:
    """Active symbols in order of ticker; a null flag counts as inactive."""
    return symbols.filter("is_active").orderBy("ticker")


def lookup(symbols: DataFrame, ticker: str) -> DataFrame:
    """The row of one ticker, in any case, or none."""
    return symbols.filter(F.col("ticker") == ticker.strip().upper()).limit(1)


def enough_history(bars: DataFrame, least: int, positive: bool = True) -> DataFrame:
    """Rows of symbols with at least ``least`` rows; with ``positive`` those whose closes are all above 0."""
    ok = bars.groupBy("symbol").agg(F.count("close").alias("n"), F.min("close").alias("lowest")).filter(F.col("n") >= least)
    return bars.join((ok.filter("lowest > 0") if positive else ok).select("symbol"), "symbol", "left_semi")


def signal_markers(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """``symbol, date, signal, price``: bullish and bearish days with the close of just that day; days without a bar, as
    weekends, have a null price."""
    marked = signals.filter(F.col("signal").isin("bullish", "bearish", "1", "-1"))
    side = F.when(F.col("signal").isin("bullish", "1"), "bullish").otherwise("bearish")
    return marked.select("symbol", "date", side.alias("signal")).join(bars.select("symbol", "date", F.col("close").alias("price")), ["symbol", "date"], "left")


def signal_markers_asof(signals: DataFrame, bars: DataFrame, max_days: int | None = None) -> DataFrame:
    """``symbol, date, signal, price, price_date``: bullish and bearish days with the last close up to that day, so weekend signals get
    Friday's; with ``max_days`` none that is older. Signals and bars go into one ordered window a symbol, which carries the last
    close on: no range join, and nothing is compared in pairs. Several signals of a day each have their row; days before the first
    close have a null price."""
    marked = signals.filter(F.col("signal").isin("bullish", "bearish", "1", "-1"))
    side = F.when(F.col("signal").isin("bullish", "1"), "bullish").otherwise("bearish")
    none = lambda kind: F.lit(None).cast(kind)
    own = marked.select("symbol", "date", F.lit(1).alias("_kind"), side.alias("signal"), none("struct<price:double,price_date:date>").alias("_bar"))
    closes = bars.filter("close is not null").select("symbol", "date", F.lit(0).alias("_kind"), none("string").alias("signal"), F.struct(F.col("close").cast("double").alias("price"), F.col("date").alias("price_date")).alias("_bar"))
    so_far = Window.partitionBy("symbol").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = own.unionByName(closes).withColumn("_last", F.last("_bar", ignorenulls=True).over(so_far)).filter("_kind = 1").select("symbol", "date", "signal", "_last.*")
    if max_days is None:
        return out
    fresh = F.datediff("date", "price_date") <= max_days
    return out.withColumns({c: F.when(fresh, F.col(c)) for c in ("price", "price_date")})


def page_kpis(sentiment: DataFrame, bars: DataFrame, risk: DataFrame) -> DataFrame:
    """One row over the symbols' latest rows: mean score, mean risk score, total volume, bullish symbols."""
    parts = [
        latest(sentiment).agg(F.avg("sentiment_score").alias("avg_score"), F.count_if(F.col("sentiment_score") > 0.1).alias("bullish")),
        latest(bars).agg(F.sum("volume").alias("total_volume")), risk.agg(F.avg("risk_score").alias("avg_risk")),
    ]
    one = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        one = one.join(p.withColumn("_k", F.lit(1)), "_k")
    return one.select("avg_score", "avg_risk", "total_volume", "bullish")


def export_sentiment(daily: DataFrame, days: int = 90) -> DataFrame:
    """Each symbol's latest day and its last days, rounded to four places, nulls as 0."""
    four = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 4).alias(c)
    clean = daily.select("symbol", "date", *[four(c) for c in ("sentiment_score", "sentiment_confidence", "bullish_ratio", "bearish_ratio")], F.coalesce("article_count", F.lit(0)).cast("long").alias("article_count"))
    history = last_rows(clean, days).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "sentiment_score", "article_count"))).alias("history"))
    return latest(clean).join(history, "symbol")


def current_sentiment(daily: DataFrame, signals: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Each symbol's latest day with its latest saved ``signal, signal_strength``; symbols without any get them from the score:
    bullish above the threshold, bearish below its negative, the score's size as strength."""
    now = latest(daily)
    saved = latest(signals.select("symbol", "date", F.col("signal").alias("_signal"), F.col("signal_strength").alias("_strength"))).drop("date")
    x = F.col("sentiment_score")
    own = F.when(x > threshold, "bullish").when(x < -threshold, "bearish").otherwise("neutral")
    out = now.drop("signal", "signal_strength").join(saved, "symbol", "left")
    known = F.col("_signal").isNotNull()
    return out.withColumns({"signal": F.when(known, F.col("_signal")).otherwise(own), "signal_strength": F.when(known, F.coalesce("_strength", F.lit(0.0))).otherwise(F.coalesce(F.abs(x), F.lit(0.0)))}).drop("_signal", "_strength")


def risk_bands(df: DataFrame, score: str = "risk_score", cuts: tuple[float, ...] = (40, 60, 80), names: tuple[str, ...] = ("Low Risk", "Moderate", "High Risk", "Very High")) -> DataFrame:
    """Add ``risk_band``: the name of the interval a score from 0 to 100 lies in; a cut belongs to the band above, null scores have none."""
    band = F.when(F.col(score).isNull(), F.lit(None).cast("string"))
    for cut, name in zip(cuts, names[:-1], strict=True):
        band = band.when(F.col(score) < cut, name)
    return df.withColumn("risk_band", band.otherwise(names[-1]))


def export_predictions(about: DataFrame) -> DataFrame:
    """Model figures by symbol for publication; what is missing is 0."""
    figures = ["samples", "features", "accuracy", "auc", "r2", "direction_accuracy"]
    return about.select("symbol", *[F.coalesce(F.col(c).cast("double") if c in about.columns else F.lit(None).cast("double"), F.lit(0.0)).alias(c) for c in figures])


def sentiment_summary(daily: DataFrame) -> DataFrame:
    return daily.groupBy("symbol").agg(
        *[F.avg(c).alias(f"avg_{c}") for c in ("sentiment_score", "sentiment_confidence", "bullish_ratio", "bearish_ratio")],
        F.sum("article_count").alias("total_articles"), F.count("*").alias("days"),
    )


def sentiment_overview(daily: DataFrame) -> DataFrame:
    return daily.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("sentiment_score", "date").alias("latest_score"), F.avg("sentiment_score").alias("avg_score"), F.sum("article_count").alias("total_articles"))


def signal_summary(signals: DataFrame) -> DataFrame:
    """Counts of each signal with the latest one and the strengths, in one aggregation."""
    return signals.groupBy("symbol").agg(
        *[F.count_if(F.col("signal") == s).alias(s) for s in ("bullish", "bearish", "neutral")],
        F.max_by("signal", "date").alias("latest_signal"), F.max("date").alias("latest_date"),
        F.avg("signal_strength").alias("avg_strength"), F.max("signal_strength").alias("max_strength"), F.min("signal_strength").alias("min_strength"),
    )


def overview(daily: DataFrame) -> DataFrame:
    return daily.agg(F.avg("sentiment_score").alias("avg_score"), F.sum("article_count").alias("total_articles"), F.count_distinct("symbol").alias("symbols"), F.avg("bullish_ratio").alias("avg_bullish"))


def series_stats(daily: DataFrame) -> DataFrame:
    x = "sentiment_score"
    return daily.groupBy("symbol").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def heatmap(daily: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    return daily.groupBy("date").pivot("symbol", symbols).agg(F.avg("sentiment_score"))


def export_prices(bars: DataFrame, days: int = 90) -> DataFrame:
    """Latest bar, mean volume, range, total return and the last bars of each symbol."""
    total = bars.groupBy("symbol").agg(
        F.max("date").alias("date"), F.max_by("close", "date").alias("close"), F.avg("volume").alias("avg_volume"), F.min("low").alias("min_price"), F.max("high").alias("max_price"),
        (F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("total_return"),
    )
    history = last_rows(bars, days).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("history"))
    return total.join(history, "symbol")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` put in the place of those with the same keys; a new null replaces too."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("r")).select(*keys, "r.*").select(*old.columns)


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    """Upsert in which a new null keeps the old value, but for the columns in ``always``."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    out = o.join(n, keys, "full")
    pick = lambda c: F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in always else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return out.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


class Watchlist:
    """A set of symbols as a one-column frame; set algebra gives new lists."""

    def __init__(self, symbols: DataFrame):
        self.frame = symbols.select(F.upper(F.trim("symbol")).alias("symbol")).filter("symbol <> ''").distinct()

    def merge(self, other: Watchlist) -> Watchlist:
        return Watchlist(self.frame.union(other.frame))

    def difference(self, other: Watchlist) -> Watchlist:
        return Watchlist(self.frame.subtract(other.frame))

    def intersection(self, other: Watchlist) -> Watchlist:
        return Watchlist(self.frame.intersect(other.frame))

    def add(self, *symbols: str) -> Watchlist:
        new = self.frame.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
        return Watchlist(self.frame.union(new))

    def remove(self, *symbols: str) -> Watchlist:
        return Watchlist(self.frame.filter(~F.col("symbol").isin([s.strip().upper() for s in symbols])))

    def clear(self) -> Watchlist:
        return Watchlist(self.frame.limit(0))

    def valid(self, known: DataFrame) -> Watchlist:
        """Those that ``known`` (a frame with ``symbol``) has."""
        return Watchlist(self.frame.join(Watchlist(known).frame, "symbol", "left_semi"))

    def members_of(self, df: DataFrame) -> DataFrame:
        return df.join(self.frame, "symbol", "left_semi")

    def contains(self, symbol: str) -> bool:
        return not self.frame.filter(F.col("symbol") == symbol.strip().upper()).isEmpty()

    def save(self, path: str) -> None:
        self.frame.agg(F.sort_array(F.collect_list("symbol")).alias("symbols"), F.count("*").alias("count")).coalesce(1).write.mode("overwrite").json(path)
