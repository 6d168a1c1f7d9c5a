"""Drawdowns of closing prices: series, episodes, durations, recovery, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import EPS_Z, lag, over_key, rolling, run_id, running

YEAR = 252.0


def series(df: DataFrame) -> DataFrame:
    """Add ``peak`` and ``drawdown`` (a share of the peak, 0 or more)."""
    df = df.withColumn("peak", F.max("close").over(running()))
    return df.withColumn("drawdown", F.try_divide(F.col("peak") - F.col("close"), F.col("peak")))


def features(df: DataFrame, window: int = 63) -> DataFrame:
    """``current_drawdown, underwater, days_since_peak`` (rows), ``drawdown_zscore``."""
    df = series(df).withColumn("_n", F.row_number().over(over_key()))
    top = F.max(F.when(F.col("close") >= F.col("peak"), F.col("_n"))).over(running())
    d = F.col("drawdown")
    return df.withColumns(
        {
            "current_drawdown": d,
            "underwater": (d > 0).cast("int"),
            "days_since_peak": F.col("_n") - top,
            "drawdown_zscore": (d - rolling(F.avg, d, window)) / (rolling(F.stddev_samp, d, window) + EPS_Z),
        }
    ).drop("_n")


def durations(df: DataFrame) -> DataFrame:
    """``symbol, current_duration, max_duration, is_in_drawdown``: rows under water in a row."""
    df = series(df).withColumn("_under", F.col("drawdown") > 0)
    df = df.withColumn("_run", run_id(~F.col("_under")))
    length = F.count_if("_under").over(Window.partitionBy("symbol", "_run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_length", F.when(F.col("_under"), length).otherwise(F.lit(0)))
    return df.groupBy("symbol").agg(F.max_by("_length", "date").alias("current_duration"), F.max("_length").alias("max_duration"), F.max_by("_under", "date").alias("is_in_drawdown"))


def episodes(df: DataFrame, min_drawdown: float = 0.01) -> DataFrame:
    """Drawdowns from peak to recovery: ``symbol, start_date, peak_value, trough_date, trough_value, drawdown,
    end_date, duration_days, recovery_days, is_recovered``; an open one lasts to the last bar and has no end."""
    df = series(df)
    df = df.withColumns({"_under": F.col("drawdown") > 0, "_before": lag(F.col("date")), "_last": F.max("date").over(Window.partitionBy("symbol"))})
    df = df.withColumns({"_run": run_id(~F.col("_under")), "_next": F.lead("date").over(over_key())})
    out = df.filter("_under").groupBy("symbol", "_run").agg(
        F.min_by("_before", "date").alias("start_date"),
        F.max("peak").alias("peak_value"),
        F.min_by("date", F.struct(-F.col("drawdown"), "date")).alias("trough_date"),
        F.min_by("close", F.struct(-F.col("drawdown"), "date")).alias("trough_value"),
        F.max("drawdown").alias("drawdown"),
        F.max_by("_next", "date").alias("end_date"),
        F.max("_last").alias("_last"),
    )
    out = out.filter(F.col("drawdown") >= min_drawdown).drop("_run")
    return out.select(
        "symbol", "start_date", "peak_value", "trough_date", "trough_value", "drawdown", "end_date",
        F.date_diff(F.coalesce("end_date", "_last"), "start_date").alias("duration_days"),
        F.date_diff("end_date", "trough_date").alias("recovery_days"),
        F.col("end_date").isNotNull().alias("is_recovered"),
    )


def recovery(df: DataFrame, min_drawdown: float = 0.01) -> DataFrame:
    """``symbol, avg_recovery_days, max_recovery_days, total_recoveries, current_recovery_days``; nulls where nothing
    has recovered yet, recoveries of no days left out of mean and maximum."""
    last = df.groupBy("symbol").agg(F.max("date").alias("_last"))
    days = F.when(F.col("recovery_days") > 0, F.col("recovery_days"))
    out = last.join(episodes(df, min_drawdown), "symbol", "left").groupBy("symbol").agg(
        F.avg(days).alias("avg_recovery_days"),
        F.max(days).alias("max_recovery_days"),
        F.count_if("is_recovered").alias("total_recoveries"),
        F.max(F.when(~F.col("is_recovered"), F.date_diff("_last", "trough_date"))).alias("current_recovery_days"),
    )
    return out.withColumn("current_recovery_days", F.when(F.col("total_recoveries") > 0, F.col("current_recovery_days")))


def totals(df: DataFrame) -> DataFrame:
    """``symbol, max_drawdown, current_drawdown, ulcer_index, pain_index, calmar_ratio`` in one aggregation. Where
    there was no drawdown calmar is null for a gain (it has no finite value) and 0 otherwise."""
    d = series(df)
    out = d.groupBy("symbol").agg(
        F.max("drawdown").alias("max_drawdown"),
        F.max_by("drawdown", "date").alias("current_drawdown"),
        F.sqrt(F.avg(F.pow(100 * F.col("drawdown"), F.lit(2.0)))).alias("ulcer_index"),
        F.avg("drawdown").alias("pain_index"),
        F.count("*").alias("_n"), F.min_by("close", "date").alias("_a"), F.max_by("close", "date").alias("_z"),
    )
    growth = F.pow(F.col("_z") / F.col("_a"), F.lit(YEAR) / F.col("_n")) - 1
    flat = F.when(growth > 0, F.lit(None).cast("double")).otherwise(F.lit(0.0))
    return out.withColumn("calmar_ratio", F.when(F.col("max_drawdown") > 0, growth / F.col("max_drawdown")).otherwise(flat)).drop("_n", "_a", "_z")


def pieces(df: DataFrame) -> DataFrame:
    """Mergeable drawdown state of a symbol's years: a row for each stretch from a new peak (or the year's begin) to the next.

    Rows are dealt by symbol and year, so a long history is spread over tasks. A year's rows need one thing of the years before,
    their highest close, which comes from a table with a row a year. Rows without symbol, date or close are left out.
    """
    rows = df.filter("close is not null and symbol is not null and date is not null").select("symbol", "date", F.col("close").cast("double").alias("close"), F.year("date").alias("year")).repartition("symbol", "year")
    tops = rows.groupBy("symbol", "year").agg(F.max(F.struct("close", "date"))["close"].alias("top"))  # of both columns, as below
    earlier = Window.partitionBy("symbol").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(tops.select("symbol", "year", F.max("top").over(earlier).alias("_carried")), ["symbol", "year"], "left")  # both sides read one shuffle
    so_far = Window.partitionBy("symbol", "year").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("peak", F.greatest(F.max("close").over(so_far), "_carried"))
    d = F.col("drawdown")
    rows = rows.withColumn("drawdown", F.try_divide(F.col("peak") - F.col("close"), F.col("peak"))).withColumn("_under", F.coalesce(d > 0, F.lit(False)))
    rows = rows.withColumn("_stretch", F.sum((~F.col("_under")).cast("int")).over(so_far))
    under = lambda c: F.when(F.col("_under"), c)
    return rows.groupBy("symbol", "year", "_stretch").agg(
        F.count("*").alias("n"), F.min("close").alias("lowest"), F.sum("drawdown").alias("sum"), F.sum(100 * d * (100 * d)).alias("squares"), F.max(~F.col("_under")).alias("new"),
        F.min(F.struct("date", "close")).alias("first"), F.max(F.struct("date", "close", "drawdown")).alias("last"),
        F.count_if("_under").alias("below"), F.max(under(F.col("peak"))).alias("peak"), F.min(under(F.struct((-d).alias("depth"), "date", "close"))).alias("trough"),
    )


def runs(df: DataFrame) -> DataFrame:
    """``pieces`` put together over the years: a row for each new peak with what lies below it until the next."""
    parts = pieces(df)
    order = Window.partitionBy("symbol").orderBy("year", "_stretch")
    parts = parts.withColumn("_run", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = parts.groupBy("symbol", "_run").agg(
        *[F.sum(c).alias(c) for c in ("n", "sum", "squares", "below")], F.min("lowest").alias("lowest"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("peak").alias("peak"), F.min("trough").alias("trough"),
    )
    w = Window.partitionBy("symbol")
    return out.withColumns({"end_date": F.lead("first.date").over(w.orderBy("_run")), "newest": F.max("last.date").over(w)})


def summary(df: DataFrame, min_drawdown: float = 0.01, least: int = 2) -> DataFrame:
    """The figures of ``totals``, ``durations`` and ``recovery`` and the number of episodes, a row per symbol, from one reading of
    the bars. Figures are null for symbols with fewer than ``least`` closes or a close that isn't positive."""
    r = runs(df).withColumn("deep", (F.col("below") > 0) & (-F.col("trough.depth") >= min_drawdown))
    r = r.withColumns({"back": F.when(F.col("deep"), F.date_diff("end_date", "trough.date")), "open": F.when(F.col("deep") & F.col("end_date").isNull(), F.date_diff("newest", "trough.date"))})
    at_end = lambda c: F.max_by(c, F.col("last.date"))
    out = r.groupBy("symbol").agg(
        F.sum("n").alias("_n"), F.min("lowest").alias("_lowest"), F.min("first").alias("_first"), F.max("last").alias("_last"), F.sqrt(F.sum("squares") / F.sum("n")).alias("ulcer_index"), (F.sum("sum") / F.sum("n")).alias("pain_index"),
        F.coalesce(F.max(-F.col("trough.depth")), F.lit(0.0)).alias("max_drawdown"), at_end(F.col("below")).alias("current_duration"), F.max("below").alias("max_duration"), at_end(F.col("below") > 0).alias("is_in_drawdown"),
        F.avg(F.when(F.col("back") > 0, F.col("back"))).alias("avg_recovery_days"), F.max(F.when(F.col("back") > 0, F.col("back"))).alias("max_recovery_days"), F.count("back").alias("total_recoveries"), F.max("open").alias("_open"),
        F.count_if("deep").alias("num_drawdowns"), F.avg(F.when(F.col("deep"), -F.col("trough.depth"))).alias("avg_drawdown"),
    )
    growth = F.pow(F.try_divide(F.col("_last.close"), F.col("_first.close")), F.lit(YEAR) / F.col("_n")) - 1
    flat = F.when(growth > 0, F.lit(None).cast("double")).otherwise(F.lit(0.0))
    out = out.withColumns({
        "current_drawdown": F.col("_last.drawdown"), "calmar_ratio": F.when(F.col("max_drawdown") > 0, growth / F.col("max_drawdown")).otherwise(flat),
        "current_recovery_days": F.when(F.col("total_recoveries") > 0, F.col("_open")),
    })
    names = (
        "max_drawdown", "current_drawdown", "ulcer_index", "pain_index", "calmar_ratio", "current_duration", "max_duration", "is_in_drawdown",
        "avg_recovery_days", "max_recovery_days", "total_recoveries", "current_recovery_days", "num_drawdowns", "avg_drawdown",
    )
    enough = (F.col("_n") >= least) & (F.col("_lowest") > 0)
    return out.select("symbol", *[F.when(enough, F.col(c)).alias(c) for c in names])
