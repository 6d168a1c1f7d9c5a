"""Price features: each adds columns to bars ``symbol, date, open, high, low, close, volume``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ewm_mean, flag, lag, over_key, rolling, running

YEAR = 252.0
EPS = 1e-10


def _change(x, k):
    return F.try_divide(x, lag(x, k)) - 1


def returns(df: DataFrame, periods: tuple[int, ...] = (1, 5, 21)) -> DataFrame:
    """``return_{p}d``; gaps are filled forward before dividing."""
    held = F.last("close", ignorenulls=True).over(running())
    return df.withColumn("_held", held).withColumns({f"return_{p}d": _change(F.col("_held"), p) for p in periods}).drop("_held")


def log_returns(df: DataFrame, periods: tuple[int, ...] = (1, 5, 21)) -> DataFrame:
    ratio = lambda p: F.try_divide(F.col("close"), lag(F.col("close"), p))
    return df.withColumns({f"log_return_{p}d": F.when(ratio(p) > 0, F.log(ratio(p))) for p in periods})


def rsi(df: DataFrame, window: int = 14) -> DataFrame:
    """``rsi_{window}`` from exponential means of gains and losses; 50 where there was no loss."""
    change = F.coalesce(F.col("close") - lag(F.col("close")), F.lit(0.0))
    df = df.withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))})
    df = ewm_mean(df, {"_g": ("_gain", window), "_l": ("_loss", window)})
    value = 100 - 100 / (1 + F.col("_g") / F.nullif(F.col("_l"), F.lit(0.0)))
    return df.withColumn(f"rsi_{window}", F.coalesce(value, F.lit(50.0))).drop("_gain", "_loss", "_g", "_l")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm_mean(df, {"_f": ("close", fast), "_s": ("close", slow)}).withColumn("macd", F.col("_f") - F.col("_s"))
    df = ewm_mean(df, {"macd_signal": ("macd", signal)})
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_f", "_s")


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    low, high = rolling(F.min, F.col("low"), k), rolling(F.max, F.col("high"), k)
    df = df.withColumn("stoch_k", 100 * (F.col("close") - low) / (high - low + EPS))
    return df.withColumn("stoch_d", rolling(F.avg, F.col("stoch_k"), d))


def volatility(df: DataFrame, windows: tuple[int, ...] = (5, 10, 21, 63)) -> DataFrame:
    """``volatility_{n}``: annualised sample deviation of daily returns."""
    df = df.withColumn("_r", _change(F.col("close"), 1))
    return df.withColumns({f"volatility_{n}": rolling(F.stddev_samp, F.col("_r"), n) * YEAR**0.5 for n in windows}).drop("_r")


def bollinger(df: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    mid, dev = rolling(F.avg, F.col("close"), window), rolling(F.stddev_samp, F.col("close"), window)
    df = df.withColumns({"bb_middle": mid, "bb_upper": mid + width * dev, "bb_lower": mid - width * dev})
    gap = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns({"bb_pct_b": (F.col("close") - F.col("bb_lower")) / (gap + EPS), "bb_bandwidth": F.try_divide(gap, F.col("bb_middle"))})


def moving_averages(df: DataFrame, windows: tuple[int, ...] = (5, 10, 21, 63)) -> DataFrame:
    df = df.withColumns({f"sma_{n}": rolling(F.avg, F.col("close"), n) for n in windows})
    return ewm_mean(df, {f"ema_{n}": ("close", n) for n in windows})


def ma_crossover(df: DataFrame, fast: int = 10, slow: int = 21) -> DataFrame:
    df = ewm_mean(df, {"_f": ("close", fast), "_s": ("close", slow)})
    df = df.withColumns({"ma_diff": F.col("_f") - F.col("_s"), "ma_ratio": F.try_divide("_f", "_s"), "_up": F.col("_f") > F.col("_s")})
    before = F.lag("_up", 1, False).over(over_key())
    return df.withColumns({"ma_cross_up": flag(F.col("_up") & ~before), "ma_cross_down": flag(~F.col("_up") & before)}).drop("_f", "_s", "_up")


def volume(df: DataFrame) -> DataFrame:
    """``volume_sma, volume_ratio, obv, obv_sma, volume_momentum``; only where there is a volume column."""
    if "volume" not in df.columns:
        return df
    change = F.coalesce(F.signum(F.col("close") - lag(F.col("close"))), F.lit(0.0))
    df = df.withColumns({"volume_sma": rolling(F.avg, F.col("volume"), 20), "_flow": change * F.col("volume"), "volume_momentum": _change(F.col("volume"), 5)})
    df = df.withColumns({"volume_ratio": F.try_divide("volume", "volume_sma"), "obv": F.sum("_flow").over(running())})
    return df.withColumn("obv_sma", rolling(F.avg, F.col("obv"), 20)).drop("_flow")


def momentum(df: DataFrame, windows: tuple[int, ...] = (5, 10, 21, 63)) -> DataFrame:
    out = {}
    held = F.last("close", ignorenulls=True).over(running())
    df = df.withColumn("_held", held)
    for n in windows:
        out[f"momentum_{n}"] = _change(F.col("close"), n)
        out[f"roc_{n}"] = 100 * _change(F.col("_held"), n)
    return df.withColumns(out).drop("_held")


def atr(df: DataFrame, window: int = 14) -> DataFrame:
    """``atr``: exponential mean of the true range; null without highs and lows."""
    if not {"high", "low"} <= set(df.columns):
        return df.withColumn("atr", F.lit(None).cast("double"))
    before = lag(F.col("close"))
    df = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return ewm_mean(df, {"atr": ("_tr", window)}).drop("_tr")


def rolling_volatility(df: DataFrame, window: int = 21, annualize: bool = True) -> DataFrame:
    df = df.withColumn("_r", _change(F.col("close"), 1))
    return df.withColumn("rolling_volatility", rolling(F.stddev_samp, F.col("_r"), window) * (YEAR**0.5 if annualize else 1.0)).drop("_r")


def fill_missing(df: DataFrame, column: str, method: str = "ffill", limit: int | None = None) -> DataFrame:
    """Fill nulls of a column forward, backward or linearly; ``limit`` bounds the nulls filled in a row."""
    if method not in ("ffill", "bfill", "interpolate"):
        raise ValueError(f"unknown fill method: {method}")
    ahead = over_key().rowsBetween(0, Window.unboundedFollowing)
    x, n = F.col(column), F.row_number().over(over_key())
    df = df.withColumn("_n", n)
    at = F.when(x.isNotNull(), F.col("_n"))
    df = df.withColumns({"_pn": F.last(at, ignorenulls=True).over(running()), "_px": F.last(x, ignorenulls=True).over(running()), "_nn": F.first(at, ignorenulls=True).over(ahead), "_nx": F.first(x, ignorenulls=True).over(ahead)})
    if method == "bfill":
        value, far = F.col("_nx"), F.col("_nn") - F.col("_n")
    else:
        far = F.col("_n") - F.col("_pn")
        line = F.col("_px") + (F.col("_nx") - F.col("_px")) * (far / (F.col("_nn") - F.col("_pn")))
        value = F.col("_px") if method == "ffill" else F.when(F.col("_nn").isNull(), F.col("_px")).otherwise(line)
    if limit is not None:
        value = F.when(far <= limit, value)
    return df.withColumn(column, F.coalesce(x, value)).drop("_n", "_pn", "_px", "_nn", "_nx")


def combined(df: DataFrame, column: str = "close", symbols: list[str] | None = None) -> DataFrame:
    """Symbols as columns, a row for each date."""
    return df.groupBy("date").pivot("symbol", symbols).agg(F.first(column))


def build_all(df: DataFrame, include_volume: bool = True) -> DataFrame:
    """All price features in one pass over one partitioning."""
    for step in (returns, log_returns, volatility, momentum, moving_averages, ma_crossover, rsi, macd, stochastic, bollinger, atr):
        df = step(df)
    return volume(df) if include_volume else df

