"""Features against their pandas definitions on seeded series, and invariants."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.windows import ewm_mean, ewm_variance
from quantloom.operators import drawdown, ml, price, risk, sentiment


@pytest.fixture(scope="module")
def series():
    r = np.random.default_rng(42)
    n = 1400
    close = 100 * np.cumprod(1 + r.normal(0.0005, 0.02, n))
    high, low = close * (1 + np.abs(r.normal(0, 0.01, n))), close * (1 - np.abs(r.normal(0, 0.01, n)))
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return pd.DataFrame({"symbol": "A", "date": days, "open": np.r_[close[0], close[:-1]], "high": high, "low": low, "close": close, "volume": r.integers(1_000_000, 10_000_000, n).astype(float)})


@pytest.fixture(scope="module")
def bars(spark, series):
    return spark.createDataFrame(series).repartition(3).cache()


def out(df, *columns):
    return df.select("date", *columns).orderBy("date").toPandas()


def same(got, want, tol=1e-8):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.allclose(got, want, rtol=tol, atol=tol, equal_nan=True)


@pytest.mark.parametrize("span", [3, 5, 14, 63])
def test_ewm_over_several_blocks(bars, series, span):
    got = out(ewm_mean(bars, {"m": ("close", span)}), "m")
    same(got["m"], series["close"].ewm(span=span, adjust=False).mean())


def test_ewm_variance(bars, series):
    ret = series["close"].pct_change().dropna()
    got = out(ewm_variance(risk.daily(bars), "v", "ret", 21), "v")
    same(got["v"], ret.ewm(span=21, adjust=False).var(), 1e-6)


def test_rsi_macd_atr(bars, series):
    c, d = series["close"], series["close"].diff().fillna(0)
    g, l = d.clip(lower=0).ewm(span=14, adjust=False).mean(), (-d.clip(upper=0)).ewm(span=14, adjust=False).mean()
    got = out(price.atr(price.macd(price.rsi(bars))), "rsi_14", "macd", "macd_signal", "atr")
    same(got["rsi_14"], (100 - 100 / (1 + g / l.replace(0, np.nan))).fillna(50))
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    same(got["macd"], macd)
    same(got["macd_signal"], macd.ewm(span=9, adjust=False).mean())
    tr = pd.concat([series["high"] - series["low"], (series["high"] - c.shift()).abs(), (series["low"] - c.shift()).abs()], axis=1).max(axis=1)
    same(got["atr"], tr.ewm(span=14, adjust=False).mean())


def test_rising_prices_have_rsi_50_and_no_drawdown(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(100 + i)) for i in range(60)], "symbol string, date date, close double")
    assert price.rsi(df).filter("rsi_14 <> 50").count() == 0
    row = drawdown.totals(df).first()
    assert row.max_drawdown == 0 and row.calmar_ratio is None


def test_rolling_features(bars, series):
    c, r = series["close"], series["close"].pct_change()
    got = out(price.bollinger(price.volatility(bars)), "volatility_21", "bb_middle", "bb_upper")
    same(got["volatility_21"], r.rolling(21).std() * math.sqrt(252))
    same(got["bb_upper"], c.rolling(20).mean() + 2 * c.rolling(20).std())
    t = out(risk.tail_risk(risk.daily(bars)), "skewness", "kurtosis")
    same(t["skewness"], r.dropna().rolling(63).skew(), 1e-5)
    same(t["kurtosis"], r.dropna().rolling(63).kurt(), 1e-5)


def test_fill_missing(spark):
    values = [None, 1.0, None, None, 4.0, None, None]
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1 + i), v) for i, v in enumerate(values)], "symbol string, date date, close double")
    s = pd.Series([math.nan if v is None else v for v in values])
    for method, want in (("ffill", s.ffill(limit=1)), ("bfill", s.bfill(limit=1)), ("interpolate", s.interpolate(limit=1))):
        same(out(price.fill_missing(df, "close", method, limit=1), "close")["close"], want)
    with pytest.raises(ValueError):
        price.fill_missing(df, "close", "zero")


def test_truncation_changes_no_earlier_feature(bars):
    cut = dt.date(2019, 6, 1)
    names = ["rsi_14", "macd_histogram", "bb_pct_b", "obv", "stoch_d", "ema_63"]
    a = out(price.build_all(bars).filter(F.col("date") < cut), *names)
    b = out(price.build_all(bars.filter(F.col("date") < cut)), *names)
    for n in names:
        same(a[n], b[n])


def test_value_at_risk_of_known_quantiles(spark):
    closes, rows = [100.0], []
    for x in np.linspace(-0.05, 0.05, 100).tolist():
        closes.append(closes[-1] * (1 + x))
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), c) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    grid = {(r.method, r.confidence): r for r in risk.var_grid(df).collect()}
    assert abs(grid["historical", "95%"].var - 0.045) < 0.001
    assert grid["historical", "99%"].var > grid["historical", "95%"].var
    assert all(r.es >= r.var for k, r in grid.items() if k[0] == "historical")
    mc = risk.monte_carlo_var(df).first()["var"]
    assert abs(mc - grid["parametric", "95%"].var) < 0.01
    assert risk.var_grid(df.limit(5)).filter("var is not null").count() == 0


def test_drawdown_episodes(spark):
    values = [100, 110, 99, 88, 105, 111, 100, 90]
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1 + i), float(v)) for i, v in enumerate(values)], "symbol string, date date, close double")
    a, b = sorted(drawdown.episodes(df).collect(), key=lambda r: r.start_date)
    assert (a.start_date.day, a.trough_date.day, a.end_date.day, a.recovery_days, a.duration_days) == (2, 4, 6, 2, 4)
    assert b.end_date is None and not b.is_recovered and b.duration_days == 2
    d = drawdown.durations(df).first()
    assert (d.current_duration, d.max_duration, d.is_in_drawdown) == (2, 3, True)


def test_garch_is_stationary(bars):
    g = risk.garch(bars).first()
    assert 0 < g.persistence < 1 and len(g.forecast) == 5 and 0.005 < g.forecast[0] < 0.1


def test_half_life_and_validity(spark):
    at = dt.datetime(2024, 1, 1, 0, 0)
    rows = [("A", at, 1.0, 0.5), ("A", at + dt.timedelta(hours=23), 0.0, 0.5)]
    df = spark.createDataFrame(rows, "symbol string, article_ts timestamp, sentiment_score double, sentiment_confidence double")
    r = sentiment.aggregate_daily(df).first()
    assert 0.3 < r.sentiment_score < 0.4 and not r.signal_valid and r.article_count == 2
    assert sentiment.aggregate_daily(df.drop("sentiment_confidence")).first().sentiment_confidence == 0.5


def test_rank_signals_average_ties(spark):
    rows = [(s, dt.date(2024, 1, 1), v) for s, v in zip("abcd", [0.1, 0.2, 0.2, 0.9], strict=True)]
    df = spark.createDataFrame(rows, "symbol string, date date, sentiment_score double")
    got = {r.symbol: r.normalized_score for r in sentiment.signals_rank(df).collect()}
    assert got == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0}
    with pytest.raises(ValueError):
        sentiment.generate_signals(df, "other")


def test_published_sample_and_feature_counts(bars, series):
    first = series["date"][251]
    data = ml.ml_dataset(bars.filter(F.col("date") < first), 1, "return")
    assert data.count() == 125
    assert len(ml.feature_names(data)) >= 80


def test_folds_and_purge(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(125)], "symbol string, date date, close double")
    plan = ml.folds(df).orderBy("fold").collect()
    assert [(r.train_end, r.test_start, r.test_end) for r in plan][:2] == [(110, 111, 125), (96, 97, 111)]
    purged = ml.folds(df, purge=5).orderBy("fold").first()
    assert purged.train_end == 105


def test_signal_rules(spark):
    rows = [(1, 0.9, None), (2, 0.52, 0.1), (3, 0.1, 0.04), (4, 0.6, 0.0)]
    df = spark.createDataFrame(rows, "i int, probability double, expected_return double")
    got = {r.i: r for r in ml.trading_signals(df).collect()}
    assert got[1].direction == 1 and abs(got[1].strength - 0.64) < 1e-9
    assert got[2].direction == 0 and got[2].strength == 0
    assert got[3].direction == -1 and got[3].strength < 0
    assert got[4].direction == 0
