"""Risk: value at risk, expected shortfall, volatility, regimes, tails; one row or column set per symbol.

Most operators take bars ``symbol, date, close, ...``; ``daily`` gives the returns they work on.
"""

from __future__ import annotations

from math import pi
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running_share
from ..functions.staging import settled
from ..functions.windows import ewm_variance, flag, frame, full, lag, over_key, rolling, run_id

YEAR = 252.0
EPS = 1e-6
LEVELS = (0.95, 0.99)
MIN_RETURNS = 10


def daily(df: DataFrame) -> DataFrame:
    """``symbol, date, close, ret``: daily returns without each symbol's first bar."""
    before = lag(F.col("close"))
    return df.select("symbol", "date", "close", (F.try_divide(F.col("close"), before) - 1).alias("ret")).filter("ret is not null")


def _tail(level: float) -> Column:
    return F.percentile("ret", 1 - level)


def historical_var(level: float) -> Column:
    return -_tail(level)


def parametric_var(level: float) -> Column:
    return -(F.avg("ret") + NormalDist().inv_cdf(1 - level) * F.stddev_samp("ret"))


def var_grid(df: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """``symbol, method, confidence, var, es, annual_var``: value at risk and expected shortfall per method and level.
    Symbols with fewer than ten returns have nulls."""
    r = daily(df)
    stats = r.groupBy("symbol").agg(F.count("*").alias("_n"), *[e.alias(f"{m}_{i}") for i, c in enumerate(levels) for m, e in (("h", historical_var(c)), ("p", parametric_var(c)))])
    tails = r.join(stats, "symbol").groupBy("symbol").agg(*[F.avg(F.when(F.col("ret") <= -F.col(f"h_{i}"), F.col("ret"))).alias(f"e_{i}") for i in range(len(levels))])
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(f"{c:.0%}").alias("confidence"), F.col(f"{m[0]}_{i}").alias("var"), (-F.col(f"e_{i}")).alias("es")) for i, c in enumerate(levels) for m in ("historical", "parametric")]))
    out = stats.join(tails, "symbol").select("symbol", "_n", grid.alias("g")).select("symbol", "_n", "g.*")
    ok = lambda c: F.when(F.col("_n") >= MIN_RETURNS, F.col(c))
    return out.select("symbol", "method", "confidence", ok("var").alias("var"), ok("es").alias("es"), (ok("var") * YEAR**0.5).alias("annual_var"))


def standard_normal(*parts: Column) -> Column:
    """A draw that depends on its parts alone: two uniforms from the digest of their text, turned into a normal (Box and Muller)."""
    code = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    u, v = [(F.conv(F.substring(code, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0 for at in (1, 9)]
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * pi * v)


def monte_carlo_var(df: DataFrame, level: float = 0.95, simulations: int = 10000, seed: int = 42) -> DataFrame:
    """``symbol, var``: loss quantile of draws from each symbol's normal. A draw follows from seed, symbol and number alone, so the
    result is the same however the work is split; draws are made in parallel for each symbol."""
    stats = daily(df).groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    draws = stats.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(simulations))))
    drawn = F.col("m") + F.col("s") * standard_normal(F.lit(seed), F.col("symbol"), F.col("i"))
    return draws.withColumn("ret", drawn).groupBy("symbol").agg((-_tail(level)).alias("var"))


def _in_order(n: int) -> Column:
    """The frame's returns, ascending: one native sort a row, for all levels."""
    return F.sort_array(F.collect_list("ret").over(frame(n)))


def _quantile(ordered: Column, n: int, q: float) -> Column:
    """Interpolated quantile of ``n`` ascending values."""
    k = min(int((n - 1) * q), n - 1)
    share = (n - 1) * q - k
    low, high = F.get(ordered, F.lit(k)), F.get(ordered, F.lit(min(k + 1, n - 1)))
    return (1 - share) * low + share * high


def rolling_var(df: DataFrame, windows: tuple[int, ...] = (21, 63), levels: tuple[float, ...] = LEVELS) -> DataFrame:
    df = df.withColumns({f"_s_{n}": _in_order(n) for n in windows})
    out = {f"var_{c * 100:.0f}_{n}": full(-_quantile(F.col(f"_s_{n}"), n, 1 - c), F.col("ret"), n) for c in levels for n in windows}
    return df.withColumns(out).drop(*[f"_s_{n}" for n in windows])


def rolling_es(df: DataFrame, windows: tuple[int, ...] = (21, 63), levels: tuple[float, ...] = LEVELS) -> DataFrame:
    df = df.withColumns({f"_s_{n}": _in_order(n) for n in windows})
    for n in windows:
        for c in levels:
            ordered = F.col(f"_s_{n}")
            df = df.withColumn("_p", _quantile(ordered, n, 1 - c))
            sums = F.aggregate(ordered, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.when(x <= F.col("_p"), F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))).otherwise(a))
            df = df.withColumn("_t", sums).withColumn(f"es_{c * 100:.0f}_{n}", full(-F.try_divide(F.col("_t.s"), F.col("_t.n")), F.col("ret"), n))
    return df.drop("_p", "_t", *[f"_s_{n}" for n in windows])


def var_backtest(df: DataFrame, window: int = 63, level: float = 0.95) -> DataFrame:
    """Kupiec test of rolling historical VaR: violations, expected, ratio, likelihood ratio, p-value, pass."""
    r = rolling_var(daily(df), (window,), (level,)).withColumnRenamed(f"var_{level * 100:.0f}_{window}", "var").filter("var is not null")
    p0 = 1 - level
    out = r.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(-F.col("ret") > F.col("var")).alias("violations"))
    p, n, x = F.col("violations") / F.col("n"), F.col("n"), F.col("violations")
    part = lambda k, q: F.when(k == 0, F.lit(0.0)).otherwise(k * F.log(q))
    lr = -2 * (n * F.log(F.lit(1 - p0)) + x * F.log(F.lit(p0 / (1 - p0))) - part(n - x, 1 - p) - part(x, p))
    out = out.withColumns({"expected": n * p0, "ratio": x / (n * p0), "lr_statistic": F.when((p > 0) & (p < 1), F.greatest(lr, F.lit(0.0)))})

    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        return v.map(lambda z: erfc(sqrt(z / 2)), na_action="ignore")

    edge = F.when(p > p0, F.lit(0.0)).otherwise(F.lit(1.0))
    out = out.withColumn("p_value", F.coalesce(tail("lr_statistic"), edge))
    return out.withColumn("passed", F.col("p_value") > 0.05)


def realized_volatility(df: DataFrame, windows: tuple[int, ...] = (5, 10, 21, 63)) -> DataFrame:
    return df.withColumns({f"realized_vol_{n}": rolling(F.stddev_samp, F.col("ret"), n) * YEAR**0.5 for n in windows})


def ewma_volatility(df: DataFrame, spans: tuple[int, ...] = (21,)) -> DataFrame:
    for n in spans:
        df = ewm_variance(df, "_v", "ret", n).withColumn(f"ewma_vol_{n}", F.sqrt("_v") * YEAR**0.5).drop("_v")
    return df


def vol_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({f"vol_ratio_{a}_{b}": F.col(f"realized_vol_{a}") / (F.col(f"realized_vol_{b}") + EPS) for a, b in ((5, 10), (10, 21), (21, 63))})


def parkinson(df: DataFrame, window: int = 21) -> DataFrame:
    """``parkinson_vol``: range volatility of bars."""
    span = F.pow(F.log(F.col("high") / F.col("low")), F.lit(2.0)) / (4 * F.log(F.lit(2.0)))
    df = df.withColumn("_s", F.when(F.col("low") > 0, span))
    return df.withColumn("parkinson_vol", F.sqrt(rolling(F.avg, F.col("_s"), window)) * YEAR**0.5).drop("_s")


def vol_regime(df: DataFrame, window: int = 63, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """``vol_regime``, its flags and ``vol_regime_duration``: rolling volatility ranked among all so far.

    The rank is the share of the rows so far (warm-up rows count) with a smaller volatility, counted by blocks.
    """
    df = df.withColumn("_vol", rolling(F.stddev_samp, F.col("ret"), window) * YEAR**0.5)
    df = running_share(df, "_vol", "vol_percentile", window).drop("_vol")
    p = F.col("vol_percentile")
    label = F.when(p < low, "low").when(p > high, "high").when(p.isNotNull(), "medium")
    df = df.withColumn("vol_regime", label).drop("vol_percentile")
    df = df.withColumns({f"vol_regime_{k}": flag(F.col("vol_regime") == k) for k in ("low", "medium", "high")})
    before = F.last("vol_regime", ignorenulls=True).over(over_key().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_run", run_id(F.col("vol_regime").isNotNull() & (before.isNull() | (before != F.col("vol_regime")))))
    length = F.count("vol_regime").over(Window.partitionBy("symbol", "_run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("vol_regime_duration", F.when(F.col("vol_regime").isNotNull(), length)).drop("_run")


def vol_cone(df: DataFrame, windows: tuple[int, ...] = (5, 10, 21, 63, 126, 252), percents: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """``symbol, window, p5.. p95, current``: percentiles of each rolling volatility."""
    r = daily(df).withColumns({f"v{n}": rolling(F.stddev_samp, F.col("ret"), n) * YEAR**0.5 for n in windows})
    rows = r.select("symbol", "date", F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"v{n}").alias("vol")) for n in windows])).alias("x")).select("symbol", "date", "x.*").filter("vol is not null")
    return rows.groupBy("symbol", "window").agg(*[F.percentile("vol", p / 100).alias(f"p{p}") for p in percents], F.max_by("vol", "date").alias("current"))


def vol_term_structure(df: DataFrame, windows: tuple[int, ...] = (5, 10, 21, 63, 126, 252)) -> DataFrame:
    """``symbol, window, volatility`` of the last returns."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    r = daily(df).withColumn("_k", back)
    out = r.groupBy("symbol").agg(F.count("*").alias("_n"), *[(F.stddev_samp(F.when(F.col("_k") <= n, F.col("ret"))) * YEAR**0.5).alias(f"v{n}") for n in windows])
    rows = out.select("symbol", "_n", F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"v{n}").alias("volatility")) for n in windows])).alias("x"))
    return rows.filter("_n >= x.window").select("symbol", "x.*")


def tail_risk(df: DataFrame, window: int = 63) -> DataFrame:
    """``skewness, kurtosis`` (bias-corrected) and ``tail_ratio`` of rolling returns."""
    n, r = float(window), F.col("ret")
    w = frame(window)
    g1, g2 = F.skewness(r).over(w), F.kurtosis(r).over(w)
    p5, p95 = F.percentile(r, 0.05).over(w), F.percentile(r, 0.95).over(w)
    return df.withColumns(
        {
            "skewness": full(g1 * (n * (n - 1)) ** 0.5 / (n - 2), r, window),
            "kurtosis": full((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), r, window),
            "tail_ratio": full(F.when(p95 != 0, F.abs(p5) / (F.abs(p95) + EPS)), r, window),
        }
    )


def risk_adjusted(df: DataFrame, window: int = 21) -> DataFrame:
    """``sharpe_ratio, sortino_ratio, calmar_ratio`` over rolling returns; ``df`` has ``ret`` and ``drawdown``."""
    r = F.col("ret")
    mean = rolling(F.avg, r, window) * YEAR
    down = F.when(r < 0, r)
    dev = F.when(F.count(down).over(frame(window)) >= 2, F.stddev_samp(down).over(frame(window)))
    return df.withColumns(
        {
            "sharpe_ratio": mean / (rolling(F.stddev_samp, r, window) * YEAR**0.5 + EPS),
            "sortino_ratio": full(mean / (dev * YEAR**0.5 + EPS), r, window),
            "calmar_ratio": mean / (rolling(F.max, F.col("drawdown"), window) + EPS),
        }
    )


TASK_ROWS, CELLS = 200_000, 2_000_000  # rows of a task that fits several symbols; cells of the arrays it works on


def _variances(x: np.ndarray, first: np.ndarray, omega: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Conditional variances of many series at once: time is the first axis of ``x``, the others are those of the parameters."""
    out = np.empty((len(x), *np.broadcast_shapes(x.shape[1:], np.shape(omega))))
    out[0] = first
    for t in range(1, len(x)):
        out[t] = omega + a * x[t - 1] ** 2 + b * out[t - 1]
    return out


def _parameters(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positive omegas, alphas and betas between 0 and 1, from free values on the last axis."""
    return np.exp(p[..., 0]), 1 / (1 + np.exp(-p[..., 1])), 1 / (1 + np.exp(-p[..., 2]))


def _simplex(f, start: np.ndarray, rounds: int = 250) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Downhill simplex searches of many problems side by side: best points, their values, whether each settled.
    ``f(which, points)``: values of points of those problems."""
    n, k = start.shape
    points = start[:, None, :] + np.concatenate([np.zeros((1, k)), 0.5 * np.eye(k)])
    values, settled, live = f(np.arange(n), points), np.zeros(n, bool), np.arange(n)
    for _ in range(rounds):
        order = np.argsort(values[live], axis=1, kind="stable")
        points[live], values[live] = np.take_along_axis(points[live], order[..., None], 1), np.take_along_axis(values[live], order, 1)
        still = ~(values[live, -1] - values[live, 0] < 1e-7)
        settled[live[~still]] = True
        live = live[still]
        if not len(live):
            break
        own = points[live]
        centre = own[:, :-1].mean(axis=1)
        tries = np.stack([centre + c * (centre - own[:, -1]) for c in (1.0, 2.0, -0.5)], axis=1)
        found = f(live, tries)
        best = found.argmin(axis=1)
        value = found[np.arange(len(live)), best]
        better = value < values[live, -1]
        points[live[better], -1], values[live[better], -1] = tries[better, best[better]], value[better]
        if len(rest := live[~better]):
            points[rest, 1:] = points[rest, :1] + 0.5 * (points[rest, 1:] - points[rest, :1])
            values[rest, 1:] = f(rest, points[rest, 1:])
    return points[:, 0], values[:, 0], settled


def _fit_garch(series: list[np.ndarray]) -> list[tuple[float, float, float, bool, np.ndarray]]:
    """For each series of returns omega, alpha, beta of percent returns, whether the search settled, and the conditional variances.
    Where the likelihood has no usable maximum: the exponential mean variance with alpha 0.1 and beta 0.85. All series are
    searched together, as arrays."""
    long = max(map(len, series))
    x, inside = np.zeros((long, len(series))), np.zeros((long, len(series)), bool)
    for i, ret in enumerate(series):
        x[: len(ret), i] = 100 * ret - (100 * ret).mean()
        inside[: len(ret), i] = True
    var = np.array([x[: len(ret), i].var() for i, ret in enumerate(series)])

    def loss(which: np.ndarray, p: np.ndarray) -> np.ndarray:
        omega, a, b = _parameters(p)
        own, known = x[:, which, None], inside[:, which, None]
        v = _variances(own, var[which, None], omega, a, b)
        out = np.where(known, np.log(v) + own * own / v, 0.0).sum(axis=0)
        return np.where(a + b >= 0.9999, 1e12, out)

    usable = np.flatnonzero(var > 0)
    out: list = [None] * len(series)
    with np.errstate(all="ignore"):
        if len(usable):
            start = np.stack([np.log(0.1 * var[usable]), np.full(len(usable), -2.2), np.full(len(usable), 1.5)], axis=1)
            points, values, settled = _simplex(lambda which, p: loss(usable[which], p), start)
            omega, a, b = _parameters(points)
            v = _variances(x[:, usable], var[usable], omega, a, b)
            for j, i in enumerate(usable):
                if np.isfinite(values[j]) and values[j] < 1e12:
                    out[i] = float(omega[j]), float(a[j]), float(b[j]), bool(settled[j]), v[: len(series[i]), j]
    for i, ret in enumerate(series):
        if out[i] is None:
            own = pd.Series(x[: len(ret), i]).ewm(span=21, adjust=False).var().bfill().fillna(0.0).to_numpy()
            out[i] = 0.0, 0.1, 0.85, False, own
    return out


def _fitted(rows: pd.DataFrame, least: int) -> list[tuple[str, pd.DataFrame, tuple | None]]:
    """Each symbol's rows by date with its fit, None for fewer than ``least``; symbols of alike lengths are fitted together."""
    parts = [(name, own.sort_values("date")) for name, own in rows.groupby("symbol", sort=True)]
    todo = sorted((len(own), i) for i, (_, own) in enumerate(parts) if len(own) >= least)
    fits: dict[int, tuple] = {}
    while todo:
        n = max(1, CELLS // todo[-1][0])
        some, todo = todo[-n:], todo[:-n]
        fits.update(zip([i for _, i in some], _fit_garch([parts[i][1]["ret"].to_numpy(np.float64) for _, i in some]), strict=True))
    return [(name, own, fits.get(i)) for i, (name, own) in enumerate(parts)]


def _in_batches(r: DataFrame, task, schema: str) -> DataFrame:
    """``task`` over the rows of several symbols at once, as many as make up a task's rows; one symbol is never split."""
    r = settled(r.select("symbol", "date", "ret"), "returns")
    batches = max(1, -(-r.count() // TASK_ROWS))
    return r.withColumn("_batch", F.pmod(F.xxhash64("symbol"), F.lit(batches))).groupBy("_batch").applyInPandas(task, schema)


def garch(df: DataFrame, horizon: int = 5, min_returns: int = 20) -> DataFrame:
    """GARCH(1,1) of each symbol: ``omega, alpha, beta, persistence, long_run_vol, forecast`` (daily deviations),
    ``converged``; nulls for symbols with too few returns."""
    schema = "symbol string, omega double, alpha double, beta double, persistence double, long_run_vol double, forecast array<double>, converged boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, own, found in _fitted(rows, min_returns):
            if found is None:
                out.append((name, None, None, None, None, None, None, False))
                continue
            omega, a, b, settled_, v = found
            ret = own["ret"].to_numpy()
            far, ahead = (v[-1], v[-1]) if omega == 0 else (omega / (1 - a - b), omega + a * (100 * (ret[-1] - ret.mean())) ** 2 + b * v[-1])
            path = [float(np.sqrt(far + (a + b) ** k * (ahead - far))) / 100 for k in range(horizon)]
            out.append((name, omega, a, b, a + b, float(np.sqrt(far)) / 100, path, settled_))
        return pd.DataFrame(out, columns=names)

    return _in_batches(daily(df), fit, schema)


def garch_variances(df: DataFrame, omega: float, alpha: float, beta: float) -> DataFrame:
    """``symbol, date, variance`` of percent returns under given parameters, the first being the sample's (population) variance."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, own in rows.groupby("symbol"):
            own = own.sort_values("date")
            x = 100 * own["ret"].to_numpy(np.float64)
            x = x - x.mean()
            out.append(pd.DataFrame({"symbol": name, "date": own["date"], "variance": _variances(x, x.var(), omega, alpha, beta)}))
        return pd.concat(out) if out else rows.assign(variance=0.0)[["symbol", "date", "variance"]]

    return _in_batches(daily(df), run, "symbol string, date date, variance double")


def garch_features(df: DataFrame, min_returns: int = 100) -> DataFrame:
    """``garch_vol, garch_forecast_1, garch_persistence, vol_surprise`` per row. The fit sees a symbol's whole history,
    so these look ahead; they are left out of the default feature set."""
    schema = "symbol string, date date, garch_vol double, garch_forecast_1 double, garch_persistence double"

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, own, found in _fitted(rows, min_returns):
            part = pd.DataFrame({"symbol": name, "date": own["date"], "garch_vol": np.nan, "garch_forecast_1": np.nan, "garch_persistence": np.nan})
            if found is not None:
                omega, a, b, _, v = found
                ret = own["ret"].to_numpy()
                ahead = v[-1] if omega == 0 else omega + a * (100 * (ret[-1] - ret.mean())) ** 2 + b * v[-1]
                part["garch_vol"], part["garch_forecast_1"], part["garch_persistence"] = np.sqrt(v) / 100 * YEAR**0.5, np.sqrt(ahead) / 100 * YEAR**0.5, a + b
            out.append(part)
        return pd.concat(out)

    numbers = ("garch_vol", "garch_forecast_1", "garch_persistence")
    r = daily(df)
    found = _in_batches(r, fit, schema)
    found = found.select("symbol", "date", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in numbers])
    out = r.join(found, ["symbol", "date"])
    week = rolling(F.stddev_samp, F.col("ret"), 5) * YEAR**0.5
    return out.withColumn("vol_surprise", week / (lag(F.col("garch_vol")) + EPS)).drop("close", "ret")
