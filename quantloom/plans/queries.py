"""Registered queries over the star-schema tables, each with DuckDB SQL of its own where SQL can express it.

A query names its keys and columns; both sides are cut to these, doubles rounded alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import shared_folder
from ..functions.windows import lag
from ..operators import drawdown, lexicon, ml, predict, price, report, risk, sentiment, serve, text
from ..operators.boost import Boost
from ..sources import files
from ..sources.adapters import ARTICLES_SQL, BARS_SQL, articles, bars, headlines

YEAR = "sqrt(252.0)"


@dataclass(frozen=True)
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    keys: str = "symbol date"
    r6: str = ""  # doubles rounded to six places
    r3: str = ""  # doubles of price size, rounded to three
    r4: str = ""
    r9: str = ""  # means of few decimals, which would tie at six
    longs: str = ""
    ints: str = ""

    def doubles(self) -> list[tuple[str, int]]:
        return [(c, d) for d in (6, 3, 4, 9) for c in getattr(self, f"r{d}").split()]

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.fn(spark, sf_dir)
        if not (self.doubles() or self.longs or self.ints):
            return df
        clean = lambda c, d: (F.round(F.when(~F.isnan(c), F.col(c)), d) + F.lit(0.0)).alias(c)
        whole = [F.col(c).cast(t).alias(c) for t, names in (("long", self.longs), ("int", self.ints)) for c in names.split()]
        return df.select(*self.keys.split(), *[clean(c, d) for c, d in self.doubles()], *whole)

    def oracle(self) -> str | None:
        if self.sql is None or not (self.doubles() or self.longs or self.ints):
            return self.sql
        whole = [f"CAST({c} AS {t}) AS {c}" for t, names in (("BIGINT", self.longs), ("INTEGER", self.ints)) for c in names.split()]
        parts = [*self.keys.split(), *[f"round(CAST({c} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in self.doubles()], *whole]
        head, _, body = self.sql.rpartition("\nFINAL ")
        return f"{head}\nSELECT {', '.join(parts)} FROM ({body}) final_rows"


QUERIES: dict[str, Query] = {}


def add(name: str, fn, sql: str | None = None, **spec) -> None:
    QUERIES[name] = Query(fn, sql, **spec)


def on_bars(*steps) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        df = bars(spark, sf_dir)
        for s in steps:
            df = s(df)
        return df

    return run


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.aggregate_daily(articles(spark, sf_dir))


def on_daily(*steps) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        df = daily(spark, sf_dir)
        for s in steps:
            df = s(df)
        return df

    return run


def joined(*names: str, join: str = "JOIN") -> dict[str, str]:
    """SQL and columns of a query that has the columns of several others side by side."""
    parts = [QUERIES[n] for n in names]
    sql = "\nFINAL SELECT * FROM " + f" {join} ".join(f"({q.oracle()}) p{i}" + " USING (symbol, date)" * (i > 0) for i, q in enumerate(parts))
    every = lambda k: " ".join(dict.fromkeys(" ".join(getattr(q, k) for q in parts).split()))
    return {"sql": sql} | {k: every(k) for k in ("keys", "r6", "r3", "r4", "r9", "longs", "ints")}


W = "(PARTITION BY symbol ORDER BY date)"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RUN = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(value: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {value} OVER {frame(n)} END"


def change(x: str, k: int) -> str:
    return f"{x} / nullif(lag({x}, {k}) OVER {W}, 0) - 1"


def ewm(source: str, out: str, means: dict[str, tuple[str, int]]) -> str:
    """CTEs of a recursive exponential mean over the rows of ``source``."""
    carry = ", ".join(f"(2.0 / {s + 1}) * n.{c} + (1 - 2.0 / {s + 1}) * e.{m}" for m, (c, s) in means.items())
    return f"""{out}_n AS (SELECT *, row_number() OVER {W} AS rn FROM {source}),
{out}_e AS (SELECT symbol, rn, {', '.join(f'{c} AS {m}' for m, (c, _) in means.items())} FROM {out}_n WHERE rn = 1
 UNION ALL SELECT n.symbol, n.rn, {carry} FROM {out}_e e JOIN {out}_n n ON n.symbol = e.symbol AND n.rn = e.rn + 1),
{out} AS (SELECT n.*, {', '.join(f'e.{m}' for m in means)} FROM {out}_n n JOIN {out}_e e ON n.symbol = e.symbol AND n.rn = e.rn)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


RET_SQL = f"ret AS (SELECT * FROM (SELECT symbol, date, close, {change('close', 1)} AS ret FROM bars) t WHERE ret IS NOT NULL)"
DD_SQL = f"dd AS (SELECT *, (peak - close) / nullif(peak, 0) AS drawdown FROM (SELECT *, max(close) OVER {RUN} AS peak FROM bars) t)"


def weighted(group: str, end: str) -> str:
    return f"""SELECT *, article_count >= 3 AND sentiment_confidence >= 0.3 AS signal_valid FROM (SELECT symbol, {group[1]} AS {group[0]},
 sum(w * sentiment_score) / sum(w) AS sentiment_score, avg(sentiment_confidence) AS sentiment_confidence, count(*) AS article_count,
 avg(CASE WHEN sentiment_signal = 'bullish' THEN 1.0 ELSE 0.0 END) AS bullish_ratio, avg(CASE WHEN sentiment_signal = 'bearish' THEN 1.0 ELSE 0.0 END) AS bearish_ratio,
 stddev_pop(sentiment_score) AS sentiment_std
 FROM (SELECT *, exp(-ln(2.0) / 24 * (epoch_us({end}) - epoch_us(article_ts)) / 3.6e9) AS w FROM articles) a GROUP BY 1, 2) g"""


DAILY_SQL = "daily AS (" + weighted(("date", "CAST(article_ts AS DATE)"), "CAST(CAST(article_ts AS DATE) + 1 AS TIMESTAMP)") + ")"
BARS_ = with_(BARS_SQL)
RET_ = with_(BARS_SQL, RET_SQL)
DD_ = with_(BARS_SQL, DD_SQL)
DAILY_ = with_(ARTICLES_SQL, DAILY_SQL)

# --- prices
add("returns", on_bars(price.returns), BARS_ + f"\nFINAL SELECT symbol, date, {', '.join(f'{change('close', p)} AS return_{p}d' for p in (1, 5, 21))} FROM bars", r6="return_1d return_5d return_21d")
add("log_returns", on_bars(price.log_returns), BARS_ + f"\nFINAL SELECT symbol, date, {', '.join(f'ln(close / lag(close, {p}) OVER {W}) AS log_return_{p}d' for p in (1, 5, 21))} FROM bars", r6="log_return_1d log_return_5d log_return_21d")
add("momentum_roc", on_bars(price.momentum), BARS_ + f"\nFINAL SELECT symbol, date, {', '.join(f'{change('close', p)} AS momentum_{p}, 100 * ({change('close', p)}) AS roc_{p}' for p in (5, 10, 21, 63))} FROM bars", r6=" ".join(f"momentum_{p} roc_{p}" for p in (5, 10, 21, 63)))
add(
    "volume_obv", on_bars(price.volume),
    BARS_ + f""",
f AS (SELECT *, coalesce(sign(close - lag(close) OVER {W}), 0) * volume AS flow, {full('avg(volume)', 'volume', 20)} AS volume_sma, {change('volume', 5)} AS volume_momentum FROM bars),
o AS (SELECT *, sum(flow) OVER {RUN} AS obv FROM f)
FINAL SELECT *, volume / nullif(volume_sma, 0) AS volume_ratio, {full('avg(obv)', 'obv', 20)} AS obv_sma FROM o""",
    r6="volume_sma volume_ratio obv obv_sma volume_momentum",
)
add(
    "stochastic", on_bars(price.stochastic),
    BARS_ + f""",
k AS (SELECT *, 100 * (close - {full('min(low)', 'low', 14)}) / ({full('max(high)', 'high', 14)} - {full('min(low)', 'low', 14)} + 1e-10) AS stoch_k FROM bars)
FINAL SELECT *, {full('avg(stoch_k)', 'stoch_k', 3)} AS stoch_d FROM k""",
    r6="stoch_k stoch_d",
)
add(
    "bollinger", on_bars(price.bollinger),
    BARS_ + f""",
m AS (SELECT *, {full('avg(close)', 'close', 20)} AS bb_middle, {full('stddev_samp(close)', 'close', 20)} AS dev FROM bars),
b AS (SELECT *, bb_middle + 2 * dev AS bb_upper, bb_middle - 2 * dev AS bb_lower FROM m)
FINAL SELECT *, (close - bb_lower) / (bb_upper - bb_lower + 1e-10) AS bb_pct_b, (bb_upper - bb_lower) / bb_middle AS bb_bandwidth FROM b""",
    r6="bb_pct_b bb_bandwidth", r4="bb_middle bb_upper bb_lower",
)
_WIN = (5, 10, 21, 63)
add("sma_ema", on_bars(price.moving_averages), with_(BARS_SQL, ewm("bars", "x", {f"ema_{n}": ("close", n) for n in _WIN})) + f"\nFINAL SELECT *, {', '.join(f'{full('avg(close)', 'close', n)} AS sma_{n}' for n in _WIN)} FROM x", r3=" ".join(f"sma_{n} ema_{n}" for n in _WIN))
add(
    "ma_crossover", on_bars(price.ma_crossover),
    with_(BARS_SQL, ewm("bars", "x", {"f": ("close", 10), "s": ("close", 21)})) + f"""
FINAL SELECT *, f - s AS ma_diff, f / s AS ma_ratio, CASE WHEN f > s AND NOT coalesce(lag(f > s) OVER {W}, false) THEN 1 ELSE 0 END AS ma_cross_up,
 CASE WHEN f <= s AND coalesce(lag(f > s) OVER {W}, false) THEN 1 ELSE 0 END AS ma_cross_down FROM x""",
    r6="ma_ratio", r3="ma_diff", ints="ma_cross_up ma_cross_down",
)
add(
    "macd", on_bars(price.macd),
    with_(BARS_SQL, ewm("bars", "x", {"f": ("close", 12), "s": ("close", 26)}), "y AS (SELECT symbol, date, f - s AS macd FROM x)", ewm("y", "z", {"macd_signal": ("macd", 9)}))
    + "\nFINAL SELECT *, macd - macd_signal AS macd_histogram FROM z",
    r3="macd macd_signal macd_histogram",
)
add(
    "rsi", on_bars(price.rsi),
    with_(BARS_SQL, f"c AS (SELECT symbol, date, coalesce(close - lag(close) OVER {W}, 0) AS d FROM bars)", "g AS (SELECT symbol, date, greatest(d, 0) AS gain, greatest(-d, 0) AS loss FROM c)", ewm("g", "x", {"g": ("gain", 14), "l": ("loss", 14)}))
    + "\nFINAL SELECT *, coalesce(100 - 100 / (1 + g / nullif(l, 0)), 50) AS rsi_14 FROM x",
    r6="rsi_14",
)
add(
    "atr", on_bars(price.atr),
    with_(BARS_SQL, f"c AS (SELECT symbol, date, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM bars)", ewm("c", "x", {"atr": ("tr", 14)})) + "\nFINAL SELECT * FROM x",
    r3="atr",
)
_R1 = f"r AS (SELECT *, {change('close', 1)} AS ret FROM bars)"
add("rolling_volatility", on_bars(price.volatility), with_(BARS_SQL, _R1) + f"\nFINAL SELECT *, {', '.join(f'({full('stddev_samp(ret)', 'ret', n)}) * {YEAR} AS volatility_{n}' for n in _WIN)} FROM r", r6=" ".join(f"volatility_{n}" for n in _WIN))
add("parkinson", on_bars(risk.parkinson), with_(BARS_SQL, "r AS (SELECT *, pow(ln(high / low), 2) / (4 * ln(2.0)) AS s FROM bars)") + f"\nFINAL SELECT *, sqrt({full('avg(s)', 's', 21)}) * {YEAR} AS parkinson_vol FROM r", r6="parkinson_vol")


def _gappy(df: DataFrame) -> DataFrame:
    return df.withColumn("close", F.when(F.dayofmonth("date") % 7 != 0, F.col("close")))


def _filled(spark, sf_dir):
    df = _gappy(bars(spark, sf_dir)).select("symbol", "date", "close")
    out = df.withColumns({"ffill": F.col("close"), "bfill": F.col("close"), "line": F.col("close")})
    return price.fill_missing(price.fill_missing(price.fill_missing(out, "ffill", limit=1), "bfill", "bfill"), "line", "interpolate")


_AHEAD = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
add(
    "fill_missing", _filled,
    BARS_ + f""",
g AS (SELECT symbol, date, CASE WHEN day(date) % 7 <> 0 THEN close END AS x, row_number() OVER {W} AS n FROM bars),
p AS (SELECT *, last_value(x IGNORE NULLS) OVER {RUN} AS px, last_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER {RUN} AS pn,
 first_value(x IGNORE NULLS) OVER {_AHEAD} AS nx, first_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER {_AHEAD} AS nn FROM g)
FINAL SELECT symbol, date, coalesce(x, CASE WHEN n - pn <= 1 THEN px END) AS ffill, coalesce(x, nx) AS bfill,
 coalesce(x, CASE WHEN nn IS NULL THEN px ELSE px + (nx - px) * (CAST(n - pn AS DOUBLE) / (nn - pn)) END) AS line FROM p""",
    r3="ffill bfill line",
)
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
add("combined_prices", on_bars(lambda df: price.combined(df, "close", _PRIORITIES)), BARS_ + " SELECT date, " + ", ".join(f"max(close) FILTER (symbol = '{p}') AS \"{p}\"" for p in _PRIORITIES) + " FROM bars GROUP BY date")


add("price_features_all", on_bars(price.build_all), **joined("returns", "log_returns", "rolling_volatility", "momentum_roc", "sma_ema", "ma_crossover", "rsi", "macd", "stochastic", "bollinger", "atr", "volume_obv"))

# --- sentiment
_DCOLS = "sentiment_score sentiment_confidence bullish_ratio bearish_ratio sentiment_std"
add("daily_sentiment", daily, DAILY_ + "\nFINAL SELECT * FROM daily", keys="symbol date signal_valid", r9=_DCOLS, longs="article_count")
add(
    "weekly_sentiment", lambda s, d: sentiment.aggregate_weekly(articles(s, d)),
    with_(ARTICLES_SQL, "weekly AS (" + weighted(("week_start", "CAST(date_trunc('week', article_ts) AS DATE)"), "CAST(CAST(date_trunc('week', article_ts) AS DATE) + 7 AS TIMESTAMP)") + ")")
    + "\nFINAL SELECT *, sentiment_score - lag(sentiment_score) OVER (PARTITION BY symbol ORDER BY week_start) AS sentiment_momentum FROM weekly",
    keys="symbol week_start signal_valid", r9=_DCOLS + " sentiment_momentum", longs="article_count",
)
_LABEL = "CASE WHEN {up} THEN 'bullish' WHEN {down} THEN 'bearish' ELSE 'neutral' END AS signal"
_SIG = {"keys": "symbol date signal", "r6": "sentiment_score normalized_score signal_strength"}
add("signals_absolute", on_daily(sentiment.signals_absolute), DAILY_ + f"\nFINAL SELECT *, greatest(-1, least(1, sentiment_score)) AS normalized_score, {_LABEL.format(up='sentiment_score > 0.5', down='sentiment_score < -0.5')}, least(1, abs(sentiment_score)) AS signal_strength FROM daily", **_SIG)
_Z = "z AS (SELECT *, coalesce(CASE WHEN stddev_samp(sentiment_score) OVER (PARTITION BY date) > 0 THEN (sentiment_score - avg(sentiment_score) OVER (PARTITION BY date)) / stddev_samp(sentiment_score) OVER (PARTITION BY date) ELSE 0 END, 0) AS normalized_score FROM daily),\nsig AS (SELECT *, " + _LABEL.format(up="normalized_score > 1", down="normalized_score < -1") + ", least(abs(normalized_score) / 3, 1) AS signal_strength FROM z)"
SIGNALS_ = with_(ARTICLES_SQL, DAILY_SQL, _Z)
add("signals_zscore", on_daily(sentiment.signals_zscore), SIGNALS_ + "\nFINAL SELECT * FROM sig", **_SIG)
add(
    "signals_rank", on_daily(sentiment.signals_rank),
    DAILY_ + f""",
r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY date) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY date ORDER BY sentiment_score) + (count(*) OVER (PARTITION BY date, sentiment_score) - 1) / 2.0) / count(*) OVER (PARTITION BY date) END AS normalized_score FROM daily)
FINAL SELECT *, {_LABEL.format(up='normalized_score > 0.75', down='normalized_score < 0.25')}, 2 * abs(normalized_score - 0.5) AS signal_strength FROM r""",
    **_SIG,
)
_S = "sentiment_score"
add("sentiment_momentum", on_daily(sentiment.score_momentum), DAILY_ + f",\nm AS (SELECT *, {_S} - lag({_S}, 5) OVER {W} AS sentiment_momentum FROM daily)\nFINAL SELECT *, sentiment_momentum - lag(sentiment_momentum) OVER {W} AS sentiment_acceleration FROM m", r6="sentiment_momentum sentiment_acceleration")
add("sentiment_lags", on_daily(sentiment.lags), DAILY_ + f"\nFINAL SELECT *, {', '.join(f'lag({_S}, {k}) OVER {W} AS sentiment_lag_{k}' for k in (1, 2, 3, 5, 7))} FROM daily", r6=" ".join(f"sentiment_lag_{k}" for k in (1, 2, 3, 5, 7)))
add("sentiment_changes", on_daily(sentiment.changes), DAILY_ + f"\nFINAL SELECT *, {', '.join(f'{_S} - lag({_S}, {k}) OVER {W} AS sentiment_change_{k}, ({_S} - lag({_S}, {k}) OVER {W}) / (abs(lag({_S}, {k}) OVER {W}) + 0.001) AS sentiment_pct_change_{k}' for k in (3, 5, 7))} FROM daily", r6=" ".join(f"sentiment_change_{k} sentiment_pct_change_{k}" for k in (3, 5, 7)))
add("sentiment_ma", on_daily(sentiment.moving_averages), with_(ARTICLES_SQL, DAILY_SQL, ewm("daily", "x", {f"sentiment_ema_{n}": (_S, n) for n in (3, 5, 7)})) + f"\nFINAL SELECT *, {', '.join(f'{full(f'avg({_S})', _S, n)} AS sentiment_sma_{n}' for n in (3, 5, 7))} FROM x", r6=" ".join(f"sentiment_sma_{n} sentiment_ema_{n}" for n in (3, 5, 7)))
add("sentiment_disagreement", on_daily(sentiment.disagreement), DAILY_ + f"\nFINAL SELECT *, CASE WHEN sentiment_std > quantile_cont(sentiment_std, 0.5) OVER {RUN} THEN 1 ELSE 0 END AS disagreement_high, bullish_ratio - bearish_ratio AS sentiment_range, bullish_ratio + bearish_ratio AS sentiment_spread FROM daily", r6="sentiment_std sentiment_range sentiment_spread", ints="disagreement_high")
add(
    "sentiment_zscore", on_daily(sentiment.zscore),
    DAILY_ + f""",
l AS (SELECT *, list({_S}) OVER {frame(21)} AS xs FROM daily)
FINAL SELECT *, ({_S} - {full(f'avg({_S})', _S, 21)}) / ({full(f'stddev_samp({_S})', _S, 21)} + 1e-6) AS sentiment_zscore, CASE WHEN len(xs) = 21 THEN len(list_filter(xs, lambda v: v < {_S})) / 21.0 END AS sentiment_percentile FROM l""",
    r6="sentiment_zscore sentiment_percentile",
)
_A = "CAST(article_count AS DOUBLE)"
add(
    "article_counts", on_daily(sentiment.article_counts),
    DAILY_ + f""",
c AS (SELECT symbol, date, {_A} AS n FROM daily),
m AS (SELECT *, {full('avg(n)', 'n', 5)} AS article_count_sma_5, {full('avg(n)', 'n', 21)} AS article_count_sma_21, {full('stddev_samp(n)', 'n', 21)} AS sd FROM c)
FINAL SELECT *, (n - article_count_sma_21) / (sd + 1e-6) AS article_count_zscore, CASE WHEN n > article_count_sma_21 THEN 1 ELSE 0 END AS high_attention, n - lag(n) OVER {W} AS article_count_change, {change('n', 1)} AS article_count_pct_change FROM m""",
    r6="article_count_sma_5 article_count_sma_21 article_count_zscore article_count_change article_count_pct_change", ints="high_attention",
)
_C = "sentiment_confidence"
add("confidence_features", on_daily(sentiment.confidence), DAILY_ + f"\nFINAL SELECT *, {full(f'avg({_C})', _C, 5)} AS confidence_sma_5, {_S} * {_C} AS weighted_sentiment, CASE WHEN {_C} > quantile_cont({_C}, 0.5) OVER {RUN} THEN 1 ELSE 0 END AS high_confidence FROM daily", r9="sentiment_confidence confidence_sma_5 weighted_sentiment", ints="high_confidence")
add("signal_features", on_daily(sentiment.signal_flags), DAILY_ + f"\nFINAL SELECT symbol, date, CAST(signal_valid AS INTEGER) AS signal_valid, CASE WHEN {_S} > 0.1 THEN 1 ELSE 0 END AS bullish_signal, CASE WHEN {_S} < -0.1 THEN 1 ELSE 0 END AS bearish_signal, CASE WHEN abs({_S}) <= 0.1 THEN 1 ELSE 0 END AS neutral_signal FROM daily", ints="signal_valid bullish_signal bearish_signal neutral_signal")
add("interaction_features", on_daily(sentiment.interactions), DAILY_ + f"\nFINAL SELECT *, {_S} * {_C} AS sent_x_conf, {_S} * ({_A} / ({full(f'avg({_A})', 'article_count', 21)} + 1)) AS sent_x_attention, ({_S} - lag({_S}) OVER {W}) - (lag({_S}) OVER {W} - lag({_S}, 2) OVER {W}) AS sentiment_acceleration FROM daily", r6="sent_x_conf sent_x_attention sentiment_acceleration")
add("sentiment_features_all", on_daily(sentiment.build_all), **joined("sentiment_lags", "sentiment_changes", "sentiment_ma", "sentiment_disagreement", "sentiment_zscore", "article_counts", "confidence_features", "signal_features", "interaction_features"))

# --- risk
_H = {"95%": 0.05, "99%": 0.01}
_GRID = " UNION ALL ".join(
    f"SELECT r.symbol, '{m}' AS method, '{c}' AS confidence, any_value({v}) AS var, -avg(CASE WHEN ret <= h{c[:2]} THEN ret END) AS es FROM ret r JOIN q ON r.symbol = q.symbol GROUP BY r.symbol"
    for c, p in _H.items() for m, v in (("historical", f"-h{c[:2]}"), ("parametric", f"-(m + ({risk.NormalDist().inv_cdf(p)!r}) * s)"))
)
_Q = "q AS (SELECT symbol, quantile_cont(ret, 0.05) AS h95, quantile_cont(ret, 0.01) AS h99, avg(ret) AS m, stddev_samp(ret) AS s FROM ret GROUP BY symbol)"
add("var_grid", on_bars(risk.var_grid), with_(BARS_SQL, RET_SQL, _Q, f"grid AS ({_GRID})") + f"\nFINAL SELECT *, var * {YEAR} AS annual_var FROM grid", keys="symbol method confidence", r6="var es annual_var")
_UNIFORM = "(CAST('0x' || substr(h, {}, 8) AS BIGINT) + 0.5) / 4294967296.0"
add(
    "var_monte_carlo", on_bars(risk.monte_carlo_var),
    with_(BARS_SQL, RET_SQL) + f""",
st AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s FROM ret GROUP BY symbol),
dr AS (SELECT symbol, m + s * sqrt(-2 * ln({_UNIFORM.format(1)})) * cos(2 * pi() * {_UNIFORM.format(9)}) AS x FROM (SELECT *, md5('42:' || symbol || ':' || i) AS h FROM st, range(1, 10001) r(i)) t)
FINAL SELECT symbol, -quantile_cont(x, 0.05) AS var FROM dr GROUP BY symbol""",
    keys="symbol", r6="var",
)
_RV = " ".join(f"var_{c}_{n}" for c in (95, 99) for n in (21, 63))
add("rolling_var", on_bars(risk.daily, risk.rolling_var), RET_ + f"\nFINAL SELECT *, {', '.join(f'-({full(f'quantile_cont(ret, {p})', 'ret', n)}) AS var_{c}_{n}' for c, p in ((95, 0.05), (99, 0.01)) for n in (21, 63))} FROM ret", r6=_RV)
add(
    "rolling_es", on_bars(risk.daily, risk.rolling_es),
    with_(BARS_SQL, RET_SQL, f"l AS (SELECT *, {', '.join(f'list(ret) OVER {frame(n)} AS x{n}' for n in (21, 63))} FROM ret)")
    + f"\nFINAL SELECT *, {', '.join(f'CASE WHEN len(x{n}) = {n} THEN -list_avg(list_filter(x{n}, lambda v: v <= list_aggregate(x{n}, {chr(39)}quantile_cont{chr(39)}, {p}))) END AS es_{c}_{n}' for c, p in ((95, 0.05), (99, 0.01)) for n in (21, 63))} FROM l",
    r6=" ".join(f"es_{c}_{n}" for c in (95, 99) for n in (21, 63)),
)
add(
    "var_backtest", on_bars(risk.var_backtest),
    with_(BARS_SQL, RET_SQL, f"v AS (SELECT *, -({full('quantile_cont(ret, 0.05)', 'ret', 63)}) AS v FROM ret)", "c AS (SELECT symbol, count(*) AS n, count(*) FILTER (-ret > v) AS violations FROM v WHERE v IS NOT NULL GROUP BY symbol)")
    + """
FINAL SELECT *, p_value > 0.05 AS passed FROM (
 SELECT *, CASE WHEN lr_statistic IS NULL THEN CASE WHEN violations / n > 0.05 THEN 0 ELSE 1 END WHEN lr_statistic = 0 THEN 1
  ELSE 1 - list_sum(list_transform(range(0, 400), lambda k: exp((k + 0.5) * ln(lr_statistic / 2) - lr_statistic / 2 - lgamma(k + 1.5)))) END AS p_value
 FROM (SELECT *, n * 0.05 AS expected, violations / (n * 0.05) AS ratio, CASE WHEN violations > 0 AND violations < n THEN greatest(0, -2 * (n * ln(0.95) + violations * ln(0.05 / 0.95) - (n - violations) * ln(1 - violations / n) - violations * ln(violations / n))) END AS lr_statistic FROM c) l) p""",
    keys="symbol passed", r6="expected ratio lr_statistic p_value", longs="n violations",
)
add("realized_volatility", on_bars(risk.daily, risk.realized_volatility, risk.vol_ratios), RET_ + f",\nv AS (SELECT *, {', '.join(f'({full('stddev_samp(ret)', 'ret', n)}) * {YEAR} AS realized_vol_{n}' for n in _WIN)} FROM ret)\nFINAL SELECT *, {', '.join(f'realized_vol_{a} / (realized_vol_{b} + 1e-6) AS vol_ratio_{a}_{b}' for a, b in ((5, 10), (10, 21), (21, 63)))} FROM v", r6=" ".join(f"realized_vol_{n}" for n in _WIN) + " vol_ratio_5_10 vol_ratio_10_21 vol_ratio_21_63")
_q21 = "(1 - 2.0 / 22)"
add(
    "ewma_volatility", on_bars(risk.daily, risk.ewma_volatility),
    with_(BARS_SQL, RET_SQL, "s AS (SELECT *, ret * ret AS sq FROM ret)", ewm("s", "x", {"m1": ("ret", 21), "m2": ("sq", 21)}))
    + f"\nFINAL SELECT *, CASE WHEN rn > 1 THEN sqrt(greatest(0, m2 - m1 * m1) / (1 - (pow({_q21}, 2 * (rn - 1)) + pow(2.0 / 22, 2) * (1 - pow({_q21}, 2 * (rn - 1))) / (1 - {_q21} * {_q21})))) * {YEAR} END AS ewma_vol_21 FROM x",
    r6="ewma_vol_21",
)
_REG = f"""v AS (SELECT *, row_number() OVER {W} AS rn, ({full('stddev_samp(ret)', 'ret', 63)}) * {YEAR} AS vol FROM ret),
p AS (SELECT a.symbol, a.date, a.rn, CASE WHEN any_value(a.vol) IS NOT NULL AND count(b.vol) >= 63 THEN count(*) FILTER (b.vol < a.vol) / CAST(a.rn AS DOUBLE) END AS pct FROM v a JOIN v b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY a.symbol, a.date, a.rn),
g AS (SELECT symbol, date, rn, CASE WHEN pct < 0.33 THEN 'low' WHEN pct > 0.67 THEN 'high' WHEN pct IS NOT NULL THEN 'medium' END AS vol_regime FROM p),
i AS (SELECT *, row_number() OVER {W} - row_number() OVER (PARTITION BY symbol, vol_regime ORDER BY date) AS island FROM g)"""
add(
    "vol_regime", on_bars(risk.daily, risk.vol_regime),
    with_(BARS_SQL, RET_SQL, _REG)
    + "\nFINAL SELECT symbol, date, vol_regime, CASE WHEN vol_regime = 'low' THEN 1 ELSE 0 END AS vol_regime_low, CASE WHEN vol_regime = 'medium' THEN 1 ELSE 0 END AS vol_regime_medium, CASE WHEN vol_regime = 'high' THEN 1 ELSE 0 END AS vol_regime_high, CASE WHEN vol_regime IS NOT NULL THEN row_number() OVER (PARTITION BY symbol, vol_regime, island ORDER BY date) END AS vol_regime_duration FROM i",
    keys="symbol date vol_regime", longs="vol_regime_duration", ints="vol_regime_low vol_regime_medium vol_regime_high",
)
_CONE = (5, 10, 21, 63, 126, 252)
add(
    "vol_cone", on_bars(risk.vol_cone),
    RET_ + ",\nv AS (" + " UNION ALL ".join(f"SELECT symbol, date, {n} AS \"window\", ({full('stddev_samp(ret)', 'ret', n)}) * {YEAR} AS vol FROM ret" for n in _CONE) + ")"
    + "\nFINAL SELECT symbol, \"window\" AS span, " + ", ".join(f"quantile_cont(vol, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95)) + ", arg_max(vol, date) AS latest FROM v WHERE vol IS NOT NULL GROUP BY symbol, \"window\"",
    keys="symbol", ints="span", r6="p5 p25 p50 p75 p95 latest",
)
QUERIES["vol_cone"] = Query(lambda s, d: risk.vol_cone(bars(s, d)).withColumnsRenamed({"window": "span", "current": "latest"}), QUERIES["vol_cone"].sql, "symbol", "p5 p25 p50 p75 p95 latest", ints="span")
add(
    "vol_term_structure", lambda s, d: risk.vol_term_structure(bars(s, d)).withColumnRenamed("window", "span"),
    RET_ + ",\nk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM ret)\nFINAL " + " UNION ALL ".join(f"SELECT symbol, {n} AS span, stddev_samp(ret) FILTER (k <= {n}) * {YEAR} AS volatility FROM k GROUP BY symbol HAVING count(*) >= {n}" for n in _CONE),
    keys="symbol", r6="volatility", ints="span",
)
add("tail_risk", on_bars(risk.daily, risk.tail_risk), RET_ + f"\nFINAL SELECT *, {full('skewness(ret)', 'ret', 63)} AS skewness, {full('kurtosis(ret)', 'ret', 63)} AS kurtosis, abs({full('quantile_cont(ret, 0.05)', 'ret', 63)}) / (abs(nullif({full('quantile_cont(ret, 0.95)', 'ret', 63)}, 0)) + 1e-6) AS tail_ratio FROM ret", r6="skewness kurtosis tail_ratio")


def _adjusted(spark, sf_dir):
    df = drawdown.series(bars(spark, sf_dir))
    df = df.withColumn("ret", F.try_divide(F.col("close"), lag(F.col("close"))) - 1).filter("ret is not null")
    return risk.risk_adjusted(df)


add(
    "risk_adjusted", _adjusted,
    with_(BARS_SQL, DD_SQL, f"r AS (SELECT * FROM (SELECT *, {change('close', 1)} AS ret FROM dd) t WHERE ret IS NOT NULL)", f"m AS (SELECT *, ({full('avg(ret)', 'ret', 21)}) * 252 AS mu, CASE WHEN ret < 0 THEN ret END AS down FROM r)")
    + f"\nFINAL SELECT *, mu / (({full('stddev_samp(ret)', 'ret', 21)}) * {YEAR} + 1e-6) AS sharpe_ratio, CASE WHEN count(down) OVER {frame(21)} >= 2 THEN mu / (stddev_samp(down) OVER {frame(21)} * {YEAR} + 1e-6) END AS sortino_ratio, mu / (({full('max(drawdown)', 'drawdown', 21)}) + 1e-6) AS calmar_ratio FROM m",
    r6="sharpe_ratio sortino_ratio calmar_ratio",
)
add("garch_forecast", on_bars(risk.garch))
add("garch_features", on_bars(risk.garch_features))
add(
    "garch_variances", on_bars(lambda df: risk.garch_variances(df, 2.0, 0.1, 0.85)),
    with_(BARS_SQL, RET_SQL) + """,
gx AS (SELECT symbol, date, 100 * (ret - avg(ret) OVER (PARTITION BY symbol)) AS x, 10000 * var_pop(ret) OVER (PARTITION BY symbol) AS v0, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM ret),
gv AS (SELECT symbol, date, k, x, v0 AS variance FROM gx WHERE k = 1 UNION ALL SELECT n.symbol, n.date, n.k, n.x, 2.0 + 0.1 * v.x * v.x + 0.85 * v.variance FROM gv v JOIN gx n ON n.symbol = v.symbol AND n.k = v.k + 1)
FINAL SELECT symbol, date, sqrt(variance) AS deviation FROM gv""",
    r3="deviation",
)
_GV = QUERIES["garch_variances"]
QUERIES["garch_variances"] = Query(lambda s, d: _GV.fn(s, d).withColumn("deviation", F.sqrt("variance")), _GV.sql, r3="deviation")

# --- drawdowns
add("drawdown_series", on_bars(drawdown.series), DD_ + "\nFINAL SELECT * FROM dd", r6="drawdown", r3="peak")
add(
    "drawdown_features", on_bars(drawdown.features),
    with_(BARS_SQL, DD_SQL, f"n AS (SELECT *, row_number() OVER {W} AS rn FROM dd)")
    + f"\nFINAL SELECT *, drawdown AS current_drawdown, CASE WHEN drawdown > 0 THEN 1 ELSE 0 END AS underwater, rn - max(CASE WHEN close >= peak THEN rn END) OVER {RUN} AS days_since_peak, (drawdown - {full('avg(drawdown)', 'drawdown', 63)}) / ({full('stddev_samp(drawdown)', 'drawdown', 63)} + 1e-6) AS drawdown_zscore FROM n",
    r6="current_drawdown drawdown_zscore", longs="days_since_peak", ints="underwater",
)
add("risk_features_all", on_bars(ml.risk_features), **joined("drawdown_features", "rolling_var", "rolling_es", "realized_volatility", "ewma_volatility", "vol_regime", "tail_risk", "risk_adjusted", join="LEFT JOIN"))
_EP = f"""u AS (SELECT *, lag(date) OVER {W} AS before, lead(date) OVER {W} AS after, max(date) OVER (PARTITION BY symbol) AS final, sum(CASE WHEN drawdown > 0 THEN 0 ELSE 1 END) OVER {RUN} AS island FROM dd),
ep AS (SELECT symbol, arg_min(before, date) AS start_date, max(peak) AS peak_value, arg_min(date, (-drawdown, date)) AS trough_date, arg_min(close, (-drawdown, date)) AS trough_value, max(drawdown) AS drawdown,
 (list(after ORDER BY date DESC))[1] AS end_date, any_value(final) AS final FROM u WHERE drawdown > 0 GROUP BY symbol, island HAVING max(drawdown) >= 0.01),
episodes AS (SELECT *, date_diff('day', start_date, coalesce(end_date, final)) AS duration_days, date_diff('day', trough_date, end_date) AS recovery_days, end_date IS NOT NULL AS is_recovered FROM ep)"""
add("underwater_periods", on_bars(drawdown.episodes), with_(BARS_SQL, DD_SQL, _EP) + "\nFINAL SELECT * FROM episodes", keys="symbol start_date trough_date end_date is_recovered", r6="drawdown", r3="peak_value trough_value", ints="duration_days recovery_days")
_DUR = f"du AS (SELECT symbol, arg_max(len, date) AS current_duration, max(len) AS max_duration, arg_max(len > 0, date) AS is_in_drawdown FROM (SELECT symbol, date, count(*) FILTER (drawdown > 0) OVER (PARTITION BY symbol, island ORDER BY date) AS len FROM (SELECT *, sum(CASE WHEN drawdown > 0 THEN 0 ELSE 1 END) OVER {RUN} AS island FROM dd) a) b GROUP BY symbol)"
add("drawdown_duration", on_bars(drawdown.durations), with_(BARS_SQL, DD_SQL, _DUR) + "\nFINAL SELECT * FROM du", keys="symbol is_in_drawdown", longs="current_duration max_duration")
_REC = "rec AS (SELECT symbol, avg(recovery_days) FILTER (recovery_days > 0) AS avg_recovery_days, max(recovery_days) FILTER (recovery_days > 0) AS max_recovery_days, count(*) FILTER (is_recovered) AS total_recoveries, CASE WHEN count(*) FILTER (is_recovered) > 0 THEN max(date_diff('day', trough_date, final)) FILTER (NOT is_recovered) END AS current_recovery_days FROM episodes GROUP BY symbol)"
add("recovery_stats", on_bars(drawdown.recovery), with_(BARS_SQL, DD_SQL, _EP, _REC) + "\nFINAL SELECT * FROM rec", keys="symbol", r6="avg_recovery_days", longs="total_recoveries", ints="max_recovery_days current_recovery_days")
_TOT = "tot AS (SELECT symbol, max(drawdown) AS max_drawdown, arg_max(drawdown, date) AS current_drawdown, sqrt(avg(pow(100 * drawdown, 2))) AS ulcer_index, avg(drawdown) AS pain_index, (pow(arg_max(close, date) / arg_min(close, date), 252.0 / count(*)) - 1) / max(drawdown) AS calmar_ratio FROM dd GROUP BY symbol)"
add(
    "drawdown_summary", on_bars(drawdown.summary),
    with_(BARS_SQL, DD_SQL, _EP, _DUR, _REC, _TOT) + "\nFINAL SELECT t.*, current_duration, max_duration, is_in_drawdown, avg_recovery_days, max_recovery_days, total_recoveries, num_drawdowns, avg_drawdown FROM tot t JOIN du USING (symbol) JOIN rec USING (symbol) JOIN (SELECT symbol, count(*) AS num_drawdowns, avg(drawdown) AS avg_drawdown FROM episodes GROUP BY symbol) c USING (symbol)",
    keys="symbol is_in_drawdown", r6="max_drawdown current_drawdown ulcer_index pain_index calmar_ratio avg_recovery_days avg_drawdown", longs="current_duration max_duration total_recoveries num_drawdowns", ints="max_recovery_days",
)

# --- reports
_MET = f"""t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM ret),
vol AS (SELECT symbol, stddev_samp(ret) FILTER (k <= 21) * {YEAR} AS volatility_21, stddev_samp(ret) FILTER (k <= 63) * {YEAR} AS volatility_63 FROM t GROUP BY symbol),
es AS (SELECT r.symbol, -any_value(h95) AS var_95, -any_value(h99) AS var_99, -avg(ret) FILTER (ret <= h95) AS es_95, -avg(ret) FILTER (ret <= h99) AS es_99 FROM ret r JOIN q ON r.symbol = q.symbol GROUP BY r.symbol),
met AS (SELECT *, least(50 * var_99, 3.33) + least(5 * volatility_21, 3.33) + least(10 * max_drawdown, 3.34) AS risk_score, least(100 * var_99, 10) AS var_score, least(10 * volatility_21, 10) AS volatility_score, least(10 * max_drawdown, 10) AS drawdown_score FROM es JOIN vol USING (symbol) JOIN tot USING (symbol))"""
_MET_ = with_(BARS_SQL, RET_SQL, DD_SQL, _Q, _TOT, _MET)
add("risk_report", on_bars(report.metrics), _MET_ + "\nFINAL SELECT * FROM met", keys="symbol", r6="var_95 var_99 es_95 es_99 volatility_21 volatility_63 max_drawdown current_drawdown ulcer_index pain_index calmar_ratio risk_score var_score volatility_score drawdown_score")
add("risk_report_regime", on_bars(lambda df: report.metrics(df).select("symbol", "vol_regime")), f"WITH v AS ({QUERIES['vol_regime'].oracle()})\nSELECT symbol, arg_max(vol_regime, date) FILTER (vol_regime IS NOT NULL) AS vol_regime FROM v GROUP BY symbol")
add("risk_ranking", on_bars(lambda df: report.ranking(df, "volatility_63")), _MET_ + "\nFINAL SELECT symbol, volatility_63 AS value, row_number() OVER (ORDER BY volatility_63 DESC, symbol) AS rank FROM met", keys="symbol", r6="value", ints="rank")
add("risk_report_full", on_bars(report.full))
add(
    "export_risk", on_bars(report.export_risk),
    with_(BARS_SQL, RET_SQL, _Q, f"t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM ret), vol AS (SELECT symbol, 100 * stddev_samp(ret) FILTER (k <= 21) * {YEAR} AS volatility_21 FROM t GROUP BY symbol)",
          f"g AS (SELECT symbol, date, exp(sum(ln(1 + ret)) OVER {RUN}) AS g FROM ret WHERE ret > -1), gd AS (SELECT symbol, 100 * min(g / p - 1) AS max_drawdown FROM (SELECT *, max(g) OVER {RUN} AS p FROM g) z GROUP BY symbol)",
          "es AS (SELECT r.symbol, 100 * avg(ret) FILTER (ret <= h95) AS es_95 FROM ret r JOIN q USING (symbol) GROUP BY r.symbol)")
    + "\nFINAL SELECT q.symbol, 100 * h95 AS var_95, 100 * h99 AS var_99, es_95, volatility_21, max_drawdown, (m * 252 * 100 - 5) / volatility_21 AS sharpe_ratio, greatest(0, least(100, 50 + 2 * (volatility_21 - 20) + 2 * abs(100 * h95) + abs(max_drawdown))) AS risk_score FROM q JOIN vol USING (symbol) JOIN gd USING (symbol) JOIN es USING (symbol)",
    keys="symbol", r6="var_95 var_99 es_95 volatility_21 max_drawdown sharpe_ratio risk_score",
)

# --- models
def _all_targets(spark, sf_dir):
    df = bars(spark, sf_dir)
    for kind in ("return", "log_return", "direction", "direction_signed"):
        df = ml.targets(df, 1, kind).withColumnRenamed("target", f"t_{kind}")
    return df


_LEAD = f"lead(close) OVER {W}"
add("targets", _all_targets, BARS_ + f"\nFINAL SELECT *, {_LEAD} / close - 1 AS t_return, ln({_LEAD} / close) AS t_log_return, coalesce(CAST({_LEAD} > close AS INTEGER), 0) AS t_direction, coalesce(CAST(sign({_LEAD} - close) AS INTEGER), 0) AS t_direction_signed FROM bars", r6="t_return t_log_return", ints="t_direction t_direction_signed")
_ALL = [QUERIES[n] for n in ("price_features_all", "risk_features_all")]
_COLS = {k: " ".join(getattr(q, k) for q in _ALL) for k in ("r6", "r3", "r4", "longs", "ints")}
add(
    "ml_dataset", on_bars(ml.ml_dataset),
    with_(*[f"p{i} AS ({q.oracle()})" for i, q in enumerate([*_ALL, QUERIES["targets"]])])
    + f"\nFINAL SELECT *, t_direction AS target FROM p0 JOIN p1 USING (symbol, date) JOIN p2 USING (symbol, date) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ' '.join(_COLS.values()).split())}",
    **_COLS | {"ints": _COLS["ints"] + " target"},
)
add(
    "feature_summary", on_bars(lambda df: ml.feature_summary(price.returns(df).drop("open", "high", "low", "close", "volume"))),
    BARS_ + f",\nf AS (SELECT {', '.join(f'{change('close', p)} AS return_{p}d' for p in (1, 5, 21))} FROM bars)\nFINAL " + " UNION ALL ".join(f"SELECT 'return_{p}d' AS feature, count(return_{p}d) AS present, count(*) - count(return_{p}d) AS missing, round(100.0 * (count(*) - count(return_{p}d)) / count(*), 2) AS missing_pct, avg(return_{p}d) AS mean, stddev_samp(return_{p}d) AS std, min(return_{p}d) AS lowest, max(return_{p}d) AS highest FROM f" for p in (1, 5, 21)),
    keys="feature", r6="missing_pct mean std lowest highest", longs="present missing",
)
_FS = QUERIES["feature_summary"]
QUERIES["feature_summary"] = Query(lambda s, d: _FS.fn(s, d).withColumnsRenamed({"count": "present", "min": "lowest", "max": "highest"}), _FS.sql, _FS.keys, _FS.r6, longs=_FS.longs)


def _folds_sql(purge: int) -> str:
    end = f"CASE WHEN test_start - 1 > {purge} THEN test_start - 1 - {purge} ELSE test_start - 1 END" if purge else "test_start - 1"
    return BARS_ + f""",
n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol),
s AS (SELECT *, greatest(1, (n - 51) // 5) AS size FROM n),
k AS (SELECT symbol, fold, n - fold * size AS test_end, n - fold * size - size AS test_start FROM s, range(5) r(fold)),
t AS (SELECT *, {end} AS train_end FROM k WHERE test_start - 1 >= 50)
FINAL SELECT symbol, fold, 0 AS train_start, train_end, test_start, test_end FROM t WHERE train_end >= 50"""


_FOLD = {"keys": "symbol", "ints": "fold", "longs": "train_start train_end test_start test_end"}
add("ts_splits", on_bars(ml.folds), _folds_sql(0), **_FOLD)
add("purged_splits", on_bars(lambda df: ml.folds(df, purge=5)), _folds_sql(5), **_FOLD)


def _small(spark, sf_dir):
    """Daily returns and their lags with the next direction: a small feature set."""
    df = ml.targets(price.volatility(price.momentum(price.returns(bars(spark, sf_dir)), (5, 21)), (21,)), 1, "direction", strict=True)
    return df.select("symbol", "date", "return_1d", "return_5d", "momentum_21", "volatility_21", "target").na.drop("any")


def _training(spark, sf_dir, kind: str = "direction") -> DataFrame:
    """All price and risk features, complete rows, with what happens next; rows whose future isn't known are left out."""
    b = bars(spark, sf_dir)
    goal = ml.targets(b, 1, kind, strict=True).select("symbol", "date", "target").na.drop()
    return ml.build_features(b).drop(*predict.PRICES).na.drop("any").join(goal, ["symbol", "date"])


add("walk_forward_classifier", lambda s, d: ml.walk_forward(_training(s, d)))
add("walk_forward_regressor", lambda s, d: ml.walk_forward(_training(s, d, "return"), "regressor"))
add("walk_forward_pooled", lambda s, d: ml.walk_forward(_training(s, d), pooled=True))
add("walk_forward_horizons", lambda s, d: ml.walk_forward_horizons(bars(s, d), ml.build_features(bars(s, d)).drop(*predict.PRICES).na.drop("any")))
add("feature_importance", lambda s, d: ml.feature_importance(_training(s, d)))

_SETUP = {"n_splits": 4, "min_train": 100, "gap": 2, "purge": 5, "embargo": 3}
_DAYS = """days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)),
cut AS (SELECT DISTINCT fold, n - (fold + 1) * ((n - 102) // 4) AS t, (n - 102) // 4 AS size FROM days, range(4) r(fold)),
c AS (SELECT date, fold, CASE WHEN i >= t AND i < t + size THEN 'test' WHEN i < t - 7 AND NOT EXISTS (SELECT 1 FROM cut o WHERE o.fold > cut.fold AND i >= o.t + o.size AND i < o.t + o.size + 3) THEN 'train' END AS part FROM days, cut WHERE t - 7 >= 100)"""
add("calendar_folds", on_bars(lambda df: ml.calendar(df, **_SETUP)), BARS_ + f",\n{_DAYS}\nFINAL SELECT date, fold, part FROM c WHERE part IS NOT NULL", keys="date part", ints="fold")
add(
    "calendar_rows",
    on_bars(lambda df: ml.in_calendar(df, ml.calendar(df, **_SETUP)).groupBy("symbol", "fold").agg(*[f(F.when(F.col("part") == p, F.col("date"))).alias(n) for n, f, p in (("trained", F.count, "train"), ("tested", F.count, "test"), ("last_train", F.max, "train"), ("first_test", F.min, "test"))]).withColumn("days_between", F.datediff("first_test", "last_train"))),
    BARS_ + f",\n{_DAYS}\nFINAL SELECT symbol, fold, count(*) FILTER (part = 'train') AS trained, count(*) FILTER (part = 'test') AS tested, min(date) FILTER (part = 'test') - max(date) FILTER (part = 'train') AS days_between FROM bars JOIN c USING (date) WHERE part IS NOT NULL GROUP BY symbol, fold",
    keys="symbol", ints="fold", longs="trained tested days_between",
)


def _some_sentiment(spark, sf_dir):
    """Daily sentiment of one symbol on all days and of another on a few: the rest has none."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderpriority = '1-URGENT' or (o_orderpriority = '2-HIGH' and o_orderdate < '1995-04-01')")
    score = ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 201 - 100) / 100.0
    label = F.when(score > 0.1, "bullish").when(score < -0.1, "bearish").otherwise("neutral")
    return sentiment.aggregate_daily(o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("article_id"), F.col("o_orderdate").cast("timestamp").alias("article_ts"), score.alias("sentiment_score"), (F.col("o_custkey") % 100 / 100.0).alias("sentiment_confidence"), label.alias("sentiment_signal")))


_SOME_ARTICLES = """articles AS (SELECT *, CASE WHEN sentiment_score > 0.1 THEN 'bullish' WHEN sentiment_score < -0.1 THEN 'bearish' ELSE 'neutral' END AS sentiment_signal
 FROM (SELECT o_orderpriority AS symbol, o_orderkey AS article_id, o_orderdate AS article_ts, ((o_orderkey * 7 + o_custkey) % 201 - 100) / 100.0 AS sentiment_score,
 (o_custkey % 100) / 100.0 AS sentiment_confidence FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND o_orderdate < '1995-04-01')))"""
_MOODS = QUERIES["sentiment_features_all"]
_MOOD_COLS = [c for k in ("r6", "r3", "r4", "r9", "longs", "ints") for c in getattr(_MOODS, k).split()]
_BASE_COLS = [c for c in " ".join(_COLS.values()).split() if not c.startswith("t_")]
_KEPT = with_(f"p0 AS ({_ALL[0].oracle()})", f"p1 AS ({_ALL[1].oracle()})", f"m AS ({_MOODS.oracle().replace(ARTICLES_SQL, _SOME_ARTICLES)})") + f""",
f AS (SELECT * EXCLUDE (ok), {' AND '.join(f'm.{c} IS NOT NULL' for c in _MOOD_COLS)} AS whole FROM (SELECT *, true AS ok FROM p0 JOIN p1 USING (symbol, date) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _BASE_COLS)}) b LEFT JOIN m USING (symbol, date)),
k AS (SELECT *, sum(CAST(whole AS INTEGER)) OVER (PARTITION BY symbol) >= 100 AS with_sentiment FROM f)"""
add(
    "features_with_fallback", lambda s, d: predict.features_or_fewer(bars(s, d), _some_sentiment(s, d)),
    _KEPT + "\nFINAL SELECT symbol, date, with_sentiment, return_1d, CASE WHEN with_sentiment THEN sentiment_change_3 END AS sentiment_change_3 FROM k WHERE whole OR NOT with_sentiment",
    keys="symbol date with_sentiment", r6="return_1d sentiment_change_3",
)
add(
    "training_samples", lambda s, d: predict.features_or_fewer(bars(s, d), _some_sentiment(s, d)).groupBy("symbol", "with_sentiment").agg(F.count("*").alias("samples"), F.count("sentiment_score").alias("with_score")),
    _KEPT + "\nFINAL SELECT symbol, with_sentiment, count(*) AS samples, count(CASE WHEN with_sentiment THEN 1 END) AS with_score FROM k WHERE whole OR NOT with_sentiment GROUP BY symbol, with_sentiment",
    keys="symbol with_sentiment", longs="samples with_score",
)
add("train_figures", lambda s, d: predict.train(bars(s, d), _some_sentiment(s, d))[1])

_P = "0.5 + (CAST(l_orderkey * 7 + l_linenumber * 13 AS BIGINT) % 101 - 50) / 110.0"


def _scores(spark, sf_dir):
    """Deterministic stand-ins for model output over order lines."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = 0.5 + ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 101 - 50) / 110.0
    return li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("symbol"), p.alias("probability"), F.when(F.col("l_linenumber") > 1, (F.col("l_discount") - 0.05) / 2).alias("expected_return"), (F.col("l_quantity") > 25).cast("int").alias("label"))


_SC = f"sc AS (SELECT l_orderkey, l_linenumber, l_returnflag AS symbol, {_P} AS probability, CASE WHEN l_linenumber > 1 THEN (l_discount - 0.05) / 2 END AS expected_return, CAST(l_quantity > 25 AS INTEGER) AS label FROM lineitem)"
_SC_ = "WITH " + _SC
add(
    "clf_metrics", lambda s, d: ml.classification_metrics(_scores(s, d).withColumn("score", F.col("probability")), "symbol"),
    _SC_ + """,
r AS (SELECT *, CAST(probability > 0.5 AS INTEGER) AS p, rank() OVER (PARTITION BY symbol ORDER BY probability) + (count(*) OVER (PARTITION BY symbol, probability) - 1) / 2.0 AS rk FROM sc),
a AS (SELECT symbol, avg(CAST(label = p AS INTEGER)) AS accuracy, sum(label * p) AS tp, sum(p) AS pp, sum(label) AS pos, count(*) AS n, sum(label * rk) AS ranks FROM r GROUP BY symbol),
b AS (SELECT *, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce((ranks - pos * (pos + 1) / 2.0) / nullif(pos * (n - pos), 0), 0.5) AS auc FROM a)
FINAL SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM b""",
    keys="symbol", r6="accuracy precision recall f1 auc",
)
add(
    "fold_summary", lambda s, d: ml.fold_summary(ml.classification_metrics(_scores(s, d).withColumn("score", F.col("probability")), "l_linenumber"), ["accuracy", "precision", "recall"]),
    _SC_ + """,
a AS (SELECT l_linenumber, avg(CAST(label = CAST(probability > 0.5 AS INTEGER) AS INTEGER)) AS accuracy, sum(label * CAST(probability > 0.5 AS INTEGER)) AS tp, sum(CAST(probability > 0.5 AS INTEGER)) AS pp, sum(label) AS pos FROM sc GROUP BY 1),
m AS (SELECT 'accuracy' AS metric, accuracy AS value FROM a UNION ALL SELECT 'precision', coalesce(tp / nullif(pp, 0), 0) FROM a UNION ALL SELECT 'recall', coalesce(tp / nullif(pos, 0), 0) FROM a)
FINAL SELECT metric, avg(value) AS mean, stddev_pop(value) AS std FROM m GROUP BY metric""",
    keys="metric", r6="mean std",
)
add("compare_models", lambda s, d: ml.compare_models(_training(s, d), {"shallow": {"settings": Boost(trees=50, depth=2)}, "deep": {}}))
add(
    "reg_metrics", lambda s, d: ml.regression_metrics(_scores(s, d).filter("expected_return is not null").select("symbol", F.col("expected_return").alias("label"), (F.col("probability") - 0.5).alias("score")), "symbol"),
    _SC_ + """
FINAL SELECT symbol, avg(pow(expected_return - (probability - 0.5), 2)) AS mse, sqrt(avg(pow(expected_return - (probability - 0.5), 2))) AS rmse, avg(abs(expected_return - (probability - 0.5))) AS mae,
 1 - avg(pow(expected_return - (probability - 0.5), 2)) / var_pop(expected_return) AS r2, avg(CAST(sign(expected_return) = sign(probability - 0.5) AS INTEGER)) AS direction_accuracy FROM sc WHERE expected_return IS NOT NULL GROUP BY symbol""",
    keys="symbol", r6="mse rmse mae r2 direction_accuracy",
)
_TS = "ts AS (SELECT *, 2 * abs(probability - 0.5) AS confidence, CASE WHEN 2 * abs(probability - 0.5) < 0.5 THEN 0 ELSE greatest(-1, least(1, 2 * (probability - 0.5) * CASE WHEN expected_return IS NULL THEN 1 ELSE (1 + least(2, abs(expected_return) / 0.02)) / 2 END * 2 * abs(probability - 0.5))) END AS strength, CASE WHEN 2 * abs(probability - 0.5) < 0.5 OR abs(probability - 0.5) < 0.05 THEN 0 WHEN probability > 0.5 THEN 1 ELSE -1 END AS direction FROM sc)"
add("trading_signals", lambda s, d: ml.trading_signals(_scores(s, d)), "WITH " + _SC + ",\n" + _TS + "\nFINAL SELECT * FROM ts", keys="l_orderkey l_linenumber symbol", r6="confidence strength", ints="direction")
add("rank_signals", lambda s, d: ml.rank_signals(ml.trading_signals(_scores(s, d)), "expected_return", 25, ties=("l_orderkey", "l_linenumber")), "WITH " + _SC + ",\n" + _TS + "\nFINAL SELECT *, abs(coalesce(expected_return, 0)) AS rank_value FROM ts ORDER BY rank_value DESC, l_orderkey, l_linenumber LIMIT 25", keys="l_orderkey l_linenumber", r6="rank_value strength")
add("filtered_signals", lambda s, d: ml.filter_signals(ml.trading_signals(_scores(s, d)), 0.6, 0.3, 1, " r "), "WITH " + _SC + ",\n" + _TS + "\nFINAL SELECT * FROM ts WHERE symbol = 'R' AND confidence >= 0.6 AND abs(strength) >= 0.3 AND direction = 1", keys="l_orderkey l_linenumber symbol", r6="confidence strength", ints="direction")
add("prediction_labels", lambda s, d: ml.prediction_labels(_scores(s, d)), "WITH " + _SC + "\nFINAL SELECT *, CASE WHEN probability > 0.55 THEN 'bullish' WHEN probability < 0.45 THEN 'bearish' ELSE 'neutral' END AS signal, round_even(greatest(probability, 1 - probability), 3) AS confidence, round_even((2 * CAST(probability > 0.5 AS INTEGER) - 1) * greatest(probability, 1 - probability), 3) AS strength FROM sc", keys="l_orderkey l_linenumber signal", r6="confidence strength")
add("signal_agreement", lambda s, d: ml.agreement(sentiment.signals_absolute(daily(s, d), 0.1, -0.1), sentiment.signals_zscore(daily(s, d))), SIGNALS_ + f"\nFINAL SELECT symbol, count(*) AS days, avg(CAST(a = signal AS INTEGER)) AS agreement FROM (SELECT *, {_LABEL.format(up='sentiment_score > 0.1', down='sentiment_score < -0.1').replace('AS signal', 'AS a')} FROM sig) t GROUP BY symbol", keys="symbol", r6="agreement", longs="days")

# --- serving
add("latest_prices", on_bars(serve.latest), BARS_ + "\nFINAL SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1", r3="open high low close volume")
add("latest_sentiment", on_daily(serve.latest), DAILY_ + "\nFINAL SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1", r9=_DCOLS, longs="article_count")
add("price_history_tail", on_bars(lambda df: serve.last_rows(df, 30)), BARS_ + "\nFINAL SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 30", r3="open high low close volume")
add("price_range", on_bars(lambda df: serve.between(df, "1996-03-01", "1996-08-31")), BARS_ + "\nFINAL SELECT * FROM bars WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-08-31'", r3="close")
add("recent_sentiment", on_daily(lambda df: serve.recent(df, 7)), DAILY_ + "\nFINAL SELECT * FROM daily WHERE date >= (SELECT max(date) - 7 FROM daily)", r6="sentiment_score")
add("sentiment_summary", on_daily(serve.sentiment_summary), DAILY_ + "\nFINAL SELECT symbol, avg(sentiment_score) AS avg_sentiment_score, avg(sentiment_confidence) AS avg_sentiment_confidence, avg(bullish_ratio) AS avg_bullish_ratio, avg(bearish_ratio) AS avg_bearish_ratio, sum(article_count) AS total_articles, count(*) AS days FROM daily GROUP BY symbol", keys="symbol", r6="avg_sentiment_score avg_sentiment_confidence avg_bullish_ratio avg_bearish_ratio", longs="total_articles days")
add("sentiment_overview", on_daily(serve.sentiment_overview), DAILY_ + "\nFINAL SELECT symbol, max(date) AS date, arg_max(sentiment_score, date) AS latest_score, avg(sentiment_score) AS avg_score, sum(article_count) AS total_articles FROM daily GROUP BY symbol", r6="latest_score avg_score", longs="total_articles")
add("signal_summary", on_daily(sentiment.signals_zscore, serve.signal_summary), SIGNALS_ + "\nFINAL SELECT symbol, " + ", ".join(f"count(*) FILTER (signal = '{s}') AS {s}" for s in ("bullish", "bearish", "neutral")) + ", arg_max(signal, date) AS latest_signal, max(date) AS latest_date, avg(signal_strength) AS avg_strength, max(signal_strength) AS max_strength, min(signal_strength) AS min_strength FROM sig GROUP BY symbol", keys="symbol latest_signal latest_date", r6="avg_strength max_strength min_strength", longs="bullish bearish neutral")
add("overview_kpis", on_daily(serve.overview), DAILY_ + "\nFINAL SELECT avg(sentiment_score) AS avg_score, sum(article_count) AS total_articles, count(DISTINCT symbol) AS symbols, avg(bullish_ratio) AS avg_bullish FROM daily", keys="", r6="avg_score avg_bullish", longs="total_articles symbols")
add("series_stats", on_daily(serve.series_stats), DAILY_ + "\nFINAL SELECT symbol, avg(sentiment_score) AS mean, stddev_samp(sentiment_score) AS std, min(sentiment_score) AS min, max(sentiment_score) AS max FROM daily GROUP BY symbol", keys="symbol", r6="mean std min max")
add("sentiment_heatmap", lambda s, d: _heat(daily(s, d)), DAILY_ + "\nFINAL SELECT symbol, date, avg(sentiment_score) AS sentiment_score FROM daily GROUP BY ALL", r6="sentiment_score")


def _heat(df: DataFrame) -> DataFrame:
    """The heat map, folded back into rows (column names depend on the data)."""
    names = [r[0] for r in df.select("symbol").distinct().orderBy("symbol").collect()]  # the symbol dimension
    wide = serve.heatmap(df, names)
    return wide.select("date", F.explode(F.array(*[F.struct(F.lit(n).alias("symbol"), F.col(f"`{n}`").alias("sentiment_score")) for n in names])).alias("x")).select("date", "x.*").filter("sentiment_score is not null")


add("latest_signals", on_daily(sentiment.signals_zscore, lambda df: df.orderBy(F.desc("date"), "symbol").limit(10)), SIGNALS_ + "\nFINAL SELECT * FROM sig ORDER BY date DESC, symbol LIMIT 10", **_SIG)
_PRIORITY = "1-URGENT"
_MERGE = DAILY_.replace("WITH RECURSIVE ", f"WITH RECURSIVE {BARS_SQL},\n") + ",\nd AS (SELECT '1-URGENT' AS symbol, date, avg(sentiment_score) AS sentiment_score FROM daily GROUP BY date), b AS (SELECT symbol, CAST(date + INTERVAL 24 YEAR AS DATE) AS day, close FROM bars)\nFINAL SELECT d.symbol, d.date, sentiment_score, close FROM d LEFT JOIN b ON b.symbol = d.symbol AND b.day = d.date"


def _merged(spark, sf_dir):
    one = daily(spark, sf_dir).groupBy("date").agg(F.avg("sentiment_score").alias("sentiment_score")).withColumn("symbol", F.lit(_PRIORITY))
    moved = bars(spark, sf_dir).select("symbol", F.add_months("date", 12 * 24).alias("date"), "close")
    return sentiment.merge_with_prices(one, moved)


add("merge_sentiment_prices", _merged, _MERGE, r6="sentiment_score", r3="close")
add("export_prices", on_bars(serve.export_prices), BARS_ + "\nFINAL SELECT symbol, max(date) AS date, arg_max(close, date) AS close, avg(volume) AS avg_volume, min(low) AS min_price, max(high) AS max_price, arg_max(close, date) / arg_min(close, date) - 1 AS total_return FROM bars GROUP BY symbol", r6="avg_volume total_return", r3="close min_price max_price")

add("export_prices_history", on_bars(lambda df: serve.export_prices(df).select("symbol", F.explode("history").alias("h")).select("symbol", "h.*")), BARS_ + "\nFINAL SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 90", r3="close")


def _upserted(spark, sf_dir):
    df = bars(spark, sf_dir).select("symbol", "date", "close", "volume")
    new = df.filter(F.month("date") == 3).withColumns({"close": F.col("close") * 2, "volume": F.lit(None).cast("double")})
    return serve.upsert(df.filter(F.month("date") < 11), new.unionByName(df.filter(F.month("date") == 12)), ["symbol", "date"])


add("upsert_prices", _upserted, BARS_ + "\nFINAL SELECT symbol, date, CASE WHEN month(date) = 3 THEN 2 * close ELSE close END AS close, CASE WHEN month(date) <> 3 THEN volume END AS volume FROM bars WHERE month(date) <> 11", r3="close volume")


def _symbols(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("ticker"), F.col("c_nationkey").alias("nation"))
    old = c.filter("nation < 20").groupBy("ticker").agg(F.count("*").cast("double").alias("sector"), F.lit(True).alias("is_active"))
    new = c.filter("nation >= 10 and ticker < 'F'").groupBy("ticker").agg(F.lit(None).cast("double").alias("sector"), F.lit(False).alias("is_active"))
    return serve.upsert_keeping(old, new, ["ticker"], ("is_active",))


add("upsert_symbols", _symbols, "WITH o AS (SELECT c_mktsegment AS ticker, CAST(count(*) AS DOUBLE) AS sector FROM customer WHERE c_nationkey < 20 GROUP BY 1), n AS (SELECT DISTINCT c_mktsegment AS ticker FROM customer WHERE c_nationkey >= 10 AND c_mktsegment < 'F')\nFINAL SELECT coalesce(o.ticker, n.ticker) AS ticker, sector, n.ticker IS NULL AS is_active FROM o FULL JOIN n ON o.ticker = n.ticker", keys="ticker is_active", r6="sector")


def _lists(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    pick = lambda cond: serve.Watchlist(n.filter(cond).select(F.col("n_name").alias("symbol")))
    return pick("n_nationkey < 15"), pick("n_nationkey >= 10")


for _name, _sql in (("merge", "true"), ("difference", "n_nationkey < 10"), ("intersection", "n_nationkey BETWEEN 10 AND 14")):
    add(f"watchlist_{_name}", lambda s, d, m=_name: (lambda a, b: getattr(a, m)(b).frame)(*_lists(s, d)), f"SELECT DISTINCT upper(trim(n_name)) AS symbol FROM nation WHERE {_sql}")
add("available_symbols", lambda s, d: bars(s, d).select("symbol").union(daily(s, d).select("symbol")).distinct(), "SELECT o_orderpriority AS symbol FROM orders UNION SELECT event_type FROM events")
add(
    "nation_summary",
    lambda s, d: (lambda o, c, n: o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.avg("o_totalprice").alias("avg_price"), F.count("*").alias("orders")))(*[s.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer", "nation")]),
    "SELECT 1\nFINAL SELECT n_name, avg(o_totalprice) AS avg_price, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name".replace("SELECT 1", ""),
    keys="n_name", r3="avg_price", longs="orders",
)

_UPSERTED = QUERIES["upsert_symbols"]
add("active_symbols", lambda s, d: serve.active(_symbols(s, d)), _UPSERTED.sql + " WHERE n.ticker IS NULL", keys="ticker is_active", r6="sector")
add("symbol_lookup", lambda s, d: serve.lookup(_symbols(s, d), " machinery"), _UPSERTED.sql + " WHERE coalesce(o.ticker, n.ticker) = 'MACHINERY'", keys="ticker is_active", r6="sector")
add("enough_history", on_bars(lambda df: serve.enough_history(df, 1000)), BARS_ + "\nFINAL SELECT * FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(close) >= 1000 AND min(close) > 0)", r3="close volume")


def _markers(spark, sf_dir):
    signals = sentiment.signals_absolute(daily(spark, sf_dir), 0.1, -0.1).withColumn("symbol", F.lit(_PRIORITY)).dropDuplicates(["date", "signal"])
    return serve.signal_markers(signals, bars(spark, sf_dir).select("symbol", F.add_months("date", 12 * 24).alias("date"), "close"))


add(
    "signal_markers", _markers,
    DAILY_.replace("WITH RECURSIVE ", f"WITH RECURSIVE {BARS_SQL},\n") + """,
m AS (SELECT DISTINCT '1-URGENT' AS symbol, date, CASE WHEN sentiment_score > 0.1 THEN 'bullish' ELSE 'bearish' END AS signal FROM daily WHERE sentiment_score > 0.1 OR sentiment_score < -0.1),
b AS (SELECT symbol, CAST(date + INTERVAL 24 YEAR AS DATE) AS day, close FROM bars)
FINAL SELECT m.symbol, m.date, m.signal, b.close AS price FROM m LEFT JOIN b ON b.symbol = m.symbol AND b.day = m.date""",
    keys="symbol date signal", r3="price",
)


def _weekly_marks(spark, sf_dir):
    """Signals of every third day, against bars of working days alone."""
    b = bars(spark, sf_dir)
    signal = F.when(F.col("close") > F.col("open"), "bullish").when(F.col("close") < F.col("open"), "bearish").otherwise("neutral")
    signals = b.filter(F.dayofyear("date") % 3 == 0).select("symbol", "date", signal.alias("signal"))
    return serve.signal_markers_asof(signals, b.filter(F.weekday("date") < 5).select("symbol", "date", "close"), 4)


add(
    "signal_markers_asof", _weekly_marks,
    BARS_ + """,
m AS (SELECT symbol, date, CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END AS signal FROM bars WHERE dayofyear(date) % 3 = 0 AND close <> open),
b AS (SELECT symbol, date AS price_date, close FROM bars WHERE isodow(date) < 6)
FINAL SELECT m.symbol, m.date, m.signal, CASE WHEN m.date - price_date <= 4 THEN close END AS price, CASE WHEN m.date - price_date <= 4 THEN m.date - price_date END AS age FROM m ASOF LEFT JOIN b ON m.symbol = b.symbol AND m.date >= b.price_date""",
    keys="symbol date signal", r3="price", longs="age",
)
_AS_OF = QUERIES["signal_markers_asof"]
QUERIES["signal_markers_asof"] = Query(lambda s, d: _AS_OF.fn(s, d).withColumn("age", F.datediff("date", "price_date")), _AS_OF.sql, _AS_OF.keys, r3="price", longs="age")


def _month_by_month(spark, sf_dir):
    """The bars of ten months of the years and then corrections, through a table on disk."""
    df = bars(spark, sf_dir).select("symbol", "date", "close", "volume")
    path = f"{shared_folder(spark)}/quantloom/bars-{uuid.uuid4().hex}"
    files.upsert_table(df.filter(F.month("date") < 11), path, period="yyyy")
    new = df.filter(F.month("date") == 3).withColumns({"close": F.col("close") * 2, "volume": F.lit(None).cast("double")})
    return files.upsert_table(new.unionByName(df.filter(F.month("date") == 12)), path, keeping=True, period="yyyy").drop("period")


add("upsert_table", _month_by_month, BARS_ + "\nFINAL SELECT symbol, date, CASE WHEN month(date) = 3 THEN 2 * close ELSE close END AS close, volume FROM bars WHERE month(date) <> 11", r3="close volume")
add("client_volatility", on_bars(lambda df: price.rolling_volatility(df, 10)), with_(BARS_SQL, _R1) + f"\nFINAL SELECT *, ({full('stddev_samp(ret)', 'ret', 10)}) * {YEAR} AS rolling_volatility FROM r", r6="rolling_volatility")
add("signals_dispatch", on_daily(lambda df: sentiment.generate_signals(df, "absolute").unionByName(sentiment.generate_signals(df, "zscore"), allowMissingColumns=True).groupBy("symbol", "signal").agg(F.count("*").alias("days"))), SIGNALS_ + f"\nFINAL SELECT symbol, signal, count(*) AS days FROM (SELECT symbol, signal FROM sig UNION ALL SELECT symbol, {_LABEL.format(up='sentiment_score > 0.5', down='sentiment_score < -0.5')} FROM sig) t GROUP BY symbol, signal", keys="symbol signal", longs="days")


def _page(spark, sf_dir):
    b = bars(spark, sf_dir)
    return serve.page_kpis(daily(spark, sf_dir), b, serve.latest(b).select("symbol", (50 * (F.col("high") - F.col("low")) / F.col("high")).alias("risk_score")))


add(
    "page_kpis", _page,
    DAILY_.replace("WITH RECURSIVE ", f"WITH RECURSIVE {BARS_SQL},\n") + """,
l AS (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
p AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
FINAL SELECT (SELECT avg(sentiment_score) FROM l) AS avg_score, (SELECT avg(50 * (high - low) / high) FROM p) AS avg_risk, (SELECT sum(volume) FROM p) AS total_volume, (SELECT count(*) FROM l WHERE sentiment_score > 0.1) AS bullish""",
    keys="", r6="avg_score avg_risk total_volume", longs="bullish",
)
add("export_sentiment", on_daily(lambda df: serve.export_sentiment(df).withColumn("days", F.size("history"))), DAILY_ + ",\nx AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, least(90, count(*) OVER (PARTITION BY symbol)) AS days FROM daily)\nFINAL SELECT symbol, date, round(coalesce(sentiment_score, 0), 4) AS sentiment_score, round(coalesce(bullish_ratio, 0), 4) AS bullish_ratio, article_count, days FROM x WHERE k = 1", r4="sentiment_score bullish_ratio", longs="article_count days")
add("export_sentiment_history", on_daily(lambda df: serve.export_sentiment(df).select("symbol", F.explode("history").alias("h")).select("symbol", "h.*")), DAILY_ + "\nFINAL SELECT symbol, date, round(coalesce(sentiment_score, 0), 4) AS sentiment_score, article_count FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 90", r4="sentiment_score", longs="article_count")
add(
    "current_sentiment", lambda s, d: (lambda df: serve.current_sentiment(df, sentiment.signals_zscore(df).filter("symbol < 'f' and day(date) < 20")))(daily(s, d)),
    SIGNALS_ + """,
l AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
k AS (SELECT symbol, signal, signal_strength FROM sig WHERE symbol < 'f' AND day(date) < 20 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
FINAL SELECT l.symbol, l.date, l.sentiment_score, coalesce(k.signal, CASE WHEN l.sentiment_score > 0.3 THEN 'bullish' WHEN l.sentiment_score < -0.3 THEN 'bearish' ELSE 'neutral' END) AS signal, CASE WHEN k.signal IS NOT NULL THEN k.signal_strength ELSE abs(l.sentiment_score) END AS signal_strength FROM l LEFT JOIN k ON k.symbol = l.symbol""",
    keys="symbol date signal", r6="sentiment_score signal_strength",
)
add("risk_bands", on_bars(lambda df: serve.risk_bands(df.withColumn("risk_score", 100 * (F.col("high") - F.col("low")) / F.col("high"))).groupBy("symbol", "risk_band").agg(F.count("*").alias("days"))), BARS_ + "\nFINAL SELECT symbol, CASE WHEN r < 40 THEN 'Low Risk' WHEN r < 60 THEN 'Moderate' WHEN r < 80 THEN 'High Risk' ELSE 'Very High' END AS risk_band, count(*) AS days FROM (SELECT symbol, 100 * (high - low) / high AS r FROM bars) t GROUP BY 1, 2", keys="symbol risk_band", longs="days")
add("export_predictions", lambda s, d: serve.export_predictions(ml.classification_metrics(_scores(s, d).withColumn("score", F.col("probability")), "symbol")), QUERIES["clf_metrics"].sql.replace("FINAL SELECT *,", "FINAL SELECT symbol, accuracy, auc, 0.0 AS samples, 0.0 AS r2, 0.0 AS unused,"), keys="symbol", r6="accuracy auc samples r2")
add("watchlist_edit", lambda s, d: _lists(s, d)[0].add(" new one ", "NATION_3").remove("nation_1").valid(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("symbol")).unionByName(s.createDataFrame([("New One",)], "symbol string"))).frame, "SELECT upper(n_name) AS symbol FROM nation WHERE n_nationkey < 15 AND upper(n_name) <> 'NATION_1' UNION SELECT 'NEW ONE' UNION SELECT 'NATION_3'")
add("standard_scaled", on_bars(lambda df: predict.Scaler.fit(df, ["close", "volume"]).transform(df)), BARS_ + "\nFINAL SELECT symbol, date, (close - avg(close) OVER ()) / stddev_pop(close) OVER () AS close, (volume - avg(volume) OVER ()) / stddev_pop(volume) OVER () AS volume FROM bars", r6="close volume")
add("return_confidence", lambda s, d: predict.return_confidence(_scores(s, d)), _SC_ + "\nFINAL SELECT *, CASE WHEN expected_return IS NOT NULL THEN coalesce(1 / (1 + abs((expected_return - avg(expected_return) OVER w) / nullif(stddev_pop(expected_return) OVER w, 0))), 0.5) END AS return_confidence FROM sc WINDOW w AS (PARTITION BY symbol)", keys="l_orderkey l_linenumber", r6="return_confidence")
add("ensemble_signal", lambda s, d: ml.ensemble(_scores(s, d).withColumn("direction", (F.col("probability") > 0.5).cast("int"))), _SC_ + "\nFINAL SELECT *, (2 * CAST(probability > 0.5 AS INTEGER) - 1) * probability * abs(expected_return) AS ensemble_signal FROM sc", keys="l_orderkey l_linenumber", r6="ensemble_signal")


def _models(spark, sf_dir):
    """Both models of each symbol over all features."""
    rows, returns = _training(spark, sf_dir), _training(spark, sf_dir, "return")
    names = ml.feature_names(rows)
    return predict.Models(names, ml.fit_model(rows, names, early_stopping=True), ml.fit_model(returns, names, "regressor")), rows


add("out_of_fold", lambda s, d: ml.out_of_fold(_training(s, d)))
add("predictions", lambda s, d: (lambda m, rows: m.predict(rows))(*_models(s, d)))
add("predictions_latest", lambda s, d: (lambda m, rows: m.predict_latest(rows))(*_models(s, d)))

# --- text
_TERMS = ", ".join(f"('{k}', {v})" for k, v in text.TERMS.items())
_HEAD = "h AS (SELECT event_id AS article_id, CASE WHEN value >= 120 THEN 'Company beats estimates, stock soars after upgrade' WHEN value >= 60 THEN 'Strong growth and record profit for the quarter' WHEN value >= 30 THEN 'Shares hold steady before results' WHEN value >= 10 THEN 'Weak guidance and layoffs hurt shares' ELSE 'ok' END AS headline FROM events)"
add(
    "lexicon_sentiment", lambda s, d: text.lexicon_sentiment(headlines(s, d)),
    f"WITH {_HEAD}, terms(term, weight) AS (VALUES {_TERMS}), w AS (SELECT article_id, unnest(regexp_split_to_array(lower(headline), '[^a-z]+')) AS term FROM h WHERE length(headline) >= 5), s AS (SELECT h.article_id, coalesce(sum(weight), 0) AS s FROM h LEFT JOIN w USING (article_id) LEFT JOIN terms USING (term) GROUP BY h.article_id), x AS (SELECT article_id, CAST(s AS DOUBLE) / sqrt(CAST(s AS DOUBLE) * CAST(s AS DOUBLE) + 15) AS sentiment_score FROM s)"
    "\nFINAL SELECT *, abs(sentiment_score) AS sentiment_confidence, CASE WHEN sentiment_score > 0.1 THEN 'bullish' WHEN sentiment_score < -0.1 THEN 'bearish' ELSE 'neutral' END AS sentiment_signal FROM x",
    keys="article_id sentiment_signal", r6="sentiment_score sentiment_confidence",
)

_LINES = (
    "Company beats estimates, stock gains after upgrade", "VERY strong growth and record profit for the quarter!!", "Shares not strong, hold steady before results",
    "Weak guidance and LAYOFFS hurt shares", "Strong sales but slightly weak outlook??", "Surely isn't a really big loss, more concerns remain", "At least stable; the least risky name", "ok",
)
_WORDS = (
    "('gains', 1.5, NULL, false), ('upgrade', 2.5, NULL, false), ('strong', 1.0, NULL, false), ('growth', 1.5, NULL, false), ('record', 1.5, NULL, false), ('profit', 1.5, NULL, false), ('hold', 0.0, NULL, false), ('steady', 0.5, NULL, false), "
    "('weak', -1.5, NULL, false), ('layoffs', -2.0, NULL, false), ('loss', -2.0, NULL, false), ('concerns', -1.5, NULL, false), ('stable', 0.5, NULL, false), ('risky', -1.5, NULL, false), "
    "('very', NULL, 0.293, false), ('really', NULL, 0.293, false), ('more', NULL, 0.293, false), ('slightly', NULL, -0.293, false), ('not', NULL, NULL, true)"
)


def _lines(spark, sf_dir):
    line = F.get(F.array(*[F.lit(x) for x in _LINES]), (F.col("event_id") % len(_LINES)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("article_id"), line.alias("headline"))


def _before(k: int) -> str:
    fade = (1.0, 0.95, 0.9)[k - 1]
    v = f"v{k - 1}"
    more = f"coalesce((b{k} + CASE WHEN mixed AND c{k} THEN 0.733 ELSE 0 END) * CASE WHEN {v} < 0 THEN -1 ELSE 1 END * {fade}, 0)"
    return f"s{k} AS (SELECT *, CASE WHEN w{k} IS NOT NULL AND a{k} IS NULL THEN ({v} + {more}) * CASE WHEN n{k} THEN -0.74 ELSE 1 END ELSE {v} END AS v{k} FROM s{k - 1})"


_LAGS = ", ".join(f"lag({c}, {k}) OVER o AS {a}{k}" for k in (1, 2, 3) for c, a in (("word", "w"), ("valence", "a"), ("boost", "b"), ("negates", "n"), ("cap", "c")))
_CASE = " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(_LINES))
add(
    "rule_sentiment", lambda s, d: lexicon.rule_sentiment(_lines(s, d)),
    rf"""WITH h AS (SELECT event_id AS article_id, CASE event_id % {len(_LINES)} {_CASE} END AS headline FROM events),
lex(term, valence, boost, negates) AS (VALUES {_WORDS}),
k AS (SELECT article_id, unnest(string_split_regex(trim(headline), '\s+')) AS raw, generate_subscripts(string_split_regex(trim(headline), '\s+'), 1) AS pos FROM h WHERE length(trim(headline)) >= 5),
w AS (SELECT article_id, pos, CASE WHEN length(bare) > 2 THEN bare ELSE raw END AS word FROM (SELECT *, regexp_replace(regexp_replace(raw, '^[[:punct:]]+', ''), '[[:punct:]]+$', '') AS bare FROM k) t),
j AS (SELECT article_id, pos, word, valence, boost, coalesce(negates, false) OR contains(word, 'n''t') AS negates, word = upper(word) AND word <> lower(word) AS cap FROM w LEFT JOIN lex ON lower(word) = term),
s0 AS (SELECT *, valence + CASE WHEN mixed AND cap THEN sign(valence) * 0.733 ELSE 0 END AS v0 FROM (SELECT *, {_LAGS}, sum(CAST(cap AS INTEGER)) OVER e BETWEEN 1 AND count(*) OVER e - 1 AS mixed, min(CASE WHEN lower(word) = 'but' THEN pos END) OVER e AS but
 FROM j WINDOW o AS (PARTITION BY article_id ORDER BY pos), e AS (PARTITION BY article_id)) t),
{_before(1)},
{_before(2)},
{_before(3)},
f AS (SELECT article_id, CASE WHEN valence IS NULL OR boost IS NOT NULL THEN 0 ELSE v3 * CASE WHEN lower(w1) = 'least' AND coalesce(lower(w2), '') NOT IN ('at', 'very') THEN -0.74 ELSE 1 END END * CASE WHEN but IS NULL OR pos = but THEN 1 WHEN pos < but THEN 0.5 ELSE 1.5 END AS s FROM s3),
t AS (SELECT article_id, sum(s) AS s, coalesce(sum(s + 1) FILTER (s > 0), 0) AS up, coalesce(sum(1 - s) FILTER (s < 0), 0) AS down, count(*) FILTER (s = 0) AS no FROM f GROUP BY article_id),
m AS (SELECT article_id, coalesce(s, 0) + sign(coalesce(s, 0)) * m AS s, up + CASE WHEN up > down THEN m ELSE 0 END AS up, down + CASE WHEN up < down THEN m ELSE 0 END AS down, no
 FROM (SELECT h.article_id, s, up, down, no, least(length(headline) - length(replace(headline, '!', '')), 4) * 0.292 + CASE length(headline) - length(replace(headline, '?', '')) WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0.36 WHEN 3 THEN 0.54 ELSE 0.96 END AS m FROM h LEFT JOIN t USING (article_id)) t),
x AS (SELECT *, s / sqrt(s * s + 15) AS sentiment_score FROM m)
FINAL SELECT article_id, sentiment_score, abs(sentiment_score) AS sentiment_confidence, coalesce(up / (up + down + no), 0) AS prob_positive, coalesce(down / (up + down + no), 0) AS prob_negative, coalesce(no / (up + down + no), 0) AS prob_neutral,
 CASE WHEN sentiment_score > 0.1 THEN 'bullish' WHEN sentiment_score < -0.1 THEN 'bearish' ELSE 'neutral' END AS sentiment_signal FROM x""",
    keys="article_id sentiment_signal", r6="sentiment_score sentiment_confidence prob_positive prob_negative prob_neutral",
)


def _classified(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    label = F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")), (F.col("event_id") % 3 + 1).cast("int"))
    return text.classifier_mapping(e.select("event_id", label.alias("label"), (0.4 + (F.col("event_id") % 60) / 100).alias("prob")))


add(
    "classifier_mapping", _classified,
    "WITH e AS (SELECT event_id, event_id % 3 AS k, 0.4 + (event_id % 60) / 100 AS p FROM events), m AS (SELECT event_id, CASE k WHEN 0 THEN p WHEN 1 THEN (1 - p) * 0.3 ELSE (1 - p) * 0.5 END AS prob_positive, CASE k WHEN 1 THEN p WHEN 0 THEN (1 - p) * 0.3 ELSE (1 - p) * 0.5 END AS prob_negative, CASE k WHEN 2 THEN p ELSE (1 - p) * 0.7 END AS prob_neutral FROM e)"
    "\nFINAL SELECT *, prob_positive - prob_negative AS sentiment_score, greatest(prob_positive, prob_negative, prob_neutral) AS sentiment_confidence FROM m",
    keys="event_id", r6="prob_positive prob_negative prob_neutral sentiment_score sentiment_confidence",
)


def _vendor(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = F.to_json(F.struct(F.col("event_type").alias("symbol"), F.struct(F.col("user_id").alias("articlesInLastWeek"), F.col("value").alias("buzz")).alias("buzz"), F.struct((F.col("value") / 500).alias("bullishPercent")).alias("sentiment")))
    return text.flatten_vendor(e.select(body.alias("payload"))).groupBy("symbol").agg(F.sum("articles_in_last_week").alias("articles"), F.avg("buzz_score").alias("buzz"), F.avg("bullish_percent").alias("bullish"), F.sum("bearish_percent").alias("bearish"), F.sum("weekly_average").alias("weekly"))


def _news(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return text.flatten_articles(e.select(F.col("event_type").alias("related"), F.col("event_id").alias("id"), F.lit("h").alias("headline"), F.lit("s").alias("summary"), F.lit("x").alias("source"), F.lit("c").alias("category"), F.lit("u").alias("url"), F.lit("i").alias("image"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("datetime")))


add("news_articles", lambda s, d: _news(s, d).groupBy("symbol", F.to_date("article_ts").alias("date")).agg(F.count("*").alias("articles"), F.min("article_id").alias("first_id")), "WITH e AS (SELECT * FROM events)\nFINAL SELECT upper(event_type) AS symbol, CAST(ts AS DATE) AS date, count(*) AS articles, min(event_id) AS first_id FROM e GROUP BY 1, 2", longs="articles first_id")


def _blended(spark, sf_dir):
    a = articles(spark, sf_dir).select("symbol", "article_id", "sentiment_score", "sentiment_signal", F.when(F.col("article_id") % 3 > 0, (F.col("article_id") % 21 - 10) / 10.0).alias("summary_score"))
    return text.blend_summary(a)


add(
    "blended_sentiment", _blended,
    f"WITH {ARTICLES_SQL},\nb AS (SELECT article_id, CASE WHEN article_id % 3 > 0 THEN 0.7 * sentiment_score + 0.3 * ((article_id % 21 - 10) / 10.0) ELSE sentiment_score END AS sentiment_score FROM articles)"
    "\nFINAL SELECT *, CASE WHEN sentiment_score > 0.1 THEN 'bullish' WHEN sentiment_score < -0.1 THEN 'bearish' ELSE 'neutral' END AS sentiment_signal FROM b",
    keys="article_id sentiment_signal", r6="sentiment_score",
)
add("vendor_json", _vendor, "WITH e AS (SELECT * FROM events)\nFINAL SELECT upper(event_type) AS symbol, sum(user_id) AS articles, avg(value) AS buzz, avg(value / 500) AS bullish, 0.0 AS bearish, 0.0 AS weekly FROM e GROUP BY 1", keys="symbol", r6="buzz bullish bearish weekly", longs="articles")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.spark for k, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, q in QUERIES.items() if (s := q.oracle())}
