"""Risk reports: a row for each symbol, rankings, nested full reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import drawdown, risk


MIN_ROWS = 30


def metrics(df: DataFrame, with_garch: bool = False, least: int = MIN_ROWS) -> DataFrame:
    """``symbol``, VaR and ES at 95 % and 99 %, volatility over 21 and 63 days, drawdowns, calmar, the last ``vol_regime``, scores
    (0 to 10). All are null for symbols with fewer than ``least`` closes or a close that isn't positive."""
    grid = risk.var_grid(df).filter("method = 'historical'").groupBy("symbol").agg(
        *[F.max(F.when(F.col("confidence") == c, F.col(v))).alias(f"{v}_{c[:2]}") for v in ("var", "es") for c in ("95%", "99%")]
    )
    vol = risk.vol_term_structure(df, (21, 63)).groupBy("symbol").agg(*[F.max(F.when(F.col("window") == n, F.col("volatility"))).alias(f"volatility_{n}") for n in (21, 63)])
    down = drawdown.summary(df, least=least).select("symbol", "max_drawdown", "current_drawdown", "ulcer_index", "pain_index", "calmar_ratio")
    out = grid.join(vol, "symbol", "left").join(down, "symbol", "left")
    regime = risk.vol_regime(risk.daily(df)).groupBy("symbol").agg(F.max_by("vol_regime", F.struct(F.col("vol_regime").isNotNull(), "date")).alias("vol_regime"))
    out = out.join(regime, "symbol", "left")
    if with_garch:
        g = risk.garch(df).select("symbol", (F.aggregate("forecast", F.lit(0.0), lambda s, x: s + x) / F.size("forecast") * risk.YEAR**0.5).alias("garch_forecast"))
        out = out.join(g, "symbol", "left")
    out = out.select("symbol", *[F.when(F.col("max_drawdown").isNotNull(), F.col(c)).alias(c) for c in out.columns if c != "symbol"])
    part = lambda c, k, top: F.when(F.col(c).isNotNull(), F.least(k * F.col(c), F.lit(top)))
    return out.withColumns(
        {
            "risk_score": part("var_99", 50, 3.33) + part("volatility_21", 5, 3.33) + part("max_drawdown", 10, 3.34),
            "var_score": part("var_99", 100, 10.0),
            "volatility_score": part("volatility_21", 10, 10.0),
            "drawdown_score": part("max_drawdown", 10, 10.0),
        }
    )


def ranking(df: DataFrame, metric: str = "risk_score") -> DataFrame:
    """``symbol, value, rank``: the riskiest first; for calmar the lowest."""
    m = metrics(df).select("symbol", F.col(metric).alias("value"))
    order = F.asc_nulls_last("value") if metric == "calmar_ratio" else F.desc_nulls_last("value")
    return m.withColumn("rank", F.row_number().over(Window.orderBy(order, "symbol")))


def full(df: DataFrame, top: int = 5) -> DataFrame:
    """Nested report: the metrics, the VaR grid, the term structure and the ``top`` deepest drawdowns."""
    grid = risk.var_grid(df).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("method", "confidence", "var", "es"))).alias("var_grid"))
    term = risk.vol_term_structure(df).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("window", "volatility"))).alias("term_structure"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("drawdown"), "start_date"))
    deep = drawdown.episodes(df).withColumn("place", place).filter(F.col("place") <= top)
    deep = deep.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("place", "start_date", "trough_date", "end_date", "drawdown"))).alias("top_drawdowns"))
    return metrics(df).join(grid, "symbol").join(term, "symbol", "left").join(deep, "symbol", "left")


def export_risk(df: DataFrame) -> DataFrame:
    """Published figures in percent, with losses negative and a score from 0 to 100."""
    r = risk.daily(df)
    s = r.groupBy("symbol").agg(
        (100 * F.percentile("ret", 0.05)).alias("var_95"), (100 * F.percentile("ret", 0.01)).alias("var_99"), F.avg("ret").alias("_m"),
    ).join(risk.vol_term_structure(df, (21,)).select("symbol", (100 * F.col("volatility")).alias("volatility_21")), "symbol", "left")
    es = r.join(s.select("symbol", "var_95"), "symbol").groupBy("symbol").agg((100 * F.avg(F.when(100 * F.col("ret") <= F.col("var_95"), F.col("ret")))).alias("es_95"))
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    growth = r.filter("ret > -1").withColumn("_g", F.exp(F.sum(F.log(1 + F.col("ret"))).over(w))).withColumn("_p", F.max("_g").over(w))
    down = growth.groupBy("symbol").agg((100 * F.min(F.col("_g") / F.col("_p") - 1)).alias("max_drawdown"))
    out = s.join(es, "symbol").join(down, "symbol")
    sharpe = F.try_divide(F.col("_m") * 252 * 100 - 5, "volatility_21")
    score = 50 + 2 * (F.col("volatility_21") - 20) + 2 * F.abs("var_95") + F.abs("max_drawdown")
    return out.select("symbol", "var_95", "var_99", "es_95", "volatility_21", "max_drawdown", sharpe.alias("sharpe_ratio"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("risk_score"))
