"""Targets, data sets, time-ordered splits, walk-forward validation, metrics and model-driven signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import settled
from ..functions.windows import over_key
from . import boost, drawdown, price, risk, sentiment
from .boost import Boost

KEYS = ("symbol", "date")


def targets(df: DataFrame, horizon: int = 1, kind: str = "return", strict: bool = False) -> DataFrame:
    """Add ``target``: what the close does over the next rows. Directions of the last rows are 0 unless ``strict``."""
    ahead = F.lead("close", horizon).over(over_key())
    ways = {
        "return": F.try_divide(ahead, F.col("close")) - 1,
        "log_return": F.when((ahead > 0) & (F.col("close") > 0), F.log(ahead / F.col("close"))),
        "direction": (ahead > F.col("close")).cast("int"),
        "direction_signed": F.signum(ahead - F.col("close")).cast("int"),
    }
    if kind not in ways:
        raise ValueError(f"unknown target: {kind}")
    out = ways[kind] if strict or not kind.startswith("direction") else F.coalesce(ways[kind], F.lit(0))
    return df.withColumn("target", out)


def risk_features(df: DataFrame) -> DataFrame:
    """All risk columns beside the bars; return-based ones are null on a symbol's first bar."""
    r = risk.daily(df)
    r = risk.vol_ratios(risk.ewma_volatility(risk.realized_volatility(risk.rolling_es(risk.rolling_var(r))), (5, 10, 21, 63)))
    d = drawdown.features(df).select("symbol", "date", "drawdown", "current_drawdown", "underwater", "days_since_peak", "drawdown_zscore")
    r = risk.risk_adjusted(risk.tail_risk(risk.vol_regime(r)).join(d.select("symbol", "date", "drawdown"), [*KEYS])).drop("close", "ret", "drawdown")
    return d.drop("drawdown").join(r, [*KEYS], "left")


def feature_names(df: DataFrame, drop: tuple[str, ...] = ("target",)) -> list[str]:
    """Numeric columns without keys and targets."""
    return [f.name for f in df.schema if f.name not in (*KEYS, *drop) and f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "decimal")]


def align(frames: list[DataFrame], how: str = "inner") -> DataFrame:
    """Join feature frames on symbol and date; columns that an earlier frame has are not taken again."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.select(*KEYS, *[c for c in f.columns if c not in out.columns]), [*KEYS], how)
    return out


def build_features(bars: DataFrame, daily_sentiment: DataFrame | None = None, include_risk: bool = True) -> DataFrame:
    parts = [price.build_all(bars)]
    if include_risk:
        parts.append(risk_features(bars))
    if daily_sentiment is not None:
        parts.append(sentiment.build_all(daily_sentiment))
    return align(parts)


def ml_dataset(bars: DataFrame, horizon: int = 1, kind: str = "direction") -> DataFrame:
    """Price and risk features with the target, complete rows alone."""
    features = build_features(bars).drop("open", "high", "low", "close", "volume")
    goal = targets(bars, horizon, kind).select(*KEYS, "target")
    names = feature_names(features)
    return features.select(*KEYS, *names).join(goal, [*KEYS]).na.drop("any")


def feature_summary(df: DataFrame) -> DataFrame:
    """``feature, count, missing, missing_pct, mean, std, min, max`` of numeric columns, in one aggregation."""
    names = feature_names(df)
    one = df.agg(F.count("*").alias("_n"), *[e.cast("double").alias(f"{k}_{i}") for i, c in enumerate(names) for k, e in (("c", F.count(c)), ("m", F.avg(c)), ("s", F.stddev_samp(c)), ("a", F.min(c)), ("z", F.max(c)))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{k}_{i}").alias(n) for k, n in (("c", "count"), ("m", "mean"), ("s", "std"), ("a", "min"), ("z", "max"))]) for i, c in enumerate(names)])
    out = one.select("_n", F.explode(rows).alias("r")).select("_n", "r.*")
    missing = F.col("_n") - F.col("count")
    return out.select("feature", F.col("count").cast("long"), missing.cast("long").alias("missing"), F.round(F.try_divide(100 * missing, "_n"), 2).alias("missing_pct"), "mean", "std", "min", "max")


def folds(df: DataFrame, n_splits: int = 5, min_train: int = 50, gap: int = 1, test_size: int | None = None, train_size: int | None = None, purge: int = 0, each: tuple[str, ...] = ()) -> DataFrame:
    """``symbol, each, fold, train_start, train_end, test_start, test_end`` (row numbers from 0, ends exclusive), the newest
    fold first; folds with too little to train on are left out."""
    n = df.groupBy("symbol", *each).agg(F.count("*").alias("n"))
    size = F.lit(test_size) if test_size else F.greatest(F.lit(1), F.floor((F.col("n") - min_train - gap) / n_splits))
    out = n.withColumn("size", size.cast("long")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    out = out.withColumn("test_end", F.col("n") - F.col("fold") * F.col("size")).withColumn("test_start", F.col("test_end") - F.col("size"))
    out = out.withColumn("train_end", F.col("test_start") - gap)
    start = F.greatest(F.lit(0).cast("long"), F.col("train_end") - train_size) if train_size else F.lit(0).cast("long")
    out = out.withColumn("train_start", start).filter(F.col("train_end") - F.col("train_start") >= min_train)
    if purge:
        length = F.col("train_end") - F.col("train_start")
        out = out.withColumn("train_end", F.when(length > purge, F.col("train_end") - purge).otherwise(F.col("train_end"))).filter(F.col("train_end") - F.col("train_start") >= min_train)
    return out.select("symbol", *each, "fold", "train_start", "train_end", "test_start", "test_end")


def in_folds(df: DataFrame, plan: DataFrame, each: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their fold and ``part`` (train or test), a symbol's rows numbered by date."""
    n = df.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", *each).orderBy("date")) - 1)
    train = (F.col("_n") >= F.col("train_start")) & (F.col("_n") < F.col("train_end"))
    test = (F.col("_n") >= F.col("test_start")) & (F.col("_n") < F.col("test_end"))
    out = n.join(plan, ["symbol", *each]).withColumn("part", F.when(train, "train").when(test, "test")).filter("part is not null")
    return out.drop("_n", "train_start", "train_end", "test_start", "test_end")


def calendar(df: DataFrame, n_splits: int = 5, min_train: int = 50, gap: int = 1, test_size: int | None = None, train_size: int | None = None, purge: int = 0, embargo: int = 0) -> DataFrame:
    """``date, fold, part``: folds cut at the same dates for all symbols, the newest fold first. Sizes count the distinct dates of
    ``df``. Before a fold's first test date lie ``gap`` and ``purge`` dates that are in neither part, so nothing trains on the day
    of a test or later; the ``embargo`` dates after an older fold's test dates aren't trained on either."""
    one = Window.partitionBy(F.lit(0))  # a row for each date there is, whatever the number of symbols
    days = df.select("date").distinct().withColumns({"_i": F.row_number().over(one.orderBy("date")) - 1, "_n": F.count("*").over(one)})
    size = F.lit(test_size) if test_size else F.greatest(F.lit(1), F.floor((F.col("_n") - min_train - gap) / n_splits))
    out = days.withColumn("_size", size.cast("long")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    test = F.col("_n") - (F.col("fold") + 1) * F.col("_size")
    end = test - gap - purge
    start = F.greatest(F.lit(0).cast("long"), end - train_size) if train_size else F.lit(0).cast("long")
    after = F.pmod(F.col("_i") - F.col("_n"), F.col("_size"))  # dates since the last end of a test
    older = F.ceil((F.col("_n") - F.col("_i")) / F.col("_size"))
    held_off = (after < embargo) & (older > F.col("fold")) & (older < n_splits)
    part = F.when((F.col("_i") >= start) & (F.col("_i") < end) & ~held_off, "train").when((F.col("_i") >= test) & (F.col("_i") < test + F.col("_size")), "test")
    return out.filter(end - start >= min_train).withColumn("part", part).filter("part is not null").select("date", "fold", "part")


def in_calendar(df: DataFrame, days: DataFrame) -> DataFrame:
    """Rows with their fold and ``part``: an equi-join on the date."""
    return df.join(days, "date")


def _keys(by: str | tuple[str, ...]) -> tuple[str, ...]:
    return (by,) if isinstance(by, str) else tuple(by)


def classification_metrics(df: DataFrame, by: str | tuple[str, ...], label: str = "label", score: str = "score") -> DataFrame:
    """``accuracy, precision, recall, f1`` (0 where undefined) and ``auc`` (ties averaged, 0.5 for one class). Rows are
    counted by score before they are ranked, so a window holds distinct scores alone."""
    by = _keys(by)
    same = df.groupBy(*by, score).agg(F.count("*").alias("_c"), F.sum(label).alias("_y"), F.sum((F.col(label) == (F.col(score) > 0.5).cast("int")).cast("int")).alias("_hits"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy(score)) - F.col("_c")
    same = same.withColumns({"_p": (F.col(score) > 0.5).cast("int"), "_r": before + (F.col("_c") + 1) / 2})  # equal scores share their mean rank
    out = same.groupBy(*by).agg(
        (F.sum("_hits") / F.sum("_c")).alias("accuracy"), F.sum(F.col("_y") * F.col("_p")).alias("_tp"), F.sum(F.col("_c") * F.col("_p")).alias("_pp"),
        F.sum("_y").alias("_pos"), F.sum("_c").alias("_n"), F.sum(F.col("_y") * F.col("_r")).alias("_ranks"),
    )
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    neg = F.col("_n") - F.col("_pos")
    auc = F.try_divide(F.col("_ranks") - F.col("_pos") * (F.col("_pos") + 1) / 2, F.col("_pos") * neg)
    out = out.withColumns({"precision": safe(F.col("_tp"), F.col("_pp")), "recall": safe(F.col("_tp"), F.col("_pos")), "auc": F.coalesce(auc, F.lit(0.5))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", safe(2 * p * r, p + r)).select(*by, "accuracy", "precision", "recall", "f1", "auc")


def regression_metrics(df: DataFrame, by: str | tuple[str, ...], label: str = "label", score: str = "score") -> DataFrame:
    """``mse, rmse, mae, r2, direction_accuracy``."""
    e = F.col(label) - F.col(score)
    out = df.groupBy(*_keys(by)).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg((F.signum(label) == F.signum(score)).cast("double")).alias("direction_accuracy"), F.var_pop(label).alias("_v"),
    )
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": 1 - F.try_divide(F.col("mse"), F.col("_v"))}).drop("_v")


def fold_summary(df: DataFrame, metrics: list[str], by: str | tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    return df.select(*_keys(by), rows.alias("r")).select(*_keys(by), "r.*").groupBy(*_keys(by), "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def fit_model(df: DataFrame, names: list[str], kind: str = "classifier", settings: Boost = Boost(), early_stopping: bool = False, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A model of ``target`` for each symbol (or other ``by``), all grown together. With ``early_stopping`` the last fifth of a
    model's rows is held back, and its trees end where they gain no more on it."""
    if not early_stopping:
        return boost.fit(df, names, by, kind, settings)
    rows = settled(df.withColumn("_place", F.percent_rank().over(Window.partitionBy(*by).orderBy("date"))), "model-rows")
    return boost.stopped_early(boost.fit(rows.filter("_place <= 0.8"), names, by, kind, settings), rows.filter("_place > 0.8"), names, by, kind)


def out_of_fold(df: DataFrame, kind: str = "classifier", n_splits: int = 5, gap: int = 1, min_train: int = 50, settings: Boost = Boost(), pooled: bool = False, each: tuple[str, ...] = ()) -> DataFrame:
    """``symbol, date, fold, label, score`` of all test rows, each scored by the model of its symbol and fold, which is trained on
    this symbol's rows before; all models grow together. ``pooled``: a model a fold for all symbols, folds cut by date.
    ``each``: further columns that a model has its own rows of, such as a horizon. ``df`` has ``target``; symbols with too few
    rows for a fold have no test rows."""
    names = feature_names(df, ("target", *each))
    df = settled(df, "walk-rows")
    rows = in_calendar(df, calendar(df, n_splits, min_train, gap)) if pooled else in_folds(df, settled(folds(df, n_splits, min_train, gap, each=each), "folds"), each)
    rows = settled(rows, "fold-rows")
    by = (*each, "fold") if pooled else ("symbol", *each, "fold")
    models = boost.fit(rows.filter("part = 'train'"), names, by, kind, settings)
    return boost.predict(rows.filter("part = 'test'").withColumn("label", F.col("target").cast("double")), models, names, by, kind, (*KEYS, *each, "fold", "label"))


def walk_forward(df: DataFrame, kind: str = "classifier", n_splits: int = 5, gap: int = 1, min_train: int = 50, settings: Boost = Boost(), pooled: bool = False, each: tuple[str, ...] = ()) -> DataFrame:
    """Figures of each symbol and fold (``pooled``: of each fold) on its out-of-fold rows."""
    found = out_of_fold(df, kind, n_splits, gap, min_train, settings, pooled, each)
    return (classification_metrics if kind == "classifier" else regression_metrics)(found, (*each, "fold") if pooled else ("symbol", *each, "fold"))


def walk_forward_horizons(bars: DataFrame, features: DataFrame, horizons: tuple[int, ...] = (1, 5, 21), **options) -> DataFrame:
    """``walk_forward`` for the direction over several horizons, with a ``horizon`` column; models of all horizons grow together."""
    features, out = settled(features, "features"), None
    for h in horizons:
        goal = targets(bars, h, "direction", strict=True).select(*KEYS, "target").na.drop()
        part = features.join(goal, [*KEYS]).withColumn("horizon", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return walk_forward(out, each=("horizon",), **options)


def compare_models(df: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """Each symbol's fold means and deviations of several walk-forward settings (``model, symbol, metric, mean, std``)."""
    df, out = settled(df, "compared"), None
    for name, options in settings.items():
        found = walk_forward(df, **options)
        part = fold_summary(found, [c for c in found.columns if c not in ("symbol", "fold")], "symbol").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def feature_importance(df: DataFrame, kind: str = "classifier", settings: Boost = Boost(), top: int | None = None) -> DataFrame:
    """``symbol, feature, importance, importance_pct`` (gain of the splits) of each symbol's model over all its rows; ``top``: the
    symbol's largest alone."""
    names = feature_names(df)
    out = boost.importance(boost.fit(df, names, ("symbol",), kind, settings), names)
    if top is None:
        return out
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("importance"), "feature"))
    return out.withColumn("_place", place).filter(F.col("_place") <= top).drop("_place")


def trading_signals(df: DataFrame, confidence_threshold: float = 0.5, strength_threshold: float = 0.0, neutral: float = 0.05) -> DataFrame:
    """From ``probability`` and, where not null, ``expected_return``: ``confidence, strength, direction`` (-1, 0, 1)."""
    p = F.col("probability")
    sure, base = 2 * F.abs(p - 0.5), 2 * (p - 0.5)
    size = F.least(F.lit(2.0), F.abs("expected_return") / 0.02)  # least() skips nulls, so these are told apart first
    raw = base * F.when(F.col("expected_return").isNull(), F.lit(1.0)).otherwise((1 + size) / 2) * sure
    low = sure < confidence_threshold
    strength = F.when(low, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    side = F.when(F.abs(p - 0.5) < neutral, 0).when(p > 0.5, 1).otherwise(-1)
    df = df.withColumns({"confidence": sure, "strength": strength})
    return df.withColumn("direction", F.when(low | (F.abs("strength") < strength_threshold), 0).otherwise(side))


def filter_signals(df: DataFrame, min_confidence: float = 0.0, min_strength: float = 0.0, direction: int | None = None, symbol: str | None = None) -> DataFrame:
    """Signals of one symbol (in any case) or all, at least as sure and strong as asked for, of one direction or all."""
    if symbol is not None:
        df = df.filter(F.upper("symbol") == symbol.strip().upper())
    keep = (F.col("confidence") >= min_confidence) & (F.abs("strength") >= min_strength)
    return df.filter(keep if direction is None else keep & (F.col("direction") == direction))


def rank_signals(df: DataFrame, by: str = "strength", top: int | None = None, ascending: bool = False, ties: tuple[str, ...] = KEYS) -> DataFrame:
    value: Column = F.col("confidence") if by == "confidence" else F.abs(F.coalesce(F.col(by), F.lit(0.0)))
    out = df.withColumn("rank_value", value).orderBy(F.asc("rank_value") if ascending else F.desc("rank_value"), *ties)
    return out.limit(top) if top else out


def prediction_labels(df: DataFrame, up: float = 0.55, down: float = 0.45) -> DataFrame:
    """Served predictions: label, confidence, signed strength, return in percent, rounded half to even."""
    p = F.col("probability")
    side = (p > 0.5).cast("int")
    label = F.when(p > up, "bullish").when(p < down, "bearish").otherwise("neutral")
    sure = F.greatest(p, 1 - p)
    return df.withColumns({"signal": label, "confidence": F.bround(sure, 3), "strength": F.bround((2 * side - 1) * sure, 3), "expected_return_pct": F.bround(100 * F.col("expected_return"), 3)})


def ensemble(df: DataFrame) -> DataFrame:
    """``ensemble_signal`` of a direction (0 or 1), its probability and an expected return."""
    return df.withColumn("ensemble_signal", (2 * F.col("direction") - 1) * F.col("probability") * F.abs("expected_return"))


def agreement(ml: DataFrame, other: DataFrame) -> DataFrame:
    """``symbol, days, agreement``: share of common days on which two signal frames agree."""
    both = ml.select(*KEYS, F.col("signal").alias("a")).join(other.select(*KEYS, F.col("signal").alias("b")), [*KEYS])
    return both.groupBy("symbol").agg(F.count("*").alias("days"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))
