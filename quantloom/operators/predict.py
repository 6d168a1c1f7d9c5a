"""Training entry point, saved models, predictions and scaling, as frames over all symbols at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.staging import settled
from . import boost, ml, serve
from . import sentiment as sentiments
from .boost import Boost

KEYS = ml.KEYS


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations of columns; a column without spread is only centred."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, names: list[str]) -> Scaler:
        """One aggregation; columns without values get mean 0 and deviation 1."""
        row = df.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return cls(tuple(names), tuple(float(row[f"m{i}"] or 0.0) for i in range(len(names))), tuple(float(row[f"s{i}"] or 1.0) for i in range(len(names))))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: (F.col(n) - m) / s for n, m, s in zip(self.names, self.mean, self.std, strict=True)})


def return_confidence(df: DataFrame, prediction: str = "expected_return", by: str = "symbol") -> DataFrame:
    """Add ``return_confidence``: 1 / (1 + |z|) of a prediction among those of its symbol, one half where all are equal.
    Null predictions have none."""
    x = F.col(prediction)
    figures = df.groupBy(F.col(by).alias("_by")).agg(F.avg(x).alias("_mean"), F.when(F.max(x) > F.min(x), F.stddev_pop(x)).alias("_std"))
    # A row a symbol: rows of one symbol stay where they are, in as many tasks as there were.
    rows = df.join(F.broadcast(figures), F.col(by).eqNullSafe(F.col("_by")), "left")
    z = (x - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
    return rows.withColumn("return_confidence", F.when(x.isNotNull(), F.coalesce(1 / (1 + F.abs(z)), F.lit(0.5)))).drop("_by", "_mean", "_std")


PRICES = ("open", "high", "low", "close", "volume")


def features_or_fewer(bars: DataFrame, daily: DataFrame | None, min_rows: int = 100) -> DataFrame:
    """Complete feature rows of all symbols, with ``with_sentiment``. A symbol that has ``min_rows`` rows complete with its sentiment
    features keeps these rows; any other keeps its rows complete in price and risk, and its sentiment columns are null."""
    base = ml.build_features(bars)
    own = [c for c in ml.feature_names(base) if c not in PRICES]
    if daily is None:
        return base.na.drop("any").withColumn("with_sentiment", F.lit(False))
    moods = sentiments.build_all(daily)
    added = [c for c in ml.feature_names(moods) if c not in base.columns]
    rows = base.na.drop("any", subset=own).join(moods.select(*KEYS, *added), [*KEYS], "left")
    whole = F.lit(True)
    for c in added:
        whole = whole & F.col(c).isNotNull()
    rows = rows.withColumn("_whole", whole)
    enough = F.sum(F.col("_whole").cast("int")).over(Window.partitionBy("symbol")) >= min_rows
    rows = rows.withColumn("with_sentiment", enough).filter(~F.col("with_sentiment") | F.col("_whole"))
    return rows.withColumns({c: F.when(F.col("with_sentiment"), F.col(c)) for c in added}).drop("_whole")


@dataclass
class Models:
    """Direction classifiers and return regressors over the same features, a row a symbol each; either may be missing."""

    names: list[str]
    classifier: DataFrame | None = None
    regressor: DataFrame | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        for kind in ("classifier", "regressor"):
            if (models := getattr(self, kind)) is not None:
                models.write.mode("overwrite").parquet(f"{path}/{kind}")
        kinds = [k for k in ("classifier", "regressor") if getattr(self, k) is not None]
        spark.createDataFrame([(self.names, kinds)], "names array<string>, kinds array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Models:
        about = spark.read.schema("names array<string>, kinds array<string>").json(f"{path}/about").first()
        return cls(list(about.names), **{k: spark.read.parquet(f"{path}/{k}") for k in about.kinds})

    def predict(self, features: DataFrame) -> DataFrame:
        """``symbol, date, probability, expected_return`` and the trading signal of each feature row, by its symbol's models.
        Features may be null. Without a classifier the probability is one half, so that every signal is neutral; without a
        regressor returns are null; symbols that neither knows are left out."""
        rows = settled(features.select(*KEYS, *self.names), "to-predict")
        parts = [
            boost.predict(rows, m, self.names, kind=k).withColumnRenamed("score", c)
            for k, c, m in (("classifier", "probability", self.classifier), ("regressor", "expected_return", self.regressor)) if m is not None
        ]
        out = parts[0] if len(parts) == 1 else parts[0].join(parts[1], [*KEYS], "full")
        missing = {c: F.lit(None).cast("double") for c in ("probability", "expected_return") if c not in out.columns}
        out = out.withColumns(missing).withColumn("probability", F.coalesce("probability", F.lit(0.5)))
        return return_confidence(ml.trading_signals(out.select(*KEYS, "probability", "expected_return")))

    def predict_latest(self, features: DataFrame) -> DataFrame:
        """The newest prediction of each symbol. Confidence is among all rows of the symbol."""
        return serve.latest(self.predict(features))


def train(bars: DataFrame, daily: DataFrame | None = None, horizon: int = 1, min_rows: int = 100, settings: Boost = Boost(), n_splits: int = 5, gap: int = 1, early_stopping: bool = False) -> tuple[Models, DataFrame, DataFrame]:
    """Both models of every symbol that has ``min_rows`` complete rows, walk-forward figures (``symbol, kind, metric, mean, std``) and
    what each was trained on (``symbol, samples, features, with_sentiment, first_date, last_date``)."""
    found = features_or_fewer(bars, daily, min_rows).drop(*PRICES)
    names = ml.feature_names(found)
    goals = ml.targets(bars, horizon, "direction", strict=True).select(*KEYS, F.col("target").alias("direction"), F.lead("close", horizon).over(Window.partitionBy("symbol").orderBy("date")).alias("_ahead"), "close")
    goals = goals.select(*KEYS, "direction", (F.try_divide("_ahead", F.col("close")) - 1).alias("return")).na.drop("any")
    rows = found.select(*KEYS, "with_sentiment", *names).join(goals, [*KEYS])
    rows = settled(rows.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).filter(F.col("_n") >= min_rows).drop("_n"), "training")
    given = F.aggregate(F.array(*[F.max(F.col(c).isNotNull().cast("int")) for c in names]), F.lit(0), lambda a, x: a + x)
    about = rows.groupBy("symbol").agg(F.count("*").alias("samples"), given.alias("features"), F.first("with_sentiment").alias("with_sentiment"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    fitted, figures = {}, None
    for kind, target in (("classifier", "direction"), ("regressor", "return")):
        own = rows.select(*KEYS, *names, F.col(target).alias("target"))
        tested = ml.walk_forward(own, kind, n_splits, gap, settings=settings)
        part = ml.fold_summary(tested, [c for c in tested.columns if c not in ("symbol", "fold")], "symbol").withColumn("kind", F.lit(kind))
        figures = part if figures is None else figures.unionByName(part)
        fitted[kind] = ml.fit_model(own, names, kind, settings, early_stopping)
    return Models(names, **fitted), figures, about
