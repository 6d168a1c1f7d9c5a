"""Training entry point, saved models, predictions, signals at rest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import ml, predict, serve
from quantloom.operators.boost import Boost
from quantloom.plans import queries
from quantloom.sources import files
from quantloom.sources.adapters import bars

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return queries._small(spark, "/root/testdata/sf0.01").cache()


FEW = Boost(trees=4, depth=2)


def test_models_survive_saving_and_predict_alike(spark, small, tmp_path):
    names = ml.feature_names(small)
    models = predict.Models(names, ml.fit_model(small, names, settings=FEW, early_stopping=True))
    models.save(spark, str(tmp_path / "m"))
    again = predict.Models.load(spark, str(tmp_path / "m"))
    key = lambda m: sorted((r.symbol, r.date, r.probability, r.direction) for r in m.predict(small).collect())
    assert again.names == names and again.regressor is None and key(models) == key(again)
    latest = again.predict_latest(small).collect()
    assert {(r.symbol, r.date) for r in latest} == {(r.symbol, r.date) for r in small.groupBy("symbol").agg(F.max("date").alias("date")).collect()}
    assert all(r.expected_return is None and r.return_confidence is None for r in latest)


def test_without_classifier_signals_are_neutral(small):
    names = ml.feature_names(small)
    rows = small.withColumn("target", F.col("return_1d"))
    got = predict.Models(names, regressor=ml.fit_model(rows, names, "regressor", FEW)).predict(small).agg(F.max(F.abs("direction")).alias("d"), F.min("probability").alias("p"), F.max("return_confidence").alias("c")).first()
    assert (got.d, got.p) == (0, 0.5) and 0 < got.c <= 1


def test_out_of_fold_rows_are_the_test_rows(small):
    found = ml.out_of_fold(small, n_splits=2, settings=FEW)
    plan = {(r.symbol, r.fold): r.test_end - r.test_start for r in ml.folds(small, 2).collect()}
    assert {(r.symbol, r.fold): r["count"] for r in found.groupBy("symbol", "fold").count().collect()} == plan


def test_no_fold_trains_on_the_days_of_its_test_or_later(spark):
    """One symbol begins late, one ends early: by date, neither lets another see the future."""
    day = dt.date(2020, 1, 1)
    rows = [(s, day + dt.timedelta(days=i)) for s, (a, z) in {"old": (0, 120), "new": (200, 400), "all": (0, 400)}.items() for i in range(a, z) if i % 7 < 5]
    df = spark.createDataFrame(rows, "symbol string, date date")
    got = ml.in_calendar(df, ml.calendar(df, n_splits=4, min_train=30, gap=2, purge=3, embargo=4)).collect()
    days = sorted({d for _, d in rows})
    size = (len(days) - 32) // 4
    assert {r.fold for r in got} == {0, 1, 2}  # the oldest would train on 29 days
    for fold in range(3):
        tests = sorted({r.date for r in got if r.fold == fold and r.part == "test"})
        trained = {r.date for r in got if r.fold == fold and r.part == "train"}
        at = len(days) - (fold + 1) * size
        assert tests == days[at : at + size]
        held = {d for older in range(fold + 1, 4) for d in days[len(days) - older * size :][:4]}
        assert trained == set(days[: at - 5]) - held and max(trained) < min(tests)
    assert {r.symbol for r in got if r.fold == 0 and r.part == "test"} == {"new", "all"}


def test_pooled_models_and_horizons(small):
    found = ml.walk_forward(small, n_splits=2, settings=FEW, pooled=True).collect()
    assert sorted(r.fold for r in found) == [0, 1] and all(0 <= r.auc <= 1 for r in found)
    features = small.drop("target")
    b = bars(small.sparkSession, "/root/testdata/sf0.01")
    got = ml.walk_forward_horizons(b, features, (1, 5), n_splits=2, settings=FEW).collect()
    symbols = small.select("symbol").distinct().count()
    assert len(got) == symbols * 2 * 2 and {r.horizon for r in got} == {1, 5}


def test_sentiment_fallback_a_symbol(spark):
    b = bars(spark, "/root/testdata/sf0.01")
    got = {(r.symbol, r.with_sentiment): r for r in predict.features_or_fewer(b, queries._some_sentiment(spark, "/root/testdata/sf0.01")).groupBy("symbol", "with_sentiment").agg(F.count("*").alias("n"), F.count("sentiment_score").alias("scores"), F.count("volatility_21").alias("v")).collect()}
    assert {s for s, own in got if own} == {"1-URGENT"} and len(got) == b.select("symbol").distinct().count()
    assert all(r.scores == (r.n if own else 0) and r.v == r.n > 0 for (_, own), r in got.items())
    none = queries.daily(spark, SF)  # other symbols: nothing joins
    assert predict.features_or_fewer(b, none).select("symbol").distinct().count() == len(got)


def test_training_keeps_every_symbol_with_enough_rows(spark):
    b = bars(spark, "/root/testdata/sf0.01").filter("symbol <> '3-MEDIUM' or date < '1995-08-01'")
    models, figures, about = predict.train(b, queries._some_sentiment(spark, "/root/testdata/sf0.01"), settings=FEW, n_splits=2)
    known = {r.symbol: r for r in about.collect()}
    assert "3-MEDIUM" not in known and len(known) == 4 and known["1-URGENT"].with_sentiment and not known["2-HIGH"].with_sentiment
    assert known["1-URGENT"].features > known["2-HIGH"].features == known["4-NOT SPECIFIED"].features
    assert {(r.symbol, r.kind) for r in figures.collect()} == {(s, k) for s in known for k in ("classifier", "regressor")}
    assert {r.symbol for r in models.classifier.collect()} == {r.symbol for r in models.regressor.collect()} == set(known)


def test_signals_are_appended_and_read(spark, tmp_path):
    path = str(tmp_path / "signals")
    assert files.sentiment_signals(spark, path).count() == 0
    row = lambda s: spark.createDataFrame([(s, None, "bullish", 0.5, None)], files.SIGNALS)
    files.append_signals(row("AB"), path)
    files.append_signals(row("CD"), path)
    assert files.sentiment_signals(spark, path).count() == 2 and files.sentiment_signals(spark, path, "ab").count() == 1


def test_tables_by_format(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "symbol string, n long")
    for kind in ("csv", "json", "parquet"):
        df.write.format(kind).option("header", True).save(str(tmp_path / f"t.{kind}"))
        assert [tuple(map(str, r)) for r in files.table(spark, str(tmp_path / f"t.{kind}"), schema="symbol string, n long").collect()] == [("a", "1")]
    with pytest.raises(ValueError):
        files.table(spark, "x.xlsx")


def test_scaler_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    assert [tuple(r) for r in predict.Scaler.fit(df, ["a", "b", "c"]).transform(df).collect()] == [(-1.0, 0.0, None), (1.0, 0.0, None)]
    assert serve.Watchlist(spark.createDataFrame([("a",)], "symbol string")).clear().frame.count() == 0


def test_exponential_means_of_span_one_and_with_gaps(spark):
    from quantloom.functions.windows import ewm_mean

    values = [1.0, 2.0, None, None, 5.0, 6.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(values)], "symbol string, date int, x double")
    got = ewm_mean(df, {"one": ("x", 1), "three": ("x", 3)}).orderBy("date").collect()
    assert [r.one for r in got] == values and [r.three for r in got] == [1.0, 1.5, None, None, 3.25, 4.625]
    with pytest.raises(ValueError):
        ewm_mean(df, {"none": ("x", 0)})


def test_return_confidence_keeps_rows_of_a_symbol_in_their_tasks(spark):
    some = [("a", float(i % 7)) for i in range(60)] + [(None, float(i)) for i in range(5)] + [("one", 0.1)] * 9 + [("gap", None), ("gap", 2.0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(some)], "id int, symbol string, expected_return double").repartition(4)
    got = predict.return_confidence(df)
    assert got.columns == [*df.columns, "return_confidence"]
    assert got.filter("symbol = 'a'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    found = {r.id: r.return_confidence for r in got.collect()}
    assert len(found) == len(some)
    for i, (symbol, x) in enumerate(some):
        own = [v for s, v in some if s == symbol and v is not None]
        mean = sum(own) / len(own)
        std = (sum((v - mean) ** 2 for v in own) / len(own)) ** 0.5
        want = None if x is None else 0.5 if min(own) == max(own) else 1 / (1 + abs(x - mean) / std)
        assert found[i] == (want if want is None else pytest.approx(want))
