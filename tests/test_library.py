"""Sources, stores, streaming, plans and the driver contract."""

import datetime as dt
import os
import re
import subprocess
import sys

import duckdb
import pytest

from quantloom.operators import serve, text
from quantloom.plans import queries as market
from quantloom.sources import adapters, files
from quantloom.streaming.sentiment import daily_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["daily_sentiment", "signals_rank", "macd", "vol_regime", "rolling_es", "underwater_periods", "risk_report", "upsert_symbols", "purged_splits", "clf_metrics", "lexicon_sentiment", "calendar_rows"])
def test_query_equals_sql(spark, duck, name):
    df = market.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(market.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want


def test_all_plans_resolve(spark):
    for name, query in market.queries().items():
        if not re.search("walk_forward|importance|out_of_fold|predictions|compare_models|train_figures", name):  # these run jobs
            assert query(spark, SF).schema.fields, name


def test_price_features_need_one_exchange(spark):
    from quantloom.operators import price

    plan = price.volatility(price.momentum(price.returns(adapters.bars(spark, SF))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= 2


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    plan = adapters.articles(spark, SF).filter(F.col("value") > 400).select("symbol", "sentiment_score")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,400.0)" in plan
    assert re.search(r"ReadSchema: struct<event_type:string,value:double>", plan)


def test_price_files(spark, tmp_path):
    (tmp_path / "AAA_prices.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02 00:00:00-05:00,1,2,0.5,1.5,10\n2024-01-03 00:00:00-05:00,1,2,0.5,bad,10\n")
    rows = files.prices(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.symbol, r.date, r.close) for r in rows] == [("AAA", dt.date(2024, 1, 2), 1.5), ("AAA", dt.date(2024, 1, 3), None)]
    assert files.daily_sentiment(spark, str(tmp_path / "none.csv")).count() == 0
    with pytest.raises(ValueError):
        files.export(spark.range(1), str(tmp_path / "x"), "xml")


def test_features_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, x double")
    files.save_features(df, str(tmp_path / "f"))
    assert files.load_features(spark, str(tmp_path / "f"), "B").first().x == 2.0


def test_upserts(spark):
    old = spark.createDataFrame([("A", 1, "x"), ("B", 2, "y")], "k string, v int, name string")
    new = spark.createDataFrame([("B", None, "z"), ("C", 3, None)], "k string, v int, name string")
    got = {r.k: (r.v, r.name) for r in serve.upsert(old, new, ["k"]).collect()}
    assert got == {"A": (1, "x"), "B": (None, "z"), "C": (3, None)}
    kept = {r.k: (r.v, r.name) for r in serve.upsert_keeping(old, new, ["k"]).collect()}
    assert kept["B"] == (2, "z")


def test_watchlist(spark, tmp_path):
    make = lambda *s: serve.Watchlist(spark.createDataFrame([(x,) for x in s], "symbol string"))
    a, b = make(" aapl", "MSFT", "msft", ""), make("MSFT", "TSLA")
    names = lambda w: sorted(r.symbol for r in w.frame.collect())
    assert names(a) == ["AAPL", "MSFT"]
    assert (names(a.merge(b)), names(a.difference(b)), names(a.intersection(b))) == (["AAPL", "MSFT", "TSLA"], ["AAPL"], ["MSFT"])
    a.save(str(tmp_path / "w"))
    assert sorted(r.symbol for r in files.watchlist(spark, str(tmp_path / "w")).collect()) == ["AAPL", "MSFT"]
    assert a.contains("aapl") and not a.contains("x")


def test_blended_summary_keeps_confidence(spark):
    df = spark.createDataFrame([(0.2, 0.9, -1.0), (0.2, 0.9, None)], "sentiment_score double, sentiment_confidence double, summary_score double")
    a, b = text.blend_summary(df).collect()
    assert abs(a.sentiment_score + 0.16) < 1e-9 and a.sentiment_signal == "bearish" and a.sentiment_confidence == 0.9
    assert b.sentiment_score == 0.2


def test_stream_equals_batch(spark, tmp_path):
    rows = adapters.articles(spark, SF).select("symbol", "article_ts", "sentiment_score", "sentiment_confidence")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = daily_stream(stream).writeStream.outputMode("complete").format("memory").queryName("daily_rows").start()
    try:
        q.processAllAvailable()
        key = lambda r: (r.symbol, r.date)
        got = {key(r): r for r in spark.sql("SELECT * FROM daily_rows").collect()}
    finally:
        q.stop()
    want = {key(r): r for r in daily_stream(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[k].sentiment_score - want[k].sentiment_score) < 1e-9 for k in want)


def test_entry_imports_without_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("quantloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(root, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quantloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'signals_zscore' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
