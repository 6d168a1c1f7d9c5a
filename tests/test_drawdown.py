"""The mergeable drawdown state: equal to the figures by episodes, one reading of the bars, guards."""

import datetime as dt

import numpy as np
import pytest

from quantloom.operators import drawdown, report
from quantloom.sources.adapters import bars


@pytest.fixture(scope="module")
def closes(spark):
    r = np.random.default_rng(2)
    rows = []
    for s, n in (("a", 1500), ("b", 30), ("c", 700)):
        x = 100.0
        for i in range(n):
            x *= 1 + r.normal(0.0003 if s != "c" else -0.001, 0.02)
            rows.append((s, dt.date(2019, 11, 20) + dt.timedelta(days=i), x))
    rows += [("up", dt.date(2020, 12, 20) + dt.timedelta(days=i), 100.0 + i) for i in range(40)]
    rows += [("one", dt.date(2020, 1, 1), 5.0), ("bad", dt.date(2020, 1, 1), 5.0), ("bad", dt.date(2020, 1, 2), 0.0), ("bad", dt.date(2020, 1, 3), 2.0)]
    return spark.createDataFrame(rows, "symbol string, date date, close double").repartition(5).cache()


def test_state_merged_over_years_equals_the_episodes(closes):
    got = {r.symbol: r for r in drawdown.summary(closes).collect()}
    assert set(got) == {"a", "b", "c", "up", "one", "bad"}
    parts = [{r.symbol: r for r in f(closes).collect()} for f in (drawdown.totals, drawdown.durations, drawdown.recovery)]
    count = {r.symbol: r["count"] for r in drawdown.episodes(closes).groupBy("symbol").count().collect()}
    for s in ("a", "b", "c", "up"):
        for p in parts:
            for c, v in p[s].asDict().items():
                assert got[s][c] == (pytest.approx(v, rel=1e-12) if isinstance(v, float) else v), (s, c)
        assert got[s].num_drawdowns == count.get(s, 0)


def test_too_few_or_bad_closes_give_nulls(closes):
    got = {r.symbol: r for r in drawdown.summary(closes).collect()}
    assert all(v is None for s in ("one", "bad") for c, v in got[s].asDict().items() if c != "symbol")
    full = {r.symbol: r for r in report.metrics(closes.filter("symbol <> 'one'").withColumn("volume", closes["close"])).collect()}
    assert full["bad"].var_95 is None and full["bad"].risk_score is None and full["a"].risk_score > 0 and full["a"].vol_regime in ("low", "medium", "high")


def test_summary_reads_the_bars_once(spark):
    df = drawdown.summary(bars(spark, "/root/testdata/sf0.001"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan parquet") == 1 or plan.count("FileScan") == 1, plan
