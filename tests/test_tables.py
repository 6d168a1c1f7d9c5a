"""Incremental upserts of partitioned tables, markers as of a day, reproducible draws."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quantloom.operators import risk, serve
from quantloom.sources import files


def test_upsert_rewrites_touched_partitions_alone(spark, tmp_path):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    schema = "symbol string, date date, close double, note string"
    path = str(tmp_path / "bars")
    files.upsert_table(spark.createDataFrame([(s, day(i), float(i), "old") for s in "ab" for i in range(100)], schema), path)
    times = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = times()
    new = spark.createDataFrame([("a", day(40), -1.0, None), ("a", day(200), 9.0, "new")], schema)
    got = {(r.symbol, r.date): (r.close, r.note) for r in files.upsert_table(new, path, keeping=True).collect()}
    after = times()
    assert len(got) == 201 and got["a", day(40)] == (-1.0, "old") and got["a", day(200)] == (9.0, "new") and got["b", day(40)] == (40.0, "old")
    assert {f for f in before if f not in after} == {f for f in before if "symbol=a/period=2024-02" in f}
    assert all(after[f] == t for f, t in before.items() if f in after) and sum("period=2024-07" in f for f in after) == 1
    got = {(r.symbol, r.date): r.note for r in files.upsert_table(new.limit(1), path).collect()}
    assert len(got) == 201 and got["a", day(40)] is None


@pytest.mark.parametrize("days", [None, 2])
def test_markers_take_the_last_close(spark, days):
    d = lambda i: dt.date(2024, 3, i)
    bars = spark.createDataFrame([("a", d(4), 1.0), ("a", d(8), 5.0), ("a", d(9), None), ("b", d(6), 7.0)], "symbol string, date date, close double")
    signals = spark.createDataFrame([("a", d(3), "bullish"), ("a", d(4), "1"), ("a", d(7), "bearish"), ("a", d(10), "bullish"), ("a", d(10), "-1"), ("a", d(10), "neutral"), ("c", d(5), "bullish")], "symbol string, date date, signal string")
    got = sorted((r.symbol, r.date.day, r.signal, r.price) for r in serve.signal_markers_asof(signals, bars, days).collect())
    old = None if days else 1.0
    assert got == sorted([("a", 3, "bullish", None), ("a", 4, "bullish", 1.0), ("a", 7, "bearish", old), ("a", 10, "bullish", 5.0), ("a", 10, "bearish", 5.0), ("c", 5, "bullish", None)], key=lambda r: r[:3])


def test_draws_are_normal_and_the_same_for_any_split(spark):
    z = spark.range(20000).select(risk.standard_normal(F.lit(1), F.lit("a"), F.col("id")).alias("z"))
    r = z.agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"), F.skewness("z").alias("k"), F.percentile("z", 0.05).alias("q")).first()
    assert abs(r.m) < 0.03 and abs(r.s - 1) < 0.02 and abs(r.k) < 0.06 and abs(r.q + 1.645) < 0.05
    df = spark.createDataFrame([("a", i, 100.0 + (i * 37) % 11) for i in range(50)], "symbol string, date int, close double")
    assert risk.monte_carlo_var(df.repartition(1), simulations=500).first() == risk.monte_carlo_var(df.repartition(7), simulations=500).first()


def test_garch_of_many_symbols_equals_each_alone(spark):
    import numpy as np

    r = np.random.default_rng(4)
    series = [r.normal(0, 0.01 + 0.01 * (np.arange(n) // 60 % 2)) for n in (30, 150, 400)] + [np.zeros(40)]
    together = risk._fit_garch(series)
    for own, got in zip(series, together, strict=True):
        alone = risk._fit_garch([own])[0]
        assert got[:4] == pytest.approx(alone[:4], rel=1e-9) and np.allclose(got[4], alone[4], rtol=1e-9)
        omega, a, b, settled, v = got
        assert 0 < a + b < 1 and len(v) == len(own)
        if settled:
            x = 100 * (own - own.mean())
            loss = lambda o, p, q: sum(np.log(v := risk._variances(x, x.var(), o, p, q)) + x * x / v)
            assert loss(omega, a, b) <= min(loss(omega * 1.05, a, b), loss(omega, a * 1.05, b), loss(omega, a, b * 0.99)) + 1e-3
    rows = [(f"s{i}", d, 100.0 + (d * 37 * (i + 1)) % 11) for i in range(3) for d in range(15 if i == 2 else 60)]
    got = {x.symbol: x for x in risk.garch(spark.createDataFrame(rows, "symbol string, date int, close double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("date")))).collect()}
    assert got["s2"].omega is None and 0 < got["s0"].persistence < 1 and len(got["s1"].forecast) == 5
