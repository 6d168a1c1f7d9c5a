"""Running ranks by blocks against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import ranks


@pytest.mark.parametrize("block", [4, 256])
def test_running_ranks(spark, block):
    r = np.random.default_rng(5)
    rows = [(s, i, None if r.random() < 0.1 else float(r.integers(0, top))) for s, n, top in (("a", 150, 12), ("b", 40, 1000), ("c", 1, 5)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("d", 0, None)], "symbol string, date int, x double").repartition(3)
    got = ranks.running_smaller(df, "x", "less", block)
    got = ranks.above_running_quantile(got, {"high": ("x", 0.5), "top": ("x", 0.9)}, block)
    got = {(x.symbol, x.date): x for x in ranks.running_share(got, "x", "share", 5, block).collect()}
    assert len(got) == len(rows) + 1 and got["d", 0].less is None and got["d", 0].high == 0
    for s in "abc":
        seen = []
        for i, x in [(i, x) for k, i, x in rows if k == s]:
            seen += [] if x is None else [x]
            g = got[s, i]
            assert g.less == (None if x is None else sum(v < x for v in seen))
            assert g.high == int(x is not None and x > np.percentile(seen, 50)) and g.top == int(x is not None and x > np.percentile(seen, 90))
            assert g.share == (sum(v < x for v in seen) / (i + 1) if x is not None and len(seen) >= 5 else None)


def test_no_unbounded_lists_or_python(spark):
    from quantloom.operators import risk, sentiment
    from quantloom.plans import queries
    from quantloom.sources.adapters import bars

    sf = "/root/testdata/sf0.001"
    for df in (risk.vol_regime(risk.daily(bars(spark, sf))), sentiment.disagreement(queries.daily(spark, sf)), sentiment.confidence(queries.daily(spark, sf))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "FlatMapGroups" not in plan


def test_work_grows_less_than_the_square(spark):
    """Rows looked at for a row of a long history are bounded by its blocks."""
    df = spark.range(3000).select(F.lit("a").alias("symbol"), F.col("id").alias("date"), F.pmod(F.col("id") * 7919, F.lit(3001)).cast("double").alias("x"))
    got = ranks.running_smaller(df, "x", "less", 64).orderBy("date").collect()
    seen = np.sort(np.array([r.x for r in got]))
    assert got[-1].less == int(np.searchsorted(seen, got[-1].x))
