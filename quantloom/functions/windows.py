"""Window kit: rolling frames with full-window guards, exponential means, ranks, runs.

All per-symbol windows share one partitioning and order, so that Spark plans one exchange and one sort for them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "symbol", "date"
#: Rows of a block of an exponential mean; 2/3 to the power of -512 is far from overflow.
EWM_BLOCK = 512
#: Added to deviations in rolling z-scores.
EPS_Z = 1e-6


def over_key() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def running() -> WindowSpec:
    return over_key().rowsBetween(Window.unboundedPreceding, 0)


def frame(n: int) -> WindowSpec:
    return over_key().rowsBetween(-(n - 1), 0)


def full(value: Column, counted: Column, n: int) -> Column:
    """A rolling value, only where the frame holds n values."""
    return F.when(F.count(counted).over(frame(n)) == n, value)


def rolling(how, x: Column, n: int) -> Column:
    return full(how(x).over(frame(n)), x, n)


def lag(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(over_key())


def flag(condition: Column) -> Column:
    """1 or 0; comparisons with null are 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def ewm_mean(df: DataFrame, means: dict[str, tuple[str, int]]) -> DataFrame:
    """Add exponential means ``out: (column, span)`` with y0 = x0 and y = (1 - a) y' + a x, a = 2 / (span + 1).

    Within a block of EWM_BLOCK values y is a running sum of x scaled by the powers of 1 / q; what earlier blocks hold
    reaches a row as the last values at their ends, each a factor q ** EWM_BLOCK smaller than the one after it. Nulls are
    skipped: one has a null mean and no weight, so that the values beside it are neighbours. A span of 1 is the column
    itself.
    """
    if min(span for _, span in means.values()) < 1:
        raise ValueError("a span is 1 at least")
    df = df.withColumns({name: F.col(c) for name, (c, span) in means.items() if span == 1})
    if not (means := {name: m for name, m in means.items() if m[1] > 1}):
        return df
    names = sorted({c for c, _ in means.values()})
    out = df.withColumns({f"_i_{c}": F.when(F.col(c).isNotNull(), F.count(c).over(running()) - 1) for c in names})
    ends: dict[str, Column] = {}
    for name, (c, span) in means.items():
        q, i = 1 - 2 / (span + 1), F.col(f"_i_{c}")
        k = i % EWM_BLOCK
        block = Window.partitionBy(KEY, F.floor(i / EWM_BLOCK)).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
        share = F.when(i == 0, F.lit(1.0)).otherwise(F.lit(1 - q))
        ends[f"_z_{name}"] = F.pow(F.lit(q), k) * F.sum(share * F.col(c) * F.pow(F.lit(q), -k)).over(block)
    out = out.withColumns(ends)
    before = over_key().rowsBetween(Window.unboundedPreceding, -1)
    steps = {n: max(1, math.ceil(-18 / (EWM_BLOCK * math.log10(1 - 2 / (s + 1))))) for n, (_, s) in means.items()}
    for step in range(max(steps.values())):
        more = {}
        for name, (c, span) in means.items():
            if step < steps[name]:
                held = F.when(F.col(f"_i_{c}") % EWM_BLOCK == EWM_BLOCK - 1, F.col(f"_z_{name}") + (F.coalesce(F.col(f"_c_{name}"), F.lit(0.0)) * (1 - 2 / (span + 1)) ** EWM_BLOCK if step else F.lit(0.0)))
                more[f"_c_{name}"] = F.last(held, ignorenulls=True).over(before)
        out = out.withColumns(more)
    final = {}
    for name, (c, span) in means.items():
        q = 1 - 2 / (span + 1)
        final[name] = F.col(f"_z_{name}") + F.pow(F.lit(q), F.col(f"_i_{c}") % EWM_BLOCK + 1) * F.coalesce(f"_c_{name}", F.lit(0.0))
        final[name] = F.when(F.col(c).isNotNull(), final[name])
    return out.withColumns(final).drop(*[f"_{p}_{n}" for n in means for p in "zc"], *[f"_i_{c}" for c in names])


def ewm_variance(df: DataFrame, out: str, column: str, span: int) -> DataFrame:
    """Add the unbiased variance that belongs to ``ewm_mean``; null at the first value."""
    q = 1 - 2 / (span + 1)
    a = 1 - q
    df = df.withColumn("_sq", F.col(column) * F.col(column))
    df = ewm_mean(df, {"_m1": (column, span), "_m2": ("_sq", span)})
    t = F.count(column).over(running()) - 1
    weights = F.pow(F.lit(q), 2 * t) + a * a * (1 - F.pow(F.lit(q), 2 * t)) / (1 - q * q)
    return df.withColumn(out, F.when(t > 0, F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)) / (1 - weights))).drop("_sq", "_m1", "_m2")


def average_rank(partition: str, x: str) -> Column:
    """Rank with ties averaged, as a share of the partition's rows."""
    w, ties = Window.partitionBy(partition), Window.partitionBy(partition, x)
    return (F.rank().over(w.orderBy(x)) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(w)


def run_id(changed: Column) -> Column:
    """Number of changes so far: equal within a run."""
    return F.sum(changed.cast("int")).over(running())
