"""Ranks among all rows so far, without a sort or a list of all of them at every row.

Rows of a symbol get their place in time and their place in value. Both orders are cut into blocks. What is earlier and smaller than a
row lies either in its own block of one order, where at most a block's rows are looked at, or in earlier blocks of both orders; those
are counted by blocks, in a grid that is small beside the rows, with running sums along both sides. So the work grows with
n * block + (n / block)^2 and not with the square of a history's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import KEY, TIME, over_key, running

BLOCK = 256


def running_smaller(df: DataFrame, column: str, out: str, block: int = BLOCK) -> DataFrame:
    """Add ``out``: how many rows of the symbol up to this one have a smaller value of ``column``; null where it is null.
    ``symbol, date`` is a key."""
    known = F.col(column).isNotNull()
    each = Window.partitionBy(KEY, known)
    rows = df.withColumns({"_t": F.when(known, F.row_number().over(each.orderBy(TIME)) - 1), "_r": F.when(known, F.row_number().over(each.orderBy(column, TIME)) - 1)})
    rows = rows.withColumns({"_tb": F.floor(F.col("_t") / block), "_vb": F.floor(F.col("_r") / block), "_same": F.row_number().over(Window.partitionBy(KEY, column).orderBy(TIME)) - 1})
    before = lambda w: w.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    in_time = F.collect_list("_r").over(before(Window.partitionBy(KEY, "_tb")))  # a block's rows at most
    in_value = F.collect_list("_r").over(before(Window.partitionBy(KEY, "_vb")))
    count = lambda rows, below: F.aggregate(rows, F.lit(0), lambda n, r: n + (r < below).cast("int"))
    rows = rows.withColumn("_near", F.when(known, count(in_time, F.col("_vb") * block) + count(in_value, F.col("_r"))))

    cells = rows.filter(known).groupBy(KEY, "_tb", "_vb").agg(F.count("*").alias("_c"))
    sizes = cells.groupBy(KEY).agg(F.max("_tb").alias("_ts"), F.max("_vb").alias("_vs"))
    grid = sizes.select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), "_ts")).alias("_tb"), "_vs").select(KEY, "_tb", F.explode(F.sequence(F.lit(0).cast("long"), "_vs")).alias("_vb"))
    grid = grid.join(cells, [KEY, "_tb", "_vb"], "left")
    below = F.coalesce(F.sum("_c").over(Window.partitionBy(KEY, "_tb").orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = F.coalesce(F.sum("_below").over(Window.partitionBy(KEY, "_vb").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("_below", below).select(KEY, "_tb", "_vb", far.alias("_far"))
    rows = rows.join(grid, [KEY, "_tb", "_vb"], "left")
    # rows of equal value and earlier date are before this one in both orders
    return rows.withColumn(out, F.when(known, F.col("_near") + F.col("_far") - F.col("_same"))).drop("_t", "_r", "_tb", "_vb", "_same", "_near", "_far")


def above_running_quantile(df: DataFrame, tests: dict[str, tuple[str, float]], block: int = BLOCK) -> DataFrame:
    """Add ``out: (column, q)``: 1 where the value is greater than the q-quantile (interpolated) of all values up to it, else 0.

    That is the case just where more values than floor((m - 1) * q) of the m so far are smaller, so no quantile is taken."""
    for c in dict.fromkeys(c for c, _ in tests.values()):
        df = running_smaller(df, c, f"_less_{c}", block)
    m = lambda c: F.count(c).over(running())
    return df.withColumns({out: F.coalesce((F.col(f"_less_{c}") > F.floor((m(c) - 1) * q)).cast("int"), F.lit(0)) for out, (c, q) in tests.items()}).drop(*[f"_less_{c}" for c, _ in tests.values()])


def running_share(df: DataFrame, column: str, out: str, least: int, block: int = BLOCK) -> DataFrame:
    """Add ``out``: the share of the rows up to this one (nulls count as rows) that have a smaller value, once ``least`` have values."""
    df = running_smaller(df, column, "_less", block)
    share: Column = F.col("_less") / F.row_number().over(over_key())
    return df.withColumn(out, F.when(F.col(column).isNotNull() & (F.count(column).over(running()) >= least), share)).drop("_less")
