"""Exact nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut into four 16-bit segments, each an index of its own. In round r every query looks into all buckets
whose segment differs in exactly r bits. A code at distance d has a segment that differs in at most d // 4 bits, so
after round r all codes up to distance 4r + 3 have been met and verified; a query is done when its kth distance is not
above that, and round 16 has met every code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SEGMENTS, WIDTH = 4, 16
BITS = SEGMENTS * WIDTH


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, code``: bit i is set where element i of the vector is above 0. Null ids and vectors have no code; null and NaN
    elements set no bit, and shorter vectors leave the rest unset. Vectors of more than 64 elements stop the job with an error:
    their code would say nothing about the elements after the 64th."""
    own = F.col(embedding)
    whole = F.when(F.size(own) > BITS, F.raise_error(F.lit(f"vectors of more than {BITS} elements have no code"))).otherwise(own)
    bits = F.transform(whole, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return vectors.filter(F.col(vec_id).isNotNull() & own.isNotNull()).select(F.col(vec_id).cast("long").alias("id"), code.alias("code"))


def _segments(df: DataFrame, code: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned(code, WIDTH * s).bitwiseAND((1 << WIDTH) - 1).cast("int").alias("val")) for s in range(SEGMENTS)])
    return df.withColumn("part", F.explode(parts)).select("*", "part.*").drop("part")


def nearest(codes: DataFrame, queries: DataFrame, k: int = 10, scope: str = "query") -> DataFrame:
    """``query_id, rank, id, distance``: the ``k`` codes nearest to each query, without the query's own id, by distance,
    then id. Both frames are ``id, code``; repeated rows count once; fewer than k codes give as many rows.

    Equal codes are searched for once and share an index entry, which keeps their k + 1 smallest ids: no later one can
    be among the k nearest. Frequent buckets are joined by a join that Spark may split.
    """
    first = Window.partitionBy("code").orderBy("id")
    pairs = codes.select("id", "code").distinct()
    kept = pairs.withColumn("n", F.row_number().over(first)).filter(f"n <= {k + 1}").groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index = staged(_segments(kept, "code"), "index", scope)
    open_ = staged(queries.select(F.col("code").alias("q")).distinct(), "open", scope)
    spark, best, done = codes.sparkSession, None, []
    # At most 12,870 masks of 16 bits have r bits set, whatever the input.
    masks = spark.range(1 << WIDTH).groupBy(F.bit_count("id").alias("r")).agg(F.collect_list(F.col("id").cast("int")).alias("masks"))
    ranked = Window.partitionBy("q").orderBy("distance", "id")
    for r in range(WIDTH + 1):
        probes = _segments(open_, "q").withColumn("r", F.lit(r)).join(F.broadcast(masks), "r").select("q", "seg", "val", F.explode("masks").alias("mask"))
        probes = probes.select("q", "seg", F.col("val").bitwiseXOR(F.col("mask")).alias("val"))
        met = probes.join(index, ["seg", "val"]).select("q", "code", "ids").groupBy("q", "code").agg(F.first("ids").alias("ids"))
        new = met.select("q", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int").alias("distance"), F.explode("ids").alias("id"))
        if best is not None:
            new = new.unionByName(best).distinct()
        best = staged(new.withColumn("n", F.row_number().over(ranked)).filter(f"n <= {k + 1}").drop("n"), "best", scope)
        state = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        ready = state.filter(f"n > {k} and far <= {SEGMENTS * r + SEGMENTS - 1}").select("q") if r < WIDTH else state.select("q")
        ready = staged(ready, "ready", scope)
        done.append(best.join(ready, "q", "left_semi"))
        if r == WIDTH:
            break
        best = best.join(ready, "q", "left_anti")
        open_ = staged(open_.join(ready, "q", "left_anti"), "open", scope)
        if open_.isEmpty():
            break
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    own = Window.partitionBy("query_id").orderBy("distance", "id")
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct()
    out = asked.join(found, "q").filter("id <> query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return out.withColumn("rank", F.row_number().over(own)).filter(f"rank <= {k}").select("query_id", "rank", "id", "distance")
