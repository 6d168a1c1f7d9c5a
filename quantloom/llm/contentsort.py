"""Exact duplicates by a content sort, in DataFrame operations alone.

Sampled splitters range-partition the normalised texts, Spark's external sort puts equal texts side by side, and a window
over the whole text compares neighbours in full: rows of a run of equal texts get the run's best row. Splitters are samples of
(first characters, hash, share), so that neither long texts nor passages that many texts begin with burden them; the
hash decides nothing but the place in the order.

A text that more than a part of one task's rows have is dealt over several shares, each a run of its own. One row of each such
run then meets the others of its text in a second, small sort. Which texts these are is counted first, by hash; there
can be no more of them than ``4 * partitions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

HEAD = 32
BLANKS = "\t\n\x0b\x0c\r "


def without_blanks(text: str) -> Column:
    """The text without white space; null is empty."""
    out = F.coalesce(F.col(text), F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int | None = None, scope: str = "query") -> DataFrame:
    """A row for each document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same without white space (null is empty). Of a group of equal texts the row
    with the most code points stays, then the one with the smallest id, null ids last; of rows alike in both, one stays. The
    digest is the normalised text's. Other columns of ``docs`` are ignored, whatever their names; an empty table gives no
    rows. ``share``: rows of one text that a run may have; by default a quarter of a task's share of all rows.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = share or max(1000, docs.count() // (4 * partitions))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_long"), without_blanks(text).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    crowded = rows.groupBy("_hash").count().filter(F.col("count") > share).select("_hash", F.ceil(F.col("count") / share).alias("_shares"))
    crowded = F.broadcast(staged(crowded, "crowded", scope))  # at most 4 rows a partition, by the choice of share
    rows = rows.join(crowded, "_hash", "left").withColumn("_share", F.pmod(F.xxhash64("doc_id", "_long", F.lit(11)), F.coalesce("_shares", F.lit(1))))
    rows = rows.withColumn("_head", F.substring("_text", 1, HEAD)).repartitionByRange("_head", "_hash", "_share").withColumn("_row", F.monotonically_increasing_id())

    best = (F.desc("_long"), F.asc_nulls_last("doc_id"))
    run = Window.partitionBy("_head", "_hash", "_share", "_text")  # satisfied by the range partitioning: no further shuffle
    place, first = F.row_number().over(run.orderBy(*best)), lambda c: F.first(c).over(run.orderBy(*best))
    rows = rows.select(
        "doc_id", "_long", first("doc_id").alias("keep_id"), first("_row").alias("_run"), (place == 1).alias("kept"), F.count("*").over(run).alias("group_size"),
        F.sha2("_text", 256).alias("text_sha256"), F.col("_shares").isNotNull().alias("_split"), F.when(F.col("_shares").isNotNull() & (place == 1), F.col("_text")).alias("_text"), "_hash",
    )
    rows = staged(rows, "runs", scope)

    whole = Window.partitionBy("_hash", "_text")
    firsts = rows.filter("_split and kept").select("_run", "_hash", "_text", "_long", "doc_id", "group_size").repartitionByRange("_hash")
    firsts = firsts.select(
        "_run", F.first("doc_id").over(whole.orderBy(*best, "_run")).alias("_keep_id"), F.sum("group_size").over(whole).alias("_size"),
        (F.row_number().over(whole.orderBy(*best, "_run")) == 1).alias("_best"),
    )
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    split = rows.filter("_split").join(staged(firsts, "firsts", scope), "_run")
    split = split.select("doc_id", F.col("_keep_id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("kept") & F.col("_best")).alias("kept"), "text_sha256")
    return rows.filter("not _split").select(*out).unionByName(split)


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str = "query") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Ids must be unique and not null, as rows are found by them."""
    dropped = exact_groups(docs, doc_id, text, scope=scope).filter("not kept").select(F.col("doc_id").alias(doc_id))
    return docs.join(dropped, doc_id, "left_anti")
