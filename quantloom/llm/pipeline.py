"""Corpus pipeline: toxic documents go, near duplicates go, benchmark passages go, personal data is masked, the rest is
packed into training sequences. Each stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontam, minhash, packing, pii, toxicity
from .common import new_folder, release, row_key, staged

SCOPE = "pipeline stage"
BATCH_ROWS = 2000  # stages pass texts through workers


def _begin(spark: SparkSession) -> None:
    """What the stage before kept in the shared folder isn't needed once its result is written. Arrow batches get at most
    BATCH_ROWS rows in this session from here on, since whole rows travel in them."""
    ship(spark)
    release(SCOPE)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learnt from all labels, is below one half; rows without text are scored too."""
    _begin(spark)
    weights = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, weights, passes=tuple(docs.columns))
    return scored.filter("score < 0.5").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, rows without id last; of rows that repeat both
    id and text, one. Rows are told apart by numbers of their own, so texts that share an id are compared as any others. Rows
    without id and words are no copies of each other and stay."""
    _begin(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows", SCOPE)
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z")
    found = minhash.near_duplicates(rows.filter(~blank), doc_id="_row", scope=SCOPE).filter("not kept").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group"))
    found = staged(found, "copies", SCOPE)
    groups = found.unionByName(found.select(F.col("group").alias("_row"), "group").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text", F.to_json(F.struct(F.lit(0), *others))).alias("tie"), "_row")
    known = rows.select("_row", "doc_id", order.alias("order")).join(groups, "_row")
    first = staged(known.groupBy("group").agg(F.min("order")["_row"].alias("_row")), "first", SCOPE)
    dropped = groups.join(first, ["group", "_row"], "left_anti").select("_row")
    repeated = rows.filter(blank & F.col("doc_id").isNotNull()).select("_row", "doc_id", "text", order.alias("order"))
    one = repeated.groupBy("doc_id", "text").agg(F.min("order")["_row"].alias("_row"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "text", F.col("_row").alias("stays"))
    dropped = dropped.unionByName(repeated.join(one, (repeated["doc_id"] == one["doc_id"]) & repeated["text"].eqNullSafe(one["text"])).filter("_row <> stays").select("_row"))
    return rows.join(staged(dropped, "dropped", SCOPE), "_row", "left_anti").select(*docs.columns)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    _begin(spark)
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scope=SCOPE)
    leaked = found.filter("n_hit > 0").select(F.col("key").alias("_leaked")).distinct()
    return docs.join(leaked, row_key("doc_id", "text") == F.col("_leaked"), "left_anti")


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked and ``n_chars`` counted again."""
    _begin(spark)
    out = pii.redacted(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in sequences of at most 2048 tokens."""
    _begin(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048, scope=SCOPE)


STAGES = [
    ("toxicity", keep_civil),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_unleaked),
    ("personal_data", mask_personal),
    ("packing", pack_sequences),
]

#: Tokens, sketches and trained models have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces. Rows with null ids or texts go through every stage as each says;
    an empty table gives no pieces; further columns are carried to the last stage but one. A stage's table in the shared
    folder goes once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = new_folder(spark, name, f"pipeline {i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(f"pipeline {i - 1}")
    release(SCOPE)
    return docs
