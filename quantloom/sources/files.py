"""Readers and writers of market tables: explicit schemas, one multi-file read for all symbols, partitioned output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import settled
from ..operators import serve

BARS = "symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, dividends DOUBLE, stock_splits DOUBLE"
PRICE_CSV = "Date STRING, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE, Dividends DOUBLE, Stock_Splits DOUBLE, Symbol STRING"
DAILY = "symbol STRING, date DATE, sentiment_score DOUBLE, sentiment_confidence DOUBLE, article_count BIGINT, bullish_ratio DOUBLE, bearish_ratio DOUBLE, sentiment_std DOUBLE, signal_valid BOOLEAN"
ARTICLES = "symbol STRING, datetime TIMESTAMP, headline STRING, summary STRING, source STRING, url STRING, sentiment_score DOUBLE, sentiment_confidence DOUBLE, sentiment_signal STRING"
NEWS_JSON = "category STRING, datetime BIGINT, headline STRING, id BIGINT, image STRING, related STRING, source STRING, summary STRING, url STRING"


def _or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    """What ``read`` gives; an empty frame of the schema where there is no such path."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def prices(spark: SparkSession, folder: str, symbol: str | None = None) -> DataFrame:
    """Bars from ``{SYMBOL}_prices.csv`` files with a header, of one symbol or all; the name gives a missing symbol.
    Dates may have a time and zone; they are taken as UTC days. No files: an empty frame."""
    glob = f"{folder}/{symbol.upper() if symbol else '*'}_prices.csv"
    raw = _or_empty(lambda: spark.read.option("header", True).option("enforceSchema", False).schema(_header(spark, glob)).csv(glob), spark, PRICE_CSV)
    have = {c.lower(): c for c in raw.columns}
    named = F.regexp_extract(F.input_file_name(), r"([^/]+)_prices\.csv$", 1) if "symbol" not in have else F.col(have["symbol"])
    number = lambda c: (F.expr(f"try_cast(`{have[c]}` AS DOUBLE)") if c in have else F.lit(None).cast("double")).alias(c)
    day = F.coalesce(F.to_date(F.expr(f"try_cast(`{have['date']}` AS TIMESTAMP)")), F.expr(f"try_cast(substring(`{have['date']}`, 1, 10) AS DATE)"))
    return raw.select(F.upper(named).alias("symbol"), day.alias("date"), *[number(c) for c in ("open", "high", "low", "close", "volume", "dividends", "stock_splits")])


def _header(spark: SparkSession, glob: str) -> str:
    """All columns as text, in the order of the first file's header."""
    names = spark.read.option("header", True).csv(glob).columns
    return ", ".join(f"`{c}` STRING" for c in names)


def daily_sentiment(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    df = _or_empty(lambda: spark.read.option("header", True).schema(DAILY).csv(path), spark, DAILY)
    return df if symbol is None else df.filter(F.col("symbol") == symbol.upper())


def news_sentiment(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Scored articles, the newest first."""
    df = _or_empty(lambda: spark.read.option("header", True).schema(ARTICLES).csv(path), spark, ARTICLES)
    df = df if symbol is None else df.filter(F.col("symbol") == symbol.upper())
    return df.withColumnRenamed("datetime", "article_ts").orderBy(F.desc_nulls_last("article_ts"))


def news_json(spark: SparkSession, path: str) -> DataFrame:
    """Vendor article JSON lines, as ``operators.text.flatten_articles`` takes them."""
    return _or_empty(lambda: spark.read.schema(NEWS_JSON).json(path), spark, NEWS_JSON)


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a ``{"symbols": [...], "count": n}`` file."""
    return spark.read.schema("symbols ARRAY<STRING>, count BIGINT").option("multiLine", True).json(path).select(F.explode("symbols").alias("symbol"))


def save_features(df: DataFrame, path: str) -> None:
    """Feature rows, partitioned by symbol, so that a later read of one symbol opens its files alone."""
    df.repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)


def load_features(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if symbol is None else df.filter(F.col("symbol") == symbol)


def upsert_table(new: DataFrame, path: str, keys: tuple[str, ...] = ("symbol", "date"), keeping: bool = False, always: tuple[str, ...] = (), period: str = "yyyy-MM") -> DataFrame:
    """Put rows into the table at ``path``, kept by symbol and ``period`` (a date format: months or years, by how many rows one
    should hold): rows with the same keys are replaced (``keeping``: a new null keeps the old value, but for ``always``). Only the
    partitions that ``new`` touches are read and written again; the files of all others stay as they are. The merged rows are
    written aside first, so a failure while merging leaves the table whole. Gives the table."""
    spark = new.sparkSession
    new = new.withColumn("period", F.date_format("date", period))
    schema = new.schema
    if not _exists(spark, path):
        new.repartition("symbol", "period").write.partitionBy("symbol", "period").parquet(path)
        return spark.read.schema(schema).parquet(path)
    new = settled(new, "upsert-new")
    old = spark.read.schema(schema).parquet(path).join(new.select("symbol", "period").distinct(), ["symbol", "period"], "left_semi")
    own = [*keys, "period"]
    merged = serve.upsert_keeping(old, new, own, always).select(*schema.names) if keeping else serve.upsert(old, new, own)
    settled(merged, "upsert").repartition("symbol", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "period").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown export format: {kind}")
    writer = df.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


SIGNALS = "symbol STRING, date DATE, signal STRING, signal_strength DOUBLE, sentiment_score DOUBLE"


def append_signals(df: DataFrame, path: str) -> None:
    """Add signals to those at ``path``; rows there stay."""
    df.select(*[F.col(c).cast(t) for c, t in (x.split() for x in SIGNALS.split(", "))]).write.mode("append").parquet(path)


def sentiment_signals(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Saved signals, of one symbol if asked for; none where nothing was saved."""
    df = _or_empty(lambda: spark.read.schema(SIGNALS).parquet(path), spark, SIGNALS)
    return df if symbol is None else df.filter(F.col("symbol") == symbol.upper())


def table(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """A table by its format, taken from the ending of its path where not given: csv (with a header), json, parquet, orc."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"unknown source format: {kind}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)
