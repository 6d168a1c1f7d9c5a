"""Importance resampling towards a target set, by a dictionary of the distinct features.

Features are runs of words. Workers add up n-grams of their batches before the shuffle that counts each string over the
corpus; each distinct string is hashed once, from that dictionary, and buckets add up the dictionary's counts. A bucket's gain
goes back through the dictionary to the documents: gains of features with a least share of all, a bounded number, are broadcast and
added up where a document is read; what is left, features of which none is frequent, is joined by its string.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, staged
from .words import NON_WORD, buffers

PIECE, HELD, EMIT = 1 << 22, 200_000, 50_000
_AS_WORDS = bytes(32 if NON_WORD[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def features(raw: memoryview, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """The n-grams of up to ``longest`` words of a UTF-8 text, in parts of a few megabytes, with the words of the part.
    A-Z become lower case; all ASCII but letters and digits separates words."""
    before: list[bytes] = []
    half, at = b"", 0
    while at < len(raw):
        part = half + bytes(raw[at : at + PIECE]).translate(_AS_WORDS)
        at += PIECE
        cut = len(part) if at >= len(raw) else part.rfind(b" ") + 1
        half = part[cut:]
        own = part[:cut].split()
        out = list(own)
        words = before + own
        for k in range(2, longest + 1):
            # n-grams that end in this part
            first = max(0, len(before) - k + 1)
            out.extend(map(b" ".join, zip(*[words[first + i :] for i in range(k)], strict=False)))
        before = words[max(0, len(words) - longest + 1) :] if longest > 1 else []
        if own or at >= len(raw):
            yield len(own), out


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[memoryview]:
    data, offsets = buffers(batch.column(column))
    view = memoryview(np.ascontiguousarray(data)).cast("B") if len(data) else memoryview(b"")
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield view[a:z]


def dictionary(texts: DataFrame, text: str, longest: int) -> DataFrame:
    """``feature, n``: how often each distinct n-gram occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def emitted():
            names, numbers = list(found), list(found.values())
            found.clear()
            for i in range(0, len(names), EMIT):
                yield pa.record_batch([pa.array(names[i : i + EMIT], pa.binary()).cast(pa.string()), pa.array(numbers[i : i + EMIT], pa.int64())], ["feature", "n"])

        for b in batches:
            for raw in _texts(b, 0):
                for _, own in features(raw, longest):
                    found.update(own)
                    if len(found) > HELD:
                        yield from emitted()
        yield from emitted()

    return texts.select(F.col(text).cast("string")).mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(feature, "UTF-8")) % buckets).cast("int")


def gains(docs: DataFrame, target: DataFrame, text: str, longest: int, buckets: int, scope: str) -> DataFrame:
    """``feature, n, gain`` of each distinct feature of ``docs``: the floor of 1000 times the log ratio of its bucket's smoothed shares."""
    own = staged(dictionary(docs, text, longest).withColumn("bucket", bucket(F.col("feature"), buckets)), "dictionary", scope)
    other = dictionary(target, text, longest).withColumn("bucket", bucket(F.col("feature"), buckets))
    s, t = [d.groupBy("bucket").agg(F.sum("n").alias(c)) for d, c in ((own, "s"), (other, "t"))]
    t = staged(t, "target", scope)
    total_s, total_t = [float(d.agg(F.sum(c)).first()[0] or 0) for d, c in ((own, "n"), (t, "t"))]
    own_t = F.coalesce("t", F.lit(0)).cast("double")
    ratio = (own_t + 1.0) * F.lit(total_s + buckets) / ((F.col("s").cast("double") + 1.0) * F.lit(total_t + buckets))
    table = s.join(t, "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))
    table = F.broadcast(staged(table, "gains", scope))  # a row a bucket at most
    return staged(own.join(table, "bucket").select("feature", "n", "gain"), "dictionary", scope)


def weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = 10_000, frequent: int = 500_000, scope: str = "query") -> DataFrame:
    """A row for each document: ``doc_id, n_features, n_words, weight``, the weight being the sum of its features' gains, repeats counted.

    Null and empty texts have no features and weight 0; rows that repeat, in id or text or both, are rows of their own;
    further columns are ignored, and empty tables give no rows (an empty target is smoothed as any other). Features that
    make up 1 / ``frequent`` of all or more are broadcast, so there are ``frequent`` of them at most; it changes no result.
    """
    spark = docs.sparkSession
    known = gains(docs, target, text, longest, buckets, scope)
    least = (known.agg(F.sum("n")).first()[0] or 0) / frequent if frequent else float("inf")
    short = known.filter((F.col("n") >= least) & (F.octet_length("feature") <= 100))
    top = {r.feature.encode(): r.gain for r in short.select("feature", "gain").collect()}
    shared = spark.sparkContext.broadcast(top)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"row long, doc_id {numbered.schema['doc_id'].dataType.simpleString()}, n_features long, n_words long, weight long, feature string, n long"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, rows = shared.value, []

        def emitted(ids: pa.DataType):
            kinds = (pa.int64(), ids, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            out[5] = out[5].cast(pa.string())
            return pa.record_batch(out, ["row", "doc_id", "n_features", "n_words", "weight", "feature", "n"])

        for b in batches:
            ids = b.schema.field(1).type
            for key, name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b, 2), strict=True):
                n_features = n_words = weight = 0
                for more, own in features(raw, longest):
                    n_features, n_words = n_features + len(own), n_words + more
                    for f, n in Counter(own).items():
                        if (g := gain.get(f)) is None:
                            rows.append((key, None, None, None, None, f, n))
                        else:
                            weight += g * n
                    if len(rows) >= EMIT:
                        yield emitted(ids)
                rows.append((key, name, n_features, n_words, weight, None, None))
            if rows:
                yield emitted(ids)

    found = staged(numbered.mapInArrow(look_up, schema), "features", scope)
    rest = found.filter("feature is not null").select("row", "feature", "n").join(known.select("feature", "gain"), "feature")
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("more"))
    out = found.filter("feature is null").join(rest, "row", "left")
    return out.select("doc_id", "n_features", "n_words", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, doc_id: str = "doc_id", scope: str = "query", **options) -> DataFrame:
    """``weights`` with ``score``, the weight and Gumbel noise, and ``rank``: 1, 2, 3 and so on of the documents drawn, null of the
    others. Of the N documents with at least ``least_words`` words those with the floor(percent * N / 100) highest scores are
    drawn, ties to the smaller id, null ids last. That is sampling without replacement in proportion to the weights."""
    scored = staged(weights(docs, target, doc_id, scope=scope, **options).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored", scope)
    fit = scored.filter(F.col("n_words") >= least_words)
    placed = ranked(fit, (), F.desc("score"), F.asc_nulls_last("doc_id"), scope=scope)
    rank = F.when(F.col("idx") < F.floor(F.col("size") * percent / 100), F.col("idx") + 1)
    placed = placed.select("doc_id", "n_features", "n_words", "weight", "score", rank.alias("rank"))
    others = scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "n_words", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return placed.unionByName(others)


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Ids must be unique, as rows are found by them."""
    ids = resample(docs, target, doc_id=doc_id, **options).filter("rank is not null").select(F.col("doc_id").alias(doc_id))
    return docs.join(ids, doc_id, "left_semi")
