"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of the beginnings of its longer words, of pairs of neighbours
and of pairs with one word between. Training goes through a bounded, hash-chosen sample of labelled rows in one task;
each coordinate has its own learning rate and L1 keeps few weights, so that the model is a small array for broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NON_WORD, mix, shingles, slices, spans, word_hashes

BITS, HEAD = 20, 5
BROADCAST_ROWS = 200_000


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature index of each feature occurrence, sorted by row."""
    starts, ends, at = spans(data, offsets, NON_WORD)
    h = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    heads = np.flatnonzero(ends - starts > HEAD)
    rows, keys = [row, row[heads]], [h, mix(word_hashes(data, starts[heads], starts[heads] + HEAD) + np.uint64(11))]
    for gap in (1, 2):
        n = max(0, len(h) - gap)
        same = row[:n] == row[gap:]
        rows.append(row[:n][same])
        keys.append(mix(h[:n] * np.uint64(0xD6E8FEB86659FD93) + h[gap:] + np.uint64(gap))[same])
    rows, keys = np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique(rows << BITS | keys)
    return both >> BITS, both & (1 << BITS) - 1


def ftrl(rows: list[np.ndarray], labels: list[int], alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that aren't zero; index 2**BITS is the bias, which has no L1."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    rows = [np.append(x, np.int32(bias)) for x in rows]

    def weights(x):
        zi = z[x]
        strength = np.where(x == bias, 0.0, l1)
        return np.where(np.abs(zi) <= strength, 0.0, -(zi - np.sign(zi) * strength) / ((beta + np.sqrt(n[x])) / alpha + l2))

    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            s = n[x]
            z[x] += g - (np.sqrt(s + g * g) - np.sqrt(s)) / alpha * w
            n[x] = s + g * g
    w = weights(np.arange(len(z)))
    keep = np.flatnonzero(w)
    return keep, w[keep]


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 12000, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, epochs: int = 6, doc_id: str = "doc_id", text: str = "text"
) -> np.ndarray:
    """Weights (2**BITS + 1 doubles) from ``labels`` (``doc_id`` and a 0/1 column) joined with ``docs``.

    ``sample_rows`` bounds the training rows: those with the smallest hash of their id. Rows with null ids or labels
    teach nothing; without any label all weights are 0 and all scores one half.
    """

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches):
            row, key = features(data, offsets)
            at = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(key.astype(np.int32))), b.column(2)], ["at", "x", "y"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        i, w = ftrl([np.asarray(x) for x in group["x"]], group["y"].tolist(), alpha, beta, l1, l2, epochs)
        return pd.DataFrame({"i": i, "w": w})

    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(sample_rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = F.broadcast(chosen) if sample_rows <= BROADCAST_ROWS else chosen  # rows of an id and two numbers
    rows = texts.join(chosen, "doc_id").select("at", "text", "y").mapInArrow(examples, "at long, x array<int>, y int")
    found = rows.groupBy(F.lit("all").alias("part")).applyInPandas(train, "i long, w double").toPandas()  # at most 2**BITS + 1 rows
    out = np.zeros((1 << BITS) + 1)
    out[found["i"].to_numpy(dtype=np.int64)] = found["w"].to_numpy(dtype=float)
    return out


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", passes: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``doc_id, score``: the model's probability, from the whole text alone; the columns in ``passes`` follow
    as ``in_0``, ``in_1`` and so on. Null and empty texts get the bias's probability; null ids stay null; repeated rows
    are scored each; other columns are not read."""
    keep = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((keep, weights[keep].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, v = sent.value
        w = np.zeros((1 << BITS) + 1, dtype=np.float32)
        w[i] = v
        for b, data, offsets in slices(batches):
            row, key = features(data, offsets)
            got = w[key]
            some = np.flatnonzero(got)
            total = np.bincount(row[some], got[some].astype(float), b.num_rows) + float(w[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35)))), *b.columns[2:]], ["doc_id", "score", *names])

    names = [f"in_{i}" for i in range(len(passes))]
    types = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, passes, strict=True))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(n) for n, c in zip(names, passes, strict=True)])
    return rows.mapInArrow(run, f"doc_id {kind}, score double{types}")
