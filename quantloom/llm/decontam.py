"""Benchmark decontamination by a prefix-filtered join of word windows.

An item's windows are its runs of ``window`` words (or the whole of a shorter item). The shingles of a window (three
words, or fewer in shorter windows) are ordered by rarity in the corpus; a window that is contained whole contains its
rarest shingle too, so that one shingle is its necessary prefix. Only places of a document that hold the prefix of some
window meet windows; the place must leave room for the window before the document's start and end (position and
length bounds), and then all words of the window must be there, in order.

A bit map of fixed size tells workers which shingles are prefixes. It never grows with the benchmark: a fuller map only
lets more places through to the join, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, staged
from .words import NON_WORD, shingles, slices, spans, word_hashes

SHINGLE, MAP_BITS = 3, 26


def _bit_map(values: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """The set of ``tok`` values as 2**bits bits: at most 2**bits / 64 rows reach the driver, whatever the input."""
    low = f"(tok & {(1 << bits) - 1}L)"
    rows = values.selectExpr(f"shiftright({low}, 6) as w", f"shiftleft(1L, cast({low} & 63 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << bits - 6, dtype=np.uint64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _in_map(bit_map: np.ndarray, tok: np.ndarray) -> np.ndarray:
    low = tok & np.uint64(len(bit_map) * 64 - 1)
    return (bit_map[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", scope: str = "query") -> DataFrame:
    """Per row of ``docs``: ``doc_id, key, n_words, n_hit, spans, items``: the row's key (``row_key`` of id and text), words,
    words inside windows that occur, those word ranges (start, end exclusive; they may overlap) and the distinct ids of
    items with occurring windows.

    Null and wordless texts have no words and no hits; wordless items have no windows; a null item id hits but is not
    listed; repeated rows are answered each; empty tables give no rows or no hits; other columns are not read.
    """
    low = min(SHINGLE, window)

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches):
            starts, ends, at = spans(data, offsets, NON_WORD)
            h = word_hashes(data, starts, ends)
            rows = []
            for key, a, z in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                n = min(window, z - a)
                for s in range(a, z - n + 1 if n else a):
                    w = h[s : s + n]
                    rows.append((key, n, int(shingles(w, n)[0].view(np.int64)), w.view(np.int64).tolist(), shingles(w, min(low, n)).view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((b.column(0).type, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["item_id", "length", "win", "words", "toks"])

    def places(h: np.ndarray, at: np.ndarray, sizes: list[int], bit_map: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, word places and shingles that the map lets through."""
        found = []
        ends = np.repeat(at[1:], np.diff(at))
        for k in sizes:
            tok = shingles(h, k)
            p = np.flatnonzero(_in_map(bit_map, tok) & (np.arange(len(tok)) + k <= ends[: len(tok)]))
            found.append((p, tok[p]))
        p, tok = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        return np.searchsorted(at, p, "right") - 1, p, tok

    def frequencies(sizes: list[int], bit_map):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, data, offsets in slices(batches, 0):
                starts, ends, at = spans(data, offsets, NON_WORD)
                row, _, tok = places(word_hashes(data, starts, ends), at, sizes, bit_map.value)
                pairs = np.unique(np.stack([tok, row.astype(np.uint64)], axis=1), axis=0) if len(tok) else np.zeros((0, 2), np.uint64)
                tok, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(n.astype(np.int64))], ["tok", "n"])

        return run

    def candidates(sizes: list[int], bit_map):
        reach, width = window - 1, 2 * window - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, data, offsets in slices(batches):
                starts, ends, at = spans(data, offsets, NON_WORD)
                h = word_hashes(data, starts, ends)
                row, p, tok = places(h, at, sizes, bit_map.value)
                order = np.argsort(row, kind="stable")
                row, p, tok = row[order], p[order], tok[order]
                around = p[:, None] + np.arange(-reach, reach + 1)
                ok = (around >= at[row][:, None]) & (around < at[row + 1][:, None])
                words = np.where(ok, h[np.clip(around, 0, max(0, len(h) - 1))] if len(h) else 0, np.uint64(0)).astype(np.uint64)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(words.reshape(-1).view(np.int64)), width).cast(pa.list_(pa.int64()))
                hits = pa.StructArray.from_arrays([pa.array(p - at[row]), pa.array(tok.view(np.int64)), flat], ["pos", "tok", "around"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)), hits)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(at)), lists], ["doc_id", "key", "n_words", "hits"])

        return run

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = window - 1
        for b in batches:
            n, off = b.column(3).to_numpy(), b.column(4).to_numpy()
            around = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1) if len(n) else np.zeros((0, 2 * window - 1), np.int64)
            counts = b.column(5).value_lengths().to_numpy(zero_copy_only=False)
            want = b.column(5).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), counts)
            place = np.arange(len(want)) - np.repeat(np.cumsum(counts) - counts, counts)
            same = around[row, reach - off[row] + place] == want
            bad = np.bincount(row[~same], minlength=len(n)) > 0
            start = b.column(1).to_numpy() - off
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(start), pa.array(start + n), b.column(6)], ["key", "start", "stop", "win"]).filter(pa.array(~bad))

    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    wins = staged(items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).mapInArrow(item_windows, f"item_id {kind}, length int, win long, words array<long>, toks array<long>"), "windows", scope)
    distinct = wins.groupBy("win", "length").agg(F.first("words").alias("words"), F.first("toks").alias("toks"))
    parts = distinct.select("win", "length", "words", F.posexplode("toks").alias("off", "tok"))
    sizes = sorted(min(low, r[0]) for r in wins.select("length").distinct().collect()) or [low]  # at most `window` rows
    sizes = sorted(set(sizes))
    texts = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"))
    all_map = spark.sparkContext.broadcast(_bit_map(parts))
    counts = texts.select("text").mapInArrow(frequencies(sizes, all_map), "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n"))
    rare = parts.join(counts, "tok", "left").groupBy("win", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok", "off", "words")).alias("p"))
    prefix = staged(rare.select("win", "length", "p.tok", "p.off", "p.words"), "prefixes", scope)
    prefix_map = spark.sparkContext.broadcast(_bit_map(prefix))
    keyed = texts.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    id_kind = docs.schema[doc_id].dataType.simpleString()
    base = staged(keyed.mapInArrow(candidates(sizes, prefix_map), f"doc_id {id_kind}, key long, n_words long, hits array<struct<pos: long, tok: long, around: array<long>>>"), "places", scope)
    hits = base.select("key", "n_words", F.explode("hits").alias("h")).select("key", "n_words", "h.*").distinct()
    met = hits.join(prefix, "tok").filter("pos >= off and pos - off + length <= n_words")
    found = staged(met.select("key", "pos", "around", F.col("length").cast("long"), F.col("off").cast("long"), "words", "win").mapInArrow(verify, "key long, start long, stop long, win long"), "found", scope)
    cover = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "stop"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(s["to"], x["start"]))).alias("n"), F.greatest(s["to"], x["stop"]).alias("to")),
        lambda s: s["n"],
    )
    words = found.groupBy("key").agg(cover.alias("n_hit"), F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    named = found.select("key", "win").distinct().join(wins.select("win", "item_id").distinct(), "win").groupBy("key").agg(F.collect_set("item_id").alias("items"))
    out = base.select("doc_id", "key", "n_words").join(words, "key", "left").join(named, "key", "left")
    empty = F.array().cast("array<struct<start: long, stop: long>>")
    return out.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"))
