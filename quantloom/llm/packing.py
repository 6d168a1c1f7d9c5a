"""Best-fit packing of documents into fixed-length token sequences by hierarchical residual packing.

Each partition encodes its documents in blocks of bounded size and packs a block's pieces best-fit decreasing. The pieces
are written once, with their ids and their place in a bin. Bins that are nearly full are final. The underfull ones travel
on as items, by number and size alone: groups of ``fan_in`` neighbouring partitions merge them best-fit again, and so on up
the tree. In the end the pieces of bins that were merged take the place of their bin in its sequence.

After a best-fit step at most one bin of a node is not more than half full (a second one's first item would have fitted into
the first), and two bins of more than half never go together. So at each later step at most ``fan_in`` bins look for room,
and each needs one other: of the bins above half a node hands on the ``fan_in`` emptiest for each step that is left, and
closes the others. That bounds the tasks of all upper levels and costs no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoded

BLOCK_IDS, EMIT_IDS = 1 << 21, 1 << 19
NODE_BITS = 33
MERGED = "node long, size int, closed boolean, bins array<long>, shifts array<int>"


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Best fit, largest first: the members of each bin. Bins are found by their free room in one bit set."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        fit = rooms >> sizes[i]
        if fit:
            r = sizes[i] + (fit & -fit).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                rooms &= ~(1 << r)
            bins[b].append(i)
        else:
            b, r = len(bins), room
            bins.append([i])
        left = r - sizes[i]
        if left:
            if not free.setdefault(left, []):
                rooms |= 1 << left
            free[left].append(b)
    return bins


def merged(items: list[tuple[int, list[int], list[int]]], room: int, slack: int, hand_on: int) -> list[tuple[int, bool, list[int], list[int]]]:
    """One node's step. items: size, bins, and how far each bin lies from the item's start. Gives size, closed, bins and
    shifts; ``hand_on`` emptiest bins above half and all others stay open."""
    out = []
    for b in best_fit([x[0] for x in items], room):
        size, bins, shifts = 0, [], []
        for i in b:
            bins += items[i][1]
            shifts += [size + s for s in items[i][2]]
            size += items[i][0]
        out.append((size, bins, shifts))
    out.sort(key=lambda x: x[:2])
    halves = sum(2 * x[0] <= room for x in out)
    return [(size, room - size <= slack or k >= halves + hand_on, bins, shifts) for k, (size, bins, shifts) in enumerate(out)]


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, slack: int = 4, fan_in: int = 16, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text", scope: str = "query") -> DataFrame:
    """Per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids`` (``ids``: little-endian uint32
    bytes, null unless ``with_ids``); a sequence is its pieces in order of ``offset``.

    A document is its ids and ``end_id``. Only documents longer than ``length`` are cut, from the back, so that all
    pieces but the first are full. Null texts are documents of the end id alone; ids may be of any type and stay as they
    are, nulls too; repeated rows are packed each; an empty table gives an empty one; other columns are not read.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "node", "size", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, end, bins = TaskContext.get().partitionId(), np.uint32(end_id).tobytes(), 0
        cols: list[pa.Array] = []
        items: list[tuple] = []
        held: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal bins
            row, piece, start, size, crc = (np.array(x, dtype=np.int64) for x in zip(*items, strict=True))
            found = best_fit(size.tolist(), length)
            order, counts = np.array([i for b in found for i in b]), np.array([len(b) for b in found])
            row, piece, start, size, crc = row[order], piece[order], start[order], size[order], crc[order]
            ends, first = np.cumsum(size), np.cumsum(counts) - counts
            offset = ends - size - np.repeat((ends - size)[first], counts)
            whole = np.repeat(np.add.reduceat(size, first), counts)
            own = np.repeat((node << NODE_BITS) + bins + np.arange(len(found)), counts)
            bins += len(found)
            keys = pa.concat_arrays(cols).take(pa.array(row))
            cut = np.unique(ends // EMIT_IDS, return_index=True)[1].tolist()
            for a, z in zip(cut, [*cut[1:], len(order)], strict=True):
                ids = pa.array([held[i] for i in order[a:z].tolist()], pa.binary()) if with_ids else pa.nulls(z - a, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, z - a), pa.array(piece[a:z].astype(np.int32)), *[pa.array(x[a:z]) for x in (start, size, crc, own, offset)], pa.array(np.full(z - a, node)), pa.array(whole[a:z].astype(np.int32)), ids], names
                )

        for b in batches:
            cols, base, n_ids = [*cols, b.column(0)], sum(map(len, cols)), sum(x[3] for x in items)
            for i, raw in enumerate(encoded(b.column(1), tokenizer, True)):
                raw += end
                n = len(raw) // 4
                cuts = [0, n] if n <= length else sorted({0, *range(n, 0, -length)})
                for piece, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    ids = raw[4 * a : 4 * z]
                    items.append((base + i, piece, a, z - a, zlib.crc32(ids)))
                    if with_ids:
                        held.append(ids)
                n_ids += n
                if n_ids >= BLOCK_IDS:
                    yield from flush()
                    cols, base, n_ids = [b.column(0)], 0, 0
                    items.clear()
                    held.clear()
        if items:
            yield from flush()

    def merge(hand_on: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("first")
            items = list(zip(group["size"].tolist(), [list(x) for x in group["bins"]], [list(x) for x in group["shifts"]], strict=True))
            found = [x for x in merged(items, length, slack, hand_on) if not x[1] or len(x[2]) > 1]  # a closed bin that stayed alone needs no row
            return pd.DataFrame([(int(group["to"].iloc[0]), *x) for x in found], columns=["node", "size", "closed", "bins", "shifts"])

        return run

    kind = docs.schema[doc_id].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, node long, size int, ids binary"
    packed = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(pieces, shape), "pieces", scope)
    full = F.col("size") >= length - slack
    under = packed.filter(~full & (F.col("offset") == 0)).select("node", "size", F.array("bin").alias("bins"), F.array(F.lit(0)).alias("shifts"))
    nodes, levels = 1 + (under.agg(F.max("node")).first()[0] or 0), 0
    while fan_in**levels < nodes:
        levels += 1
    done = None
    for left in range(max(levels, 1) - 1, -1, -1):
        to = (F.col("node") / fan_in).cast("long").alias("to")
        step = staged(under.select(to, "size", "bins", "shifts", F.col("bins")[0].alias("first")).groupBy("to").applyInPandas(merge(fan_in * left), MERGED), "bins", scope)
        ended = step.filter("closed" if left else "size(bins) > 1").select("bins", "shifts")
        done, under = ended if done is None else done.unionByName(ended), step.filter("not closed")
    moved = done.select(F.col("bins")[0].alias("to"), F.explode(F.arrays_zip("bins", "shifts")).alias("m")).select(F.col("m.bins").alias("bin"), "to", F.col("m.shifts").alias("shift"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    final = packed.filter(full).select(*out, F.col("bin").alias("sequence_id"), "offset", "ids")
    rest = packed.filter(~full).join(staged(moved, "moves", scope), "bin", "left")
    return final.unionByName(rest.select(*out, F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), "ids"))
