"""Removal of repeated byte strings by anchored, enhanced suffix arrays.

Of each ``length`` bytes in a row one place is the anchor: that with the smallest hash of the ``GRAM`` bytes from it
on. Equal strings have their anchor at the same place inside, so all repeats of ``length`` bytes meet at anchors, and an
anchor with what lies ``length - GRAM`` bytes before and ``length`` bytes after its start (its context) decides them.

1. Partitions list the hashes of their anchors; shards keep those that occur twice. 2. Occurrences of these anchors fall
into classes of equal contexts; the first of each class is found by a pre-aggregated minimum. 3. Anchors with several
classes: an array of their suffixes, sorted, with the longest common prefixes of neighbours, is scanned with a stack for
its prefix intervals. Inside an interval the same scan over the texts to the left, sorted backwards, finds whether and how
its members extend to the left: where they differ on both sides is a maximal repeat, with all its occurrences, and all
but the first are marked. Anchors with more than ``crowd`` classes are decided by hashes of their single windows instead,
pre-aggregated, so that no anchor makes a large task. 4. A last pass removes, of each text, the contexts of all
occurrences that aren't the first of their class, and what was marked.

Between the passes stand sorted arrays in shards of the shared folder (anchors that occur twice, first occurrences, marks),
which workers map. Texts are read once for each pass and never shuffled; only contexts of undecided classes are.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mounted, new_folder, row_key, staged
from .ngram import by_shard, save
from .words import BYTE, INV, POW, buffers, mix

GRAM, CHUNK, OVERLAP, FLUSH, BLOCK = 32, 1 << 20, 1024, 1 << 19, 1 << 14
MEMBERS = 1 << 17
NONE = np.iinfo(np.uint64).max


class Piece:
    """Some rows' bytes (or a part of one long row) with the running sums that give any substring's hash."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, rows: np.ndarray, base: int, cut_left: bool, cut_right: bool):
        self.data, self.bounds, self.rows, self.base, self.cut = data, bounds, rows, base, (cut_left, cut_right)
        self.run = np.zeros(len(data) + 1, dtype=np.uint64)
        for s in range(0, len(data), BLOCK):  # blocks that stay in a core's cache
            part = self.run[s + 1 : s + 1 + BLOCK]
            np.cumsum(BYTE[data[s : s + BLOCK]] * POW[s : s + len(part)], out=part)
            part += self.run[s]

    def hashes(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return mix((self.run[z] - self.run[a]) * INV[a] + (z - a).astype(np.uint64))

    def anchors(self, length: int) -> tuple[np.ndarray, ...]:
        """Row (index into ``rows``), start in the piece, hash, and bytes of context before and after, of each anchor."""
        n, w = len(self.data), length - GRAM + 1
        none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
        if n < length:
            return none
        inside = np.ones(n - length + 1, dtype=bool)  # windows that don't leave their row
        for e in self.bounds[1:-1].tolist():
            inside[max(0, e - length + 1) : e] = False
        low, found = np.uint64((1 << 24) - 1), []
        for s in range(0, n - length + 1, BLOCK):
            keep = inside[s : s + BLOCK]
            e = s + len(keep) + w - 1
            least = mix((self.run[s + GRAM : e + GRAM] - self.run[s:e]) * INV[s:e]) & ~low | np.arange(s, e, dtype=np.uint64)
            span = 1
            while 2 * span <= w:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < w:
                least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
            at = least[keep] & low
            found.append(at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at)
        at = np.concatenate(found).astype(np.int64)
        if not len(at):
            return none
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        row = np.searchsorted(self.bounds, at, "right") - 1
        left = np.minimum(at - self.bounds[row], length - GRAM)
        right = np.minimum(self.bounds[row + 1] - at, length)
        keep = np.ones(len(at), dtype=bool)
        if self.cut[0]:
            keep &= left == length - GRAM
        if self.cut[1]:
            keep &= right == length
        at = at[keep]
        return row[keep], at, mix((self.run[at + GRAM] - self.run[at]) * INV[at]), left[keep], right[keep]


def pieces(col: pa.Array) -> Iterator[Piece]:
    """The rows of a column in pieces of about CHUNK bytes; longer rows in overlapping parts."""
    data, offsets = buffers(col)
    i, n = 0, len(col)
    while i < n:
        if offsets[i + 1] - offsets[i] > CHUNK - 2 * OVERLAP:
            a, z = int(offsets[i]), int(offsets[i + 1])
            for x in range(a, z, CHUNK - 3 * OVERLAP):
                lo, hi = max(a, x - OVERLAP), min(z, x + CHUNK - 2 * OVERLAP)
                yield Piece(data[lo:hi], np.array([0, hi - lo]), np.array([i]), lo - a, lo > a, hi < z)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK - 2 * OVERLAP, "right")) - 1)
        yield Piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.arange(i, j), 0, False, False)
        i = j


def byte_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of one array, with zeros behind them, and their lengths."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), int(sizes.max(initial=0)) + 1), dtype=np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return out, sizes


def common(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row in ``order`` with the one before it; -1 for the first."""
    out = np.full(len(order), -1, dtype=np.int64)
    for k in range(1, len(order), BLOCK):
        x, y = order[k : k + BLOCK], order[k - 1 : k - 1 + BLOCK][: len(order) - k]
        differ = rows[x] != rows[y]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[k : k + BLOCK] = np.minimum(at, np.minimum(sizes[x], sizes[y]))
    return out


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Prefix intervals (length, first, end exclusive) of at least ``least``, by a scan with a stack: a new one opens
    where the common prefix grows and closes where it falls."""
    stack: list[list[int]] = []
    for i, v in enumerate([*lcp[1:], -1], 1):
        start = i - 1
        while stack and stack[-1][0] > v:
            depth, start = stack.pop()
            if depth >= least:
                yield depth, start, i
        if v >= 0 and (not stack or stack[-1][0] < v):
            stack.append([v, start])


def ramps(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as its size, in a row."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def repeat_groups(anchor: np.ndarray, contexts: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Maximal repeats of at least ``length`` bytes through the anchors of some contexts (bytes before, bytes from the
    anchor on), in blocks: how far each reaches to the left and right, its number of members, and all members in a row."""
    m, right_of, back = len(contexts), [c[1] for c in contexts], [c[0][::-1] for c in contexts]
    order = np.array(sorted(range(m), key=right_of.__getitem__), dtype=np.int64)
    order = order[np.argsort(anchor[order], kind="stable")]
    lcp = common(*byte_rows(right_of), order)
    lcp[1:][anchor[order[1:]] != anchor[order[:-1]]] = -1
    rank = np.empty(m, dtype=np.int64)
    rank[sorted(range(m), key=back.__getitem__)] = np.arange(m)
    back_rows = byte_rows(back)
    right, first, stop = np.array(list(intervals(lcp.tolist(), GRAM)), dtype=np.int64).reshape(-1, 3).T
    block = np.cumsum(stop - first) // MEMBERS
    for k in np.unique(block).tolist():
        r, a, size = right[block == k], first[block == k], (stop - first)[block == k]
        which, at = np.repeat(np.arange(len(r)), size), ramps(a, size)
        child = np.cumsum(lcp[at] == r[which])  # parts of an interval that differ behind its prefix
        i = np.lexsort((rank[order[at]], which))
        own, child = order[at[i]], child[i]
        lcs = common(*back_rows, own)
        lcs[1:][which[1:] != which[:-1]] = -1
        lcs[lcs < length - r[which]] = -1
        keep = np.flatnonzero((lcs >= 0) | (np.append(lcs[1:], -1) >= 0))  # those that share enough with a neighbour
        left, x, y = np.array(list(intervals(lcs[keep].tolist(), 0)), dtype=np.int64).reshape(-1, 3).T
        n = y - x
        if not len(n):
            continue
        member, begin = keep[ramps(x, n)], np.cumsum(n) - n
        wide = np.minimum.reduceat(child[member], begin) != np.maximum.reduceat(child[member], begin)
        yield left[wide], r[which[keep[x]]][wide], n[wide], own[member[np.repeat(wide, n)]]


def maximal_repeats(contexts: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """The maximal repeats through one anchor: reach to the left and right, and the indices of all contexts that have it."""
    for left, right, n, members in repeat_groups(np.zeros(len(contexts), dtype=np.int64), contexts, length):
        for x, y, part in zip(left.tolist(), right.tolist(), np.split(members, np.cumsum(n)[:-1]), strict=True):
            yield x, y, part.tolist()


def marked(anchor: np.ndarray, contexts: list[tuple[bytes, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts in order of occurrence those that repeat an earlier one of their anchor, and how far to its left and
    right; the repeats of one context all hold the anchor, so together they are one run."""
    to_left, to_right = np.zeros(len(contexts), dtype=np.int64), np.zeros(len(contexts), dtype=np.int64)
    for left, right, n, members in repeat_groups(anchor, contexts, length):
        if len(n):
            later = members != np.repeat(np.minimum.reduceat(members, np.cumsum(n) - n), n)
            np.maximum.at(to_left, members[later], np.repeat(left, n)[later])
            np.maximum.at(to_right, members[later], np.repeat(right, n)[later])
    i = np.flatnonzero(to_right)
    return i, to_left[i], to_right[i]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the ranges cover; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def place(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Hash of an occurrence: its text's key and its place there."""
    return mix(key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + pos.astype(np.uint64))


class KeySet:
    """Sorted shards of 64-bit keys in the shared folder, mapped, with columns beside them."""

    def __init__(self, folder: str, n: int):
        self.to, self.n, self.files = mounted(folder), n, {}

    def array(self, s: int, name: str = "keys") -> np.ndarray | None:
        if (s, name) not in self.files:
            path = f"{self.to}/set-{s:06d}.{name}.npy"
            self.files[s, name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.files[s, name]

    def shards(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Shards that are there, each with the places of its keys, in order of keys."""
        order = np.argsort(keys)
        for s, i in by_shard((keys[order] % np.uint64(self.n)).astype(np.int32)):
            have = self.array(s)
            if have is not None and len(have):
                yield s, order[i]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        for s, i in self.shards(keys):
            have = self.array(s)
            out[i] = have[np.minimum(np.searchsorted(have, keys[i]), len(have) - 1)] == keys[i]
        return out


def write_set(df: DataFrame, folder: str, n: int) -> None:
    """Write a KeySet of the first column's values (long), or of the places the first two stand for."""
    pair = len(df.columns) == 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            h = place(key, b.column(1).to_numpy()) if pair else key.view(np.uint64)
            rows = [(s, h[i].tobytes()) for s, i in by_shard((h % np.uint64(n)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "hashes"])

    to = mounted(folder)

    def put(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        save(to, f"set-{shard:06d}", keys=np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in group["hashes"]])))
        return pd.DataFrame({"shard": [shard]})

    df.mapInArrow(deal, "shard int, hashes binary").groupBy("shard").applyInPandas(put, "shard int").agg(F.count("*")).first()


def remove_repeats(docs: DataFrame, length: int = 100, crowd: int = 8192, doc_id: str = "doc_id", text: str = "text", scope: str = "query") -> DataFrame:
    """Per row ``doc_id, n_bytes, spans, kept``: bytes of the text, the maximal runs (start, stop; byte offsets) covered
    by a string of ``length`` bytes that also starts earlier (smaller id, or earlier in the same text), and the bytes
    that are left. Strings are judged on the input and never cross texts.

    Null texts are empty. Null ids count as the smallest; rows with one id and different texts go by a hash of the
    text; rows with the same id and text are one document and all treated alike; an empty table gives an empty one;
    other columns are not read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = length - GRAM
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = texts.withColumn("key", row_key("doc_id", "text"))
    ordered = keyed.select("text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "key")

    def list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            h, counts = np.unique(np.concatenate(held), return_counts=True)
            rows = [(s, h[i].tobytes(), (counts[i] > 1).tobytes()) for s, i in by_shard((h % np.uint64(n)).astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["shard", "hashes", "twice"])

        held, size = [], 0
        for b in batches:
            for p in pieces(b.column(0)):
                held.append(p.anchors(length)[2])
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def keep_twice(folder: str):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            h = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in group["hashes"]])
            twice = np.concatenate([np.frombuffer(x, dtype=bool) for x in group["twice"]])
            order = np.argsort(h, kind="stable")
            h, twice = h[order], twice[order]
            again = np.concatenate([h[1:] == h[:-1], [False]]) | twice
            shard = int(group["shard"].iloc[0])
            keys = np.unique(h[again])
            save(folder, f"set-{shard:06d}", keys=keys)
            return pd.DataFrame({"shard": [shard], "keys": [len(keys)]})

        return run

    def occurrences(twice: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = KeySet(twice, n)
            for b in batches:
                ids, keys = b.column(1).to_numpy(), b.column(2).to_numpy()
                for p in pieces(b.column(0)):
                    row, at, h, left, right = p.anchors(length)
                    i = np.flatnonzero(known.has(h))
                    row, at, h, left, right = row[i], at[i], h[i], left[i], right[i]
                    ch = mix(p.hashes(at - left, at + right) + left.astype(np.uint64) * np.uint64(977))
                    own = p.rows[row]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(ids[own]), pa.array(keys[own]), pa.array(at - p.bounds[row] + p.base)], ["h", "ch", "doc_id", "key", "pos"])

        return run

    def contexts(chosen: str, crowds: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, crowded = KeySet(chosen, n), KeySet(crowds, n)
            for b in batches:
                ids, keys = b.column(1).to_numpy(), b.column(2).to_numpy()
                for p in pieces(b.column(0)):
                    row, at, h, left, right = p.anchors(length)
                    pos, own = at - p.bounds[row] + p.base, p.rows[row]
                    i = np.flatnonzero(known.has(place(keys[own], pos)))
                    raw = p.data.tobytes()
                    text = pa.array([raw[x:y] for x, y in zip((at - left)[i].tolist(), (at + right)[i].tolist(), strict=True)], pa.binary())
                    cols = [pa.array(h[i].view(np.int64)), pa.array(ids[own[i]]), pa.array(keys[own[i]]), pa.array(pos[i]), pa.array(left[i].astype(np.int32)), text, pa.array(crowded.has(h[i]))]
                    yield pa.RecordBatch.from_arrays(cols, ["h", "doc_id", "key", "pos", "l", "context", "crowded"])

        return run

    def scan_arrays(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["h", "key", "pos"]).sort_values(["h", "doc_id", "key", "pos"])
        pairs = [(c[:x], c[x:]) for c, x in zip(group["context"], group["l"].tolist(), strict=True)]
        i, left, right = marked(group["h"].to_numpy(), pairs, length)
        pos = group["pos"].to_numpy()[i]
        return pd.DataFrame({"key": group["key"].to_numpy()[i], "start": pos - left, "stop": pos + right})

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of all windows of crowded contexts, of their anchor and of their distance from it."""
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                raw, left, h = part.column(1).to_pylist(), part.column(2).to_numpy().astype(np.int64), part.column(0).to_numpy().view(np.uint64)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                run = np.zeros(len(data) + 1, dtype=np.uint64)
                np.cumsum(BYTE[data] * POW[: len(data)], out=run[1:])
                for o in range(before + 1):
                    ok = np.flatnonzero((left >= o) & (offsets[1:] - offsets[:-1] - left >= length - o))
                    a = offsets[ok] + left[ok] - o
                    win = mix(mix((run[a + length] - run[a]) * INV[a] + np.uint64(o)) + h[ok] * np.uint64(0xD6E8FEB86659FD93))
                    yield pa.RecordBatch.from_arrays([pa.array(win.view(np.int64)), part.column(3).take(pa.array(ok)), pa.array(np.full(len(ok), o, np.int32))], ["win", "at", "o"])

    def put_marks(folder: str):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            shard = int(group["shard"].iloc[0])
            key = group["key"].to_numpy(dtype=np.int64).view(np.uint64)
            order = np.argsort(key, kind="stable")
            save(folder, f"set-{shard:06d}", keys=key[order], start=group["start"].to_numpy(dtype=np.int64)[order], stop=group["stop"].to_numpy(dtype=np.int64)[order])
            return pd.DataFrame({"shard": [shard]})

        return run

    def remove(twice: str, firsts: str, marks: str):
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, first, other = KeySet(twice, n), KeySet(firsts, n), KeySet(marks, n)
            for b in batches:
                keys = b.column(1).to_numpy()
                found = [(np.zeros(0, np.int64),) * 3]
                for p in pieces(b.column(0)):
                    row, at, h, left, right = p.anchors(length)
                    i = np.flatnonzero((left + right >= length) & known.has(h))
                    pos, own = (at - p.bounds[row] + p.base)[i], p.rows[row[i]]
                    again = ~first.has(place(keys[own], pos))
                    found.append((own[again], (pos - left[i])[again], (pos + right[i])[again]))
                mine = keys.view(np.uint64)
                for s, i in other.shards(mine):
                    have = other.array(s)
                    for r, x, y in zip(i.tolist(), np.searchsorted(have, mine[i]).tolist(), np.searchsorted(have, mine[i], "right").tolist(), strict=True):
                        if x < y:
                            found.append((np.full(y - x, r), other.array(s, "start")[x:y], other.array(s, "stop")[x:y]))
                row, start, stop = (np.concatenate([f[k] for f in found]) for k in range(3))
                order = np.lexsort((start, row))
                row, start, stop = row[order], start[order], stop[order]
                at = np.searchsorted(row, np.arange(b.num_rows + 1))
                data, offsets = buffers(b.column(0))
                spans, kept = [], []
                for r, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    raw = data[offsets[r] : offsets[r + 1]].tobytes()
                    runs, parts, done = merged(list(zip(start[x:y].tolist(), stop[x:y].tolist(), strict=True))), [], 0
                    for a, z in runs:
                        parts.append(raw[done:a])
                        done = z
                    parts.append(raw[done:])
                    spans.append([{"start": a, "stop": z} for a, z in runs])
                    kept.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(np.diff(offsets)), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

        return run

    def folder() -> str:
        path = new_folder(spark, "anchors", scope)
        os.makedirs(mounted(path), exist_ok=True)
        return path

    twice, firsts, chosen, crowds, marks = (folder() for _ in range(5))
    ordered.select("text").mapInArrow(list_hashes, "shard int, hashes binary, twice binary").groupBy("shard").applyInPandas(keep_twice(mounted(twice)), "shard int, keys long").agg(F.sum("keys")).first()
    found = ordered.mapInArrow(occurrences(twice), "h long, ch long, doc_id long, key long, pos long")
    first = F.min(F.struct("doc_id", "key", "pos")).alias("first")
    classes = staged(found.groupBy("h", "ch").agg(first).select("h", "first.key", "first.pos"), "classes", scope)
    write_set(classes.select("key", "pos"), firsts, n)

    # Anchors with several classes: the contexts of their classes' first occurrences.
    several = staged(classes.groupBy("h").agg(F.count("*").alias("classes")).filter("classes > 1"), "several", scope)
    write_set(classes.join(several, "h").select("key", "pos"), chosen, n)
    write_set(several.filter(f"classes > {crowd}").select("h"), crowds, n)
    shown = staged(ordered.mapInArrow(contexts(chosen, crowds), "h long, doc_id long, key long, pos long, l int, context binary, crowded boolean"), "contexts", scope)
    part = F.pmod(F.xxhash64("h"), F.lit(4 * n)).alias("part")
    scanned = shown.filter("not crowded").groupBy(part).applyInPandas(scan_arrays, "key long, start long, stop long")
    # Ids of crowded contexts rise with their order of occurrence; a context's windows that start earlier overlap.
    crowded = shown.filter("crowded").dropDuplicates(["h", "key", "pos"]).orderBy("h", "doc_id", "key", "pos")
    crowded = staged(crowded.select("h", "context", "l", F.monotonically_increasing_id().alias("at"), "key", "pos"), "crowded", scope)
    wins = crowded.select("h", "context", "l", "at").mapInArrow(windows_of, "win long, at long, o int")
    earliest = wins.groupBy("win").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select("win", "first")
    again = wins.join(earliest, "win").filter("at <> first").groupBy("at").agg(F.max("o").alias("far"), F.min("o").alias("near"))
    later = crowded.select("at", "key", "pos").join(again, "at").select("key", (F.col("pos") - F.col("far")).alias("start"), (F.col("pos") - F.col("near") + length).alias("stop"))
    two64 = f"cast({1 << 64} as decimal(38,0))"
    shard = F.expr(f"cast((case when key < 0 then cast(key as decimal(38,0)) + {two64} else cast(key as decimal(38,0)) end) % {n} as int)").alias("shard")
    every = staged(scanned.unionByName(later).select(shard, "key", "start", "stop"), "marks", scope)
    every.groupBy("shard").applyInPandas(put_marks(mounted(marks)), "shard int").agg(F.count("*")).first()
    return keyed.select("text", "key", "doc_id").mapInArrow(remove(twice, firsts, marks), "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
