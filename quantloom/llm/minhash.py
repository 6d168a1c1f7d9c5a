"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

Sketch of a set: in round i each element falls into a hashed bin (from round t on into bin i - t) with a hashed value,
and a bin keeps the smallest (round, value). Rounds go on until all t bins are filled, which 2t rounds guarantee.
Equal coordinates of two sketches estimate the Jaccard similarity with the concentration of t independent samples.

Bands of equal coordinates give buckets of candidates. Each bucket is first a star: its members meet one pivot, chosen
by hash, and the links that hold on full sets are joined to components. Buckets that still hold several components
(documents that are alike but not alike enough) form families. A family, or each bucket of it where that sends fewer sets, is
cut into blocks of bounded size; a task gets two blocks with their sets and checks all their pairs that share a band and are not yet connected, by counting
common shingles in bit rows. It returns links alone. So no candidate is given up, no pairs are written out, groups of
copies cost a star, and no task holds more than two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .graph import components
from .words import SPACES, mix, shingles, slices, spans, word_hashes


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; with fewer words the whole row as one shingle."""
    starts, ends, at = spans(data, offsets, SPACES)
    h = word_hashes(data, starts, ends)
    s = shingles(h, k)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= k:
            out.append(np.unique(s[a : z - k + 1]))
        else:
            out.append(shingles(h[a:z], z - a) if z > a else h[:0])
    return out


def sketches(items: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each non-empty set."""
    out = np.full((len(items), t), np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.array([len(x) for x in items])
    todo = np.arange(len(items))
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(todo):
            break
        own = np.repeat(todo, sizes[todo])
        h = mix(np.concatenate([items[j] for j in todo.tolist()]) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        b = (h & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32) if i < t else np.full(len(h), i - t, dtype=np.uint64)
        np.minimum.at(flat, own * t + b.astype(np.int64), np.uint64(i << 52) | mix(h) >> np.uint64(12))
        todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(axis=1)]
    return out


def block_links(group: pd.DataFrame, bands: int, rows: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect components, among the pairs of two blocks (or within one) that share a band."""
    x, y = int(group["x"].iloc[0]), int(group["y"].iloc[0])
    group = group.sort_values(["block", "node"]).drop_duplicates(["node", "set"])
    nodes, own, block = group["node"].tolist(), group["own"].tolist(), group["block"].to_numpy()
    parts = [np.frombuffer(s, dtype=np.uint64) for s in group["set"]]
    sizes, low = np.array([len(p) for p in parts]), np.stack([np.frombuffer(s, dtype=np.uint16) for s in group["low"]])
    values, inverse, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    common = np.cumsum(seen > 1) - 1  # bits for shingles of several members alone
    width = -(-int((seen > 1).sum()) // 64) or 1
    bits, at = np.zeros((len(parts), width), dtype=np.uint64), np.repeat(np.arange(len(parts)), sizes)
    keep = seen[inverse] > 1
    place = common[inverse[keep]]
    np.bitwise_or.at(bits, (at[keep], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    parent = {c: c for c in own}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out, root = [], np.array([find(c) for c in own])
    for i in np.flatnonzero(block == x).tolist():
        others = np.arange(i + 1, len(nodes)) if x == y else np.flatnonzero(block == y)
        others = others[root[others] != root[i]]
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        others = others[(low[others] == low[i]).reshape(len(others), bands, rows).all(axis=2).any(axis=1)]
        for k in range(0, len(others), 256):
            j = others[k : k + 256]
            both = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
            for t in j[100 * both >= percent * (sizes[j] + sizes[i] - both)].tolist():
                p, q = find(own[t]), find(own[i])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((nodes[i], nodes[t]))
        if out and len(others):
            root = np.array([find(c) for c in own])
    return out


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 75, bands: int = 40, rows: int = 4, block_rows: int = 1024, block_shingles: int = 1 << 22, doc_id: str = "doc_id", text: str = "text", scope: str = "query"
) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept``.

    Rows are linked if 100 * intersection >= percent * union of their shingle sets, exactly; a pair at the threshold of
    75 % misses all 40 bands of 4 with a chance of 2.4e-7. Rows without words have an empty set and no links. Rows that
    repeat an id count as one document. A row without id stays alone: component_id null, kept true. An empty table
    gives an empty one; other columns are not read.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches):
            got = sets(data, offsets, shingle)
            n = np.array([len(x) for x in got], dtype=np.int64)
            full = np.flatnonzero(n)
            sk = sketches([got[i] for i in full.tolist()], bands * rows).reshape(len(full), bands, rows)
            keys = np.zeros((len(full), bands), dtype=np.uint64)
            for r in range(rows):
                keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + sk[:, :, r])
            keys = mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
            prints, values = [None] * len(got), [None] * len(got)
            for i, v in zip(full.tolist(), keys, strict=True):
                prints[i], values[i] = hashlib.blake2b(got[i].tobytes(), digest_size=16).digest(), v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(prints, pa.binary()), pa.array(values, pa.list_(pa.int64()))], ["doc_id", "n", "print", "bands"])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches):
            got = sets(data, offsets, shingle)
            low = (sketches(got, bands * rows) & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in got], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())], ["node", "set", "low"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    def check_blocks(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(group, bands, rows, percent), columns=["a", "b"])

    rows_ = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signs = staged(rows_.mapInArrow(signed, "doc_id long, n long, print binary, bands array<long>"), "signs", scope)
    known = signs.filter("doc_id is not null and n > 0")
    classes = staged(known.groupBy("print").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n").alias("n")), "classes", scope)
    members = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = staged(members.join(shared, "band"), "members", scope)
    need = members.select(F.col("node").alias("doc_id")).distinct()
    full = staged(rows_.filter("doc_id is not null").join(need, "doc_id", "left_semi").mapInArrow(with_sets, "node long, set binary, low binary").dropDuplicates(["node", "set"]), "sets", scope)

    # Rows that repeat an id with other texts: their classes are one document.
    again = known.join(known.groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).filter("p <> q").select("doc_id"), "doc_id").join(classes.select("print", "node"), "print").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    pivot = F.min(F.struct(F.xxhash64("node", "band").alias("at"), "node", "n")).alias("pivot")
    chosen = members.groupBy("band").agg(pivot).select("band", F.col("pivot.node").alias("to"), F.col("pivot.n").alias("to_n"))
    pairs = members.join(chosen, "band").filter(f"node <> to and 100 * least(n, to_n) >= {percent} * greatest(n, to_n)")
    pairs = staged(pairs.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct(), "pairs", scope)
    joined = pairs.join(full.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    links = staged(again.unionByName(joined.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")).distinct(), "links", scope)
    comp = staged(components(links, scope), "components", scope)

    # Families: classes that share a bucket with another component.
    owned = members.select("band", "node", "n").join(comp, "node", "left").withColumn("own", F.coalesce("component", "node"))
    mixed = owned.groupBy("band").agg(F.min("own").alias("p"), F.max("own").alias("q"), F.min("node").alias("head")).filter("p <> q").select("band", "head")
    kin = staged(owned.join(mixed, "band").select("band", "node", "n", "own", "head"), "kin", scope)
    family = components(kin.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), scope).select("node", F.col("component").alias("family"))
    kin = staged(kin.drop("head").join(family, "node"), "kin", scope)
    # A family is checked as one, or bucket by bucket, by which of the two sends fewer sets.
    cut = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks")
    whole = kin.select("family", "node", "n").distinct().groupBy("family").agg(cut, F.count("*").alias("size"))
    apart = kin.groupBy("family", "band").agg(cut, F.count("*").alias("size"))
    cheaper = apart.groupBy("family").agg(F.sum(F.col("size") * F.col("blocks")).alias("apart")).join(whole, "family")
    cheaper = staged(cheaper.select("family", "blocks", (F.col("apart") < F.col("size") * F.col("blocks")).alias("split")), "families", scope)
    as_one = kin.select("family", "node", "own").distinct().join(cheaper.filter("not split"), "family").select(F.lit(None).cast("long").alias("band"), "family", "node", "own", "blocks")
    by_bucket = kin.select("family", "band", "node", "own").join(staged(apart.join(cheaper.filter("split").select("family"), "family").select("family", "band", "blocks"), "buckets", scope), ["family", "band"]).select("band", "family", "node", "own", "blocks")
    dealt = as_one.unionByName(by_bucket).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(full, "node").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("band", "family", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "own", "set", "low")
    more = staged(dealt.groupBy("band", "family", "x", "y").applyInPandas(check_blocks, "a long, b long"), "links", scope)
    comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scope)
    whole = classes.select("print", "node").join(comp, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    out = signs.join(whole, "print", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
