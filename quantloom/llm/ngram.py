"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Words are 48-bit hashes (0 begins a text, 1 ends it). Partitions count their n-grams of the highest order; arrays of
distinct ones go to shards by their middle words and a part of the first word, so that no frequent word makes a large
shard. A shard adds up its n-grams and writes them as sorted arrays of hashes: those seen once as hashes alone, the others with
their counts; so also its contexts, which are whole there, but for those with one continuation seen once: any context
that was seen is an n-gram of the next lower order, and one without an entry of its own must be such. What is left
without the first word goes on as n-grams of that order, each with the number of its first words, and so down to pairs,
whose shards are by the last word and a part of the first; what they know of each word goes on to shards of words.

A sorted array keeps 32 bits of each hash below those that its directory of leading bits tells, some 8 to 16 hashes to
an entry: 44 bits or more, so that one in 3e8 n-grams never seen is taken for a seen one. Workers map the files and look
all n-grams of a batch up in sorted order. Nothing but a few sums of each shard reaches the driver, the model's files
grow with the corpus, and so does the number of shards.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mounted
from .words import SPACES, mix, slices, spans, word_hashes

BEGIN, END, FLUSH = 0, 1, 1 << 22
_STEP = np.uint64(0xD6E8FEB86659FD93)


def token_grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each token with the ``order - 1`` words before it, the farthest first, and the first token of each row (one more
    entry at the end)."""
    starts, ends, at = spans(data, offsets, SPACES)
    h = np.maximum(word_hashes(data, starts, ends) >> np.uint64(16), np.uint64(2))
    n = len(at) - 1
    out = np.full(len(h) + n, END, dtype=np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(at))] = h
    first = at + np.arange(n + 1)
    place = np.arange(len(out)) - np.repeat(first[:-1], np.diff(first))
    return [*[np.where(place >= j, np.roll(out, j), np.uint64(BEGIN)) for j in range(order - 1, 0, -1)], out], first


def gram_key(grams: list[np.ndarray]) -> np.ndarray:
    h = grams[0]
    for w in grams[1:]:
        h = h * _STEP + w
    return mix(h)


def gram_shard(grams: list[np.ndarray], n: int) -> np.ndarray:
    """Pairs go by the last word, longer ones by the middle words, either with a part of the first word. So a context of
    two words or more is whole in one shard."""
    parts = np.uint64(max(8, n // 8))
    middle = gram_key(grams[1:-1]) if len(grams) > 2 else grams[-1]
    return (mix(middle * np.uint64(0x9E3779B97F4A7C15) + grams[0] % parts) % np.uint64(n)).astype(np.int32)


def squeezed(a: np.ndarray) -> bytes:
    """Compressed planes of bytes: the high ones of small numbers cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def loosened(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def packed_words(words: np.ndarray) -> bytes:
    """Words by their differences, which are small where words ascend."""
    return squeezed(np.diff(words, prepend=np.uint64(0)))


def unpacked_words(raw: bytes) -> np.ndarray:
    return np.cumsum(loosened(raw, np.uint64), dtype=np.uint64)


def place_kind(words: np.ndarray) -> type:
    return np.uint16 if len(words) <= 1 << 16 else np.uint32


def unpacked(words: bytes, at: bytes, order: int) -> np.ndarray:
    words = unpacked_words(words)
    return words[loosened(at, place_kind(words)).reshape(order, -1)]


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def word_shard(w: np.ndarray, n: int) -> np.ndarray:
    return (mix(w) % np.uint64(n)).astype(np.int32)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, each with the sums of its values."""
    order = np.argsort(keys)
    keys = keys[order]
    at = firsts(keys)
    return keys[at], *[np.add.reduceat(v[order], at) if len(at) else v for v in values]


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    at = firsts(shard[order])
    for a, z in zip(at, [*at[1:], len(order)], strict=True):
        yield int(shard[order[a]]), order[a:z]


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """One file for each array that isn't empty, put in place at one stroke."""
    for k, a in arrays.items():
        if not len(a):
            continue
        part = f"{folder}/{name}.{k}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            np.save(f, a)
        os.replace(part, f"{folder}/{name}.{k}.npy")


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams counted once to four times; halves where too few are known."""
    if min(n[:4]) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1 * k), float(k)) for k in (1, 2, 3)]


def classes(counts: np.ndarray, most: int) -> list[int]:
    """How many counts are 1, 2 and so on, the last of them ``most`` or more."""
    return np.bincount(np.minimum(counts, most), minlength=most + 1)[1:].tolist()


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers (0 or more) in as few bytes as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a


def directory(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted keys as the places where each value of their leading bits begins, and the 32 bits below."""
    if not len(keys):
        return {}
    bits = max(1, len(keys).bit_length() - 4)
    top = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return {f"{name}_top": narrow(top), f"{name}_low": (keys >> np.uint64(32 - bits)).astype(np.uint32)}


def look_up(top: np.ndarray, low: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a directory, and whether they are there."""
    bits = (len(top) - 1).bit_length() - 1
    lead, rest = (keys >> np.uint64(64 - bits)).astype(np.int64), (keys >> np.uint64(32 - bits)).astype(np.uint32)
    at, end = top[lead].astype(np.int64), top[lead + 1].astype(np.int64)
    stop = end.copy()
    while (at < stop).any():
        half = (at + stop) >> 1
        less = (at < stop) & (low[np.minimum(half, len(low) - 1)] < rest)
        stop = np.where(less, stop, half)
        at = np.where(less, half + 1, at)
    return at, (at < end) & (low[np.minimum(at, len(low) - 1)] == rest)


def by_count(keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of sorted keys: those seen once have no counts."""
    more = counts > 1
    return directory("once", keys[~more]) | directory("keys", keys[more]) | {"counts": narrow(counts[more])}


GRAMS = "shard int, words binary, at binary, counts binary, raw binary, stats array<long>"


def rows_of(grams: list[np.ndarray], counts: np.ndarray, raw: np.ndarray | None, shard: np.ndarray) -> list[tuple]:
    """A row for each shard, equal words side by side: the distinct words, frequent ones first, the n-grams as places
    among them, counts, and ``raw``, the counts of tokens (None where ``counts`` are just these)."""
    out = []
    for s, i in by_shard(shard):
        words, at, often = np.unique(np.stack([g[i] for g in grams]), return_inverse=True, return_counts=True)
        rank = np.lexsort((words, -often))
        place = np.empty(len(words), dtype=place_kind(words))
        place[rank] = np.arange(len(words))
        words, at = words[rank], place[at].reshape(len(grams), -1)
        by = np.lexsort((at[-1], at[-2]))
        out.append((s, packed_words(words), squeezed(at[:, by]), squeezed(counts[i[by]]), b"" if raw is None else squeezed(raw[i[by]]), []))
    return out


def train(docs: DataFrame, folder: str, text: str = "text", order: int = 3, shard_bytes: int = 1 << 25) -> dict:
    """Count the n-grams of ``docs`` up to ``order`` (2 or more) and write the model's files into ``folder``, a shared
    folder that workers have mounted; gives its constants. There is a shard for each ``shard_bytes`` of text, and no fewer
    than shuffle partitions. Null texts are empty: their one token is the end. An empty table gives a model that knows no
    word."""
    if order < 2:
        raise ValueError(f"order {order}: pairs are the smallest n-grams")
    to = mounted(folder)
    os.makedirs(to, exist_ok=True)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            g = [np.concatenate([x.pop(0) for x in held]) for _ in range(order)]
            held.clear()
            _, at, counts = np.unique(gram_key(g), return_index=True, return_counts=True)
            g = [w[at] for w in g]
            rows = rows_of(g, counts.astype(np.int64), None, gram_shard(g, n))
            return pa.RecordBatch.from_pylist([dict(zip(("shard", "words", "at", "counts", "raw", "stats"), r, strict=True)) for r in rows], kinds)

        kinds = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("words", "at", "counts", "raw")], ("stats", pa.list_(pa.int64()))])
        held, size = [], 0
        for _, data, offsets in slices(batches, 0):
            held.append(token_grams(data, offsets, order)[0])
            size += len(held[-1][0])
            if size >= FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    def gathered(group: pd.DataFrame, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """A shard's distinct n-grams of k words, sorted by key: words, keys, counts and counts of tokens."""
        g = np.concatenate([unpacked(w, a, k) for w, a in zip(group["words"], group["at"], strict=True)], axis=1)
        counts = np.concatenate([loosened(c, np.int64) for c in group["counts"]])
        raw = np.concatenate([loosened(r or c, np.int64) for r, c in zip(group["raw"], group["counts"], strict=True)])
        key = gram_key(list(g))
        by = np.argsort(key)
        at = firsts(key[by])
        return list(g[:, by[at]]), key[by[at]], np.add.reduceat(counts[by], at), np.add.reduceat(raw[by], at)

    def known(counts: np.ndarray, k: int) -> list[int]:
        """Numbers of n-grams counted once to four times, in the place of this order."""
        return [0] * 4 * (order - k) + classes(counts, 5)[:4] + [0] * 4 * (k - 1)

    def passed(group: pd.DataFrame, like: list[str]) -> pd.DataFrame:
        total = np.sum([np.array(x) for x in group["stats"]], axis=0).tolist()
        return pd.DataFrame([(-1, *[b""] * (len(like) - 2), total)], columns=like)

    def add_grams(k: int):
        def add(group: pd.DataFrame) -> pd.DataFrame:
            shard, like = int(group["shard"].iloc[0]), ["shard", "words", "at", "counts", "raw", "stats"]
            if shard < 0:
                return passed(group, like)
            g, key, counts, raw = gathered(group, k)
            ctx, total, one, two, more, begin = summed(gram_key(g[:-1]), counts, (counts == 1) * 1, (counts == 2) * 1, (counts > 2) * 1, (g[-2] == BEGIN) * 1)
            own = (total > 1) | (begin > 0)
            save(to, f"grams{k}-{shard:06d}", **by_count(key, counts))
            save(to, f"contexts{k}-{shard:06d}", **directory("keys", ctx[own]), total=narrow(total[own]), after=narrow(np.stack([one, two, more], axis=1)[own]))
            # Without the first word: distinct n-grams here have other first words in all other shards.
            low = gram_key(g[1:])
            by = np.argsort(low)
            at = firsts(low[by])
            left, seen, g = np.diff([*at, len(by)]).astype(np.int64), np.add.reduceat(raw[by], at), [w[by[at]] for w in g[1:]]
            return pd.DataFrame([*rows_of(g, left, seen, gram_shard(g, n)), (-1, b"", b"", b"", b"", known(counts, k))], columns=like)

        return add

    def add_pairs(group: pd.DataFrame) -> pd.DataFrame:
        shard, like = int(group["shard"].iloc[0]), ["shard", "words", "seen", "after", "stats"]
        if shard < 0:
            return passed(group, like)
        (b, c), key, counts, raw = gathered(group, 2)
        save(to, f"grams2-{shard:06d}", **by_count(key, counts))
        words, seen, left = summed(c, raw, np.ones_like(raw))
        before, *after = summed(b, counts, (counts == 1) * 1, (counts == 2) * 1, (counts > 2) * 1)
        rows = [(s, packed_words(words[i]), squeezed(np.stack([seen[i], left[i]])), b"", []) for s, i in by_shard(word_shard(words, n))]
        rows += [(s, packed_words(before[i]), b"", squeezed(np.stack([x[i] for x in after]).astype(np.int64)), []) for s, i in by_shard(word_shard(before, n))]
        return pd.DataFrame([*rows, (-1, b"", b"", b"", known(counts, 2))], columns=like)

    def add_words(group: pd.DataFrame) -> pd.DataFrame:
        shard, w, v, like = int(group["shard"].iloc[0]), [], [], ["v", "n", "types", "stats", "classes"]
        if shard < 0:
            return pd.DataFrame([(0, 0, 0, np.sum([np.array(x) for x in group["stats"]], axis=0).tolist(), [0] * 3)], columns=like)
        for raw, seen, after in zip(group["words"], group["seen"], group["after"], strict=True):
            x = unpacked_words(raw)
            part = np.zeros((6, len(x)), dtype=np.int64)
            if seen:
                part[:2] = loosened(seen, np.int64).reshape(2, -1)
            else:
                part[2:] = loosened(after, np.int64).reshape(4, -1)
            w.append(x)
            v.append(part)
        words, seen, left, total, one, two, more = summed(np.concatenate(w), *np.concatenate(v, axis=1))
        save(to, f"words-{shard:06d}", keys=words, seen=narrow(seen), left=narrow(left), total=narrow(total), after=narrow(np.stack([one, two, more], axis=1)))
        here = left[left > 0]
        return pd.DataFrame([(len(here), int(seen.sum()), int(left.sum()), known(here, 1), classes(here, 3))], columns=like)

    counted = texts.mapInArrow(grams, GRAMS)
    for k in range(order, 2, -1):
        counted = counted.groupBy("shard").applyInPandas(add_grams(k), GRAMS)
    paired = counted.groupBy("shard").applyInPandas(add_pairs, "shard int, words binary, seen binary, after binary, stats array<long>")
    last = paired.groupBy("shard").applyInPandas(add_words, "v long, n long, types long, stats array<long>, classes array<long>")
    add = [F.sum(F.element_at("stats", k)).alias(f"s{k}") for k in range(1, 4 * order + 1)] + [F.sum(F.element_at("classes", k)).alias(f"c{k}") for k in range(1, 4)]
    sums = last.agg(*[F.sum(c).alias(c) for c in ("v", "n", "types")], *add).first()
    d = {order - i: discounts([sums[f"s{4 * i + k}"] or 0 for k in range(1, 5)]) for i in range(order)}
    spread = sum(x * (sums[f"c{k}"] or 0) for k, x in enumerate(d[1], 1))
    return {"folder": folder, "order": order, "shards": n, "vocabulary": sums.v or 0, "tokens": sums.n or 0, "types": sums["types"] or 0, "discounts": d, "spread": spread}


class Mapped:
    """A model's files, mapped. Missing shards have no entries."""

    def __init__(self, model: dict, most: int = 8192):
        self.model, self.to, self.most = model, mounted(model["folder"]), most
        self.files: dict[str, np.ndarray | None] = {}

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.files:
            if len(self.files) >= self.most:
                self.files.clear()
            path = f"{self.to}/{name}.npy"
            self.files[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.files[name]

    def find(self, kind: str, shard: np.ndarray, keys: np.ndarray, **columns: np.ndarray) -> None:
        """Fill the columns for the keys (in ascending order) that the shards have."""
        for s, i in by_shard(shard):
            name = f"{kind}-{s:06d}"
            if kind == "words":
                have = self.array(f"{name}.keys")
                if have is None:
                    continue
                at = np.minimum(np.searchsorted(have, keys[i]), len(have) - 1)
                ok = have[at] == keys[i]
            elif (top := self.array(f"{name}.keys_top")) is not None:
                at, ok = look_up(top, self.array(f"{name}.keys_low"), keys[i])
            else:
                continue
            for k, out in columns.items():
                out[i[ok]] = self.array(f"{name}.{k}")[at[ok]]

    def counts(self, order: int, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Counts of n-grams by their keys, in ascending order."""
        out = np.zeros(len(keys), np.int64)
        self.find(f"grams{order}", shard, keys, counts=out)
        for s, i in by_shard(shard):
            if (top := self.array(f"grams{order}-{s:06d}.once_top")) is not None:
                left = i[out[i] == 0]
                out[left[look_up(top, self.array(f"grams{order}-{s:06d}.once_low"), keys[left])[1]]] = 1
        return out

    def scores(self, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the n-grams that end at successive tokens: each token's log10 probability, log10 base probability and whether it was seen in training."""
        m = self.model
        n, d = m["shards"], {k: np.array([0.0, *x]) for k, x in m["discounts"].items()}
        words, at = np.unique(np.concatenate(grams[-2:]), return_inverse=True)
        seen, left, total = (np.zeros(len(words), np.int64) for _ in range(3))
        after = np.zeros((len(words), 3))
        self.find("words", word_shard(words, n), words, seen=seen, left=left, total=total, after=after)
        bi, ci = at[: len(grams[-1])], at[len(grams[-1]) :]
        p = ((np.maximum(left - d[1][np.minimum(left, 3)], 0) + m["spread"] / (m["vocabulary"] + 1)) / m["types"] if m["types"] else np.full(len(words), 1 / (m["vocabulary"] + 1)))[ci]
        total, after = total[bi], after[bi]
        for k in range(2, m["order"] + 1):
            g = grams[-k:]
            shard = gram_shard(g, n)
            if k > 2:
                keys, first, inverse = np.unique(gram_key(g[:-1]), return_index=True, return_inverse=True)
                total, after = np.zeros(len(keys), np.int64), np.zeros((len(keys), 3))
                self.find(f"contexts{k}", shard[first], keys, total=total, after=after)
                total, after = total[inverse], after[inverse]
                alone = np.flatnonzero((total == 0) & (np.concatenate([[0], c[:-1]]) > 0) & (g[-2] != BEGIN))  # the token before ends this context
                total[alone], after[alone, 0] = 1, 1
            keys, first, inverse = np.unique(gram_key(g), return_index=True, return_inverse=True)
            c = self.counts(k, shard[first], keys)[inverse]
            whole = np.maximum(total, 1)
            p = np.where(total > 0, np.maximum(c - d[k][np.minimum(c, 3)], 0) / whole + after @ d[k][1:] / whole * p, p)
        base = np.log10((seen + 0.5) / (m["tokens"] + 0.5 * (m["vocabulary"] + 1)))
        return np.log10(p), base[ci], seen[ci] > 0


_MAPPED: dict[str, Mapped] = {}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, n_tokens, n_known, base_score, score, perplexity`` of the whole text and its end. Null texts
    are empty, null ids stay null, repeated rows are scored each; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model["folder"] not in _MAPPED:
            _MAPPED.clear()
            _MAPPED[model["folder"]] = Mapped(model)
        mapped = _MAPPED[model["folder"]]
        try:
            for part, data, offsets in slices(batches):
                grams, first = token_grams(data, offsets, model["order"])
                p, base, known = mapped.scores(grams)
                n, at = np.diff(first), first[:-1]
                p, base, known = np.add.reduceat(p, at), np.add.reduceat(base, at), np.add.reduceat(known.astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(known), pa.array(base), pa.array(p), pa.array(10 ** (-p / n))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])
        finally:
            _MAPPED.clear()
            del mapped
            give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
