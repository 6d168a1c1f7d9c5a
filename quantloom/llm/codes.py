"""Token files of directly addressable codes.

An id is split into 8-bit chunks, the lowest first. Level 0 has a chunk of each token; a bitmap says which tokens
continue on the next level, which has chunks of those alone. A rank directory (ones before each block of 512 bits)
leads from a token's place on one level to its place on the next, so that any token is read by itself.

A shard file: 8-byte magic, header length, JSON header, then its arrays, each from a multiple of 8 bytes on.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mounted
from .tokens import encoded

MAGIC, BLOCK = b"DACTOK01", 512
SHARD_BYTES = 64 << 20


def write_shard(path: str, doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> None:
    """Write one shard, at one stroke: a second try of a task replaces the same file with the same bytes."""
    level, arrays, n = np.ascontiguousarray(ids, dtype=np.uint32), {}, 0
    arrays["doc_id"] = np.array([0 if x is None else x for x in doc_ids], dtype="<i8")
    arrays["doc_null"] = np.array([x is None for x in doc_ids], dtype=np.uint8)
    arrays["doc_end"] = ends.astype("<i8")
    while True:
        more = level >> 8 > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
        arrays |= {f"chunk{n}": (level & 255).astype(np.uint8), f"more{n}": bits, f"rank{n}": np.concatenate([[0], np.cumsum(ones)]).astype("<i8")}
        level, n = level[more] >> 8, n + 1
        if not len(level):
            break
    head, at = {"levels": n, "tokens": len(ids), "docs": len(doc_ids), "arrays": {}}, 0
    for k, a in arrays.items():
        head["arrays"][k] = [at, len(a), a.dtype.str]
        at += a.nbytes + -a.nbytes % 8
    raw = json.dumps(head).encode()
    raw += b" " * (-(len(raw) + 16) % 8)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(MAGIC + np.int64(len(raw)).tobytes() + raw)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(part, path)


class TokenFile:
    """A mapped shard: single tokens and ranges without decoding what lies before."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if bytes(raw[:8]) != MAGIC:
            raise ValueError(f"{path} is no token file")
        size = int(raw[8:16].view("<i8")[0])
        head = json.loads(bytes(raw[16 : 16 + size]))
        self.tokens, self.docs, levels = head["tokens"], head["docs"], head["levels"]
        arr = {k: raw[16 + size + at : 16 + size + at + n * np.dtype(t).itemsize].view(t) for k, (at, n, t) in head["arrays"].items()}
        self.doc_id, self.doc_null, self.doc_end = arr["doc_id"], arr["doc_null"], arr["doc_end"]
        self.levels = [(arr[f"chunk{k}"], arr[f"more{k}"], arr[f"rank{k}"]) for k in range(levels)]

    def rank(self, level: int, i: int) -> int:
        """Tokens among the first i of a level that continue."""
        _, bits, ranks = self.levels[level]
        b, rest = divmod(i, BLOCK)
        part = bits[b * BLOCK // 8 : b * BLOCK // 8 + (rest + 7) // 8]
        return int(ranks[b]) + int(np.unpackbits(part, bitorder="little")[:rest].sum())

    def token(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for k, (chunk, bits, _) in enumerate(self.levels):
            out |= int(chunk[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            i = self.rank(k, i)
        return out

    def range(self, a: int, z: int) -> np.ndarray:
        """Ids of the tokens a to z - 1."""
        out, at = np.zeros(z - a, dtype=np.uint32), np.arange(z - a)
        for k, (chunk, bits, _) in enumerate(self.levels):
            if z <= a:
                break
            out[at] |= chunk[a:z].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits[a >> 3 : (z + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + z - a].astype(bool)
            at = at[more]
            a = self.rank(k, a) if k + 1 < len(self.levels) else 0
            z = a + len(at)
        return out


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` in ascending order of id (null ids first, equal ids by text) into shard files in ``folder``,
    a shared folder that workers have mounted; gives ``shard, path, start, docs, tokens`` per shard.

    Null texts are the end id alone, repeated rows are written each, an empty table gives no tokens; other columns are
    not read. The range exchange also splits one id with very many rows, by a hash of the text. A shard, which a task holds
    at once, gets some SHARD_BYTES of text at most, one long text aside.
    """
    to = mounted(folder)
    os.makedirs(to, exist_ok=True)
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, ends, end = [], [], [], np.uint32(end_id).tobytes()
        for b in batches:
            keys += b.column(0).to_pylist()
            for raw in encoded(b.column(1), tokenizer, True):
                parts.append(raw + end)
        if not keys:
            return
        ends = np.cumsum([len(x) // 4 for x in parts])
        shard = TaskContext.get().partitionId()
        path = f"{to}/shard-{shard:08d}.dac"
        write_shard(path, keys, np.frombuffer(b"".join(parts), dtype="<u4"), ends)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([path]), pa.array([len(keys)]), pa.array([int(ends[-1])])], ["shard", "path", "docs", "tokens"])

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    made = sorted(ordered.mapInArrow(run, "shard long, path string, docs long, tokens long").collect())  # a row for each file
    rows, start = [], 0
    for r in made:
        rows.append((r.shard, r.path, start, r.docs, r.tokens))
        start += r.tokens
    return docs.sparkSession.createDataFrame(rows, "shard long, path string, start long, docs long, tokens long")


def read_tokens(spark: SparkSession, shards: DataFrame, digest: bool = False) -> DataFrame:
    """Per document of the files ``doc_id, start, n_tokens`` and ``ids`` (little-endian uint32 bytes), or with
    ``digest`` their ``ids_crc32`` instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(path)
                ends = np.asarray(f.doc_end)
                begins = np.concatenate([[0], ends[:-1]])
                for i in range(0, f.docs, 2000):
                    s, e = begins[i : i + 2000], ends[i : i + 2000]
                    raw, base = f.range(int(s[0]), int(e[-1])).tobytes(), int(s[0])
                    each = [raw[4 * (x - base) : 4 * (y - base)] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                    ids = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array(each, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(f.doc_id[i : i + 2000]), mask=np.asarray(f.doc_null[i : i + 2000]).astype(bool)), pa.array(start + s), pa.array(e - s), ids], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    n = max(1, shards.count())
    return shards.select("path", "start").repartition(n, "path").mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")
