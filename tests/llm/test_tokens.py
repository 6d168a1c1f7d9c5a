"""Token counts, packing and token files against the tokenizer library itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import codes, packing, tokens
from quantloom.llm.common import mounted, new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "  a", "a  b \n c ", "x\n y", "don't  stop<|endoftext|> now", "<|endoftext|>", "tab\t x", "a b  c  d é  ü", "end ", " lead", "n\n\n\n  m",
    "z" * 3000, "1 2 3  4", "q \r\n w", "  a b", "a 　b c", "word " * 9000, "\x1c a \x85 b \x1f", "no\nblank\nlines", "a" + " " * 700 + "b",
]


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return docs + [(100000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id here"), (5, "dup row"), (5, "dup row")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "ids": F.lit(1), "piece": F.lit(2)}).repartition(5).cache()


@pytest.fixture(scope="module")
def want(rows):
    tok = Tokenizer.from_file(PATH)
    return {(k, t or ""): tok.encode(t or "", add_special_tokens=False).ids for k, t in rows}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_counts(docs, rows, want, spark):
    got = Counter(tuple(r) for r in tokens.token_counts(docs, PATH, limit=512).collect())
    assert got == Counter((k, len((t or "").encode()), len(want[k, t or ""]), len(want[k, t or ""]) > 512) for k, t in rows)
    assert tokens.token_counts(empty(spark), PATH).count() == 0


def test_long_texts_are_cut_safely(monkeypatch, want, rows):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 64)
    enc = tokens.Encoder(PATH, True)
    for k, t in rows[-40:]:
        assert np.frombuffer(enc.batch([t or ""])[0], "<u4").tolist() == want[k, t or ""]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name, rows):
    path = public_tokenizers.path(name)
    texts = [t or "" for _, t in rows[:30]] + [t or "" for t in ODD]
    if name.endswith(".json"):
        tok = Tokenizer.from_file(path)
        want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert tokens.Encoder(path, False).batch(texts) == want


def test_packing(docs, rows, want, spark):
    got = packing.pack(docs, PATH, length=256).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.03 * -(-total // 256) + 1
    for k, t in rows:
        own = sorted(pieces[k], key=lambda r: r.piece)
        assert all(r.length == 256 for r in own[1:]) or k == 5
        if k != 5:
            assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == [*want[k, t or ""], 0]
    assert packing.pack(empty(spark), PATH).count() == 0


def test_packing_of_items_that_never_fit_together(spark):
    df = spark.createDataFrame([(i, "a b c") for i in range(300)], "doc_id long, text string").repartition(20)
    got = packing.pack(df, PATH, length=6, slack=0, fan_in=2).collect()
    assert len(got) == 300 and len({r.sequence_id for r in got}) == 300


def test_packing_in_blocks_with_text_ids(docs, rows, want, spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_IDS", 3000)
    monkeypatch.setattr(packing, "EMIT_IDS", 700)
    some = [(f"k{k}", t) for k, t in rows[:150]]
    got = packing.pack(spark.createDataFrame(some, "doc_id string, text string").repartition(9), PATH, length=128, fan_in=2).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        own[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        sequences[r.sequence_id].append((r.offset, r.length))
    assert own == {k: [*want[int(k[1:]), t or ""], 0] for k, t in some}
    for s in sequences.values():
        assert [a for a, _ in sorted(s)] == np.cumsum([0, *[n for _, n in sorted(s)]]).tolist()[:-1] and sum(n for _, n in s) <= 128


def test_closing_bins_early_costs_no_sequence():
    """The tree with early closing ends in as many bins as one in which every underfull bin travels on."""
    r = random.Random(6)
    for _ in range(200):
        room, fan_in, n = 40, r.choice([2, 3]), r.choice([5, 9, 16])
        nodes = [[([r.randint(*r.choice([(1, 12), (14, 30), (21, 40)])) for _ in range(r.randint(1, 25))])] for _ in range(n)]
        first = [[sum(own[0][i] for i in b) for b in packing.best_fit(own[0], room)] for own in nodes]

        def run(early):
            level, closed, left = first, 0, 0
            while fan_in**left < n:
                left += 1
            while left:
                left, after = left - 1, []
                for k in range(0, len(level), fan_in):
                    found = packing.merged([(s, [i], [0]) for i, s in enumerate(x for own in level[k : k + fan_in] for x in own)], room, 0, fan_in * left if early else 10**9)
                    closed += sum(x[1] for x in found)
                    after.append([x[0] for x in found if not x[1]])
                level = after
            return closed + sum(map(len, level))

        assert run(True) == run(False)


def test_best_fit_is_exact_where_it_can_be():
    bins = packing.best_fit([5, 5, 3, 3, 2, 2], 10)
    assert sorted(sum([5, 5, 3, 3, 2, 2][i] for i in b) for b in bins) == [10, 10]


def test_token_files(docs, rows, want, spark):
    shards = codes.write_tokens(docs, new_folder(spark, "tokens"), PATH)
    got = codes.read_tokens(spark, shards).orderBy("start").collect()
    assert len(got) == len(rows)
    at, before = 0, -1
    for r in got:
        assert r.start == at and before <= (-1 if r.doc_id is None else r.doc_id)
        at, before = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
        assert any(k == r.doc_id and np.frombuffer(r.ids, "<u4").tolist() == [*ids, 0] for (k, _), ids in want.items())
    f = codes.TokenFile(shards.first().path)
    every = f.range(0, f.tokens)
    assert all(f.token(i) == every[i] for i in range(0, f.tokens, 97))
    assert (f.range(1000, 1777) == every[1000:1777]).all()
    digest = codes.read_tokens(spark, shards, digest=True).orderBy("start").collect()
    assert [r.ids_crc32 for r in digest] == [zlib.crc32(r.ids) for r in got]
    assert codes.read_tokens(spark, codes.write_tokens(empty(spark), new_folder(spark, "tokens"), PATH)).count() == 0


def test_codes_of_any_width(tmp_path):
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1, 7, 2**24], dtype=np.uint32)
    codes.write_shard(str(tmp_path / "x"), [1], ids, np.array([len(ids)]))
    f = codes.TokenFile(str(tmp_path / "x"))
    assert [f.token(i) for i in range(8)] == ids.tolist() and (f.range(2, 7) == ids[2:7]).all()


def test_remote_folders_are_refused():
    with pytest.raises(ValueError):
        mounted("hdfs://a/b")
