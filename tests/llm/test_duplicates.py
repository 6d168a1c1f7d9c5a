"""Near duplicates, decontamination and repeated substrings against brute force."""

import random

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import decontam, graph, minhash, repeats


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{helpers.SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(20000, ""), (20001, None), (20002, "one two"), (20003, "One two"), (20004, "  \n"), (20005, "a b c d e"), (20006, "a b c d e")]
    base = [f"w{r.randrange(500)}" for _ in range(160)]
    for i in range(60):  # a family of copies that are alike, only some of them alike enough
        w = list(base)
        for _ in range(r.randrange(14)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        docs.append((30000 + i, " ".join(w)))
    return docs


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([*rows, rows[3], (None, "one two")], "doc_id long, text string")
    return df.withColumns({"n": F.lit(1), "band": F.lit("b"), "key": F.lit(None).cast("string"), "kept": F.lit(3)}).repartition(6).cache()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_near_duplicates(docs, rows, spark, block_rows):
    got, want = minhash.near_duplicates(docs, block_rows=block_rows).collect(), helpers.near_duplicates(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(1, 1 << 62, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:600], r.integers(1, 1 << 62, 300).astype(np.uint64)]))
    x, y, z = minhash.sketches([a, b, a[:1]], 160)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - true) < 0.12
    assert (z < np.iinfo(np.uint64).max).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_contamination(docs, rows, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{helpers.SF}/benchmark.parquet").collect()]
    items += [(9001, "the of"), (9002, "and"), (9003, ""), (9004, None), (9005, "Und die"), (None, "a b c"), (9001, "the of"), (9006, " ".join(rows[0][1].split()[3:20]))]
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).filter("doc_id is not null").collect()
    want = helpers.contamination(rows, items)
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_words, r.n_hit, sorted(r["items"])) == want[r.doc_id]


def test_contamination_of_nothing(docs, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, items).filter("n_hit > 0 or size(items) > 0").count() == 0
    assert decontam.contamination(empty(spark), items.union(spark.createDataFrame([(1, "a b")], "item_id long, text string"))).count() == 0


@pytest.mark.parametrize("crowd", [256, 4])
def test_repeats(rows, spark, crowd):
    r = random.Random(3)
    text = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    passage, edge, big = text("abcdefgh ", 173), text("xyzuvw ", 104), text("abcdefghijk ", 1_300_000)
    own = [*rows, (40000, "a" * 1000), (40001, "ab" * 300), (40002, "é" * 120), (40003, "é" * 120), (40004, big), (40005, big[:500_000] + "Q" + big[500_000:1_100_000])]
    for i in range(80):
        own.append((41000 + i, text("klmno ", r.randint(0, 150)) + passage[r.randint(0, 40) : r.randint(120, 173)] + text("klmno ", r.randint(0, 90)) + edge + text("klmno ", r.randint(0, 150))))
    df = spark.createDataFrame(own, "doc_id long, text string").withColumns({"key": F.lit("k"), "pos": F.lit(1)}).repartition(7)
    want = helpers.repeats(own)
    for x in repeats.remove_repeats(df, crowd=crowd).collect():
        assert (x.n_bytes, [(s.start, s.stop) for s in x.spans], bytes(x.kept)) == want[x.doc_id], x.doc_id


def test_repeats_of_nulls_and_nothing(spark):
    assert repeats.remove_repeats(empty(spark)).count() == 0
    r = random.Random(6)
    t = "".join(r.choice("abcdefgh ") for _ in range(134))
    got = {r.doc_id: len(r.kept) for r in repeats.remove_repeats(spark.createDataFrame([(None, t), (3, t), (4, None)], "doc_id long, text string")).collect()}
    assert got == {None: len(t), 3: 0, 4: 0}


def test_maximal_repeats_have_all_occurrences():
    anchor = bytes(range(32))
    contexts = [(b"xx" + b"L" * 40, anchor + b"R" * 60 + b"1"), (b"yL" + b"L" * 39, anchor + b"R" * 60 + b"2"), (b"zz", anchor + b"R" * 10)]
    found = list(repeats.maximal_repeats(contexts, 100))
    assert any(sorted(m) == [0, 1] and l + r >= 100 for l, r, m in found) and not any(2 in m for _, _, m in found)


@pytest.mark.parametrize("hub", [0, 10**9])
def test_components_of_a_hub(spark, hub):
    """A hub with the smallest or the largest id of all."""
    links = spark.range(1, 3000).select(F.lit(hub).cast("long").alias("a"), F.col("id").alias("b"))
    links = links.unionByName(spark.createDataFrame([(10**6, 10**6 + 1)], "a long, b long"))
    got = {r.node: r.component for r in graph.components(links).collect()}
    least = min(hub, 1)
    assert len(got) == 3002 and all(got[i] == least for i in [hub, *range(1, 3000)]) and got[10**6 + 1] == 10**6


def test_family_of_documents_that_are_alike_but_unlinked(spark):
    """Buckets of a large family are checked apart; pairs in it that are linked are still found."""
    r = random.Random(8)
    docs = []
    for i in range(400):
        own = [f"f{i % 9}_{j}" for j in range(40)] + [f"x{r.randrange(10**9)}" for _ in range(12 + r.randrange(16))]
        docs.append((i, " ".join(own)))
    docs += [(1000 + i, docs[i * 13][1] + " tail") for i in range(20)]
    want = helpers.near_duplicates(docs)
    for rows in (8, 1024):
        got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), block_rows=rows).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
