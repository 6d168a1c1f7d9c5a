"""Exact duplicates, the Merkle manifest and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import helpers
import pytest
from pyspark.sql import functions as F

from quantloom.llm import contentsort, merkle, resample
from quantloom.llm.common import ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{helpers.SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    odd = ["", None, " \n\t", "Über straße \U0001f600", "a b", "ab", "a b", " ", "one two " * 30000, "word" * 400000]
    docs += [(9000 + i, t, (None, "", "-", "en", "xx")[i % 5], None if i % 3 else "s", None if i % 2 else 7) for i, t in enumerate(odd)]
    docs += [(9100 + i, "the same words " + " " * (i % 4), "en", "s", i) for i in range(400)]  # one text, four lengths
    docs += [(9600 + i, "common beginning " * 40 + str(i % 50), "de", "s", i) for i in range(120)]
    return docs


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = {c: F.lit(1) for c in ("keep_id", "kept", "_text", "idx", "size", "hash", "root", "row", "weight", "rank")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(more).repartition(7).cache()


@pytest.mark.parametrize("share", [None, 30])
def test_exact_groups(docs, rows, share):
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k))
    want = {k: (min(g)[1], len(g), k == min(g)[1], sha(t)) for t, g in groups.items() for _, k in g}
    got = contentsort.exact_groups(docs, share=share).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("share", [None, 3])
def test_exact_groups_of_repeated_and_null_ids(spark, share):
    own = [(None, "a b"), (None, "a b"), (5, "ab"), (5, "a b"), (5, "a b"), (7, "c"), (7, "c"), (None, None), (None, "")]
    got = contentsort.exact_groups(spark.createDataFrame(own, "doc_id long, text string").repartition(3), share=share).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter(
        [(None, 5, 5, False)] * 2 + [(5, 5, 5, True)] + [(5, 5, 5, False)] * 2 + [(7, 7, 2, True), (7, 7, 2, False), (None, None, 2, True), (None, None, 2, False)]
    )
    assert contentsort.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_drop_exact_duplicates(docs, rows):
    left = contentsort.drop_exact_duplicates(docs)
    assert set(left.columns) == set(docs.columns)
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows})


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fan):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        levels.append(nodes)
    return levels


def path(levels, i, fan, start):
    proof, h = [], start
    for nodes in levels[:-1]:
        first = i - i % fan
        run = [h if first + j == i else x for j, x in enumerate(nodes[first : first + fan])]
        proof += [x for j, x in enumerate(run) if first + j != i]
        h, i = sha("".join(run)), i // fan
    return proof, h


def brute_manifest(rows, fan, forge):
    """doc_id -> leaf, subroot, root, proof, folded root."""
    langs = defaultdict(list)
    for k, t, lang, source, n in rows:
        own = (k, source, lang, n, t)
        langs[lang].append((k is not None, k or 0, leaf(own), leaf((k, source, lang, n + 1 if n is not None and forge(k) else n, t))))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(langs[x])], fan) for x in names}
    top, out = tree([trees[x][-1][0] for x in names], fan), {}
    for place, x in enumerate(names):
        for i, (known, k, h, start) in enumerate(sorted(langs[x])):
            below, sub = path(trees[x], i, fan, start)
            above, root = path(top, place, fan, sub)
            out[k if known else None, h] = (trees[x][-1][0], top[-1][0], below + above, root)
    return out


@pytest.mark.parametrize(("fan", "block"), [(2, 1024), (2, 4), (3, 9), (16, 8)])
def test_manifest(docs, rows, fan, block, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", block)
    n_chars = F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.manifest(docs, tampered={"n_chars": n_chars}, fan=fan).collect()
    want = brute_manifest(rows, fan, lambda k: k % 7 == 0)
    assert len(got) == len(rows)
    for r in got:
        subroot, root, proof, folded = want[r.doc_id, r.leaf]
        assert (r.subroot, r.root, [bytes(x).hex() for x in r.proof], r.folded_root, r.verified) == (subroot, root, proof, folded, folded == root)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_little(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).count() == 0
    (one,) = merkle.manifest(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == leaf([None] * 5) and one.proof == [] and one.verified
    twice = [(3, "a", "en", "s", 1)] * 3 + [(None, "b", "en", "s", 1), (4, None, None, "s", None)]
    got = merkle.manifest(spark.createDataFrame(twice, SCHEMA)).collect()
    assert len(got) == 5 and all(r.verified for r in got) and len({r.root for r in got}) == 1


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", helpers.lower(text or ""))


def grams(w, longest):
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize(("longest", "frequent", "piece"), [(1, 500_000, 1 << 22), (1, 20, 64), (3, 0, 100)])
def test_resample(spark, docs, rows, longest, frequent, piece, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", piece)
    small = docs.filter("coalesce(length(text), 0) < 1000000") if piece < 1000 else docs
    own = [r for r in rows if piece > 1000 or len(r[1] or "") < 1_000_000]
    target = spark.read.parquet(f"{helpers.SF}/benchmark.parquet").select("text")
    counts = {k: Counter(grams(words(t), longest)) for k, t, *_ in own}
    s, t = Counter(), Counter()
    for b, found in [(s, counts.values()), (t, [Counter(grams(words(r.text), longest)) for r in target.collect()])]:
        for c in found:
            for f, n in c.items():
                b[zlib.crc32(f.encode()) % 997] += n
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 997) / ((s[b] + 1) * (t.total() + 997))))
    want = {}
    for k, c in counts.items():
        w, h = sum(n * gain(zlib.crc32(f.encode()) % 997) for f, n in c.items()), int(sha(f"5:{k}")[:8], 16)
        want[k] = (c.total(), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    fit = sorted((-want[k][2], k) for k, x, *_ in own if len(words(x)) >= 20)
    place = {k: i + 1 for i, (_, k) in enumerate(fit[: len(fit) * 30 // 100])}
    got = resample.resample(small, target, percent=30, least_words=20, seed=5, longest=longest, buckets=997, frequent=frequent).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got} == {k: (*x, place.get(k)) for k, x in want.items()} and len(got) == len(own)


def test_resample_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    own = spark.createDataFrame([(None, "a b " * 15), (None, None), (3, "a b " * 15), (3, "a b " * 15), (4, "c")], "doc_id long, text string")
    assert resample.resample(none, own).count() == 0
    got = resample.resample(own, none, percent=100).collect()
    assert len(got) == 5 and sorted(r.rank for r in got if r.rank) == [1, 2, 3] and all((r.weight == 0) == (r.n_features == 0) for r in got)
    assert resample.drawn(own.filter("doc_id = 4 or doc_id is null").limit(1), own, percent=100).count() <= 1


def test_ranked(spark):
    df = spark.range(3000).selectExpr("id % 3 as g", "(id * 7919) % 3001 as x").repartition(9)
    got = ranked(df, ("g",), F.col("x")).collect()
    for g in range(3):
        mine = sorted((r.x, r.idx, r["size"]) for r in got if r.g == g)
        assert [i for _, i, _ in mine] == list(range(len(mine))) and {n for *_, n in mine} == {len(mine)}
