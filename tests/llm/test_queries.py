"""The registered queries over small tables with odd rows: the contracts' columns against brute force."""

import hashlib
import pickle
import zlib
from collections import defaultdict

import helpers
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quantloom.llm import pii
from quantloom.llm.queries import QUERIES, TOKENIZER


@pytest.fixture(scope="module")
def texts(spark):
    found = [r.text for r in spark.read.parquet(f"{helpers.SF}/documents.parquet").orderBy("doc_id").collect()][:50]
    found += ["", None, " \n", found[3], found[4] + " so " + found[5], "word " * 5000, "one two", "One two"]
    found.append("joe@mail.example.com or +1 415 555 0132, 192.168.0.1, 192.168.0.999, 4111 1111 1111 1111, 4111 1111 1111 1112")
    return {3 * i + 1: t for i, t in enumerate(found)}


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    items = spark.createDataFrame([(1, " ".join(helpers.words(texts[4])[:14])), (2, "one two"), (3, None), (10, "one two")], "item_id long, text string")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return {k: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}


def fold(k):
    return zlib.crc32(str(k).encode()) % 5


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def run(spark, folder, name, texts):
    got = QUERIES[name](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    return {r.doc_id: r for r in got}


def test_op2(spark, folder, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op2_best_fit_packing"](spark, folder).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for k, want in ids.items():
        at = 0
        for i, r in enumerate(sorted(pieces[k], key=lambda r: r.piece)):
            part = want[at : at + r.length]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (i, at, len(part), zlib.crc32(part.tobytes()))
            assert r.length == 2048 or i == 0
            at += r.length
        assert at == len(want) and (len(want) > 2048 or len(pieces[k]) == 1)
    for s in sequences.values():
        assert [a for a, _ in sorted(s)] == np.cumsum([0, *[n for _, n in sorted(s)]]).tolist()[:-1] and sum(n for _, n in s) <= 2048


def test_op3(spark, folder, texts):
    brute = helpers.KneserNey([t for k, t in texts.items() if fold(k) != 1], 3)
    for k, r in run(spark, folder, "op3_lm_scores", texts).items():
        n, known, base, score = brute.score(texts[k])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(k) == 1, n, known, brute.n)
        assert (r.base_score, r.score) == pytest.approx((base, score), rel=1e-9, abs=1e-9)


def test_op4(spark, folder, texts, ids):
    for k, r in run(spark, folder, "op4_token_counts", texts).items():
        n = len(ids[k]) - 1
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[k] or "").encode()), n, n > 512)


def test_op5(spark, folder, texts):
    want = helpers.repeats(list(texts.items()))
    for k, r in run(spark, folder, "op5_repeated_substrings", texts).items():
        n, runs, kept = want[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(runs), sha(kept))


def test_op6(spark, folder, texts):
    want = helpers.contamination(list(texts.items()), [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    for k, r in run(spark, folder, "op6_decontamination", texts).items():
        n, hit, items = want[k]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0)
        assert r.items_sha256 == sha(",".join(sorted(map(str, items))))


def test_op7(spark, folder, texts, monkeypatch):
    monkeypatch.setattr(pii, "fit", lambda docs: pickle.dumps(pii.Tagger().p))  # an untrained tagger: the columns matter here
    order = {kind: i for i, kind in enumerate(("email", "ip", "card", "phone", "secret"))}
    for k, r in run(spark, folder, "op7_personal_data", texts).items():
        base = pii.pattern_spans(texts[k] or "")
        listed = [f"{kind}:{a}:{z}" for kind, a, z in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == kind for s in base) for kind in list(order)[:4]]
        assert r.base_sha256 == sha(",".join(listed))
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert set(listed) <= {":".join(s) for s in spans} and spans == sorted(spans, key=lambda s: (order[s[0]], int(s[1])))
        assert (r.n_spans, r.n_added, r.n_secret) == (len(spans), len(spans) - len(base), sum(s[0] == "secret" for s in spans))


def test_op8(spark, folder, texts):
    want = helpers.near_duplicates(list(texts.items()))
    for k, r in run(spark, folder, "op8_minhash_near_duplicates", texts).items():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[k], want[k][1] == k)


def test_op9(spark, folder, texts):
    for k, r in run(spark, folder, "op9_toxicity", texts).items():
        assert r.held_out == (fold(k) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op10(spark, folder, texts, ids):
    got, at = run(spark, folder, "op10_token_files", texts), 0
    for k in sorted(ids):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        at += len(ids[k])
