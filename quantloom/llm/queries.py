"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import codes, contentsort, decontam, hamming, merkle, minhash, ngram, packing, pii, repeats, resample, tokens, toxicity
from .common import fold, new_folder

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hamming.sign_codes(table(spark, sf_dir, "embeddings"))
    found = hamming.nearest(vectors, vectors.filter("id % 50 = 0"), k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "distance")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)
    return out.drop("ids")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram.train(docs.filter(fold() != 1), new_folder(spark, "ngram"))
    out = ngram.score(docs, model).withColumn("held_out", fold() == 1).withColumn("train_tokens", F.lit(model["tokens"]).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=512)


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.personal_data(docs, pii.fit(docs))
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select(
        "doc_id", *[count("base", k).alias(f"n_{k}") for k in pii.KINDS[:4]], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"), count("spans", "secret").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"),
    )


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=5, percent=75)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels.filter(fold() != 0))
    out = toxicity.score(docs, weights)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = codes.write_tokens(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), public_tokenizers.path(TOKENIZER))
    return codes.read_tokens(spark, shards, digest=True)


def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.exact_groups(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    forged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(forged, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    out = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": n_chars})
    proof = F.array_join(F.transform("proof", lambda x: F.lower(F.hex(x))), "")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", "verified")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024, longest=1, buckets=10_000)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = """
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.embedding[i] > 0) <> (e.embedding[i] > 0) AS INTEGER))) AS INTEGER) AS distance
      FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
       FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) WHERE len(w) >= n),
m AS (SELECT doc_id, dw.n AS n, i, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
      FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""


def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit."""
    code = f"hex(encode({text}))"
    half = lambda at: f"(strpos('0123456789ABCDEF', substr({code}, CAST({at} AS BIGINT), 1)) - 1)"
    octets = f"list_transform(range(0, strlen({text})), lambda i: 16 * {half('2 * i + 1')} + {half('2 * i + 2')})"
    bit = "lambda a, i: xor(a >> 1, 3988292384 * (a & 1))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, o: list_reduce(list_prepend(xor(c, o), range(8)), {bit})), 4294967295)"


def _code(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_code, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _tree_sql(name: str, base: str) -> str:
    return f"{name} AS (SELECT g, 0 AS level, idx, n, h FROM {base} UNION ALL SELECT g, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY g, level, idx // 2, n)"


def _fold_sql(name: str, base: str, tree: str) -> str:
    return f"""{name} AS (SELECT doc_id, g, 0 AS level, idx, n, h FROM {base}
      UNION ALL SELECT f.doc_id, f.g, f.level + 1, f.idx // 2, (f.n + 1) // 2, sha256(CASE WHEN f.idx % 2 = 0 THEN f.h || coalesce(t.h, '') ELSE t.h || f.h END)
      FROM {name} f LEFT JOIN {tree} t ON t.g = f.g AND t.level = f.level AND t.idx = xor(f.idx, 1) WHERE f.n > 1)"""


OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(':' || lang, '') AS g, {_leaf_sql('n_chars')} AS h,
      CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS start FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree_sql('t', 'leaves')},
tops AS (SELECT g AS name, h FROM t WHERE n = 1),
groups AS (SELECT name, '' AS g, h, row_number() OVER (ORDER BY name) - 1 AS idx, count(*) OVER () AS n FROM tops),
{_tree_sql('u', 'groups')},
{_fold_sql('f', '(SELECT doc_id, g, idx, n, start AS h FROM leaves)', 't')},
{_fold_sql('r', "(SELECT f.doc_id, '' AS g, s.idx, s.n, f.h FROM f JOIN groups s ON s.name = f.g WHERE f.n = 1)", 'u')},
side AS (SELECT l.doc_id, 0 AS tier, t.level, t.h FROM leaves l JOIN t ON t.g = l.g AND t.idx = xor(l.idx >> t.level, 1)
      UNION ALL SELECT l.doc_id, 1, u.level, u.h FROM leaves l JOIN groups s ON s.name = l.g JOIN u ON u.idx = xor(s.idx >> u.level, 1)),
p AS (SELECT doc_id, string_agg(h, '' ORDER BY tier, level) AS proof FROM side GROUP BY doc_id)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, top.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, r.h AS folded_root, r.h = top.h AS verified
FROM leaves l JOIN groups s ON s.name = l.g JOIN u top ON top.n = 1 JOIN r ON r.doc_id = l.doc_id AND r.n = 1 LEFT JOIN p ON p.doc_id = l.doc_id
"""


def _features_sql(table: str) -> str:
    return rf"SELECT {{}}, unnest(list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM {table}"


OP13_SQL = f"""
WITH a AS (SELECT doc_id, w, count(*) AS n FROM ({_features_sql('documents').format('doc_id')}) GROUP BY ALL),
b AS (SELECT w, count(*) AS n FROM ({_features_sql('benchmark').format('item_id')}) GROUP BY w),
words AS (SELECT w, {_crc32('w')} % 10000 AS k FROM (SELECT DISTINCT w FROM (SELECT w FROM a UNION ALL SELECT w FROM b))),
s AS (SELECT k, sum(n) AS s FROM a JOIN words USING (w) GROUP BY k),
t AS (SELECT k, sum(n) AS t FROM b JOIN words USING (w) GROUP BY k),
total AS (SELECT (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM a) AS s_all, (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM b) AS t_all),
gains AS (SELECT s.k, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.k = t.k, total),
w AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM a JOIN words USING (w) JOIN gains USING (k) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN w USING (doc_id)),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT x.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank
FROM x LEFT JOIN r ON r.doc_id = x.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_hamming_top_k, op2_best_fit_packing, op3_lm_scores, op4_token_counts, op5_repeated_substrings, op6_decontamination, op7_personal_data, op8_minhash_near_duplicates, op9_toxicity, op10_token_files, op11_exact_duplicates, op12_merkle_manifest, op13_importance_resampling)
}
ORACLE: dict[str, str] = {"op1_hamming_top_k": OP1_SQL, "op6_decontamination": OP6_SQL, "op8_minhash_near_duplicates": OP8_SQL, "op11_exact_duplicates": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_importance_resampling": OP13_SQL}
