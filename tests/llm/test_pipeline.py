"""Near duplicates in the pipeline over tables with repeated and null ids."""

from collections import Counter

import helpers

import corpus_pipeline

WORDS = [f"w{i}" for i in range(40)]
COPY, NEAR, OTHER, THIRD = " ".join(WORDS), " ".join([*WORDS, "x"]), " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(20))


def test_repeated_and_null_ids(spark):
    rows = [
        (1, OTHER, "a"), (1, COPY, "a"), (1, COPY, "b"), (2, NEAR, "a"), (3, OTHER, "a"),  # id 1 has two texts; the copy of each goes
        (None, THIRD, "a"), (None, THIRD, "b"), (None, THIRD + " x", "a"), (None, COPY, "a"),  # copies without id
        (None, "", "a"), (None, "", "a"), (None, None, "a"), (4, "", "a"), (5, None, "a"),  # without words: all stay
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [corpus_pipeline.keep_distinct(spark, docs.repartition(n), helpers.SF).collect() for n in (1, 5)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    left = Counter((r.doc_id, r.text) for r in got[0] if not (r.text or "").startswith("u"))
    assert left == Counter({(1, OTHER): 1, (1, COPY): 1, (None, ""): 2, (None, None): 1, (4, ""): 1, (5, None): 1})
    assert sum((r.text or "").startswith("u") for r in got[0]) == 1
