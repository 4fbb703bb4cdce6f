"""Unlike rows under one id lose no link, no candidate and no text."""

import random

import numpy as np

from duelframe.llm import near_text, near_vectors, vector_search
from pyspark.sql import functions as F


def words(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def nearly(text):
    return [*text[:-1], "changed"]


def test_texts(spark):
    a, b, c = words(1), words(2), words(3)
    rows = [(1, a), (1, b), (2, nearly(a)), (3, nearly(b)), (4, c), (4, c), (5, nearly(c)), (6, words(4))]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    found = near_text.near_duplicates(docs, words=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6)]
    kept = near_text.keep_one(docs, 3, 85).collect()
    assert sorted((r.doc_id, r.text[:6]) for r in kept) == sorted([(1, a[0]), (1, b[0]), (4, c[0]), (6, words(4)[0])])


def test_a_text_that_is_no_copy_stays(spark):
    a, b = words(1), words(2)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in [(2, a), (2, b), (1, nearly(a))]], "doc_id long, text string")
    kept = near_text.keep_one(docs, 3, 85).collect()
    assert sorted((r.doc_id, r.text[:6]) for r in kept) == [(1, a[0]), (2, b[0])]
    assert {(r.doc_id, r.component_id) for r in near_text.near_duplicates(docs, words=3, percent=85).collect()} == {(1, 1), (2, 1)}


def test_search(spark):
    rows = [(100, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.1, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (200, [0.0, 1.0]), (200, [0.2, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector_search.top_k_search(df, F.col("vec_id") % 100 == 0, k=4).collect()
    whole = [(k, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for k, v in rows]
    want = []
    for n, (k, v) in enumerate(whole):
        if k % 100 == 0:
            scores = sorted((-int(v @ w), j) for m, (j, w) in enumerate(whole) if m != n)[:4]
            want += [(k, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.01], "a"), (3, [0.01, 1.0], "a"), (4, [-1.0, 0.0], "a"), (4, [-1.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = near_vectors.near_duplicate_vectors(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (4, 0, 4)]


def test_a_repeated_sampled_id_brings_one_text(spark, monkeypatch):
    """Thousands of rows under a sampled id, some of them long, do not grow what the driver learns from."""
    from duelframe.llm import toxicity

    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, marked, rate: seen.append((texts, list(marked))) or 0.5)
    rows = [(1, f"text {k} of one id") for k in range(3000)] + [(1, "x" * (toxicity.SAMPLE_CHARS + 1)), (2, "another one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    toxicity.learn(docs, marks)
    assert seen == [(["text 0 of one id", "another one"], [1, 0])]
