"""Sparse vectors and searches against plain loops."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import retrieval


def brute_vector(text, dimensions=384):
    n = Counter(int(hashlib.md5(w.encode()).hexdigest(), 16) % dimensions for w in (text or "").lower().split())
    norm = math.sqrt(sum(x * x for x in n.values()))
    return {b: x / norm for b, x in n.items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["Été", "漢字", "w1", "w2"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + [None, "", "  ", "w5", "w5", "W5 w5", "x " * 20_000]


def test_sparse_vectors_equal_a_loop(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {r["id"]: dict(zip(r["buckets"], r["weights"], strict=True)) for r in retrieval.sparse_vectors(rows, "id").collect()}
    want = {i: v for i, t in enumerate(texts) if (v := brute_vector(t))}
    assert got.keys() == want.keys() and all(got[i].keys() == want[i].keys() and all(abs(got[i][b] - x) < 1e-12 for b, x in want[i].items()) for i in want)
    assert {(r["id"], r["bucket"]) for r in retrieval.embed(rows, "id").collect()} == {(i, b) for i, v in want.items() for b in v}


@pytest.mark.parametrize("block", [8192, 20])
@pytest.mark.parametrize("scope", [None, "scope"])
def test_sparse_top_k_equals_a_loop(spark, texts, monkeypatch, block, scope):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "id int, text string, scope int")
    vectors = retrieval.sparse_vectors(rows, "id").join(rows.select("id", "scope"), "id")
    asked = vectors.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    got = [(r["query_id"], r["id"], r["rank"]) for r in retrieval.sparse_top_k(asked, vectors, 5, key="id", scope=scope).orderBy("query_id", "rank").collect()]
    known, want = {i: v for i, t in enumerate(texts) if (v := brute_vector(t))}, []
    for q in sorted(i for i in known if i % 4 == 0):
        scores = [(round(sum(x * known[i].get(b, 0.0) for b, x in known[q].items()), 9), i) for i in known if scope is None or i % 3 == q % 3]
        best = sorted(((s, i) for s, i in scores if s >= 1e-9), key=lambda x: (-x[0], x[1]))[:5]
        want += [(q, i, k + 1) for k, (_, i) in enumerate(best)]
    assert got == want


def test_rows_of_buckets_give_the_same(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    flat = retrieval.embed(rows, "chunk_id")
    asked = flat.where("chunk_id < 9").select(F.col("chunk_id").alias("query_id"), "bucket", F.col("weight").alias("q_weight"))
    listed = retrieval.sparse_vectors(rows, "chunk_id")
    shown = lambda df: sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in df.collect())
    assert shown(retrieval.top_by_words(asked, flat, 4)) == shown(retrieval.sparse_top_k(listed.where("chunk_id < 9").withColumnRenamed("chunk_id", "query_id"), listed, 4))


def test_no_texts(spark):
    none = spark.createDataFrame([(1, None), (2, " ")], "chunk_id int, text string")
    vectors = retrieval.sparse_vectors(none, "chunk_id")
    assert vectors.count() == 0 and retrieval.sparse_top_k(vectors.withColumnRenamed("chunk_id", "query_id"), vectors, 3).count() == 0
