"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codefacts.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def vectors(spark, n=1500, d=16, seed=1):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, d)) * r.uniform(0.1, 2, size=(n, 1)) / 4).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[0]  # a quarter of all rows are one vector
    return x, spark.createDataFrame([(i, v.tolist(), 0, 0.0, 0) for i, v in enumerate(x)], SCHEMA)


def odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 2.0], 0, None, None), (2, None, 0, 0.0, 0), (3, [0.0, 0.0, 0.0], 0, 0.0, 0), (4, [float("nan"), 1.0, 1.0], 0, 0.0, 0), (5, [None, 1.0, 1.0], 0, 0.0, 0), (6, [float("inf"), 1.0, 1.0], 0, 0.0, 0), (7, [1.0], 0, 0.0, 0), (8, [1.0, 0.0, 2.5], 0, 0.0, 0), (8, [1.0, 0.0, 2.5], 0, 0.0, 0), (None, [1.0, 0.0, 2.0], 0, 0.0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_neighbours_recall_and_exact_scores(spark):
    x, rows = vectors(spark)
    got: dict[int, list] = {}
    for r in ann.search(rows, F.col("vec_id") % 50 == 0, part=256).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    y = x.astype(float)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert np.allclose([f[2] for f in found], [np.sqrt(((y[v] - y[q]) ** 2).sum()) for _, v, _ in found], rtol=0, atol=1e-12)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        bar = np.sort(d)[9]
        hit += sum(s <= bar + 1e-12 for _, _, s in found)
        total += 10
    assert len(got) == 30 and hit / total >= 0.9


@pytest.mark.parametrize("shape", ["lengths", "wide", "copies"])
def test_neighbours_are_the_nearest_on_other_rows(spark, shape):
    """Vectors that codes can't tell apart: of very different lengths, without clusters in many dimensions, or near and exact copies."""
    r = np.random.default_rng(5)
    x = r.normal(size=(2500, 256 if shape == "wide" else 32))
    if shape == "lengths":
        x *= r.lognormal(0, 3, size=(2500, 1))
    elif shape == "copies":
        x[500:1500] = x[0] + r.normal(size=(1000, 32)) * 1e-4
        x[2000:] = x[1]
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), 0, 0.0, 0) for i, v in enumerate(x)], SCHEMA)
    got: dict[int, list] = {}
    for a in ann.search(rows.union(rows.filter("vec_id < 200")), F.col("vec_id") % 100 == 0, part=400).orderBy("query_id", "rank").collect():
        got.setdefault(a["query_id"], []).append((a["score"], a["vec_id"]))
    y = x.astype(float)
    for q in range(0, 2500, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(2500), d))[:10]
        assert got[q] == list(zip(d[order].tolist(), order.tolist(), strict=True)), q


def test_equal_vectors_tie_to_the_smaller_id(spark):
    x, rows = vectors(spark)
    first = [r["vec_id"] for r in ann.search(rows, F.col("vec_id") == 0, part=128).orderBy("rank").collect()]
    assert first == list(range(750, 760))


def test_products_equal_brute_force(spark):
    x, rows = vectors(spark)
    v = np.floor(x.astype(float) * 256).astype(np.int64)
    got: dict[int, list] = {}
    for r in topk.top_products(rows.union(rows.filter("vec_id < 300")), F.col("vec_id") % 50 == 0, block=200, chunk=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 1500, 50):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:5]
        assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(order)]


def test_odd_vectors(spark):
    near = sorted((r["query_id"], r["vec_id"], r["rank"]) for r in ann.search(odd_vectors(spark), F.lit(True)).collect())
    assert near == [(1, 8, 1), (8, 1, 1)]
    top = sorted((r["query_id"], r["vec_id"]) for r in topk.top_products(odd_vectors(spark), F.lit(True), k=2).select("query_id", "vec_id").distinct().collect())
    assert top == [(1, 3), (1, 8), (3, 1), (3, 8), (8, 1), (8, 3)]
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.search(empty, F.lit(True)).count() == 0 and topk.top_products(empty, F.lit(True)).count() == 0


def test_recall_on_the_given_vectors(spark):
    """At least 0.9 of the true ten nearest with the query's own parameters."""
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("needs the given tables")
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    given = [r for r in rows.collect() if r["embedding"] is not None and None not in r["embedding"]]
    ids, x = np.array([r["vec_id"] for r in given]), np.array([r["embedding"] for r in given], float)
    got: dict[int, list] = {}
    for r in ann.op3_ivf_pq_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += (np.array(found) <= np.sort(d)[9] + 1e-12).sum()
    assert len(got) == (ids % 100 == 0).sum() and hit >= 0.9 * 10 * len(got)
