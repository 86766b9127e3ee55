import random

import brute
import numpy as np
import pytest

from pathloom.llm import topk as K


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec string")


def want(rows, k):
    vectors = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            vectors[i] = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
    return brute.top(vectors, [i for i in vectors if i % 10 == 0], k)


def found(spark, rows, k=10, parts=3):
    df = table(spark, rows).repartition(parts)
    return sorted(tuple(r) for r in K.top_k(df, df.where("vec_id % 10 = 0"), k).collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], "x") for i in range(700)]
    rows += [(1000 + i, [0.5] * 8, "x") for i in range(300)] + [(2000 + i, [0.0] * 8, "x") for i in range(30)]
    rows += [(3000, None, "x"), (3001, [], "x"), (3010, [None] * 8, "x"), (3020, [float("nan")] + [1.0] * 7, "x"), (3030, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (3040, [1.0, 2.0], "x"), (3041, [3.0, -2.0], "x")]
    monkeypatch.setattr(K, "QUERIES", 60)
    assert found(spark, rows) == want(rows, 10)
    monkeypatch.setattr(K, "GROUP_VALUES", 500)
    assert found(spark, rows) == want(rows, 10)
    assert found(spark, rows, 3, 1) == want(rows, 3)


def test_large_numbers(spark):
    rows = [(i, [float(3e15 + i * 1e9), -1.0, 2e14], "x") for i in range(0, 40)]
    assert found(spark, rows, 5) == [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in sorted_saturated(rows, 5)]


def sorted_saturated(rows, k):
    vectors = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v, _ in rows}
    out = []
    for q in (i for i in vectors if i % 10 == 0):
        scores = {i: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(vectors[q], v, strict=True)))) for i, v in vectors.items() if i != q}
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


def test_repeated_and_few(spark):
    rows = [(10, [1.0, 0.0], "x"), (10, [1.0, 0.0], "x"), (11, [2.0, 0.0], "x"), (11, [2.0, 0.0], "x"), (12, [-1.0, 5.0], "x")]
    assert found(spark, rows) == [(10, 1, 11, 2097152), (10, 2, 12, -1048576)]


def test_an_invalid_row_does_not_take_the_place_of_a_valid_one(spark):
    rows = [(10, None, "x"), (10, [float("nan"), 1.0], "x"), (10, [1.0, 0.0], "x"), (11, [2.0, 0.0], "x"), (20, [None, 1.0], "x"), (20, [0.0, 1.0], "x")]
    assert found(spark, rows) == [(10, 1, 11, 2097152), (10, 2, 20, 0), (20, 1, 10, 0), (20, 2, 11, 0)]


def test_jobs_do_not_depend_on_the_queries(spark):
    rng = random.Random(3)
    rows = [(10 * i, [rng.gauss(0, 1) for _ in range(3)], "x") for i in range(3000)]
    jobs = []
    for n in (30, 3000):
        spark.sparkContext.setJobGroup(f"queries-{n}", "")
        found(spark, rows[:n])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"queries-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] <= 12


def test_empty(spark):
    assert found(spark, [(1, None, "x")]) == []
    df = table(spark, [(1, [1.0], "x")]).where("false")
    assert K.top_k(df, df).count() == 0


def test_boxes_bound_products():
    rng = np.random.default_rng(2)
    v = np.floor(1024 * rng.standard_normal((2000, 6)))
    tree = K.Tree(v, np.arange(2000), 10)
    q = np.floor(1024 * rng.standard_normal((5, 6)))
    allowed = tree.bounds(q)
    for node, leaf in enumerate(tree.leaf):
        if leaf is not None:
            assert len(leaf[0]) <= K.LEAF
            assert ((leaf[0] @ q.T).max(0) <= allowed[:, node]).all()


@pytest.mark.parametrize("n", [1, 2, 257])
def test_equal_vectors_are_one_leaf(n):
    tree = K.Tree(np.ones((n, 3)), np.arange(n)[::-1].copy(), 10)
    assert list(tree.leaf[0][1]) == list(range(min(n, 11)))
