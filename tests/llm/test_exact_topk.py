import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from intakespark.llm import exact_topk


def brute(rows, k, every):
    """All scores by plain loops over valid rows; a row never meets itself."""
    good = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            found = sorted((-int(q @ v), j) for b, (j, v) in enumerate(good) if a != b and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("n, spread", [(30, 1.0), (700, 0.2), (700, 0.0)])
def test_equals_brute_force(spark, n, spread):
    rng = np.random.default_rng(n)
    hot = rng.normal(size=6)
    rows = [(k, [float(x) for x in (hot + spread * rng.normal(size=6))]) for k in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, exact_topk.exact_top_k(df, k=7, every=10).collect()))
    assert got == brute(rows, 7, 10)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (6, [1.0]), (0, [1.0, 2.0]), (-20, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("body", F.lit("x"))
    got = sorted(map(tuple, exact_topk.exact_top_k(df).collect()))
    assert got == brute(rows, 20, 20)
    assert exact_topk.exact_top_k(df.limit(0)).count() == 0


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 64)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["vec_id", "embedding"])
    v = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64)
    order, nodes = exact_topk.build_tree(v, 16)
    ids, own = np.arange(400)[order], v[order]
    skip = np.flatnonzero(ids % 20 == 0)
    start = np.full(len(skip), exact_topk.NONE, np.int64)
    best, name = exact_topk.search(own[skip], skip, start, ids, own, nodes, 5)
    got = sorted((int(ids[s]), n + 1, int(name[a, n]), int(best[a, n])) for a, s in enumerate(skip) for n in range(5))
    assert batch.num_rows == 400 and got == brute(rows, 5, 20)


def test_what_does_not_fit_raises(spark):
    for big in (1e300, 1e12):
        df = spark.createDataFrame([(0, [big, 1.0]), (20, [big, 2.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="do(es)? not fit 64 bits"):
            exact_topk.exact_top_k(df).collect()


@pytest.mark.parametrize("size, dim", [(1e8, 16), (1e6, 64), (1e3, 5)])
def test_bound_holds_where_products_cancel(size, dim):
    """One-row shards of large vectors with small products, and a start that equals the row's own score: the row must still be found."""
    rng = np.random.default_rng(int(size))
    kept = 0
    for _ in range(3_000):
        q = np.rint(size * rng.normal(size=dim)).astype(np.int64)
        v = np.rint(size * rng.normal(size=dim)).astype(np.int64)
        k = int(np.argmax(np.abs(q)))
        v[k] = 0
        v[k] = -(int(q @ v) // int(q[k]))
        score = int(q.astype(object) @ v.astype(object))
        _, nodes = exact_topk.build_tree(v[None])
        best, name = exact_topk.search(q[None], np.array([-1]), np.array([score]), np.array([7]), v[None], nodes, 1)
        kept += (int(best[0, 0]), int(name[0, 0])) == (score, 7)
    assert kept == 3_000


@pytest.mark.parametrize("size", [1e8, 1e5])
def test_large_components_equal_brute_force(spark, size):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=(4, 8))
    rows = [(k, [float(x) for x in np.rint(size * (hot[k % 4] + 1e-6 * rng.normal(size=8))) / 64]) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, exact_topk.exact_top_k(df, k=5, every=20).collect())) == brute(rows, 5, 20)
