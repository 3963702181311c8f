import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from intakespark.llm import centroids, queries


def brute(rows, k, rounds, dim, scale=256, seed=2):
    """Plain clustering of (id, vector) rows: every distance in full."""
    good = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)[:k]
    now = [v for _, v in first]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in good] if now else []
        for j in range(len(now)):
            mine = [v for (_, v), c in zip(good, own) if c == j]
            if mine:
                now[j] = [sum(x) // len(mine) for x in zip(*mine)]
    if not now:
        return [], []
    last = [(i, *near(v)) for i, v in good]
    total = sum(d for _, d, _ in last)
    each = {j: sum(d for _, d, c in last if c == j) for j in range(len(now))}
    out = [(i, c, d, each[c], total, hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, d, c in last]
    return sorted(out, key=repr), now


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("n, spread", [(5, 1.0), (300, 0.1), (300, 1.0), (120, 0.0)])
def test_equals_brute_force(spark, n, spread):
    rng = np.random.default_rng(n)
    hot = rng.normal(size=(3, 11))
    rows = [(k, [float(x) for x in hot[k % 3] + spread * rng.normal(size=11)]) for k in range(n)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), k=7, rounds=4, dim=11)
    expected, now = brute(rows, 7, 4, 11)
    assert rows_of(got.vectors) == expected and got.centroids == now


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("-inf"), 0.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (6, [1.0]), (0, [1.0, 2.0]), (0, [-3.0, 2.5]), (-20, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("units", F.lit("x")).withColumn("cluster", F.lit(9))
    assert rows_of(centroids.cluster(df, k=3, rounds=2, dim=2).vectors) == brute(rows, 3, 2, 2)[0]
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id IS NULL")):
        assert centroids.cluster(none, k=3, dim=2).vectors.count() == 0


def test_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in np.round(4e5 * rng.normal(size=5), 2)]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(centroids.cluster(df, k=6, rounds=3, dim=5).vectors) == brute(rows, 6, 3, 5)[0]
    huge = spark.createDataFrame([(0, [1e9, 1.0]), (1, [-1e9, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit 64 bits"):
        centroids.cluster(huge, k=1, rounds=0, dim=2).vectors.collect()


def test_search_abandons_and_breaks_ties():
    rng = np.random.default_rng(2)
    c = rng.integers(-200, 200, size=(40, 64))
    c[9], c[30] = c[3], c[3]
    v = np.concatenate([c[rng.integers(0, 40, 500)] + rng.integers(-20, 20, size=(500, 64)), c])
    order = np.argsort(-v.var(axis=0), kind="stable")
    full = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    at, distance, terms = centroids.nearest(v, c, order)
    assert (at == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert terms < 0.4 * full.size * 64
    exact = centroids.nearest_exact(v[:50], c, order)
    assert (exact[0] == at[:50]).all() and list(exact[1]) == distance[:50].tolist() and exact[2] < 50 * 40 * 64


def test_query_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    v = [(i, x) for i, x in rows if x is not None]
    got = rows_of(queries.op12_centroids(spark, d))
    # numpy in place of plain sums, as there are 500 vectors of 64 components
    good = [(i, np.floor(256 * np.array(x, np.float64)).astype(np.int64)) for i, x in v if len(x) == 64 and all(y is not None and np.isfinite(y) for y in x)]
    m = np.array([x for _, x in good])
    now = np.array([x for _, _, x in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), n, x) for n, (i, x) in enumerate(good))[:40]])
    for step in range(6):
        far = ((m[:, None, :] - now[None]) ** 2).sum(axis=2)
        own = far.argmin(axis=1)
        if step < 5:
            now = np.array([m[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else now[j] for j in range(len(now))])
    low = far.min(axis=1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    assert got == sorted(((i, int(c), int(d), int(low[own == c].sum()), int(low.sum()), sha[c]) for (i, _), c, d in zip(good, own, low)), key=repr)
