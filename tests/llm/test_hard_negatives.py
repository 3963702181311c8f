import numpy as np
import pytest
from pyspark.sql import functions as F

from intakespark.llm import hard_negatives as hn


def brute(rows, every, positives=5, negatives=10, low=30, high=90):
    """All scores by plain loops over valid (id, label, vector) rows; a row never meets itself."""
    good = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, y, q) in enumerate(good):
        if i % every:
            continue
        scores = [(-sum(x * z for x, z in zip(q, v)), j, m == y) for b, (j, m, v) in enumerate(good) if a != b and len(v) == len(q)]
        for s, p, _ in sorted(x for x in scores if x[2])[:positives]:
            window = sorted((t, n) for t, n, same in scores if not same and low * -s <= 100 * -t <= high * -s)
            out += [(i, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(window[:negatives])]
    return sorted(out)


def mined(df, every, **kw):
    got = hn.mine_hard_negatives(df, F.col("vec_id") % every == 0, **kw)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("n, labels, spread, dim", [(60, 3, 1.0, 5), (400, 4, 0.3, 70), (300, 300, 0.5, 33), (200, 1, 0.5, 4), (150, 2, 0.0, 64)])
def test_equals_brute_force(spark, monkeypatch, n, labels, spread, dim):
    monkeypatch.setattr(hn, "ROW_BLOCK", 40)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 4)
    rng = np.random.default_rng(n)
    hot = rng.normal(size=dim)
    rows = [(k, int(rng.integers(labels)), [float(x) for x in hot + spread * rng.normal(size=dim)]) for k in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    expected = brute(rows, 7)
    assert mined(df, 7) == expected and bool(expected) == (labels > 1 and spread > 0)


def test_ties(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROW_BLOCK", 16)
    rng = np.random.default_rng(9)
    rows = [(int(i), int(rng.integers(3)), [float(x) for x in rng.integers(0, 3, size=4)]) for i in rng.integers(0, 90, size=140)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    assert mined(df, 10) == brute(rows, 10)


def test_panels(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROW_BLOCK", 30)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hn, "PANEL_SCORES", 1_500)
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(3)), [float(x) for x in 1 + rng.normal(size=6)]) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    assert mined(df, 5, positives=2, negatives=3) == brute(rows, 5, 2, 3)


def test_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, None), (2, 1, [None, 1.0]), (3, 2, [float("nan"), 1.0]), (4, 2, [float("inf"), 0.0]), (None, 1, [1.0, 1.0]), (5, None, [1.0, 2.0]),
        (6, 1, [1.0]), (7, 1, [1.0, 2.5]), (8, 2, [0.5, 0.5]), (8, 2, [0.5, 0.5]), (0, 1, [1.0, 2.0]), (9, 3, [0.25, 1.0]), (100, 2, [0.5, 0.75]), (200, 4, [1.0, 1.0]), (300, 1, []), (12, 2, [0.6, 0.6]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("uid", F.lit(1)).withColumn("names", F.lit("x"))
    expected = brute(rows, 100)
    assert expected and mined(df, 100) == expected
    for none in (df.limit(0), df.where("vec_id = 7")):
        assert mined(none, 100) == []


def test_window_and_sums():
    for s in (-7, 0, 1, 99, 101, 10**18):
        low, high = hn.window_bounds(s, 30, 90)
        assert 30 * s <= 100 * low < 30 * s + 100 and 90 * s - 100 < 100 * high <= 90 * s
    assert (hn.add_tiles([np.array([[1 << 62]]), np.array([[-5]], np.int8)]) == (1 << 62) - 5).all()
    with pytest.raises(OverflowError):
        hn.add_tiles([np.array([[1 << 62]]), np.array([[1 << 62]])])


def test_grid_sends_least():
    for anchors, rows, tasks in ((1, 1, 16), (10, 1000, 400), (50, 50, 64), (3, 7, 1000)):
        down, across = hn.grid(anchors, rows, 2, tasks)
        assert 1 <= down <= anchors and 1 <= across <= rows
    assert hn.grid(10, 1000, 2, 800) == (2, 200)


def test_what_does_not_fit_raises(spark):
    df = spark.createDataFrame([(0, 1, [1e12, 1.0]), (1, 1, [1e12, 2.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="do(es)? not fit 64 bits"):
        mined(df, 100)
