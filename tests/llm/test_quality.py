import zlib

import numpy as np

from intakespark.llm import quality as Q
from intakespark.llm import queries


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.op4_quality(spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(seen) > 700 and np.mean([a == b for a, b in seen]) > 0.98
    assert np.mean([a for a, b in seen if b == 1]) > 0.99


def test_features_do_not_depend_on_stretches(monkeypatch):
    text = (" ".join(f"word{k % 97} é\n" for k in range(3000)) + "x" * 5000).encode()
    whole = np.sort(np.concatenate(list(Q.features(text))))
    monkeypatch.setattr(Q, "_STRETCH", 1000)
    assert (np.sort(np.concatenate(list(Q.features(text)))) == whole).all()


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, " \n ", 9.0), (4, "good text here", 9.0), (4, "good text here", 9.0), (None, "x " * 200_000, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, 1), (None, 1), (2, None), (3, 0)], "doc_id long, quality int")
    model = Q.fit(df, labels)
    rows = Q.score(df, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and len({r.score for r in rows if r.doc_id == 4}) == 1
    none = Q.fit(df, labels.limit(0))
    assert {round(r.score, 6) for r in Q.score(df, none).collect()} == {0.5}
    assert Q.score(df.limit(0), none).count() == 0
