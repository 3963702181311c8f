import re

import duckdb

from intakespark.llm import queries, source_mix
from intakespark.llm.mix_sql import OP2_SQL


def test_targets(spark):
    rows = [(None, 60), ("a", 600), ("b", 10), ("c", 0), ("\U0001f600", 30), ("z￿", 300)]
    got = {r.source: (r.weight, r.target) for r in source_mix.target_sizes(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    weights = [3, 1, 2, 3, 1, 2]
    order = ["a", "b", "c", "z￿", "\U0001f600", None]
    assert [got[s][0] for s in order] == weights
    sizes = dict(rows)
    target, capped = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        for s in order:
            target[s] = 2 * sizes[s] if s in capped else rest * weights[order.index(s)] / sum(weights[order.index(f)] for f in free)
        over = {s for s in free if target[s] >= 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert {s: round(got[s][1], 6) for s in order} == {s: round(target[s], 6) for s in order}
    assert abs(sum(t for _, t in got.values()) - 1500) < 1e-6


def test_small_cases(spark):
    df = spark.createDataFrame(
        [(1, "one two three", "a", 1), (1, "one two three", "a", 1), (2, None, "a", 1), (3, "", None, 1), (4, "x " * 5000, None, 1), (None, "p q", "b", 1), (5, " ", "b", 1)],
        "doc_id long, text string, source string, taken int",
    )
    mix = source_mix.plan_mix(df, ["doc_id"], block=16)
    rows = mix.taken().collect()
    assert len(rows) == 7 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for source in ("a", "b", None):
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target)
    again = source_mix.plan_mix(df, ["doc_id"], block=16).taken().collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    schedule = [r for r in mix.schedule.orderBy("position").collect()]
    assert sum(r.tokens for r in schedule) == sum(int(t) for t in {r.source: r.target for r in rows}.values())
    assert source_mix.plan_mix(df.limit(0), ["doc_id"]).taken().count() == 0
    assert source_mix.mix_documents(df.limit(0), ["doc_id"]).count() == 0


def test_schedule_spreads_sources(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "concat('s', id % 4) as source", "repeat('w ', 20) as text")
    schedule = source_mix.plan_mix(df, ["doc_id"], block=64).schedule.orderBy("position").collect()
    n = len(schedule)
    share = {s: sum(r.source == s for r in schedule) / n for s in ("s0", "s1", "s2", "s3")}
    for low in range(0, n - 200, 100):
        for s, p in share.items():
            assert abs(sum(r.source == s for r in schedule[low : low + 200]) - 200 * p) < 6


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(con.sql(OP2_SQL).fetchall())
    rows = queries.op2_source_mix(spark, d).collect()
    assert sorted(map(tuple, rows)) == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) and r.taken <= 2 * r["size"] for r in rows)


def test_mixed_documents(spark):
    df = spark.range(300).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat('w ', 30) as text", "1 as _copies")
    out = source_mix.mix_documents(df, ["doc_id"], block=32)
    assert out.columns == df.columns
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert counts["s0"] > counts["s2"] > counts["s1"]
    assert out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
