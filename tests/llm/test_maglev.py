from collections import Counter

import pytest

from intakespark.llm import maglev


def by_turns(shards, slots):
    """Plain statement of the filling rule."""
    order = [[(maglev._number(f"offset:{s}") + j * (maglev._number(f"skip:{s}") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    owner = {}
    while len(owner) < slots:
        for k, pref in enumerate(order):
            if len(owner) < slots:
                owner[next(x for x in pref if x not in owner)] = k
    return [owner[x] for x in range(slots)]


def test_fill_matches_turns():
    shards = [f"s{k}" for k in range(7)]
    assert maglev.fill_table(shards, 101) == by_turns(shards, 101)


def test_even_and_stable():
    shards = [f"s{k}" for k in range(20)]
    a = maglev.fill_table(shards, 2003)
    assert max(Counter(a).values()) - min(Counter(a).values()) <= 1
    b = maglev.fill_table(shards[:-1], 2003)
    assert sum(x != y for x, y in zip(a, b) if x != 19) < 0.15 * 2003


@pytest.mark.parametrize("shards, slots", [([], 11), (["a", "a"], 11), (["a"], 12), (["a", "b", "c"], 2)])
def test_bad_tables(shards, slots):
    with pytest.raises(ValueError):
        maglev.fill_table(shards, slots)


def test_rows(spark):
    df = spark.createDataFrame([(None, "n", 1), (5, "a", 2), (5, "b", 3), (6, "c", 4)], "doc_id long, text string, shard int")
    rows = maglev.assign_shards(df, "doc_id").collect()
    assert len(rows) == 4 and all(0 <= r.shard < 64 for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert maglev.assign_shards(df.limit(0), "doc_id").count() == 0
    hot = spark.range(3000).selectExpr("id as doc_id", "'same' as source")
    assert maglev.assign_shards(hot, "source").select("shard").distinct().count() == 1
    assert maglev.assign_shards(hot, "source", spread_by="doc_id", spread=256).select("shard").distinct().count() > 40
