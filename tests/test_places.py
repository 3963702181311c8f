"""Places over ranges of sampled keys, and the load report from one scan."""

import random

from pyspark.sql import functions as F

from intakespark.operators.cleaning import place_contacts, sort_columns, sort_contacts
from intakespark.operators.places import dealt_by_range, with_place
from intakespark.operators.reports import placed_by
from intakespark.sources.contacts import load_report
from intakespark.sources.settings import FIELDS


def test_places_as_sorted(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice([None, 1.5, 1.5, 1.5, -3.0, rnd.random()]), "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "row long, score double, k0 string").repartition(7)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for parts in (2, 5, 40):
        got = placed_by(df, "score", parts).orderBy("place").collect()
        assert [r.row for r in got] == [r[0] for r in want] and [r.place for r in got] == list(range(1, 3001))
        assert got[0].k0 == "x"
    assert placed_by(df.limit(0), "score").count() == 0
    assert [r.place for r in placed_by(df.where("row = 5"), "score", 9).collect()] == [1]


def test_equal_keys_are_spread(spark):
    """All rows but a few have one bad identifier: parts are told apart by the rows' numbers."""
    df = spark.range(40_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("L-"), F.col("id"))).otherwise("see the notes").alias("lead_id"))
    placed = place_contacts(df, parts=8)
    assert placed.agg(F.sum("place"), F.max("place")).first()[0] == 40_000 * 40_001 // 2
    assert [r.seq for r in placed.where("place <= 402").orderBy("place").collect()] == [r.seq for r in placed.orderBy(*sort_columns()).limit(402).collect()]
    sizes = sorted(r["count"] for r in dealt_by_range(df, [F.col("lead_id"), F.col("seq")], 8).groupBy("_part").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    tasks = sorted(r["count"] for r in placed.groupBy(F.spark_partition_id().alias("task")).count().collect())
    assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[4]


def test_rows_without_keys_and_repeats(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1), (1, None), (1, 1)], "a int, b int")
    got = [(r.place, r.a, r.b) for r in with_place(df, [F.col("a"), F.col("b")], parts=3).orderBy("place").collect()]
    assert got == [(1, None, 1), (2, None, 1), (3, 1, None), (4, 1, 1), (5, 2, 1)]


def contact_rows(spark, rows):
    cols = ["seq long", *(f"{f} string" for f in FIELDS)]
    return spark.createDataFrame([(k, *(r.get(f, "") for f in FIELDS)) for k, r in enumerate(rows)], ", ".join(cols))


def test_load_report_from_one_scan(spark, tmp_path):
    rows = [{"lead_id": f"L-{k % 30}", "created": f"{k % 28 + 1}/{k % 12 + 1}/2024" if k % 2 else "2024-01-02"} for k in range(200)]
    rows += [{"lead_id": "test", "created": "01.31.2024"} for _ in range(20)] + [{"lead_id": None, "created": None}, {"lead_id": "?", "created": "31-01-2024"}, {"lead_id": "", "created": "01.31.2024"}]
    contact_rows(spark, rows).write.parquet(str(tmp_path / "c"))
    table = spark.read.parquet(str(tmp_path / "c"))
    r = load_report(table).first()
    assert (r.rows_in_file, r.rows_loaded, r.rows_dropped, r.dropped_examples) == (223, 203, 20, "test,test,test,test,test")
    assert (r.date_order_policy, r.duplicate_ids) == ("-=day_first,.=month_first,/=day_first", 170)
    empty = load_report(table.limit(0)).first()
    assert tuple(empty)[:4] == (0, 0, 0, "") and (empty.date_order_policy, empty.duplicate_ids) == ("", 0)


def test_one_scan_in_the_plan(spark, tmp_path, capsys):
    from pyspark.sql import Observation

    from intakespark.sources.contacts import _counted
    from intakespark.sources.settings import DROP

    contact_rows(spark, [{"lead_id": "L-1"}]).write.parquet(str(tmp_path / "c"))
    _counted(spark.read.parquet(str(tmp_path / "c")), DROP, None, Observation()).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_reversed_places(spark):
    """The whole order turned round, ties in file order, as sorting says; the same for any number of parts."""
    ids = ["L-7", "L-12", "l 12", "L-0012-dup", "header", "see notes", None, "", "ACM-12", "99"]
    df = spark.createDataFrame([(k, ids[k * 7 % len(ids)]) for k in range(500)], "seq long, lead_id string").repartition(5)
    for invalid_last in (True, False):
        want = [r.seq for r in sort_contacts(df, reverse=True, invalid_last=invalid_last).collect()]
        for parts in (2, 7, 40):
            got = place_contacts(df, parts=parts, invalid_last=invalid_last, reverse=True).orderBy("place").collect()
            assert [r.seq for r in got] == want and [r.place for r in got] == list(range(1, 501))
    assert place_contacts(df.limit(0), reverse=True).count() == 0
