"""What a query costs a row and a task, by plans and partitions: figures that grow with the table only where they must."""

import time

import pytest
from pyspark.sql import functions as F

from intakespark.functions.amounts import PERIODS, parse_amount
from intakespark.functions.contacts import ID_PATTERN, group_numbers, parse_lead_id
from intakespark.operators import reports
from intakespark.operators.cleaning import mark_duplicates
from intakespark.operators.intent import _firsts, _Places, extract_intent
from intakespark.operators.lexicon import load_lexicon
from intakespark.plans import catalog
from intakespark.sources import shared
from intakespark.sources.synthetic import contacts

SF = "/root/testdata/sf0.001"


def optimised(df) -> str:
    """The optimised plan with nothing left out."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        conf.unset("spark.sql.debug.maxToStringFields")


def test_contradictions_read_each_note_once(spark):
    notes = spark.createDataFrame([(1, "We don't have money to spend, but the budget is approved."), (2, ""), (3, None)], "seq long, notes string")
    found = reports.contradictions(extract_intent(notes))
    assert optimised(found).count("post-contrast clause takes precedence") == 1
    assert {r["seq"] for r in found.collect()} <= {1}
    assert found.where("dimension is null").count() == 0


@pytest.mark.parametrize("policy", ["min", "max"])
def test_amounts_try_each_period_once(spark, policy):
    rows = spark.createDataFrame([("900 per week",), ("$6k-$8k",), (None,)], "t string")
    read = rows.select(parse_amount(F.col("t"), range_policy=policy).alias("r"))
    text = optimised(read)
    assert all(text.count(f"(?i){pattern}") == 1 for _, pattern in PERIODS)
    week, span, none = (r["r"] for r in read.collect())
    assert (week["value"]["period"], week["value"]["monthly"]) == ("week", 900 * 4.345)
    assert span["value"]["value"] == {"min": 6000.0, "max": 8000.0}[policy] and span["code"] == "OK_ASSUMED"
    assert (none["ok"], none["code"], none["value"], none["warnings"]) == (False, "EMPTY", None, [])


def test_identifiers_are_parsed_once_on_each_side(spark):
    rows = spark.createDataFrame([(0, "L-1"), (1, "l 1"), (2, ""), (3, ""), (4, "n/a"), (5, "2")], "seq long, lead_id string")
    marked = mark_duplicates(rows.withColumn("id_result", parse_lead_id(F.col("lead_id"))))
    once = optimised(rows.select(parse_lead_id(F.col("lead_id")).alias("r"))).count(group_numbers(ID_PATTERN)[0])
    assert optimised(marked).count(group_numbers(ID_PATTERN)[0]) == 2 * once
    assert [r["seq"] for r in marked.where("is_duplicate").collect()] == [1] and marked.count() == 6


def test_tasks_grow_with_the_contacts(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    n = contacts(spark, SF).count()
    assert shared.tasks_for(spark, n) == n // 10 and shared.tasks_for(spark, n + 1) == n // 10 + 1
    assert contacts(spark, SF).rdd.getNumPartitions() == n // 10
    catalog.release(spark)
    try:
        kept = catalog._scored(spark, SF)
        sizes = [len(p) for p in kept.select("seq").rdd.glom().collect()]
        assert len(sizes) == n // 10 and max(sizes) <= 20
    finally:
        catalog.release(spark)


REPORTS = ["A11_code_histogram", "A17_ledger_totals", "A19_ledger_lines", "A1_A9_all_reports", "A1_leads_per_band", "A2_stage_by_budget", "A3_top_enquiry_types", "A4_source_by_band", "A5_problem_counts", "A6_score_histogram", "A7_pipeline_value", "A8_kpis", "A9_route_counts"]


def tasks_run(spark, group: str) -> list[int]:
    """Tasks of each stage that ran for a job group; the tracker follows a moment behind."""
    tracker = spark.sparkContext.statusTracker()
    for _ in range(100):
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        if jobs and all(j.status == "SUCCEEDED" for j in jobs):
            break
        time.sleep(0.1)
    return [s.numCompletedTasks for j in jobs for i in j.stageIds if (s := tracker.getStageInfo(i))]


def test_reports_read_the_kept_contacts_in_tasks_that_grow_with_them(spark, monkeypatch):
    """Held with the join by identifier shuffled, as it is where identifiers are too many to broadcast: it leaves the session's few partitions."""
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    catalog.release(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = contacts(spark, SF).count() // 10
        rows = catalog._scored(spark, SF).count()
        for name in REPORTS:
            spark.sparkContext.setJobGroup(f"growth {name}", name)
            catalog.QUERIES[name](spark, SF).collect()
            assert (name, max(tasks_run(spark, f"growth {name}"))) == (name, parts)
        assert parts > spark.sparkContext.defaultParallelism and rows <= 10 * parts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        catalog.release(spark)


def test_entries_met_follow_the_places_found(spark):
    lexicon = load_lexicon()
    rows = [p for p in _Places(lexicon).problems if p["n"] > 1][:1]
    at, n = rows[0]["at"], rows[0]["n"]
    found = [(p, 0, 1, None, False) for p in (at - 1, at, at + n - 1, at + n)]
    df = spark.createDataFrame([(found,), ([],)], "found array<struct<pattern:int,s:int,e:int,number:string,negated:boolean>>")
    met = df.select(_firsts(F.col("found"), rows, "at:int,n:int,label:string,category:string").alias("x"))
    first, none = (r["x"] for r in met.collect())
    assert [(x["m"]["pattern"], x["e"]["label"]) for x in first] == [(at, rows[0]["label"])] and none == []
    assert df.select(_firsts(F.col("found"), [], "at:int,n:int").alias("x")).where(F.size("x") > 0).count() == 0
