"""All reports from one pass against the reports one by one."""

import pytest
from pyspark.sql import functions as F

from intakespark.operators import reports

SCHEMA = "band string, band_label string, buying_stage string, budget_status string, intent_type string, source string, route string, score double, problems string, budget_monthly double"


@pytest.fixture(scope="module")
def leads(spark):
    bands = reports.BANDS
    rows = [(bands[k % 4], bands[k % 4].title(), f"S{k % 3}", f"B{k % 2}", f"T{k % 5}", None if k % 7 == 0 else f"src{k % 3}", f"R{k % 2}", k * 1.7 % 100, ", ".join(f"P{j}" for j in range(k % 4)), None if k % 3 else 10.5 * k) for k in range(200)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, name, key, subkey=None):
    return sorted((name, str(r[key]) if r[key] is not None else None, r[subkey] if subkey else None, r.leads) for r in df.collect())


def test_same_as_one_by_one(leads):
    got = [tuple(r)[:4] for r in reports.all_reports(leads).collect()]
    none_last = lambda x: tuple((v is None, v) for v in x)
    own = []
    for df, *what in (
        (reports.leads_per_band(leads), "bands", "band", "band_label"), (reports.stage_by_budget(leads), "stages", "buying_stage", "budget_status"), (leads.groupBy("intent_type").agg(F.count(F.lit(1)).alias("leads")), "types", "intent_type"),
        (reports.problem_counts(leads), "problems", "problem"), (reports.score_histogram(leads), "scores", "bin"), (reports.route_counts(leads), "routes", "route"),
    ):
        own += rows(df, *what)
    own += [("sources", r.source, r.band, r.leads) for r in reports.source_by_band(leads).collect()] + [("all", None, None, 200)]
    assert sorted(got, key=none_last) == sorted(own, key=none_last)
    value = reports.pipeline_value(leads).first()
    whole = reports.all_reports(leads).where("report = 'all'").first()
    assert (whole.pipeline_value, whole.active) == (value.pipeline_value, value.leads)


def test_one_shuffle_and_empty(leads, capsys):
    reports.all_reports(leads).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in reports.all_reports(leads.limit(0)).collect()] == []
