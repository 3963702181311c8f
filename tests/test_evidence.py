"""What is shown of a reading: quotes, contradictions, ledger texts, marked notes, and the flow kept as a table."""

import html
import re

import pytest
from pyspark.sql import functions as F

from intakespark.functions.texts import highlight
from intakespark.operators import reports
from intakespark.operators.intent import extract_intent
from intakespark.plans.contacts import flat_frame, process, process_to
from intakespark.sources.settings import FIELDS

NOTES = [
    "Budget approved and we need to start asap. But honestly there is no budget at the moment.",
    'We are "evaluating" <three> vendors & want a demo, not just curious.',
    "I'm a student doing research for my thesis.",
    "",
    None,
    "word " * 4000 + "budget approved",
]
SPANS = "array<struct<s:int,e:int,kind:string>>"


@pytest.fixture(scope="module")
def read(spark):
    return extract_intent(spark.createDataFrame(list(enumerate(NOTES)), "seq long, notes string")).cache()


def marked(spark, text, spans):
    rows = ", ".join(f"named_struct('s', {s}, 'e', {e}, 'kind', '{k}')" for s, e, k in spans)
    return spark.range(1).select(highlight(F.lit(text), F.expr(f"cast(array({rows}) as {SPANS})"))).first()[0]


def test_kind_of_marks_that_meet(spark):
    assert marked(spark, "abcdef", [(1, 3, "pos"), (1, 3, "neg")]) == "a<mark>bc</mark>def"
    assert marked(spark, "abcdef", [(1, 3, "neg"), (1, 3, "pos")]) == 'a<mark class="neg">bc</mark>def'
    assert marked(spark, "abcdef", [(2, 5, "neg"), (1, 3, "pos")]) == "a<mark>bcde</mark>f"
    assert marked(spark, "abcdef", [(0, 2, "pos"), (2, 9, "neg"), (3, 3, "pos"), (4, 6, "neg")]) == '<mark>ab</mark>cd<mark class="neg">ef</mark>'
    assert marked(spark, "<a>&'", []) == "&lt;a&gt;&amp;&#x27;"


def test_marked_notes(read):
    rows = {r.seq: r for r in reports.highlighted_notes(read).collect()}
    for seq, note in enumerate(NOTES):
        plain = html.unescape(re.sub(r"</?mark(?: class=\"neg\")?>", "", rows[seq].html))
        assert plain == (note or "")
        spans = [tuple(map(int, s.split("-"))) for s in rows[seq].spans.split(",") if s]
        assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    # The place of the reading and that of the negative signal meet in the first note, so the mark is the reading's.
    assert "<mark>no budget</mark>" in rows[0].html and '<mark class="neg">' in rows[2].html and rows[3].spans == rows[4].spans == ""


def test_contradictions(read):
    rows = reports.contradictions(read).collect()
    (budget,) = [r for r in rows if r.seq == 0 and r.dimension == "budget_status"]
    assert (budget.kept, budget.rejected, budget.rule) == ("NO_BUDGET", "APPROVED", "post-contrast clause takes precedence")
    assert "no budget" in budget.evidence_kept and "approved" in budget.evidence_rejected
    assert {r.seq for r in rows} <= {0, 1, 5} and reports.contradictions(read.limit(0)).count() == 0


def contacts(spark):
    rows = [{"lead_id": f"L-{k % 9}", "created": "2024-05-0%d" % (k % 9 + 1), "email": f"a{k}@acme.com", "company": "Acme", "employees": "30", "website": "acme.com", "source": "referral", "monthly_budget": f"{k}k", "notes": NOTES[k % 3]} for k in range(12)]
    return spark.createDataFrame([(k, *(r.get(f, "") for f in FIELDS)) for k, r in enumerate(rows)], ", ".join(["seq long", *(f"{f} string" for f in FIELDS)]))


def test_kept_flow_is_filtered_and_joined(spark, tmp_path):
    """Filters over the stored flow are planned at once and give the rows of the flow itself."""
    as_of = F.lit("2026-01-01").cast("date")
    kept = process_to(contacts(spark), str(tmp_path / "scored"), as_of=as_of)
    whole = flat_frame(process(contacts(spark), as_of=as_of)).collect()
    got = flat_frame(kept.where((F.col("route") == "Sales") & (F.col("intent")["confidence"] > 0.2) & ~F.col("is_duplicate"))).orderBy("row").collect()
    dupes = {r.row for r in whole if r.row >= 9}
    assert got == sorted(r for r in whole if r.route == "Sales" and r.confidence > 0.2 and r.row not in dupes) and got
    assert kept.join(kept.select("seq", "score").withColumnRenamed("score", "again"), "seq").where("score = again").count() == 12
    lines = reports.ledger_texts(kept).collect()
    assert all(r.label for r in lines) and {r.seq for r in lines} == set(range(12))
    assert any(r.label == "Source: referral" and r.evidence.startswith("channel quality ") for r in lines)


def test_sure_signals_and_caps_are_met(spark):
    """The queries with SQL for these are no empty claims on the given tables."""
    from intakespark.plans import catalog

    d = "/root/testdata/sf0.001"
    one = catalog.QUERIES["F6_surer_signals"](spark, d).orderBy("seq").collect()
    all_ = catalog.QUERIES["N2_N16_intent_profiles"](spark, d).orderBy("seq").collect()
    assert 0 < sum(a.urgency != b.urgency or a.budget_status != b.budget_status or a.buying_stage != b.buying_stage for a, b in zip(one, all_, strict=True))
    said = {x.split(" at ")[0].split(" to ")[0] for r in catalog.QUERIES["S7_G11_low_bands"](spark, d).collect() for x in r.caps.split("; ") if x}
    catalog.release(spark)
    assert said == {"Capped", "Held", "Raised"} and "total >= -10 " in catalog.ORACLES["S7_G11_low_bands"]
