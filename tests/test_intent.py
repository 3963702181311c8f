import pytest
from pyspark.sql import functions as F

from intakespark.functions.texts import matches, merge_spans, negation_spans, normalise, snippet, split_clauses
from intakespark.operators.intent import extract_intent
from intakespark.operators.lexicon import default_data, load_lexicon

# Notes with their readings.
NOTES = {
    "buyer": ("We're a full-service marketing agency, 23 people. Summarizing call recordings into crm notes is eating our week. Want it automated end to end. Budget approved, ready to pilot in the next 2 weeks. I make the call here.", None),
    "contradiction": ("This is a priority, but we don't have budget until next quarter.", None),
    "flip": ("very early startup, 3 people, no real budget yet but sharp.", None),
    "operative": ("Car dealership wanting a lead chatbot. Not your usual client but we have money to spend.", None),
    "job": ("Not looking to buy — I'm a developer looking for a role. Attaching my CV.", None),
    "student": ("hi! CS student, i love what you do. could you send a free template?", None),
    "spam": ("You have WON $1,000,000!!! Click here to claim.", None),
    "panel": ("Cheap SMM panel, buy followers and likes, DM for rates.", None),
    "rival": ("I actually run a competing automation agency, just seeing how you package your offer.", None),
    "vc": ("VC here — wanting to intro you to a few portfolio companies.", None),
    "press": ("Journalist writing about the AI automation space, looking for a quote.", None),
    "bench": ("We have automation devs on our bench, would love to place candidates.", None),
    "explore": ("Exploring automating qualifying inbound leads. Comparing a few options.", None),
    "project": ("I'm researching AI automation for my final-year project, need it by Friday, my supervisor is very keen.", None),
    "sparse": ("Interested in automating lead routing.", None),
    "empty": ("", None),
    "blank": ("  \n ", "LIKELY"),
    "null": (None, None),
    "explicit_none": ("Not sure who signs off internally.", "LIKELY"),
    "titled": ("Want to automate lead routing.", "LIKELY"),
    "asap": ("Budget approved, wants to start ASAP.", None),
    "emoji": ("😀 Budget approved 😀, but maybe later.", None),
}


@pytest.fixture(scope="module")
def profiles(spark):
    df = spark.createDataFrame([(k, n, t) for k, (n, t) in NOTES.items()], "key string, notes string, level string")
    return {r.key: r.intent for r in extract_intent(df, "notes", "level").collect()}


def test_strong_buyer(profiles):
    p = profiles["buyer"]
    assert (p.intent_type.type, p.buying_stage.value, p.budget_status.value, p.urgency.value) == ("PURCHASE", "PURCHASE", "APPROVED", "HIGH")
    assert (p.decision_authority.value, p.pain_severity.value, p.timeline_days) == ("EXPLICIT", "HIGH", 14)
    assert "Call summarisation" in [x.label for x in p.problems] and not p.negatives and p.confidence > 0.8
    assert (p.commitment, p.solution_intent) == ("READY_TO_BUY", "IMPLEMENTATION")


def test_contradiction_is_recorded_not_averaged(profiles):
    p = profiles["contradiction"]
    assert (p.pain_severity.value, p.budget_status.value, p.urgency.value, p.timeline_days) == ("HIGH", "NOT_LOCKED", "MODERATE", 90)
    assert p.contradictions


def test_negation_and_contrast(profiles):
    assert profiles["flip"].budget_status.value == "NO_BUDGET" and "NO_BUDGET" in [n.code for n in profiles["flip"].negatives]
    assert profiles["operative"].budget_status.value == "ALLOCATED" and "OUT_OF_ICP" in [n.code for n in profiles["operative"].negatives]


@pytest.mark.parametrize("key, kind", [("job", "EMPLOYMENT"), ("student", "EDUCATIONAL"), ("spam", "SPAM"), ("panel", "SPAM"), ("rival", "COMPETITIVE"), ("vc", "PARTNERSHIP"), ("press", "RESEARCH"), ("bench", "VENDOR_PITCH"), ("explore", "PURCHASE"), ("project", "EDUCATIONAL")])
def test_enquiry_types(profiles, key, kind):
    assert profiles[key].intent_type.type == kind


def test_quality(profiles):
    p = profiles["sparse"]
    assert p.budget_status.is_unknown and p.decision_authority.value == "UNKNOWN" and any("budget" in m for m in p.missing) and not p.negatives
    for key in ("empty", "null"):
        e = profiles[key]
        assert e.confidence == 0 and e.intent_type.type == "UNKNOWN" and e.intent_type.confidence == 0 and len(e.missing) == 6 and not e.negatives
    assert profiles["blank"].decision_authority.value == "LIKELY" and profiles["blank"].confidence == 0
    assert profiles["spam"].confidence > 0.7 and profiles["spam"].buying_stage.value == "UNKNOWN"
    assert "STUDENT_OR_RESEARCH" in [n.code for n in profiles["project"].negatives]
    assert profiles["explicit_none"].decision_authority.value == "NONE"
    t = profiles["titled"].decision_authority
    assert (t.value, t.confidence, t.rule_id) == ("LIKELY", 0.55, "authority.from_title")


def test_evidence_points_at_the_note(profiles):
    for key in ("asap", "emoji"):
        r = profiles[key].budget_status
        assert NOTES[key][0][r.start : r.end].lower() == "budget approved" and "udget approved" in r.evidence
    for key, (note, _) in NOTES.items():
        for s in profiles[key].signals:
            assert 0 <= s.start < s.end <= len(note)


def test_clauses(spark):
    notes = ["This is a priority, but we have no budget.", "we don't have budget until next quarter", "no real budget yet but sharp and might grow", "One. Two - three, so four; five", ""]
    df = spark.createDataFrame([(n,) for n in notes], "n string").select("n", split_clauses(normalise(F.col("n"))).alias("c"))
    got = {r.n: r.c for r in df.collect()}
    a = got[notes[0]]
    assert len(a) == 2 and a[1].operative and a[1].marker == "but" and not a[0].operative and a[1].text == "but we have no budget."
    for note, word in ((notes[1], "next quarter"), (notes[2], "sharp")):
        for c in got[note]:
            at = note.index(word) - c.start
            assert not any(s.s <= at < s.e for s in c.neg)
    assert [c.text for c in got[notes[3]]] == ["one.", "two", "three,", "so four;", "five"] and got[""] == []
    for n in notes:
        for c in got[n]:
            assert normalise_text(n)[c.start : c.end] == c.text


def normalise_text(text):
    return text.lower()


def test_spans_and_snippets(spark):
    one = spark.range(1)
    row = one.select(
        matches(F.lit("ab xx ab y ab"), "ab").alias("m"),
        merge_spans(F.expr("array(named_struct('s', 5, 'e', 7), named_struct('s', 0, 'e', 3), named_struct('s', 3, 'e', 4))")).alias("merged"),
        negation_spans(F.lit("no doubt we never, ever pay without a contract")).alias("neg"),
        snippet(F.lit("x" * 30 + "HIT" + "y" * 30), F.lit(30), F.lit(33)).alias("s"),
    ).first()
    assert [(m.s, m.e) for m in row.m] == [(0, 2), (6, 8), (11, 13)]
    assert [(m.s, m.e) for m in row.merged] == [(0, 4), (5, 7)]
    assert [(m.s, m.e) for m in row.neg] == [(35, 46)]
    assert row.s == "…" + "x" * 24 + "HIT" + "y" * 24 + "…"


def test_lexicon_checks():
    assert len(load_lexicon().rules) == 30
    bad = [
        {"rules": [{"id": "a", "dimension": "urgency", "value": "HIGH"}]},
        {"rules": [{"id": "a", "value": "HIGH", "patterns": ["x"]}]},
        {"rules": [{"id": "a", "dimension": "urgency", "value": "SOON", "patterns": ["x"]}]},
        {"rules": [{"id": "a", "dimension": "urgency", "value": "HIGH", "patterns": ["("]}]},
        {"rules": [default_data()["rules"][0]] * 2},
    ]
    for data in bad:
        with pytest.raises(ValueError):
            load_lexicon(data=data)


def test_custom_lexicon(spark):
    lex = load_lexicon(data={"rules": [{"id": "u", "dimension": "urgency", "value": "HIGH", "patterns": ["pronto"]}], "timeline": [{"pattern": r"in (\d+) fortnights", "label": "{0} fortnights", "days_from_group": 1, "multiplier": 14}], "problems": [{"label": "P", "category": "C", "patterns": ["p1"]}], "negative_signals": [{"code": "X", "patterns": ["bad"]}], "intent_types": [{"type": "RESEARCH", "patterns": ["study"]}]})
    p = extract_intent(spark.createDataFrame([("pronto in 3 fortnights for a study, p1 is bad",)], "notes string"), lexicon=lex).first().intent
    assert (p.urgency.value, p.timeline_days, p.timeline_text, p.problems[0].label, p.negatives[0].code, p.intent_type.type) == ("HIGH", 42, "3 fortnights", "P", "X", "RESEARCH")


def test_default_lexicon_is_whole():
    count = lambda part: sum(len(e["patterns"]) for e in default_data()[part])
    assert [count(k) for k in ("rules", "intent_types", "negative_signals", "problems")] == [212, 81, 59, 68]
    assert len(default_data()["timeline"]) == 11


def test_readings_of_the_whole_lexicon(spark):
    want = {
        "let's start": ("buying_stage", "PURCHASE"), "you have a green light": ("buying_stage", "PURCHASE"), "we are evaluating": ("buying_stage", "EVALUATION"), "getting quotes now": ("buying_stage", "EVALUATION"),
        "still scoping": ("buying_stage", "EXPLORATION"), "hoping to learn more": ("buying_stage", "AWARENESS"), "budget locked in": ("budget_status", "APPROVED"), "willing to invest": ("budget_status", "ALLOCATED"),
        "there is real budget": ("budget_status", "BUDGETED"), "a limited budget": ("budget_status", "PRICE_SENSITIVE"), "i'm the decision-maker": ("decision_authority", "EXPLICIT"), "it is on hold": ("urgency", "NEGATIVE"),
    }
    got = {r.notes: r.intent for r in extract_intent(spark.createDataFrame([(n,) for n in [*want, "subscribed to the newsletter"]], "notes string")).collect()}
    assert {n: (d, got[n][d].value) for n, (d, _) in want.items()} == want
    assert got["subscribed to the newsletter"].intent_type.type == "SPAM"
