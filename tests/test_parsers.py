"""Field parsers, sources, sorts and settings."""

import pytest
from pyspark.sql import functions as F

from intakespark.functions.amounts import AmountConfig, parse_amount
from intakespark.functions.contacts import LeadIdConfig, parse_email, parse_lead_id, parse_website
from intakespark.functions.dates import DateConfig, parse_date, parse_date_column
from intakespark.functions.texts import highlight, normalise
from intakespark.operators.cleaning import mark_duplicates, sort_contacts
from intakespark.operators.intent import confidence_of, evidence_of, extract_intent, is_purchase_intent, level, level_place, read_note
from intakespark.operators.scoring import band_meta, load_scoring
from intakespark.plans.contacts import flat_frame, process
from intakespark.sources.contacts import contacts_from_text, is_path_like, load_report, normalise_header, read_contacts, resolve_columns, write_csv
from intakespark.sources.settings import default_dataset_path, load_settings

# Inputs with their readings.
SINGLE = {"6k": 6000, "$12k": 12000, "$8,000": 8000, "5000/month": 5000, "8000": 8000, "15k/mo": 15000, "$11k/mo": 11000, "5,000/mo": 5000, "$8,500": 8500, "500": 500, "₦2.5m": 2_500_000, "18k": 18000}
RANGES = {"$6k-$8k": (6000, 8000), "5k - 8k": (5000, 8000), "8k-12k": (8000, 12000), "5k-7k": (5000, 7000), "$6-8k": (6000, 8000), "between 5 and 8k": (5000, 8000), "35-55": (35, 55)}
AMOUNT_CODES = {"": "EMPTY", "TBD": "PLACEHOLDER", "depends": "PLACEHOLDER", "depends what you can do": "PLACEHOLDER", "budget way below range": "AMOUNT_NO_DIGITS", "not a number": "AMOUNT_NO_DIGITS", "asdf": "JUNK"}
DATES = {"2024-06-08": "2024-06-08", "2024-6-7": "2024-06-07", "Jun 7 2024": "2024-06-07", "June 7, 2024": "2024-06-07", "7th June 2024": "2024-06-07", "20240607": "2024-06-07", "6/1/24": "2024-06-01", "19-06-2024": "2024-06-19", "2024-06-08T09:30:00": "2024-06-08"}
DATE_CODES = {"": "EMPTY", "asdf": "JUNK", "2024-13-45": "DATE_IMPOSSIBLE", "hello world": "DATE_UNKNOWN_FORMAT", "45-46-2024": "DATE_IMPOSSIBLE"}
EMAIL_CODES = {"": "EMPTY", "weird-email-no-domain": "EMAIL_NO_AT", "ivan@": "EMAIL_MISSING_DOMAIN", "@acme.com": "EMAIL_MISSING_LOCAL", "obi@leverageside": "EMAIL_MISSING_TLD", "deji m.@scaleforge": "EMAIL_INVALID_CHARS", "a@b@c.com": "EMAIL_MULTIPLE_AT", "test@test.com": "JUNK", "obi@leverageside.1": "EMAIL_INVALID_TLD", "kunle[at]meridianbound.com": "OK_REPAIRED"}
IDS = {"L-1369": ("L-1369", 1369), "1341": ("L-1341", 1341), "L-1205-dup": ("L-1205-dup", 1205), "L-0007": ("L-7", 7)}
ID_CODES = {"": "ID_MISSING", "TESTROW": "JUNK", "header": "JUNK", "no-digits-here": "ID_NO_NUMBER"}
SITES = {"luxauto.io": ("https://luxauto.io", "luxauto.io"), "www.apexsend.co": ("https://apexsend.co", "apexsend.co"), "http://upshiftloop.agency": ("http://upshiftloop.agency", "upshiftloop.agency"), "https://x.co.uk/path": ("https://x.co.uk", "x.co.uk"), "sub.foo.com.ng": ("https://sub.foo.com.ng", "foo.com.ng")}
SITE_CODES = {"": "EMPTY", "asdf": "JUNK", "website": "JUNK", "localhost": "WEB_NO_DOT", "ivan@x.com": "WEB_IS_EMAIL", "foo.123": "WEB_INVALID_TLD"}


def read(spark, parse, values, **how):
    df = spark.createDataFrame([(v,) for v in values], "t string").select("t", parse(F.col("t"), **how).alias("r"))
    return {r.t: r.r for r in df.collect()}


def test_amounts(spark):
    got = read(spark, parse_amount, [*SINGLE, *RANGES, *AMOUNT_CODES, "0", "$5/hr", "$120,000/yr", None])
    assert {t: got[t].value.value for t in SINGLE} == SINGLE and {t: got[t].code for t in AMOUNT_CODES} == AMOUNT_CODES and got[None].code == "EMPTY"
    assert {t: (got[t].value.options.min, got[t].value.options.max) for t in RANGES} == RANGES and all("AMOUNT_RANGE" in got[t].warnings and got[t].value.options.avg == sum(x) / 2 for t, x in RANGES.items())
    assert "AMOUNT_ZERO" in got["0"].warnings and got["$5/hr"].value.monthly is None and round(got["$120,000/yr"].value.monthly) == 10000
    for policy, value in (("min", 6000), ("max", 8000), ("avg", 7000)):
        assert read(spark, parse_amount, ["$6k-$8k"], range_policy=policy)["$6k-$8k"].value.value == value
    assert read(spark, parse_amount, ["9k"], config=AmountConfig(max_plausible=8000))["9k"].code == "OUT_OF_RANGE"
    with pytest.raises(ValueError):
        parse_amount(F.lit("1"), range_policy="most")


def test_dates(spark):
    got = read(spark, parse_date, [*DATES, *DATE_CODES, "04-06-2024"])
    assert {t: str(got[t].value.date) for t in DATES} == DATES and {t: got[t].code for t in DATE_CODES} == DATE_CODES and "DATE_AMBIGUOUS_ORDER" in got["04-06-2024"].warnings
    limits = DateConfig(plausible_from="2024-01-01", plausible_to="2024-12-31", reject_future=True)
    got = read(spark, lambda c: parse_date(c, limits, as_of=F.lit("2024-07-01").cast("date")), ["2023-05-05", "2024-08-01", "2024-06-01"])
    assert got["2023-05-05"].warnings == ["DATE_OUT_OF_WINDOW"] and got["2024-08-01"].code == "DATE_FUTURE" and got["2024-06-01"].warnings == []
    df = spark.createDataFrame([(t,) for t in ("06/28/2024", "19-06-2024", "04-06-2024", "6/13/24", "06/07/2024")], "t string")
    column = {r.t: str(r.r.value.date) for r in parse_date_column(df, "t", "r").collect()}
    assert column["04-06-2024"] == "2024-06-04" and column["06/07/2024"] == "2024-06-07"


def test_contact_fields(spark):
    mail = read(spark, parse_email, [*EMAIL_CODES, "blessing@proton.me", "info@acme.com", "Jane Doe <jane@acme.com>"])
    assert {t: mail[t].code for t in EMAIL_CODES} == EMAIL_CODES and mail["kunle[at]meridianbound.com"].value.address == "kunle@meridianbound.com"
    assert mail["blessing@proton.me"].warnings == ["EMAIL_FREEMAIL"] and mail["info@acme.com"].warnings == ["EMAIL_ROLE_ADDRESS"] and mail["Jane Doe <jane@acme.com>"].value.address == "jane@acme.com"
    ids = read(spark, parse_lead_id, [*IDS, *ID_CODES])
    assert {t: (ids[t].value.canonical, int(ids[t].value.number)) for t in IDS} == IDS and {t: ids[t].code for t in ID_CODES} == ID_CODES
    own = LeadIdConfig(pattern=r"^(?P<prefix>[A-Z]{3})(?P<number>\d+)$", canonical_format="{prefix}/{number}", pad_to=5)
    assert read(spark, parse_lead_id, ["ACM42"], config=own)["ACM42"].value.canonical == "ACM/00042"
    sites = read(spark, parse_website, [*SITES, *SITE_CODES])
    assert {t: (sites[t].value.url, sites[t].value.registrable_domain) for t in SITES} == SITES and {t: sites[t].code for t in SITE_CODES} == SITE_CODES


def test_sorts_and_duplicates(spark):
    df = spark.createDataFrame(list(enumerate(["L-1369", "1341", "L-99", "7", "", "TESTROW", "L-1205-dup", "ACME-7"])), "seq long, lead_id string")
    shown = lambda d: [r.id_result.value.canonical if r.id_result.ok else None for r in d.collect()]
    assert shown(sort_contacts(df)) == ["ACME-7", "L-7", "L-99", "L-1205-dup", "L-1341", "L-1369", None, None]
    assert shown(sort_contacts(df, reverse=True))[:3] == [None, None, "L-1369"] and shown(sort_contacts(df, invalid_last=False))[:2] == [None, None]
    marked = mark_duplicates(df.withColumn("id_result", parse_lead_id(F.col("lead_id"))))
    assert [r.seq for r in marked.where("is_duplicate").collect()] == [7] and marked.count() == 8


def test_sources(spark, tmp_path):
    text = 'ref,submitted,contact,e-mail,account,headcount,site,role,channel,spend,message\nACME-12,2024-06-01,Ada,ada@acme.io,Acme,30,acme.io,Founder,referral,$8k/mo,"Budget approved, ready to pilot\nin 2 weeks. I make the call here."\n'
    path = tmp_path / "leads.csv"
    path.write_text(text, encoding="utf-8")
    for rows in (contacts_from_text(spark, text), read_contacts(spark, str(path), multi_line=True)):
        r = flat_frame(process(rows, as_of=F.lit("2026-01-01").cast("date"))).first()
        assert (r.company, r.budget_monthly, r.budget_status, r.authority, r.lead_id, r.band_label) == ("Acme", 8000, "APPROVED", "EXPLICIT", "ACME-12", band_meta(r.band)["label"])
    assert is_path_like("a.csv") and not is_path_like(text) and normalise_header(" Lead-ID ") == "lead_id"
    assert resolve_columns(["Ref", "ID", "id"])["lead_id"] == 2
    report = load_report(contacts_from_text(spark, "id,other,created\nL-1,x,13/06/2024\nL-1,y,\nheader,z,\n"), headers=["id", "other", "created"]).first()
    assert (report.rows_in_file, report.rows_dropped, report.dropped_examples, report.duplicate_ids, report.date_order_policy) == (3, 1, "header", 1, "/=day_first")
    assert report.column_map == "lead_id=id,created=created" and report.unmapped_fields.startswith("name,email")
    write_csv(spark.range(1).selectExpr("id as row", "'a\"b' as t"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first().t == 'a"b'


def test_settings(tmp_path):
    s = load_settings(data={"mapping": {"lead_id": ["nr"]}, "parsing": {"amount": {"range_policy": "max"}, "date": {"infer_order_from_column": False}}, "dataset": {"default_path": "x/y.csv", "drop_rows_matching": {"lead_id": ["NO"]}}})
    assert (s.amount.range_policy, s.infer_order, s.fields, s.drop) == ("max", False, {"lead_id": ("nr",)}, {"lead_id": ("no",)})
    assert default_dataset_path(s, str(tmp_path)) == str(tmp_path / "x/y.csv")
    c = load_scoring(data={"bands": [{"name": "A", "min_score": 5}], "fit_weights": {"budget_vs_floor": {"floor": 9, "above_floor": 1}}})
    assert c["bands"] == [("A", 5, "A")] and c["budget"]["floor"] == 9 and c["budget"]["above"] == 1


def test_folding_marks_and_one_note(spark):
    row = spark.createDataFrame([("ＢＵＤＧＥＴ “ok” – İ…", "a <b> c")], "a string, b string").select(
        normalise(F.col("a")).alias("n"), normalise(F.lit("ＢＵＤＧＥＴ")).alias("w"), highlight(F.col("b"), F.expr("array(named_struct('s', 2, 'e', 5, 'kind', 'neg'), named_struct('s', 4, 'e', 6, 'kind', ''))")).alias("h")
    ).first()
    assert row.w == "budget" and row.n.startswith("ｂｕｄｇｅｔ") and row.h == 'a <mark class="neg">&lt;b&gt; </mark>c'
    p = read_note(spark, "ＢＵＤＧＥＴ approved, want it automated asap.")
    assert p.budget_status.value == "APPROVED" and p.intent_type.type == "PURCHASE"
    i = F.col("intent")
    r = extract_intent(spark.createDataFrame([("Want it automated asap.",)], "notes string")).select(level(i, "urgency").alias("u"), level_place(i, "urgency").alias("k"), confidence_of(i, "urgency").alias("c"), evidence_of(i, "urgency").alias("e"), is_purchase_intent(i).alias("p")).first()
    assert (r.u, r.k, r.p) == ("VERY_HIGH", 5, True) and 0.9 < r.c <= 1 and "asap" in r.e
