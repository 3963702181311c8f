"""Registered queries of the core library, by survey id, and their SQL counterparts.

Most run over the synthetic contact table. The whole flow (parsing, reading notes, scoring) is computed once a session
and folder and kept, as reports on one load would be.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.amounts import ABOUT, UP_TO, AmountConfig, amount_options, parse_amount
from ..functions.contacts import domains_match, parse_email, parse_lead_id, parse_website, registrable
from ..functions.dates import DateConfig, infer_order_policy, order_evidence, parse_date_column
from ..functions.fit import employees_of, in_profile, is_non_buyer, size_band, source_quality, title_authority
from ..functions.results import all_codes, as_json
from ..functions.texts import normalise, split_clauses, word_count
from ..operators import cleaning, reports
from ..operators.intent import extract_intent, profile_json, profile_record, profile_variant, read_variant
from ..operators.lexicon import LADDERS, load_lexicon
from ..operators.scoring import GROUPS, load_scoring, score
from ..operators.search import indexed_search, write_search_index
from ..sources.contacts import drop_test_rows, load_report, read_contacts, with_row_index
from ..sources.settings import FIELDS
from ..sources.shared import shared_path, tasks_for
from ..sources.synthetic import contacts
from .contacts import flat_frame, process
from .oracles import AS_OF, q, sql
from .oracles import registrable as registrable_sql

_kept: dict[tuple[str, str], DataFrame] = {}
FLAGSHIP = "A1_leads_per_band"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored contacts, computed by the first query that reads them and kept (spilling to disk) for the reports after it, until ``release``."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        rows = contacts(spark, sf_dir)
        _kept[key] = process(rows, as_of=F.lit(AS_OF).cast("date"), parts=tasks_for(spark, rows.count())).persist()
    return _kept[key]


def release(spark: SparkSession) -> None:
    """Give back what this module keeps for a session."""
    for key in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        _kept.pop(key).unpersist()


def _flat(spark, d):
    return flat_frame(_scored(spark, d))


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _p7(spark, d):
    r = parse_lead_id(F.col("lead_id"))
    v = F.col("r")["value"]
    return contacts(spark, d).select("seq", r.alias("r")).select("seq", F.col("r")["code"].alias("code"), v["canonical"].alias("canonical"), v["number"].cast("bigint").alias("number"), F.array_join(F.col("r")["warnings"], ",").alias("warnings"))


def _p1(spark, d):
    v = F.col("r")["value"]
    rows = contacts(spark, d).select("seq", parse_amount(F.col("monthly_budget")).alias("r"))
    return rows.select("seq", F.col("r")["code"].alias("code"), F.bround(v["value"], 2).alias("value"), F.bround(v["monthly"], 2).alias("monthly"), v["period"].alias("period"), v["currency"].alias("currency"), F.array_join(F.col("r")["warnings"], ",").alias("warnings"))


def _p3(spark, d):
    rows = parse_date_column(contacts(spark, d), "created", "r", as_of=F.lit(AS_OF).cast("date"))
    return rows.select("seq", F.col("r")["code"].alias("code"), F.col("r")["value"]["date"].cast("string").alias("parsed"), F.array_join(F.col("r")["warnings"], ",").alias("warnings"))


def _p1d(spark, d):
    """Amounts with each end of a range for its value."""
    rows = contacts(spark, d).select("seq", *(parse_amount(F.col("monthly_budget"), range_policy=k).alias(k) for k in ("min", "max")))
    columns = lambda k: (F.col(k)["code"].alias(f"{k}_code"), F.bround(F.col(k)["value"]["value"], 2).alias(f"{k}_value"), F.bround(F.col(k)["value"]["monthly"], 2).alias(f"{k}_monthly"))
    return rows.select("seq", *columns("min"), *columns("max"))


#: Dates outside are marked; those after the day of reading are refused.
_WINDOW = DateConfig(plausible_from="2024-02-01", plausible_to="2024-05-31", reject_future=True)
_READ_ON = "2024-06-15"


def _p3c(spark, d):
    rows = parse_date_column(contacts(spark, d), "created", "r", _WINDOW, F.lit(_READ_ON).cast("date"))
    return rows.select("seq", F.col("r")["code"].alias("code"), F.col("r")["value"]["date"].cast("string").alias("parsed"), F.array_join(F.col("r")["warnings"], ",").alias("warnings"))


def _p2(spark, d):
    o = amount_options(F.col("monthly_budget"))
    return contacts(spark, d).select("seq", o.alias("o")).select("seq", *(F.bround(F.col("o")[k], 2).alias(k) for k in ("min", "max", "avg")))


def _p6(spark, d):
    v = F.col("r")["value"]
    return contacts(spark, d).select("seq", parse_email(F.col("email")).alias("r")).select("seq", F.col("r")["code"].alias("code"), v["address"].alias("address"), F.array_join(F.col("r")["warnings"], ",").alias("warnings"))


def _p8(spark, d):
    v = F.col("r")["value"]
    return contacts(spark, d).select("seq", parse_website(F.col("website")).alias("r")).select("seq", F.col("r")["code"].alias("code"), v["url"].alias("url"), v["registrable_domain"].alias("registrable"), F.array_join(F.col("r")["warnings"], ",").alias("warnings"))


def _p10(spark, d):
    mail = F.when(F.col("m")["ok"], F.col("m")["value"]["domain"])
    return contacts(spark, d).select("seq", parse_email(F.col("email")).alias("m"), parse_website(F.col("website")).alias("w")).select("seq", domains_match(F.col("w"), mail).alias("same_domain"))


def _p9(spark, d):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)
    return _t(spark, d, "pages").select("page_id", registrable(host)["domain"].alias("registrable")).groupBy("registrable").agg(F.count(F.lit(1)).alias("pages"))


def _notes(spark, d, **columns):
    return extract_intent(contacts(spark, d).select("seq", "notes")).select("seq", *(c.alias(n) for n, c in columns.items()))


def _resolved(spark, d):
    p = F.col("intent")
    return _notes(
        spark, d, intent_type=p["intent_type"]["type"], **{x: p[x]["value"] for x in LADDERS}, timeline_days=p["timeline_days"], timeline=p["timeline_text"],
        negatives=F.array_join(F.transform(p["negatives"], lambda n: n["code"]), ","), confidence=p["confidence"], type_confidence=p["intent_type"]["confidence"],
        commitment=p["commitment"], contradictions=F.size(p["contradictions"]).cast("long"), missing=F.size(p["missing"]).cast("long"), words=p["note_length"].cast("long"),
        **{f"confidence_{x}": F.when(~p[x]["is_unknown"], F.bround(p[x]["confidence"], 6)) for x in LADDERS},
    )


def _of_notes(spark, d, report):
    return report(extract_intent(contacts(spark, d).select("seq", "notes")))


#: A signal has to be this sure to count.
_SURE = 0.82


def _surer(spark, d):
    """Readings of the notes where only sure signals count."""
    lexicon = load_lexicon()
    p = F.col("intent")
    rows = extract_intent(contacts(spark, d).select("seq", "notes"), lexicon=replace(lexicon, settings=lexicon.settings | {"min_signal_confidence": _SURE}))
    return rows.select("seq", *(p[x]["value"].alias(x) for x in LADDERS), F.size(p["contradictions"]).cast("long").alias("contradictions"))


#: Bands so low that readings cap, hold and raise them in every way, as a file of settings would say it.
_LOW_BANDS = {"CONTACT_NOW": 0, "CONSIDER": -10, "NURTURE": -20, "DISQUALIFY": -999}


def _low_bands(spark, d):
    """The kept contacts scored again with other bands."""
    config = load_scoring(data={"bands": [{"name": n, "min_score": least, "label": n.replace("_", " ").capitalize()} for n, least in _LOW_BANDS.items()]})
    again = score(_scored(spark, d).drop("score", "display_score", "band", "band_label", "route", "ledger", "caps"), config)
    return again.select("seq", F.array_join("caps", "; ").alias("caps"), "band_label", "score")


def _problems(spark, d):
    p = F.col("intent")
    return _notes(spark, d, problems=F.array_join(F.transform(p["problems"], lambda x: x["label"]), ", "), categories=F.array_join(p["categories"], ", "))


def _texts(spark, d):
    """Clauses of whole conversation turns."""
    rows = _t(spark, d, "conversations").select("conv_id", "turn", split_clauses(normalise(F.col("text"))).alias("c"), word_count(F.col("text")).alias("words"))
    return rows.select("conv_id", "turn", F.size("c").cast("long").alias("clauses"), F.col("words").cast("long").alias("words"), F.size(F.filter("c", lambda x: x["operative"])).cast("long").alias("operative"))


def _frame_orders(spark, d):
    """Orders per priority with their share in each status: the shares of the reports on a table of their own."""
    o = _t(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return o.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 6))


def _fit(spark, d):
    size = employees_of(F.col("employees"))
    c = contacts(spark, d)
    return c.select("seq", size.alias("head_count"), size_band(size).alias("band"), title_authority(F.col("title")).alias("level"), is_non_buyer(F.col("title")).alias("non_buyer"), in_profile(F.col("company"), F.col("notes")).alias("icp"), source_quality(F.col("source")).alias("quality"))


def _json(spark, d):
    got = lambda path: F.get_json_object("j", path)
    rows = _scored(spark, d).select("seq", profile_json(F.col("intent"), company=F.col("company")).alias("j"), as_json(F.col("email_result")).alias("m"))
    return rows.select(
        "seq", got("$.context.company").alias("company"), got("$.intent.intent_type").alias("intent_type"), got("$.authority.decision_authority").alias("authority"), got("$.quality.confidence").cast("double").alias("confidence"),
        got("$.quality.per_dimension.urgency.confidence").cast("double").alias("urgency_confidence"), got("$.negative_signals[0].code").alias("first_negative"), F.get_json_object("m", "$.code").alias("email_code"),
    )


def _profile_store(spark, d):
    """All profiles stored as variants and read back with the types of their fields."""
    path = shared_path(spark, "profiles")
    rows = _scored(spark, d)
    like = rows.select(profile_record(F.col("intent"), company=F.col("company")).alias("v")).schema["v"].dataType
    rows.select("seq", profile_variant(F.col("intent"), company=F.col("company")).alias("v")).write.parquet(path)
    p = F.col("p")
    return spark.read.parquet(path).select("seq", read_variant(F.col("v"), like).alias("p"), F.variant_get("v", "$.negative_signals[0].code", "string").alias("first_negative")).select(
        "seq", "first_negative", p["context"]["company"].alias("company"), p["intent"]["intent_type"].alias("intent_type"), p["intent"]["buying_stage"].alias("buying_stage"), p["buying_signals"]["timeline"].alias("timeline"), p["buying_signals"]["timeline_days"].alias("timeline_days"),
        F.array_join(p["pain"]["problems"], ", ").alias("problems"), F.array_join(F.transform(p["negative_signals"], lambda n: n["code"]), ",").alias("negatives"), p["quality"]["confidence"].alias("confidence"),
        F.size(p["quality"]["contradictions"]).cast("long").alias("contradictions"), p["quality"]["per_dimension"]["urgency"]["confidence"].alias("urgency_confidence"),
    )


_SEARCHED_FOR = "agency|dealership|@corp|l-1[0-9]$"


def _indexed_search(spark, d):
    path = shared_path(spark, "search")
    write_search_index(_flat(spark, d), path)
    return indexed_search(spark, path, _SEARCHED_FOR).select("row", "company")


#: What is added to every third note, so that cells of the written files hold line feeds, quotes and commas.
_SAID = '\n"said", and\n\nmore'


def _csv_scan(spark, d):
    """The contact table written as CSV files and read back: quoted line feeds, rows numbered over all files."""
    path = shared_path(spark, "contacts")
    rows = contacts(spark, d).withColumn("notes", F.when(F.col("seq") % 3 == 0, F.concat("notes", F.lit(_SAID))).otherwise(F.col("notes")))
    dealt = rows.repartitionByRange(4, "seq").sortWithinPartitions("seq").drop("seq")
    dealt.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_contacts(spark, path).drop("raw")


def _codes(r: str):
    return F.array_join(all_codes(F.col(r)), ",")


QUERIES = {
    "A1_leads_per_band": lambda s, d: reports.leads_per_band(_scored(s, d)),
    "A1_A9_all_reports": lambda s, d: reports.all_reports(_flat(s, d)),
    "A2_stage_by_budget": lambda s, d: reports.stage_by_budget(_flat(s, d)),
    "A3_top_enquiry_types": lambda s, d: reports.top_values(_flat(s, d), "intent_type"),
    "A4_source_by_band": lambda s, d: reports.source_by_band(_flat(s, d)),
    "A5_problem_counts": lambda s, d: reports.problem_counts(_flat(s, d)),
    "A6_score_histogram": lambda s, d: reports.score_histogram(_flat(s, d)),
    "A7_pipeline_value": lambda s, d: reports.pipeline_value(_flat(s, d)),
    "A8_kpis": lambda s, d: reports.kpis(_flat(s, d)),
    "A9_route_counts": lambda s, d: reports.route_counts(_flat(s, d)),
    "A10_parse_rates": lambda s, d: reports.parse_rates(_scored(s, d)),
    "A11_code_histogram": lambda s, d: reports.code_histogram(_scored(s, d)),
    "A12_date_evidence": lambda s, d: order_evidence(drop_test_rows(contacts(s, d)), "created"),
    "A13_duplicate_count": lambda s, d: reports.duplicate_count(cleaning.mark_duplicates(drop_test_rows(contacts(s, d)).select("seq", parse_lead_id(F.col("lead_id")).alias("id_result")))),
    "A17_ledger_totals": lambda s, d: reports.ledger_totals(_scored(s, d)),
    "A19_ledger_lines": lambda s, d: reports.ledger_lines(_scored(s, d)),
    "F2_filter_leads": lambda s, d: reports.filter_leads(_flat(s, d), bands=["CONTACT_NOW", "CONSIDER"], sources=["referral", "linkedin"], least_confidence=0.5).select("row", "band", "source", "size_band"),
    "F3_search": lambda s, d: reports.search(_flat(s, d), _SEARCHED_FOR).select("row", "company"),
    "F3_indexed_search": _indexed_search,
    "F6_surer_signals": _surer,
    "G_scored_leads": lambda s, d: _flat(s, d).select("row", "raw_score", "score", "band", "route"),
    "G11_ledger_texts": lambda s, d: reports.ledger_texts(_scored(s, d)),
    "G11_caps": lambda s, d: _scored(s, d).select("seq", F.array_join("caps", "; ").alias("caps"), "band_label"),
    "S7_G11_low_bands": _low_bands,
    "N2_N16_intent_profiles": _resolved,
    "N8_intent_type": lambda s, d: _notes(s, d, intent_type=F.col("intent")["intent_type"]["type"]),
    "N9_problems": _problems,
    "N13_solution_intent": lambda s, d: _notes(s, d, solution_intent=F.col("intent")["solution_intent"]),
    "N14_contradictions": lambda s, d: _of_notes(s, d, reports.contradictions),
    "P1_amounts": _p1,
    "P1d_amount_policies": _p1d,
    "P2_amount_options": _p2,
    "P3_dates": _p3,
    "P3c_date_window": _p3c,
    "P4_date_policy": lambda s, d: infer_order_policy(drop_test_rows(contacts(s, d)), "created"),
    "P6_emails": _p6,
    "P7_lead_ids": _p7,
    "P8_websites": _p8,
    "P9_page_domains": _p9,
    "P10_domain_match": _p10,
    "P11_P14_fit": _fit,
    "P15_result_codes": lambda s, d: _scored(s, d).select("seq", *(_codes(r).alias(r.replace("_result", "_codes")) for r in cleaning.FIELD_RESULTS)),
    "P16_data_issues": lambda s, d: _scored(s, d).select("seq", F.array_join(cleaning.data_issues(), "; ").alias("issues")),
    "S1_S6_csv_scan": _csv_scan,
    "S5_kept_rows": lambda s, d: drop_test_rows(contacts(s, d)).select("seq", "lead_id", "source"),
    "S6_row_index": lambda s, d: with_row_index(drop_test_rows(contacts(s, d))).select("seq", "row_index"),
    "S10_profile_json": _json,
    "S10_profile_store": _profile_store,
    "S11_flat_frame": _flat,
    "S12_load_report": lambda s, d: load_report(contacts(s, d)),
    "T1_sorted_ids": lambda s, d: cleaning.place_contacts(contacts(s, d)).select("seq", "lead_id", "place"),
    "T2_reversed_ids": lambda s, d: cleaning.place_contacts(contacts(s, d), reverse=True).select("seq", "lead_id", "place"),
    "T3_invalid_first": lambda s, d: cleaning.place_contacts(contacts(s, d), invalid_last=False).select("seq", "lead_id", "place"),
    "T4_top_scores": lambda s, d: reports.top_by_score(_flat(s, d)).select("row", "raw_score", "band"),
    "T5_top_issues": lambda s, d: reports.top_by_issues(_flat(s, d)).select("row", "data_issues"),
    "T6_by_display_score": lambda s, d: reports.placed_by(_flat(s, d), "score").select("row", "score", "place"),
    "T7_by_raw_score": lambda s, d: reports.placed_by(_flat(s, d), "raw_score").select("row", "raw_score", "place"),
    "W1_duplicates": lambda s, d: cleaning.mark_duplicates(drop_test_rows(contacts(s, d)).withColumn("id_result", parse_lead_id(F.col("lead_id")))).select("seq", "is_duplicate"),
    "W3_order_shares": _frame_orders,
    "W4_X6_highlighted_notes": lambda s, d: _of_notes(s, d, reports.highlighted_notes),
    "X2_conversation_clauses": _texts,
}

_DISPLAY = "coalesce(id_canonical, nullif(trim(lead_id), ''), '(row ' || seq || ')')"
_FLAT = f"""SELECT seq AS "row", {_DISPLAY} AS lead_id, name, company, title, band, band_label, score, raw_score, route, intent_type, buying_stage, budget_status, urgency, decision_authority AS authority, pain_severity AS pain,
  competitive_evaluation AS competitive, round_even(confidence, 2) AS confidence, timeline, timeline_days, problems, array_to_string(list_filter(cats, lambda x, i: list_position(cats, x) = i), ', ') AS categories, array_to_string(codes, ', ') AS negatives,
  CAST(n_conflicts AS INT) AS contradictions, source, head_count AS employees, size_band, CASE WHEN icp THEN 'Yes' WHEN NOT icp THEN 'No' ELSE 'Unknown' END AS icp, coalesce(address, email) AS email, email_code AS email_status,
  coalesce(url, '') AS website, site_code AS website_status, coalesce(parsed, '') AS created, date_code AS created_status, monthly_budget AS budget_raw, budget_monthly, amount_code AS budget_code, CAST(data_issues AS INT) AS data_issues, notes FROM scored"""
_by_place = lambda score: f'SELECT seq AS "row", {score}, row_number() OVER (ORDER BY {score} DESC, seq) AS place FROM scored'
_ISSUES = [
    *((f"{bad}", f"'{name}: ' || {code}") for bad, name, code in (("id_bad", "Lead ID", "id_code"), ("NOT date_ok", "Created", "date_code"), ("NOT email_ok", "Email", "email_code"), ("NOT site_ok", "Website", "site_code"), ("NOT amount_ok", "Budget", "amount_code"))),
    ("freemail", "'Email: EMAIL_FREEMAIL'"), ("role_address", "'Email: EMAIL_ROLE_ADDRESS'"), ("list_contains(date_warnings, 'DATE_AMBIGUOUS_ORDER')", "'Created: DATE_AMBIGUOUS_ORDER'"), ("list_contains(amount_warnings, 'AMOUNT_RANGE')", "'Budget: AMOUNT_RANGE'"),
    ("is_duplicate", "'Lead ID: ID_DUPLICATE'"), ("trim(notes) = ''", "'Notes: EMPTY'"),
]
_PROFILE = ", ".join(["intent_type", *LADDERS, "timeline_days", "timeline", "array_to_string(codes, ',') AS negatives", "confidence", f"CASE WHEN empty THEN {q(0.0)} ELSE tconf END AS type_confidence", "commitment", "n_conflicts AS contradictions", "CAST(n_missing AS BIGINT) AS missing", "CAST(n_words AS BIGINT) AS words", *(f"round_even(conf_{d}, 6) AS confidence_{d}" for d in LADDERS)])
_GROUP_PLACE = "list_position([" + ", ".join(q(g) for g in GROUPS) + "], x.g)"

_count = lambda report, key, subkey: f"SELECT '{report}' AS report, CAST({key} AS VARCHAR) AS \"key\", CAST({subkey} AS VARCHAR) AS subkey, count(*) AS leads, count(*) FILTER (band IN ('CONTACT_NOW', 'CONSIDER')) AS active, NULL AS pipeline_value FROM scored GROUP BY 2, 3"
_ALL_REPORTS = " UNION ALL ".join([
    *(_count(*x) for x in (("bands", "band", "band_label"), ("stages", "buying_stage", "budget_status"), ("types", "intent_type", "NULL"), ("sources", "source", "band"), ("scores", "CAST(floor(score / 5) * 5 AS INT)", "NULL"), ("routes", "route", "NULL"))),
    "SELECT 'problems', label, NULL, count(*), NULL, NULL FROM scored s JOIN no1 n ON n.note = s.notes JOIN pr ON regexp_matches(n.norm, pr.pattern) GROUP BY 2",
    "SELECT 'all', NULL, NULL, count(*), count(*) FILTER (band IN ('CONTACT_NOW', 'CONSIDER')), round_even(coalesce(sum(budget_monthly) FILTER (band IN ('CONTACT_NOW', 'CONSIDER')), 0), 2) FROM scored",
])

_CHOSEN = {"min": "CASE WHEN is_range THEN least(v[1], v[2]) ELSE v[1] END", "max": "CASE WHEN is_range THEN greatest(v[1], v[2]) ELSE v[1] END"}
_PLAUSIBLE = f"BETWEEN {q(float(AmountConfig.min_plausible))} AND {q(float(AmountConfig.max_plausible))}"
_policy_code = lambda x: f"CASE WHEN bad <> 'OUT_OF_RANGE' THEN bad WHEN {x} <> 0 AND NOT {x} {_PLAUSIBLE} THEN 'OUT_OF_RANGE' WHEN is_range OR regexp_matches(s, {q(ABOUT)}) THEN 'OK_ASSUMED' ELSE 'OK' END"
_POLICIES = f"""SELECT seq, min_code, CASE WHEN min_code LIKE 'OK%' THEN round_even(x_min, 2) END AS min_value, CASE WHEN min_code LIKE 'OK%' THEN round_even(x_min * factor, 2) END AS min_monthly,
  max_code, CASE WHEN max_code LIKE 'OK%' THEN round_even(x_max, 2) END AS max_value, CASE WHEN max_code LIKE 'OK%' THEN round_even(x_max * factor, 2) END AS max_monthly
  FROM (SELECT *, {_policy_code("x_min")} AS min_code, {_policy_code("x_max")} AS max_code FROM (SELECT *, {_CHOSEN["min"]} AS x_min, {_CHOSEN["max"]} AS x_max FROM am6))"""
_WINDOWED = f"""SELECT seq, code, CASE WHEN code LIKE 'OK%' THEN CAST(day AS VARCHAR) END AS parsed,
  CASE WHEN code LIKE 'OK%' THEN concat_ws(',', CASE WHEN short THEN 'DATE_TWO_DIGIT_YEAR' END, CASE WHEN unclear THEN 'DATE_AMBIGUOUS_ORDER' END, CASE WHEN day NOT BETWEEN DATE '2024-02-01' AND DATE '2024-05-31' THEN 'DATE_OUT_OF_WINDOW' END) ELSE '' END AS warnings
  FROM (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN day > DATE '2024-06-15' THEN 'DATE_FUTURE' WHEN unclear OR kind IN ('my', 'ym') THEN 'OK_ASSUMED' ELSE 'OK' END AS code FROM dt7)"""

# What was done to a band beside the score, in literals, not from the operators' tables. The places of bands are 0 to 3.
_BAND = lambda k: f"['Contact now', 'Consider', 'Nurture', 'Disqualify'][{k} + 1]"
_CAPS = f"""SELECT seq, array_to_string(list_filter([CASE WHEN capped <> by_score THEN 'Capped at ' || {_BAND("capped")} END, CASE WHEN placed < capped THEN 'Raised to ' || {_BAND("placed")} WHEN placed > capped THEN 'Held at ' || {_BAND("placed")} END,
    CASE WHEN killed <> placed THEN 'Capped at ' || {_BAND("killed")} END, CASE WHEN place <> killed THEN 'Raised to ' || {_BAND("place")} END], lambda x: x IS NOT NULL), '; ') AS caps, {_BAND("place")} AS band_label
  FROM (SELECT *, CASE WHEN list_contains(targets, 3) THEN 3 ELSE placed END AS killed FROM (SELECT *, CASE WHEN len(soft) > 0 THEN list_max(soft) ELSE capped END AS placed FROM scored))"""
_SURER = sql("note_profiles", f"SELECT seq, {', '.join(LADDERS)}, n_conflicts AS contradictions FROM profiles").replace(f"WHERE conf >= {q(0.15)}", f"WHERE conf >= {q(_SURE)}")

ORACLES = {
    "A1_A9_all_reports": sql("scored", _ALL_REPORTS),
    "A1_leads_per_band": sql("scored", "SELECT band, band_label, count(*) AS leads FROM scored GROUP BY ALL"),
    "A2_stage_by_budget": sql("scored", "SELECT buying_stage, budget_status, count(*) AS leads FROM scored GROUP BY ALL"),
    "A3_top_enquiry_types": sql("scored", "SELECT intent_type AS value, count(*) AS leads FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"),
    "A4_source_by_band": sql("scored", "SELECT source, band, count(*) AS leads, count(*) / sum(count(*)) OVER (PARTITION BY source) AS share FROM scored GROUP BY source, band"),
    "A5_problem_counts": sql("scored", "SELECT label AS problem, count(*) AS leads FROM scored s JOIN no1 n ON n.note = s.notes JOIN pr ON regexp_matches(n.norm, pr.pattern) GROUP BY 1"),
    "A6_score_histogram": sql("scored", "SELECT CAST(floor(score / 5) * 5 AS INT) AS bin, count(*) AS leads FROM scored GROUP BY 1"),
    "A7_pipeline_value": sql("scored", "SELECT round_even(coalesce(sum(budget_monthly), 0), 2) AS pipeline_value, count(*) AS leads FROM scored WHERE band IN ('CONTACT_NOW', 'CONSIDER')"),
    "A8_kpis": sql("scored", "SELECT count(*) AS leads, " + ", ".join(f"count(*) FILTER (band = '{b}') AS n_{b.lower()}" for b in reports.BANDS) + ", round_even(100 * count(*) FILTER (band = 'CONTACT_NOW') / count(*), 1) AS contact_now_percent, round_even(avg(round_even(confidence, 2)), 4) AS mean_confidence, count(*) FILTER (data_issues > 0) AS with_issues FROM scored"),
    "A9_route_counts": sql("scored", "SELECT route, count(*) AS leads FROM scored GROUP BY 1"),
    "A10_parse_rates": sql("fields", "SELECT field, count(*) FILTER (trim(raw) <> '') AS supplied, count(*) FILTER (trim(raw) = '') AS blank, count(*) FILTER (trim(raw) <> '' AND ok) AS read, round_even(count(*) FILTER (trim(raw) <> '' AND ok) / greatest(count(*) FILTER (trim(raw) <> ''), 1), 4) AS rate FROM fields GROUP BY 1"),
    "A11_code_histogram": sql("fields", "SELECT field, code, count(*) AS n, arg_min(raw, seq) AS example FROM (SELECT seq, field, raw, unnest(codes) AS code FROM fields) GROUP BY 1, 2"),
    "A12_date_evidence": sql("evidence", "SELECT * FROM evidence"),
    "A13_duplicate_count": sql("dups", "SELECT count(*) FILTER (is_duplicate) AS duplicates FROM dups"),
    "A17_ledger_totals": sql("scored", "SELECT seq, round_even(coalesce(list_sum(list_transform(ledger, lambda x: x.p)), 0), 1) + 0 AS ledger_total, raw_score AS score FROM scored"),
    "A19_ledger_lines": sql("scored", f"SELECT seq, CAST({_GROUP_PLACE} AS INT) AS group_place, CAST(k - 1 AS INT) AS pos, x.g AS line_group, round_even(x.p, 1) + 0 AS points FROM (SELECT seq, k, ledger[k] AS x FROM (SELECT seq, ledger, unnest(range(1, len(ledger) + 1)) AS k FROM scored))"),
    "F2_filter_leads": sql("scored", "SELECT seq AS \"row\", band, source, size_band FROM scored WHERE band IN ('CONTACT_NOW', 'CONSIDER') AND source IN ('referral', 'linkedin') AND round_even(confidence, 2) >= 0.5"),
    "F3_search": sql("kept ids emails", f"SELECT k.seq AS \"row\", company FROM kept k JOIN (SELECT * EXCLUDE (lead_id) FROM ids) i USING (seq) JOIN emails e USING (seq) WHERE " + " OR ".join(f"regexp_matches(lower({x}), 'agency|dealership|@corp|l-1[0-9]$')" for x in ("company", "name", "notes", "coalesce(address, email)", _DISPLAY.replace("seq", "k.seq")))),
    "F6_surer_signals": _SURER,
    "G11_ledger_texts": sql("lines", "SELECT seq, CAST(k - 1 AS INT) AS pos, says[k].label AS label, says[k].evidence AS evidence FROM (SELECT seq, says, unnest(range(1, len(says) + 1)) AS k FROM lines)"),
    "G11_caps": sql("scored", _CAPS),
    "G_scored_leads": sql("scored", 'SELECT seq AS "row", raw_score, score, band, route FROM scored'),
    "N2_N16_intent_profiles": sql("note_profiles", f"SELECT seq, {_PROFILE} FROM profiles"),
    "N8_intent_type": sql("note_profiles", "SELECT seq, intent_type FROM profiles"),
    "N9_problems": sql("notes", "SELECT seq, problems, array_to_string(list_filter(cats, lambda x, i: list_position(cats, x) = i), ', ') AS categories FROM c JOIN notes n ON n.note = c.notes"),
    "N14_contradictions": sql("contradictions", "SELECT seq, dimension, kept, rejected, rule, evidence_kept, evidence_rejected FROM c JOIN contradictions x ON x.note = c.notes"),
    "N13_solution_intent": sql("note_profiles", "SELECT seq, CASE buying_stage WHEN 'AWARENESS' THEN 'GENERAL_INTEREST' WHEN 'EXPLORATION' THEN 'EXPLORATION' WHEN 'EVALUATION' THEN 'EVALUATION' WHEN 'DECISION' THEN 'EVALUATION' WHEN 'PURCHASE' THEN 'IMPLEMENTATION' ELSE 'UNKNOWN' END AS solution_intent FROM profiles"),
    "P1_amounts": sql("amounts", "SELECT seq, amount_code AS code, round_even(value, 2) AS value, round_even(monthly, 2) AS monthly, period, currency, array_to_string(amount_warnings, ',') AS warnings FROM amounts"),
    "P1d_amount_policies": sql("amounts", _POLICIES),
    "P2_amount_options": sql("amounts", "SELECT a.seq, CASE WHEN amount_ok THEN round_even(CASE WHEN is_range THEN least(v[1], v[2]) WHEN is_open AND regexp_matches(s, " + q(UP_TO) + ") THEN 0 ELSE v[1] END, 2) END AS min, CASE WHEN amount_ok THEN round_even(CASE WHEN is_range THEN greatest(v[1], v[2]) ELSE v[1] END, 2) END AS max, CASE WHEN amount_ok THEN round_even(chosen, 2) END AS avg FROM amounts a JOIN am6 USING (seq)"),
    "P3_dates": sql("dates", "SELECT seq, date_code AS code, parsed, array_to_string(date_warnings, ',') AS warnings FROM dts"),
    "P3c_date_window": sql("dates", _WINDOWED),
    "P4_date_policy": sql("policy", 'SELECT separator, ord AS "order" FROM policy'),
    "P6_emails": sql("emails", "SELECT seq, email_code AS code, address, array_to_string(email_warnings, ',') AS warnings FROM emails"),
    "P7_lead_ids": sql("ids", "SELECT seq, id_code AS code, id_canonical AS canonical, id_number AS number, array_to_string(id_warnings, ',') AS warnings FROM ids"),
    "P8_websites": sql("sites", "SELECT seq, site_code AS code, url, site_domain AS registrable, array_to_string(site_warnings, ',') AS warnings FROM sites"),
    "P9_page_domains": f"WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages) SELECT {registrable_sql('host')} AS registrable, count(*) AS pages FROM h GROUP BY 1",
    "P10_domain_match": sql("emails sites", f"SELECT e.seq, CASE WHEN email_domain <> '' THEN {registrable_sql('email_domain')} = site_domain END AS same_domain FROM emails e JOIN sites s USING (seq)"),
    "P11_P14_fit": sql("fit", "SELECT seq, head_count, band, level, non_buyer, icp, quality FROM fit"),
    "P15_result_codes": sql("scored", "SELECT seq, array_to_string(list_concat([id_code], id_warnings), ',') AS id_codes, array_to_string(list_concat([date_code], date_warnings), ',') AS created_codes, array_to_string(list_concat([email_code], email_warnings), ',') AS email_codes, array_to_string(list_concat([site_code], site_warnings), ',') AS website_codes, array_to_string(list_concat([amount_code], amount_warnings), ',') AS budget_codes FROM scored"),
    "P16_data_issues": sql("scored", "SELECT seq, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {text} END" for cond, text in _ISSUES) + "], lambda x: x IS NOT NULL), '; ') AS issues FROM scored"),
    "S1_S6_csv_scan": sql("c", "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, * EXCLUDE (seq, notes), notes || CASE WHEN seq % 3 = 0 THEN " + q(_SAID) + " ELSE '' END AS notes FROM c"),
    "S5_kept_rows": sql("kept", "SELECT seq, lead_id, source FROM kept"),
    "S6_row_index": sql("kept", "SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS row_index FROM kept"),
    "S10_profile_json": sql("scored", "SELECT seq, company, intent_type, decision_authority AS authority, confidence, coalesce(round_even(conf_urgency, 3), 0) AS urgency_confidence, codes[1] AS first_negative, email_code FROM scored"),
    "S10_profile_store": sql("scored", "SELECT seq, codes[1] AS first_negative, company, intent_type, buying_stage, timeline, timeline_days, problems, array_to_string(codes, ',') AS negatives, confidence, CAST(n_conflicts AS BIGINT) AS contradictions, coalesce(round_even(conf_urgency, 3), 0) AS urgency_confidence FROM scored"),
    "S11_flat_frame": sql("scored", _FLAT),
    "S12_load_report": sql("kept policy dups", f"""SELECT (SELECT count(*) FROM c) AS rows_in_file, (SELECT count(*) FROM kept) AS rows_loaded, (SELECT count(*) FROM c) - (SELECT count(*) FROM kept) AS rows_dropped,
  (SELECT string_agg(lead_id, ',' ORDER BY seq) FROM (SELECT seq, lead_id FROM c WHERE seq NOT IN (SELECT seq FROM kept) ORDER BY seq LIMIT 5)) AS dropped_examples, '{",".join(FIELDS)}' AS headers, '{",".join(f"{f}={f}" for f in FIELDS)}' AS column_map, '' AS unmapped_fields,
  (SELECT coalesce(string_agg(separator || '=' || ord, ',' ORDER BY separator), '') FROM policy) AS date_order_policy, (SELECT count(*) FILTER (is_duplicate) FROM dups) AS duplicate_ids"""),
    "T1_sorted_ids": sql("ids", "SELECT seq, lead_id, row_number() OVER (ORDER BY bad IS NOT NULL, id_number, CASE WHEN bad IS NULL THEN id_suffix ELSE lead_id END, id_prefix, seq) AS place FROM ids"),
    "T2_reversed_ids": sql("ids", "SELECT seq, lead_id, row_number() OVER (ORDER BY bad IS NOT NULL DESC, id_number DESC, CASE WHEN bad IS NULL THEN id_suffix ELSE lead_id END DESC, id_prefix DESC, seq) AS place FROM ids"),
    "T3_invalid_first": sql("ids", "SELECT seq, lead_id, row_number() OVER (ORDER BY bad IS NULL, id_number, CASE WHEN bad IS NULL THEN id_suffix ELSE lead_id END, id_prefix, seq) AS place FROM ids"),
    "T4_top_scores": sql("scored", 'SELECT seq AS "row", raw_score, band FROM scored ORDER BY raw_score DESC, seq LIMIT 10'),
    "T5_top_issues": sql("scored", 'SELECT seq AS "row", CAST(data_issues AS INT) AS data_issues FROM scored WHERE data_issues > 0 ORDER BY data_issues DESC, seq LIMIT 25'),
    "T6_by_display_score": sql("scored", _by_place("score")),
    "T7_by_raw_score": sql("scored", _by_place("raw_score")),
    "X2_conversation_clauses": sql("turns", "SELECT conv_id, turn, clauses, words, operative FROM turns"),
    "W4_X6_highlighted_notes": sql("marked", "SELECT seq, html, spans FROM c JOIN marked m ON m.note = c.notes"),
    "W1_duplicates": sql("dups", "SELECT seq, is_duplicate FROM dups"),
    "W3_order_shares": "SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)",
}
_LOWER = sql("scored", _CAPS.replace("AS band_label", "AS band_label, raw_score AS score"))
for _least, _low in ((82, 0), (50, -10), (22, -20)):
    _LOWER = _LOWER.replace(f"total >= {_least} ", f"total >= {_low} ")
ORACLES["S7_G11_low_bands"] = _LOWER
ORACLES["F3_indexed_search"] = ORACLES["F3_search"]
