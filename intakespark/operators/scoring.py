"""Explainable scores: a ledger of points, then routing, caps, placements and floors."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.settings import read_settings
from .lexicon import LADDERS

# Points, bands and routes.
DEFAULT = {
    "bands": [("CONTACT_NOW", 82, "Contact now"), ("CONSIDER", 50, "Consider"), ("NURTURE", 22, "Nurture"), ("DISQUALIFY", -999, "Disqualify")],
    #: ceiling, floor, route, multiplier
    "routing": {
        "PURCHASE": ("CONTACT_NOW", None, "Sales", 1.0),
        "UNKNOWN": ("CONSIDER", None, "Sales", 0.85),
        "PARTNERSHIP": ("CONSIDER", "CONSIDER", "Partnerships", 0.6),
        "RESEARCH": ("NURTURE", "NURTURE", "Marketing", 0.4),
        "EDUCATIONAL": ("NURTURE", "NURTURE", "Community", 0.3),
        "COMPETITIVE": ("DISQUALIFY", None, "None", 0.0),
        "EMPLOYMENT": ("DISQUALIFY", None, "Recruiting", 0.0),
        "VENDOR_PITCH": ("DISQUALIFY", None, "None", 0.0),
        "SPAM": ("DISQUALIFY", None, "None", 0.0),
    },
    "intent": {
        "budget_status": {"APPROVED": 16, "ALLOCATED": 13, "BUDGETED": 10, "NOT_LOCKED": 4, "PRICE_SENSITIVE": -4, "NO_BUDGET": -12},
        "urgency": {"VERY_HIGH": 18, "HIGH": 15, "MODERATE": 8, "LOW": 1, "NEGATIVE": -10},
        "buying_stage": {"PURCHASE": 18, "DECISION": 14, "EVALUATION": 10, "EXPLORATION": 5, "AWARENESS": 1},
        "decision_authority": {"EXPLICIT": 12, "LIKELY": 8, "INFLUENCER": 4, "NONE": -5},
        "pain_severity": {"CRITICAL": 12, "HIGH": 10, "MODERATE": 5, "LOW": 1},
        "problem_recognition": {"STRONG": 8, "MODERATE": 5, "WEAK": 1, "NONE": -3},
        "competitive_evaluation": {"YES": 5, "NO": 2},
    },
    "problem_bonus": 4,
    "confidence_floor": 0.55,
    "size": {"solo": -6, "small": 6, "mid": 10, "large": 7},
    "profile": {"true": 8, "false": -6},
    "source_points": 8,
    "budget": {"floor": 5000, "above": 10, "at": 6, "below": -8, "unknown": 0},
    "non_buyer": -15,
    "quality": {"invalid_email": -6, "freemail": -2, "role": -1, "missing_website": -2, "invalid_website": -2, "domain_match": 3, "missing_notes": -8, "duplicate": -5, "bad_id": -2},
    "negative_factor": 14,
    "already_scored": ("NO_BUDGET", "DEFERRED"),
    "placements": {
        "NOT_A_BUYER": "DISQUALIFY", "JOB_SEEKER": "DISQUALIFY", "SPAM": "DISQUALIFY", "VENDOR_PITCH": "DISQUALIFY", "COMPETITOR": "DISQUALIFY",
        "STUDENT_OR_RESEARCH": "NURTURE", "PARTNERSHIP_ONLY": "CONSIDER", "NO_BUDGET": "NURTURE", "DEFERRED": "NURTURE", "OUT_OF_ICP": "CONSIDER",
    },
    "display": (-60, 115),
}
_BUDGET_KEYS = {"above_floor": "above", "at_floor": "at", "below_floor": "below"}
_QUALITY_KEYS = {"freemail_email": "freemail", "role_email": "role", "email_domain_matches_website": "domain_match", "duplicate_lead": "duplicate", "missing_lead_id": "bad_id"}
GROUPS = ("Intent", "Fit", "Data quality", "Negative signal", "Routing")
LINE = "struct<group:string,label:string,points:double,evidence:string>"


def scoring_config(**changes) -> dict:
    """The default configuration with whole sections replaced."""
    out = copy.deepcopy(DEFAULT)
    unknown = set(changes) - set(out)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    return out | changes


def load_scoring(path: str | None = None, data: dict | None = None) -> dict:
    """A configuration from a file or dict with the sections bands, intent_routing, intent_weights, fit_weights and so on; what is missing keeps its default."""
    raw = read_settings(path) if data is None and path else data or {}
    changes: dict = {}
    if raw.get("bands"):
        changes["bands"] = [(b["name"], b.get("min_score", -1e9), b.get("label", b["name"].replace("_", " ").title())) for b in raw["bands"]]
    if raw.get("intent_routing"):
        changes["routing"] = {t: (r.get("max_band"), r.get("min_band"), r.get("route", "Sales"), float(r.get("multiplier", 1.0))) for t, r in raw["intent_routing"].items()}
    if raw.get("intent_weights"):
        changes["intent"] = {d: {str(k): v for k, v in w.items() if v} for d, w in raw["intent_weights"].items()}
    for name, key in (("problem_identified_bonus", "problem_bonus"), ("confidence_floor", "confidence_floor"), ("negative_signal_penalty", "negative_factor"), ("hard_cap_codes", "placements")):
        if name in raw:
            changes[key] = raw[name]
    if "negative_signals_already_scored" in raw:
        changes["already_scored"] = tuple(raw["negative_signals_already_scored"] or ())
    fit, quality = raw.get("fit_weights") or {}, raw.get("quality_weights") or {}
    if "employee_band" in fit:
        changes["size"] = {k: v for k, v in fit["employee_band"].items() if v}
    if "is_icp_agency" in fit:
        changes["profile"] = {"true": 0, "false": 0} | {str(k).lower(): v for k, v in fit["is_icp_agency"].items() if str(k).lower() in ("true", "false")}
    if "source_quality_points" in fit:
        changes["source_points"] = fit["source_quality_points"]
    if "budget_vs_floor" in fit:
        changes["budget"] = DEFAULT["budget"] | {_BUDGET_KEYS.get(k, k): v for k, v in fit["budget_vs_floor"].items()}
    if "non_buyer_title" in fit:
        changes["non_buyer"] = fit["non_buyer_title"]
    if quality:
        changes["quality"] = dict.fromkeys(DEFAULT["quality"], 0) | {_QUALITY_KEYS.get(k, k): v for k, v in quality.items() if _QUALITY_KEYS.get(k, k) in DEFAULT["quality"]}
    if "display" in raw:
        changes["display"] = (raw["display"].get("raw_min", -60), raw["display"].get("raw_max", 110))
    return scoring_config(**changes)


def band_meta(name: str, config: dict | None = None) -> dict:
    """Name, least score and label of a band; {} for an unknown one."""
    return next(({"name": n, "min_score": least, "label": label} for n, least, label in (config or DEFAULT)["bands"] if n == name), {})


def _map(column: Column, table: dict, default=None) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in table.items():
        out = out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(default))


def _line(group: str, label, points: Column, evidence) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(group).alias("group"), text(label).alias("label"), points.cast("double").alias("points"), F.coalesce(text(evidence), F.lit("")).alias("evidence"))


def _lines(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(cond, line) for cond, line in pairs))).cast(f"array<{LINE}>")


def intent_lines(p: Column, c: dict) -> tuple[Column, Column]:
    """(points, lines) of the note: table values, the bonus for a named problem, all times the confidence."""
    parts, total = [], F.lit(0.0)
    for d in LADDERS:
        if d in c["intent"]:
            points = _map(p[d]["value"], {k: float(v) for k, v in c["intent"][d].items()}, 0.0)
            total = total + points
            parts.append((points != 0, _line("Intent", F.concat(F.lit(d.replace("_", " ").capitalize() + ": "), p[d]["value"]), points, p[d]["evidence"])))
    named = F.size(p["problems"]) > 0
    total = total + F.when(named, float(c["problem_bonus"])).otherwise(0.0)
    parts.append((named & F.lit(bool(c["problem_bonus"])), _line("Intent", F.concat(F.lit("Named problem: "), F.array_join(F.transform(p["problems"], lambda x: x["label"]), ", ")), F.lit(float(c["problem_bonus"])), F.array_join(F.transform(p["problems"], lambda x: x["evidence"]), "; "))))
    factor = F.greatest(F.lit(c["confidence_floor"]), p["confidence"])
    parts.append(((factor < 1) & (total != 0), _line("Intent", F.concat(F.lit("NLP confidence x"), F.format_number(factor, 2)), F.bround(total * factor - total, 1), F.concat(F.size(p["missing"]).cast("string"), F.lit(" field(s) not stated in the note")))))
    return total * F.when(factor < 1, factor).otherwise(1.0), _lines(*parts)


def fit_lines(c: dict) -> tuple[Column, Column]:
    size = _map(F.col("employee_band"), {k: float(v) for k, v in c["size"].items()}, 0.0)
    icp = F.when(F.col("is_icp"), float(c["profile"]["true"])).when(~F.col("is_icp"), float(c["profile"]["false"])).otherwise(0.0)
    source = F.lit(float(c["source_points"])) * F.col("source_quality")
    m, b = F.col("budget_monthly"), c["budget"]
    budget = F.when(m.isNull(), float(b["unknown"])).when(m > b["floor"], float(b["above"])).when(m == b["floor"], float(b["at"])).otherwise(float(b["below"]))
    seller = F.when(F.col("is_non_buyer_title"), float(c["non_buyer"])).otherwise(0.0)
    where = F.when(m.isNull(), "unknown").when(m > b["floor"], "above floor").when(m == b["floor"], "at floor").otherwise("below floor")
    lines = _lines(
        (size != 0, _line("Fit", F.concat(F.lit("Company size: "), F.col("employee_band")), size, F.col("employees"))),
        (icp != 0, _line("Fit", F.when(F.col("is_icp"), "In target profile").otherwise("Outside target profile"), icp, F.col("company"))),
        (source != 0, _line("Fit", F.concat(F.lit("Source: "), F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown"))), F.bround(source, 1), F.concat(F.lit("channel quality "), F.format_number("source_quality", 2)))),
        (budget != 0, _line("Fit", F.concat(F.lit("Stated budget "), where), budget, F.col("monthly_budget"))),
        (F.col("is_non_buyer_title"), _line("Fit", F.concat(F.lit("Non-buying role: "), F.col("title")), seller, F.col("title"))),
    )
    return size + icp + source + budget + seller, lines


def quality_lines(c: dict) -> tuple[Column, Column]:
    q = {k: float(v) for k, v in c["quality"].items()}
    mail, web = F.col("email_result"), F.col("website_result")
    rows = (
        (~mail["ok"], "invalid_email", F.concat(F.lit("Invalid email ("), mail["code"], F.lit(")")), mail["raw"]),
        (mail["ok"] & mail["value"]["is_freemail"], "freemail", F.lit("Personal email domain"), mail["value"]["domain"]),
        (mail["ok"] & mail["value"]["is_role"], "role", F.lit("Role mailbox"), mail["value"]["address"]),
        (~web["ok"] & (web["code"] == "EMPTY"), "missing_website", F.lit("Website empty"), web["raw"]),
        (~web["ok"] & (web["code"] != "EMPTY"), "invalid_website", F.concat(F.lit("Website "), web["detail"]), web["raw"]),
        (F.coalesce(F.col("domain_match"), F.lit(False)), "domain_match", F.lit("Email domain matches website"), F.lit("")),
        (F.trim(F.coalesce("notes", F.lit(""))) == "", "missing_notes", F.lit("No notes"), F.lit("")),
        (F.col("is_duplicate"), "duplicate", F.lit("Duplicate lead ID"), F.col("lead_id")),
        (~F.col("id_result")["ok"], "bad_id", F.concat(F.lit("Lead ID "), F.col("id_result")["code"]), F.col("id_result")["raw"]),
    )
    total = F.lit(0.0)
    for cond, key, _, _ in rows:
        total = total + F.when(cond, q[key]).otherwise(0.0)
    return total, _lines(*((cond & F.lit(q[key] != 0), _line("Data quality", label, F.lit(q[key]), evidence)) for cond, key, label, evidence in rows))


def negative_lines(p: Column, c: dict) -> tuple[Column, Column]:
    """(points, lines): severity times a factor; codes that a dimension already scores stay in the ledger at 0."""
    already = F.array(*map(F.lit, c["already_scored"])) if c["already_scored"] else F.array().cast("array<string>")
    cost = lambda n: F.when(F.array_contains(already, n["code"]), 0.0).otherwise(-F.bround(n["severity"] * float(c["negative_factor"]), 1))
    lines = F.transform(p["negatives"], lambda n: _line("Negative signal", F.concat(n["code"], F.lit(": "), n["reason"]), cost(n), n["evidence"]))
    return F.aggregate(F.transform(p["negatives"], cost), F.lit(0.0), lambda s, x: s + x), lines.cast(f"array<{LINE}>")


def score(df: DataFrame, config: dict | None = None, intent: str = "intent") -> DataFrame:
    """Add score, display_score, band, band_label, route, ledger and caps to cleaned records with an intent profile."""
    c = config or DEFAULT
    names = [b[0] for b in c["bands"]]
    index = {n: k for k, n in enumerate(names)}
    p = F.col(intent)
    blocks = [intent_lines(p, c), fit_lines(c), quality_lines(c), negative_lines(p, c)]
    kind = F.when(p["intent_type"]["type"].isin(*c["routing"]), p["intent_type"]["type"]).otherwise("UNKNOWN")
    route = lambda k: {t: r[k] for t, r in c["routing"].items() if r[k] is not None}
    step = df.select(
        "*",
        (blocks[0][0] + blocks[1][0] + blocks[2][0] + blocks[3][0]).alias("_before"),
        F.concat(*(lines for _, lines in blocks)).alias("_lines"),
        kind.alias("_kind"),
        _map(kind, route(3), 1.0).alias("_times"),
        _map(kind, route(2), "Sales").alias("route"),
        _map(kind, {t: index[b] for t, b in route(0).items()}, 0).alias("_ceiling"),
        _map(kind, {t: index[b] for t, b in route(1).items()}, len(names)).alias("_floor"),
    )
    total = F.col("_before") * F.col("_times")
    routed = _line("Routing", F.concat(F.col("_kind"), F.lit(" multiplier x"), F.col("_times").cast("string")), F.bround(total - F.col("_before"), 1), "")
    by_score = F.lit(len(names) - 1)
    for k, (_, least, _) in reversed(list(enumerate(c["bands"]))):
        by_score = F.when(F.col("_total") >= least, k).otherwise(by_score)
    target = F.transform(p["negatives"], lambda n: _map(n["code"], {code: index[b] for code, b in c["placements"].items()}))
    dead = index.get("DISQUALIFY", len(names) - 1)
    low, high = c["display"]
    step = step.withColumn("_total", total).withColumn("ledger", F.when(F.col("_times") != 1, F.concat("_lines", F.array(routed).cast(f"array<{LINE}>"))).otherwise(F.col("_lines")))
    step = step.withColumn("_by_score", by_score).withColumn("_targets", F.array_compact(target))
    capped = F.greatest("_by_score", "_ceiling")
    placed = F.coalesce(F.array_max(F.filter("_targets", lambda t: t != dead)), capped)
    killed = F.when(F.array_contains("_targets", F.lit(dead)), dead).otherwise(placed)
    final = F.least(killed, F.col("_floor"))
    label = F.array(*(F.lit(b[2]) for b in c["bands"]))
    word = lambda text, k: F.concat(F.lit(text), F.get(label, k))
    caps = F.array_compact(
        F.array(
            F.when(capped != F.col("_by_score"), word("Capped at ", capped)),
            F.when(placed != capped, F.when(placed < capped, word("Raised to ", placed)).otherwise(word("Held at ", placed))),
            F.when(killed != placed, word("Capped at ", killed)),
            F.when(final != killed, word("Raised to ", final)),
        )
    )
    return step.select(
        *df.columns,
        F.bround("_total", 1).alias("score"),
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("_total") - low) / (high - low) * 100)), 1).alias("display_score"),
        F.get(F.array(*map(F.lit, names)), final).alias("band"),
        F.get(label, final).alias("band_label"),
        "route",
        "ledger",
        caps.alias("caps"),
    )
