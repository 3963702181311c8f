"""Reading intent from notes: signals, resolutions, enquiry type, problems, horizon, negatives and confidence.

One Arrow function cuts a note into clauses and says where the lexicon's patterns occur and whether they are negated there
(``functions.scan``: one pass of an automaton over the note). All that follows from the places, such as modality,
the strongest signal of each dimension and the confidences, is expressions of the same row: no explode
and no shuffle, so it scales with the scan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.results import let, table
from ..functions.scan import Reading, pattern_set
from ..functions.texts import CLAUSES, clause_reader, modality, normalise, snippet, word_count
from .lexicon import LADDERS, Lexicon, load_lexicon

# What a buyer's note is expected to say, and how it is called.
EXPECTED = {"budget_status": "budget", "urgency": "timeline / urgency", "decision_authority": "decision authority", "buying_stage": "buying stage", "pain_severity": "pain severity"}
SOLUTION = {"UNKNOWN": "UNKNOWN", "AWARENESS": "GENERAL_INTEREST", "EXPLORATION": "EXPLORATION", "EVALUATION": "EVALUATION", "DECISION": "EVALUATION", "PURCHASE": "IMPLEMENTATION"}
SIGNAL = "struct<operative:boolean,strength:double,specificity:double,confidence:double,back:int,order:array<int>,dimension:string,value:string,polarity:string,rule_id:string,evidence:string,start:int,end:int,clause:int,negated:boolean>"
_FOUND = f"struct<clauses:{CLAUSES.simpleString()},rules:array<struct<pattern:int,nth:int,s:int,e:int,clause:int,negated:boolean>>,notes:array<struct<pattern:int,s:int,e:int,number:string,negated:boolean>>>"


def _reader(of_clauses: tuple[str, ...], of_notes: tuple[str, ...], groups: list[int | None]):
    """An Arrow function of a normalised note: its clauses, all places of the clause patterns, and the first of every note pattern that occurs."""

    @F.arrow_udf(_FOUND)
    def read(notes: pa.Array) -> pa.Array:
        reading = Reading(clause_reader(), pattern_set(of_clauses), pattern_set(of_notes), groups)
        for note in notes.to_pylist():
            reading.add(note)
        return pa.StructArray.from_arrays([reading.clause_array(), reading.place_array(), reading.first_array()], ["clauses", "rules", "notes"])

    # Marked so that the optimiser keeps it in a step of its own; inside the lambdas that read its answer Spark could not run it.
    return read.asNondeterministic()


class _Places:
    """Which note pattern stands at which place of the finder's answer."""

    def __init__(self, lexicon: Lexicon):
        self.clauses = [{"pattern": p, "entry": k, "nth": i} for k, r in enumerate(lexicon.rules) for i, p in enumerate(r["patterns"])]
        self.notes: list[tuple[str, int | None]] = []
        self.types = [self._add([p]) | {"type": t["type"], "confidence": t["confidence"]} for t in lexicon.intent_types for p in t["patterns"]]
        self.problems = [self._add(p["patterns"]) | {"label": p["label"], "category": p["category"]} for p in lexicon.problems]
        self.negatives = [self._add(n["patterns"]) | {"seq": k, "code": n["code"], "reason": n["reason"], "severity": n["severity"]} for k, n in enumerate(lexicon.negatives)]
        self.timelines = [self._add([t["pattern"]], t["group"]) | {"seq": k, "days": None if t["group"] is not None else int(t["days"] or 0), "times": int(t["multiplier"]), "label": t["label"]} for k, t in enumerate(lexicon.timelines)]

    def _add(self, patterns: list[str], group: int | None = None) -> dict:
        at = len(self.notes)
        self.notes += [(p, group) for p in patterns]
        return {"at": at, "n": len(patterns)}


def _firsts(found: Column, rows: list[dict], kind: str) -> Column:
    """array<struct<m, e>> in the order of the entries: the place ``m`` of the first pattern of every entry ``e`` that occurs.

    Goes over what was found, which is little, and not over all entries: entries are runs of patterns, one after the
    other, and ``found`` is sorted by pattern.
    """
    low, high = (rows[0]["at"], rows[-1]["at"] + rows[-1]["n"]) if rows else (0, 0)
    of_pattern = table([r for r in rows for _ in range(r["n"])], kind)
    own = F.filter(found, lambda m: (m["pattern"] >= low) & (m["pattern"] < high))
    met = F.transform(own, lambda m: F.struct(m.alias("m"), F.get(of_pattern, m["pattern"] - low).alias("e")))
    return let(met, lambda all_met: F.filter(all_met, lambda x, i: F.coalesce(F.get(all_met, i - 1)["e"]["at"] != x["e"]["at"], F.lit(True))))


def signals(clauses: Column, places: Column, raw: Column, lexicon: Lexicon, patterns: list[dict]) -> Column:
    """array of all signals of a note, in the order of clauses, rules, patterns and places. ``patterns`` says which rule's each clause pattern is."""
    entries = [{k: lexicon.rules[p["entry"]][k] for k in ("id", "dimension", "value", "negated_value", "strength", "specificity")} | {"entry": p["entry"], "nth": p["nth"]} for p in patterns]
    rules = table(entries, "id:string,dimension:string,value:string,negated_value:string,strength:double,specificity:double,entry:int,nth:int")

    def signal(h: Column) -> Column:
        return let(F.struct(F.get(clauses, h["clause"]).alias("c"), F.get(rules, h["pattern"]).alias("r")), lambda x: made(h, x["c"], x["r"], h["negated"]))

    def made(h: Column, c: Column, r: Column, neg: Column) -> Column:
        confidence = F.least(F.lit(1.0), r["specificity"] * modality(c["text"], h["s"])) * F.when(neg, 0.9).otherwise(1.0)
        return F.struct(
            c["operative"].alias("operative"),
            (r["strength"] * F.when(neg, 0.95).otherwise(1.0)).alias("strength"),
            r["specificity"].alias("specificity"),
            confidence.alias("confidence"),
            (-(c["start"] + h["s"])).alias("back"),
            F.array(-h["clause"], -r["entry"], -r["nth"], -h["nth"]).alias("order"),
            r["dimension"].alias("dimension"),
            F.when(neg, r["negated_value"]).otherwise(r["value"]).alias("value"),
            F.when(neg, "NEGATIVE").otherwise("POSITIVE").alias("polarity"),
            r["id"].alias("rule_id"),
            snippet(raw, c["start"] + h["s"], c["start"] + h["e"]).alias("evidence"),
            (c["start"] + h["s"]).alias("start"),
            (c["start"] + h["e"]).alias("end"),
            h["clause"].alias("clause"),
            neg.alias("negated"),
        )

    return F.filter(F.transform(places, signal), lambda s: s["value"].isNotNull()).cast(f"array<{SIGNAL}>")


def resolve_all(all_signals: Column, least: float) -> Column:
    """array<struct<value, confidence, evidence, rule_id, start, end, is_unknown, support, conflict>>, one a dimension.

    The operative, strongest, most specific, surest and earliest signal wins outright; nothing is averaged.
    """
    dimensions = table([{"name": d, "ladder": list(ladder)} for d, ladder in LADDERS.items()], "name:string,ladder:array<string>")

    def resolve(d: Column) -> Column:
        own = F.filter(all_signals, lambda s: (s["dimension"] == d["name"]) & (s["confidence"] >= least))
        return let(own, lambda group: let(F.array_max(group), lambda w: ranked(d, group, w)))

    def ranked(d: Column, group: Column, w: Column) -> Column:
        step = lambda s: F.array_position(d["ladder"], s["value"])
        real = F.filter(group, lambda s: (s["value"] != w["value"]) & ((F.abs(step(s) - step(w)) >= 2) | (s["polarity"] != w["polarity"])))
        worst = lambda x: F.array_max(F.transform(x, lambda s: F.struct(s["strength"].alias("strength"), s["order"].alias("order"), s["value"].alias("value"), s["evidence"].alias("evidence"), s["operative"].alias("operative"))))
        return let(real, lambda x: let(worst(x), lambda y: found(d, group, w, x, y)))

    def found(d: Column, group: Column, w: Column, real: Column, worst: Column) -> Column:
        support = F.size(F.filter(group, lambda s: s["value"] == w["value"]))
        lifted = w["confidence"] + F.least(F.lit(0.15), 0.05 * (support - 1)) - F.when(F.size(real) > 0, 0.2).otherwise(0.0)
        conflict = F.struct(
            d["name"].alias("dimension"),
            w["value"].alias("kept"),
            worst["value"].alias("rejected"),
            F.when(w["operative"] & ~worst["operative"], "post-contrast clause takes precedence").otherwise("stronger, more specific evidence retained").alias("rule"),
            w["evidence"].alias("evidence_kept"),
            worst["evidence"].alias("evidence_rejected"),
        )
        return F.struct(
            F.coalesce(w["value"], F.lit("UNKNOWN")).alias("value"),
            F.when(w.isNull(), 0.0).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), lifted))).alias("confidence"),
            F.coalesce(w["evidence"], F.lit("")).alias("evidence"),
            F.coalesce(w["rule_id"], F.lit("")).alias("rule_id"),
            w["start"].alias("start"),
            w["end"].alias("end"),
            w.isNull().alias("is_unknown"),
            support.alias("support"),
            F.when(worst.isNotNull(), conflict).alias("conflict"),
        )

    return F.transform(dimensions, resolve)


def intent_type(found: Column, raw: Column, rows: list[dict]) -> Column:
    """struct<type, confidence, evidence>: the first pattern, by priority, whose first match is not negated."""
    sure = F.filter(_firsts(found, rows, "at:int,n:int,type:string,confidence:double"), lambda x: ~x["m"]["negated"])
    unknown = F.struct(F.lit("UNKNOWN").alias("type"), F.lit(0.3).alias("confidence"), F.lit("").alias("evidence"))
    shown = lambda x: F.when(x.isNotNull(), F.struct(x["e"]["type"].alias("type"), x["e"]["confidence"].alias("confidence"), snippet(raw, x["m"]["s"], x["m"]["e"]).alias("evidence")))
    return F.coalesce(let(F.get(sure, F.lit(0)), shown), unknown)


def problems(found: Column, raw: Column, rows: list[dict]) -> Column:
    """array<struct<label, category, evidence>> of the problems a note names."""
    one = lambda x: F.struct(x["e"]["label"].alias("label"), x["e"]["category"].alias("category"), snippet(raw, x["m"]["s"], x["m"]["e"]).alias("evidence"))
    return F.transform(_firsts(found, rows, "at:int,n:int,label:string,category:string"), one)


def timeline(found: Column, rows: list[dict]) -> Column:
    """struct<days, seq, label> of the soonest horizon that a note states, or null."""

    def one(x: Column) -> Column:
        t, m = x["e"], x["m"]
        days = F.coalesce(t["days"], m["number"].try_cast("int") * t["times"])
        label = F.replace(t["label"], F.lit("{0}"), F.coalesce(m["number"], F.lit("")))
        return F.when(days.isNotNull(), F.struct(days.alias("days"), t["seq"].alias("seq"), label.alias("label")))

    return F.array_min(F.transform(_firsts(found, rows, "at:int,n:int,seq:int,days:int,times:int,label:string"), one))


def negatives(found: Column, raw: Column, rows: list[dict]) -> Column:
    """array<struct<code, reason, evidence, start, end, severity>>, the gravest first."""

    def one(x: Column) -> Column:
        n, m = x["e"], x["m"]
        return F.struct((-n["severity"]).alias("rank"), n["seq"].alias("seq"), n["code"].alias("code"), n["reason"].alias("reason"), snippet(raw, m["s"], m["e"]).alias("evidence"), m["s"].alias("start"), m["e"].alias("end"), n["severity"].alias("severity"))

    ordered = F.array_sort(F.transform(_firsts(found, rows, "at:int,n:int,seq:int,code:string,reason:string,severity:double"), one))
    return F.transform(ordered, lambda n: F.struct(*(n[k].alias(k) for k in ("code", "reason", "evidence", "start", "end", "severity"))))


def extract_intent(df: DataFrame, notes: str = "notes", title_level: str | None = None, lexicon: Lexicon | None = None, name: str = "intent") -> DataFrame:
    """Add the intent profile of every note as a struct column. Empty notes give unknowns and confidence 0."""
    lex = lexicon or load_lexicon()
    at = _Places(lex)
    least = float(lex.settings["min_signal_confidence"])
    kept = [F.col(c) for c in df.columns if c != name]
    raw = F.coalesce(F.col("_raw"), F.lit(""))
    level = F.col(title_level) if title_level else F.lit(None).cast("string")

    step = df.select(*kept, F.coalesce(F.col(notes).cast("string"), F.lit("")).alias("_raw"), level.alias("_level"))
    step = step.withColumn("_norm", normalise(F.col("_raw")))
    read = _reader(tuple(p["pattern"] for p in at.clauses), tuple(p for p, _ in at.notes), [group for _, group in at.notes])
    step = step.withColumn("_found", read(F.col("_norm"))).withColumn("_clauses", F.col("_found")["clauses"])
    step = step.withColumn("_signals", signals(F.col("_clauses"), F.col("_found")["rules"], raw, lex, at.clauses))
    found = F.col("_found")["notes"]
    step = step.select(
        *step.columns,
        resolve_all(F.col("_signals"), least).alias("_resolved"),
        intent_type(found, raw, at.types).alias("_type"),
        problems(found, raw, at.problems).alias("_problems"),
        timeline(found, at.timelines).alias("_when"),
        negatives(found, raw, at.negatives).alias("_negatives"),
        word_count(F.col("_raw")).alias("_words"),
    )
    step = step.select(*(c for c in step.columns if c not in ("_found", "_norm", "_resolved")), *(F.get("_resolved", F.lit(k)).alias(f"_{d}") for k, d in enumerate(LADDERS)))
    asked = F.col("_decision_authority")
    titled = F.struct(
        F.col("_level").alias("value"), F.lit(0.55).alias("confidence"), F.lit("(inferred from job title)").alias("evidence"), F.lit("authority.from_title").alias("rule_id"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("is_unknown"), asked["support"].alias("support"), asked["conflict"].alias("conflict"),
    )
    step = step.withColumn("_decision_authority", F.when(asked["is_unknown"] & F.col("_level").isNotNull(), titled).otherwise(asked))
    dims = [F.col(f"_{d}") for d in LADDERS]
    empty = F.trim(F.regexp_replace("_raw", r"\s+", " ")) == ""
    contradictions = F.filter(F.array(*(d["conflict"] for d in dims)), lambda c: c.isNotNull())
    known = F.filter(F.array(*(F.when(~d["is_unknown"], d["confidence"]) for d in dims)), lambda c: c.isNotNull())
    said = F.array(*(F.when(F.col(f"_{d}")["is_unknown"], F.lit(f"no {word} stated")) for d, word in EXPECTED.items()))
    lacking = F.filter(F.concat(said, F.array(F.when(F.col("_words") < 6, "note is very short"), F.when(F.size("_problems") == 0, "no specific problem identified"))), lambda x: x.isNotNull())
    nothing = F.array(F.lit("notes are empty"), *(F.lit(f"no {word} stated") for word in EXPECTED.values()))
    kind = F.when(empty, F.struct(F.lit("UNKNOWN").alias("type"), F.lit(0.0).alias("confidence"), F.lit("").alias("evidence"))).otherwise(F.col("_type"))
    step = step.select(*kept, *(c for c in step.columns if c.startswith("_")), contradictions.alias("_contra"), known.alias("_known"), F.when(empty, nothing).otherwise(lacking).alias("_lacking"), kind.alias("_kind"), empty.alias("_empty"))

    n = F.size("_known")
    mean = F.aggregate("_known", F.lit(0.0), lambda s, x: s + x) / F.greatest(n, F.lit(1))
    base = F.when(n == 0, 0.1).otherwise(0.65 * mean + 0.35 * n / len(LADDERS))
    base = F.when(F.col("_words") < 6, base * 0.7).when(F.col("_words") > 25, F.least(F.lit(1.0), base * 1.05)).otherwise(base)
    base = base - 0.05 * F.size("_contra")
    t = F.col("_kind")
    base = F.when(t["type"] == "UNKNOWN", base * 0.85).otherwise(0.75 * base + 0.25 * t["confidence"])
    gravest = F.array_max(F.transform("_negatives", lambda x: x["severity"]))
    base = F.when(~t["type"].isin("UNKNOWN", "PURCHASE"), F.greatest(base, t["confidence"] * 0.9)).when(gravest.isNotNull(), F.greatest(base, gravest * 0.7)).otherwise(base)
    confidence = F.when(F.col("_empty"), 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 3))

    stage, urgent = F.col("_buying_stage")["value"], F.col("_urgency")["value"]
    codes = F.transform("_negatives", lambda x: x["code"])
    commitment = (
        F.when(F.col("_empty"), "UNKNOWN")
        .when(stage == "PURCHASE", "READY_TO_BUY")
        .when(urgent.isin("HIGH", "VERY_HIGH") & stage.isin("EVALUATION", "DECISION"), "CONCRETE_TIMELINE")
        .when(stage == "DECISION", "CONCRETE_TIMELINE")
        .when(stage == "EVALUATION", "ACTIVE_EVALUATION")
        .when(stage == "EXPLORATION", "EXPLORATION")
        .when(stage == "AWARENESS", "INTEREST")
        .when(F.arrays_overlap(codes, F.array(F.lit("NOT_A_BUYER"), F.lit("JOB_SEEKER"), F.lit("SPAM"))), "NONE")
        .otherwise("UNKNOWN")
    )
    solution = F.lit("UNKNOWN")
    for s, meant in SOLUTION.items():
        solution = F.when(stage == s, meant).otherwise(solution)
    profile = F.struct(
        *(F.col(f"_{d}").alias(d) for d in LADDERS),
        t.alias("intent_type"),
        F.col("_problems").alias("problems"),
        F.array_distinct(F.transform("_problems", lambda p: p["category"])).alias("categories"),
        F.coalesce(F.col("_when")["label"], F.lit("")).alias("timeline_text"),
        F.col("_when")["days"].alias("timeline_days"),
        F.col("_negatives").alias("negatives"),
        F.col("_contra").alias("contradictions"),
        commitment.alias("commitment"),
        solution.alias("solution_intent"),
        F.col("_lacking").alias("missing"),
        confidence.alias("confidence"),
        F.col("_words").alias("note_length"),
        F.col("_clauses").alias("clauses"),
        F.col("_signals").alias("signals"),
    )
    return step.select(*kept, profile.alias(name))


def read_note(spark: SparkSession, note: str | None, title_level: str | None = None, lexicon: Lexicon | None = None) -> Row:
    """The profile of one note, for looking at by hand; many notes go through ``extract_intent``."""
    df = spark.createDataFrame([(note, title_level)], "notes string, level string")
    return extract_intent(df, "notes", "level", lexicon).first()["intent"]


def level(profile: Column, dimension: str) -> Column:
    """Value of a dimension; UNKNOWN where the note says nothing."""
    return profile[dimension]["value"]


def level_place(profile: Column, dimension: str) -> Column:
    """Place of the value on the dimension's ladder, from 0 for UNKNOWN."""
    return F.array_position(F.array(*map(F.lit, LADDERS[dimension])), profile[dimension]["value"]).cast("int") - 1


def evidence_of(profile: Column, dimension: str) -> Column:
    return profile[dimension]["evidence"]


def confidence_of(profile: Column, dimension: str) -> Column:
    return profile[dimension]["confidence"]


def is_purchase_intent(profile: Column) -> Column:
    return profile["intent_type"]["type"] == "PURCHASE"


def profile_record(profile: Column, **context: Column) -> Column:
    """The profile grouped for reading, confidences to three digits. ``context`` goes in as it is (lead_id, company, contact, raw_notes)."""
    p, r3 = profile, lambda x: F.bround(x, 3)
    value = lambda d: p[d]["value"].alias(d)

    def said(s: Column) -> Column:
        return F.struct(*(s[k].alias(k) for k in ("dimension", "value")), r3(s["strength"]).alias("strength"), *(s[k].alias(k) for k in ("polarity", "rule_id", "evidence")), F.array(s["start"], s["end"]).alias("span"), *(s[k].alias(k) for k in ("clause", "operative", "negated")), r3(s["confidence"]).alias("confidence"))

    def dimension(d: str) -> Column:
        x = p[d]
        supporting = F.filter(p["signals"], lambda s: (s["dimension"] == d) & (s["value"] == x["value"]))
        span = F.when(x["start"].isNotNull(), F.array(x["start"], x["end"]))
        return F.struct(x["value"].alias("value"), r3(x["confidence"]).alias("confidence"), x["evidence"].alias("evidence"), x["rule_id"].alias("rule_id"), span.alias("span"), F.transform(supporting, said).alias("supporting"), x["conflict"].alias("conflict"), x["is_unknown"].alias("unknown")).alias(d)

    parts = [
        F.struct(p["intent_type"]["type"].alias("intent_type"), r3(p["intent_type"]["confidence"]).alias("intent_type_confidence"), p["intent_type"]["evidence"].alias("intent_type_evidence"), value("buying_stage"), p["solution_intent"].alias("solution_intent"), p["commitment"].alias("commitment")).alias("intent"),
        F.struct(F.transform(p["problems"], lambda x: x["label"]).alias("problems"), p["categories"].alias("problem_categories"), value("problem_recognition"), value("pain_severity")).alias("pain"),
        F.struct(value("budget_status"), value("urgency"), p["timeline_text"].alias("timeline"), p["timeline_days"].alias("timeline_days"), value("competitive_evaluation")).alias("buying_signals"),
        F.struct(value("decision_authority")).alias("authority"),
        F.transform(p["negatives"], lambda n: F.struct(*(n[k].alias(k) for k in ("code", "reason", "evidence", "severity")))).alias("negative_signals"),
        F.struct(r3(p["confidence"]).alias("confidence"), p["missing"].alias("missing_information"), p["contradictions"].alias("contradictions"), F.struct(*(dimension(d) for d in LADDERS)).alias("per_dimension")).alias("quality"),
    ]
    if context:
        parts.insert(0, F.struct(*(c.alias(k) for k, c in context.items())).alias("context"))
    return F.struct(*parts)


def profile_json(profile: Column, **context: Column) -> Column:
    """``profile_record`` as JSON text."""
    return F.to_json(profile_record(profile, **context), {"ignoreNullFields": "false"})


def profile_variant(profile: Column, **context: Column) -> Column:
    """``profile_record`` as a variant, which keeps the types of all its fields and is read by path without parsing text."""
    return F.to_variant_object(profile_record(profile, **context))


def read_variant(stored: Column, like: T.DataType) -> Column:
    """A stored record as typed columns again; ``like`` is the type of the record (``profile_record`` of any profile)."""
    return F.variant_get(stored, "$", like.simpleString())
