"""Notes as text: folding, clauses, negation, modality and quotes, all with code point offsets."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .results import let
from .scan import ClauseReader, Reading, pattern_set, structs

# Signs, markers, cues, terms and windows.
FOLD_FROM = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u2013\u2014\u2012\u2015\u2212\u00a0\u2007\u202f\t\n\r\u2026"
FOLD_TO = "''''\"\"\"-----      ."
CONTRAST = ("but", "however", "although", "though", "that said", "even so", "unfortunately", "sadly", "except", "unless", "whereas", "still", "on the other hand", "having said that", "then again", "albeit")
SENTENCE_END = r"(?<=[.!?;])\s+|\s+[-–—]\s+"
CONTRAST_AT = rf"(?:(?<=[\s,;])|^)(?:{'|'.join(CONTRAST)})(?=[\s,]|$)"
SUBCLAUSE = r",\s+(?=(?:so|because|since|while|which|as)\b)"
NEGATION = (
    r"\bnot\b", r"\bno\b", r"\bnone\b", r"\bnever\b", r"\bnothing\b", r"\bn't\b", r"\bdon'?t\b", r"\bdoesn'?t\b", r"\bdidn'?t\b", r"\bisn'?t\b", r"\baren'?t\b",
    r"\bwasn'?t\b", r"\bweren'?t\b", r"\bwon'?t\b", r"\bwont\b", r"\bcan'?t\b", r"\bcannot\b", r"\bcouldn'?t\b", r"\bshouldn'?t\b", r"\bwouldn'?t\b", r"\bhaven'?t\b",
    r"\bhasn'?t\b", r"\bhadn'?t\b", r"\bwithout\b", r"\black(?:ing|s)?\s+(?:of\s+)?\b", r"\bhardly\b", r"\bbarely\b", r"\bscarcely\b", r"\brather than\b",
    r"\binstead of\b", r"\bfar from\b", r"\bnowhere near\b",
)
NOT_NEGATION = (r"\bno\s+(?:brainer|doubt|question|problem)\b", r"\bnot\s+only\b", r"\bnot\s+sure\s+who\b", r"\bno\s+longer\b")
SCOPE_STOP = r"[,;:]|\b(?:but|however|although|though|so|because|since|yet|until|till|unless|before|after|once|when|while|except)\b"
SCOPE = 60
HEDGES = (
    "might", "maybe", "may ", "perhaps", "possibly", "could", "would", "considering", "thinking about", "not sure", "unsure", "somewhat", "kind of", "sort of",
    "eventually", "someday", "at some point", "curious", "vague", "loosely", "in future", "down the line", "ish",
)
BOOSTERS = (
    "definitely", "absolutely", "certainly", "urgently", "immediately", "asap", "right away", "must", "need to", "have to", "ready to", "committed", "approved",
    "signed off", "priority", "keen", "already",
)
MODAL_WINDOW = 45

SPANS = T.ArrayType(T.StructType().add("s", T.IntegerType()).add("e", T.IntegerType()))


@F.arrow_udf(T.StringType())
def _compatible(texts: pa.Array) -> pa.Array:
    """NFKC of each text, or the text itself where that would change its length. Spark has no such function."""
    folded = ((t, t and unicodedata.normalize("NFKC", t)) for t in texts.to_pylist())
    return pa.array([f if f is not None and len(f) == len(t) else t for t, f in folded], pa.string())


def normalise(text: Column) -> Column:
    """Lower case in compatibility form, with folded quotes, dashes and spaces, one sign for one. Only texts beyond ASCII go to Python."""
    text = F.coalesce(text, F.lit(""))
    # Marked so that the optimiser does not move it into an expression that Python runs, or into a lambda.
    plain = F.coalesce(_compatible.asNondeterministic()(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    return F.lower(F.translate(plain, FOLD_FROM, FOLD_TO))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e>>: start and end of every match of a pattern; null texts have none."""

    @F.arrow_udf(SPANS)
    def places(texts: pa.Array) -> pa.Array:
        found = [[m.span() for m in re.finditer(pattern, t)] for t in texts.to_pylist()]
        ends = [0, *accumulate(map(len, found))]
        return structs({"s": ([s for own in found for s, _ in own], pa.int32()), "e": ([e for own in found for _, e in own], pa.int32())}, ends)

    return places(F.coalesce(text, F.lit("")))


def merge_spans(spans: Column) -> Column:
    """Sorted spans with those that meet or overlap put together."""
    kind = "array<struct<s:int,e:int>>"

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(out) > 0) & (x["s"] <= last["e"]), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans).cast(kind), F.array().cast(kind), step)


@lru_cache(maxsize=1)
def clause_reader() -> ClauseReader:
    return ClauseReader(SENTENCE_END, CONTRAST_AT, SUBCLAUSE, NEGATION, NOT_NEGATION, SCOPE_STOP, SCOPE)


@F.arrow_udf(SPANS)
def _scopes(clauses: pa.Array) -> pa.Array:
    found = [clause_reader().scopes(t) for t in clauses.to_pylist()]
    return structs({"s": ([s for own in found for s, _ in own], pa.int32()), "e": ([e for own in found for _, e in own], pa.int32())}, [0, *accumulate(map(len, found))])


def negation_spans(clause: Column) -> Column:
    """array<struct<s, e>>: stretches of a clause under negation."""
    return _scopes(F.coalesce(clause, F.lit("")))


CLAUSES = T.ArrayType(T.StructType().add("text", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("operative", T.BooleanType()).add("marker", T.StringType()).add("neg", SPANS))


@F.arrow_udf(CLAUSES)
def _clauses(texts: pa.Array) -> pa.Array:
    reading = Reading(clause_reader(), pattern_set(()), pattern_set(()), [])
    for text in texts.to_pylist():
        reading.add(text)
    return reading.clause_array()


def split_clauses(norm: Column) -> Column:
    """array<struct<text, start, end, operative, marker, neg>> of a normalised note; a null note has none.

    Sentences are cut before contrast markers (the clause from there is operative) and after commas that open a
    subordinate clause. Time and size grow with the note.
    """
    return _clauses(F.coalesce(norm, F.lit("")))


def negated_at(neg: Column, at: Column) -> Column:
    return F.exists(neg, lambda s: (s["s"] <= at) & (at < s["e"]))


def modality(clause: Column, at: Column) -> Column:
    """Factor by which the words around a place weaken or strengthen it."""
    escape = lambda words: "|".join(w.replace(".", r"\.") for w in words)
    low = F.greatest(at - MODAL_WINDOW, F.lit(0))
    window = F.substring(clause, low + 1, at + MODAL_WINDOW - low)
    factor = F.when(window.rlike(escape(HEDGES)), 0.75).otherwise(1.0) * F.when(window.rlike(escape(BOOSTERS)), 1.15).otherwise(1.0)
    return F.greatest(F.lit(0.4), F.least(F.lit(1.2), factor))


def snippet(raw: Column, start: Column, end: Column, pad: int = 24) -> Column:
    """A quote of the original note around a span, with marks where it was cut."""
    low, high = F.greatest(start - pad, F.lit(0)), F.least(end + pad, F.length(raw))
    body = F.replace(F.regexp_replace(F.substring(raw, low + 1, high - low), r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(high < F.length(raw), "…").otherwise(""))


def highlight(raw: Column, spans: Column) -> Column:
    """The note as HTML with its evidence marked. ``spans`` are array<struct<s, e, kind>>; those that overlap are put together and have the kind of the first, of equal ones the first given; kind "neg" is marked as such."""
    kind = "array<struct<s:int,back:int,nth:int,e:int,kind:string>>"
    safe = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    fits = F.filter(spans, lambda x: (x["s"] >= 0) & (x["e"] <= F.length(raw)) & (x["e"] > x["s"]))
    ordered = F.array_sort(F.transform(fits, lambda x, i: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), i.alias("nth"), x["e"].alias("e"), x["kind"].alias("kind")))).cast(kind)

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        merged = F.struct(last["s"].alias("s"), last["back"].alias("back"), last["nth"].alias("nth"), F.greatest(last["e"], x["e"]).alias("e"), F.coalesce(F.nullif(last["kind"], F.lit("")), x["kind"]).alias("kind"))
        return F.when((F.size(out) > 0) & (x["s"] < last["e"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(merged))).otherwise(F.concat(out, F.array(x)))

    def shown(m: Column) -> Column:
        cut = lambda a, b: safe(F.substring(raw, a + 1, b - a))
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(m, i - 1)["e"])
        marked = lambda x, i: F.concat(cut(before(i), x["s"]), F.when(x["kind"] == "neg", '<mark class="neg">').otherwise("<mark>"), cut(x["s"], x["e"]), F.lit("</mark>"))
        return F.concat(F.array_join(F.transform(m, marked), ""), cut(F.coalesce(F.try_element_at(m, F.lit(-1))["e"], F.lit(0)), F.length(raw)))

    return let(F.aggregate(ordered, F.array().cast(kind), step), shown)
