"""How a company and a person fit the target profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .results import let, strip

# Bands, titles, channels and profile patterns.
SIZE_BANDS = (("solo", 1, 1), ("micro", 2, 9), ("small", 10, 24), ("mid", 25, 74), ("large", 75, 999_999))
TITLES = {
    "EXPLICIT": (),
    "LIKELY": ("ceo", "founder", "co-founder", "owner", "managing director", "md", "managing partner", "partner", "coo", "cto", "president", "principal"),
    "INFLUENCER": ("head of ops", "head of growth", "head of revops", "vp growth", "vp ops", "director of ops", "director", "head of", "vp ", "marketing manager", "operations manager", "consultant"),
    "NONE": ("student", "intern", "recruiter", "developer", "engineer", "freelancer", "job seeker", "candidate"),
}
NON_BUYERS = ("student", "recruiter", "developer", "intern", "journalist", "candidate")
SOURCE_QUALITY = {"referral": 1.0, "linkedin": 0.8, "event": 0.7, "cold reply": 0.6, "webform": 0.5, "unknown": 0.4}
PROFILE_COMPANY = ("agency", "marketing", "growth", "media", "gtm", "seo", "ppc", "demand gen", "outbound", "performance", "lead gen", "appointment.setting")
PROFILE_NOTES = (r"we'?re an? .{0,40}agency", r"\bour (?:clients|accounts)\b", "agency owner")
PROFILE_NOT = ("not an agency", "small local business", "car dealership")


def employees_of(text: Column) -> Column:
    """Number in a head-count cell: the mean of several, rounded half to even; null without digits."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("bigint"))
    mean = lambda n: F.bround(F.aggregate(n, F.lit(0).cast("bigint"), lambda s, x: s + x) / F.size(n), 0).cast("bigint")
    return let(numbers, lambda n: F.when(F.size(n) == 1, F.get(n, F.lit(0))).when(F.size(n) > 1, mean(n)))


def size_band(employees: Column, bands=SIZE_BANDS) -> Column:
    out = F.when(employees.isNull(), "unknown")
    for name, low, high in bands:
        out = out.when(employees.between(low, high), name)
    return out.otherwise("unknown")


def title_authority(title: Column, levels=TITLES) -> Column:
    """Level of the first list of which a word is part of the title; null where none is."""
    t = F.lower(strip(F.coalesce(title, F.lit(""))))
    out = F.when(t == "", None)
    for level in ("EXPLICIT", "LIKELY", "INFLUENCER", "NONE"):
        for word in levels.get(level, ()):
            out = out.when(t.contains(word), level)
    return out


def is_non_buyer(title: Column, words=NON_BUYERS) -> Column:
    t = F.lower(strip(F.coalesce(title, F.lit(""))))
    out = F.lit(False)
    for word in words:
        out = out | t.contains(word)
    return out


def in_profile(company: Column, notes: Column, profile: dict | None = None) -> Column:
    """True, false or null (nothing says): exclusions first, then what notes and company say."""
    own = profile or {"company": PROFILE_COMPANY, "notes": PROFILE_NOTES, "not": PROFILE_NOT}
    name, said = F.lower(F.coalesce(company, F.lit(""))), F.lower(F.concat_ws(" ", F.coalesce(company, F.lit("")), F.coalesce(notes, F.lit(""))))
    hit = lambda text, patterns: text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    return F.when(hit(said, own["not"]), False).when(hit(said, own["notes"]) | hit(name, own["company"]), True)


def source_quality(source: Column, quality=None) -> Column:
    quality = quality or SOURCE_QUALITY
    out = F.when(F.lit(False), 0.0)
    for name, value in quality.items():
        out = out.when(F.lower(F.coalesce(source, F.lit(""))) == name, value)
    return out.otherwise(quality.get("unknown", 0.4))
