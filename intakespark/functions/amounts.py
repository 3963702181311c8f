"""Money amounts from free text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .results import first_of, let, outcome, strip, warned, whole

# Signs, units, words and patterns that readings depend on.
CURRENCIES = {"$": "USD", "us$": "USD", "usd": "USD", "£": "GBP", "gbp": "GBP", "€": "EUR", "eur": "EUR", "₦": "NGN", "ngn": "NGN", "₹": "INR", "inr": "INR", "zar": "ZAR", "kes": "KES"}
MULTIPLIERS = {"k": 1e3, "m": 1e6, "mm": 1e6, "b": 1e9}
MONTHLY = {"month": 1.0, "week": 4.345, "day": 30.44, "quarter": 1 / 3, "year": 1 / 12, "hour": 0.0, "one_off": 0.0}
PERIODS = (
    ("month", r"/\s*mo\b|/\s*month\b|per\s+month\b|p/?m\b|a\s+month\b|monthly\b|/\s*mth\b"),
    ("week", r"/\s*wk\b|/\s*week\b|per\s+week\b|weekly\b|a\s+week\b"),
    ("day", r"/\s*day\b|per\s+day\b|daily\b|a\s+day\b"),
    ("hour", r"/\s*hr\b|/\s*hour\b|per\s+hour\b|hourly\b|an\s+hour\b"),
    ("quarter", r"/\s*q\b|per\s+quarter\b|quarterly\b|a\s+quarter\b"),
    ("year", r"/\s*yr\b|/\s*year\b|per\s+year\b|annually\b|per\s+annum\b|p\.?a\.?\b|a\s+year\b"),
    ("one_off", r"\bone[-\s]?off\b|\bone[-\s]?time\b|\btotal\b|\bproject\b"),
)
PLACEHOLDERS = (
    "tbd", "t.b.d", "tba", "n/a", "na", "none", "nil", "null", "-", "--", "unknown", "unsure", "not sure", "depends", "it depends", "depends what you can do",
    "ask", "tbc", "?", "??", "open", "flexible", "negotiable", "confidential", "prefer not to say", "wont share", "won't share",
)
PLACEHOLDER_FORMS = r"(?:wont|won't|will\s+not)\s+share.*|depends.*|(?:not\s+)?(?:sure|decided|set|fixed)"
JUNK = ("asdf", "test", "qwerty", "xxx", "budget", "monthly_budget")
CURRENCY = r"(?:us\$|[$£€₦₹]|\b(?:usd|gbp|eur|ngn|inr|kes|zar)\b)"
TOKEN = rf"(?i)({CURRENCY})?\s*(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*((?:k|m|mm|b)\b)?"
RANGE = r"\s*(?:-|–|—|to|and|until|thru|through|\.\.\.?)\s*|(?i:\s*(?:-|–|—|to|and|through|thru)\s*)"
UP_TO = r"(?i)\b(?:up\s+to|under|below|less\s+than|max(?:imum)?(?:\s+of)?|<=?)\b"
FROM = r"(?i)\b(?:from|at\s+least|over|above|more\s+than|min(?:imum)?(?:\s+of)?|starting(?:\s+at)?|>=?|\+)\b"
ABOUT = r"(?i)\b(?:approx(?:imately)?|around|about|circa|roughly|~|ish)\b"


@dataclass(frozen=True)
class AmountConfig:
    default_currency: str = "USD"
    range_policy: str = "avg"
    normalise_to_monthly: bool = True
    assume_period: str = "month"
    min_plausible: float = 1.0
    max_plausible: float = 5_000_000.0


def currency_of(text: Column, default: str) -> Column:
    def named(found: Column) -> Column:
        out = F.when(found == "", default)
        for sign, code in CURRENCIES.items():
            out = out.when(found == sign, code)
        return out.otherwise(default)

    return let(F.lower(F.regexp_extract(text, f"(?i){CURRENCY}", 0)), named)


def period_of(text: Column) -> Column:
    out = None
    for name, pattern in PERIODS:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _times(mult: Column) -> Column:
    out = F.when(mult == "", 1.0)
    for sign, factor in MULTIPLIERS.items():
        out = out.when(F.lower(mult) == sign, factor)
    return out


def parse_amount(text: Column, config: AmountConfig | None = None, range_policy: str | None = None) -> Column:
    """struct result whose value has value, minimum, maximum, currency, period, is_range, monthly, policy and options."""
    c = config or AmountConfig()
    policy = range_policy or c.range_policy
    if policy not in ("min", "max", "avg"):
        raise ValueError(f"unknown range policy {policy!r}")
    raw = F.coalesce(text.cast("string"), F.lit(""))

    def read(s: Column) -> Column:
        return let(
            F.struct(
                F.regexp_extract_all(s, F.lit(TOKEN), F.lit(2)).alias("nums"),
                F.regexp_extract_all(s, F.lit(TOKEN), F.lit(3)).alias("mults"),
                F.get(F.split(s, TOKEN, -1), F.lit(1)).alias("between"),
                F.btrim(F.lower(s), F.lit(" .,;:")).alias("low"),
            ),
            lambda t: let(
                F.struct(
                    F.transform(
                        F.arrays_zip(t["nums"].alias("n"), t["mults"].alias("m")),
                        lambda x: let(
                            F.regexp_replace(x["n"], ",", "").cast("double"),
                            lambda n: n * F.when((x["m"] == "") & (n < 1000), _times(F.coalesce(F.try_element_at(F.filter(t["mults"], lambda m: m != ""), F.lit(-1)), F.lit("")))).otherwise(_times(x["m"])),
                        ),
                    ).alias("v"),
                    ((F.size(t["nums"]) >= 2) & F.coalesce(t["between"].rlike(whole(RANGE)), F.lit(False))).alias("is_range"),
                ),
                lambda v: _amount(raw, s, t, v, policy, c),
            ),
        )

    return let(strip(raw), read)


def _amount(raw: Column, s: Column, t: Column, v: Column, policy: str, c: AmountConfig) -> Column:
    a, b = F.get(v["v"], F.lit(0)), F.get(v["v"], F.lit(1))
    return let(F.struct(s.rlike(UP_TO).alias("up"), (s.rlike(FROM) | s.endswith("+")).alias("more"), period_of(s).alias("stated")), lambda w: _stated(raw, s, t, v, w, a, b, policy, c))


def _stated(raw: Column, s: Column, t: Column, v: Column, w: Column, a: Column, b: Column, policy: str, c: AmountConfig) -> Column:
    """The outcome from what is read once of a text: numbers (``t``, ``v``), limits and period (``w``)."""
    up, more, stated = w["up"], w["more"], w["stated"]
    period = F.coalesce(stated, F.lit(c.assume_period))
    low = F.when(v["is_range"], F.least(a, b)).when(up, 0.0).otherwise(a)
    high = F.when(v["is_range"], F.greatest(a, b)).when(~up & more, F.lit(float("inf"))).otherwise(a)
    middle = F.when(v["is_range"], (a + b) / 2).otherwise(a)
    chosen = F.when(v["is_range"], {"min": F.least(a, b), "max": F.greatest(a, b), "avg": (a + b) / 2}[policy]).otherwise(a)

    factor = F.lit(None).cast("double")
    if c.normalise_to_monthly:
        factor = F.when(F.lit(False), 0.0)
        for name, times in MONTHLY.items():
            factor = factor.when(period == name, times)
        factor = F.nullif(factor.otherwise(1.0), F.lit(0.0))

    def closed(x: Column) -> Column:
        value = F.struct(
            x["chosen"].alias("value"),
            x["low"].alias("minimum"),
            x["high"].alias("maximum"),
            currency_of(s, c.default_currency).alias("currency"),
            period.alias("period"),
            v["is_range"].alias("is_range"),
            (x["chosen"] * factor).alias("monthly"),
            F.lit(policy).alias("policy"),
            F.struct(x["low"].alias("min"), F.when(x["high"] == float("inf"), a).otherwise(x["high"]).alias("max"), x["middle"].alias("avg")).alias("options"),
        )
        failure = first_of(
            (s == "", "EMPTY"),
            (t["low"].isin(*JUNK), "JUNK"),
            (t["low"].isin(*PLACEHOLDERS) | t["low"].rlike(whole(PLACEHOLDER_FORMS)), "PLACEHOLDER"),
            (~s.rlike(r"\d"), "AMOUNT_NO_DIGITS"),
            (F.size(t["nums"]) == 0, "NOT_A_VALUE"),
            ((x["chosen"] != 0) & ~x["chosen"].between(c.min_plausible, c.max_plausible), "OUT_OF_RANGE"),
        )
        warnings = warned(
            (v["is_range"] & (a > b), "AMOUNT_INVERTED_RANGE"),
            (v["is_range"], "AMOUNT_RANGE"),
            (~v["is_range"] & (up | more), "AMOUNT_OPEN_ENDED"),
            (x["chosen"] == 0, "AMOUNT_ZERO"),
            (stated.isNull(), "AMOUNT_NO_PERIOD"),
            (factor.isNotNull() & (period != "month"), "AMOUNT_PERIOD_CONVERTED"),
        )
        return outcome(raw, failure, F.when(s.rlike(ABOUT) | v["is_range"], "OK_ASSUMED").otherwise("OK"), value, warnings)

    return let(F.struct(low.alias("low"), high.alias("high"), middle.alias("middle"), chosen.alias("chosen")), closed)


def amount_options(text: Column, config: AmountConfig | None = None) -> Column:
    """struct<min, max, avg>: every reading of a range; null where nothing was read."""
    return parse_amount(text, config)["value"]["options"]
