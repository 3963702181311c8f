"""The uniform outcome of a field parser: struct<ok, value, code, raw, detail, warnings>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Return codes.
CODES = (
    "OK", "OK_NORMALISED", "OK_REPAIRED", "OK_ASSUMED",
    "EMPTY", "JUNK", "PLACEHOLDER", "NOT_A_VALUE", "OUT_OF_RANGE", "AMBIGUOUS",
    "AMOUNT_NO_DIGITS", "AMOUNT_INVERTED_RANGE", "AMOUNT_RANGE", "AMOUNT_OPEN_ENDED", "AMOUNT_ZERO", "AMOUNT_NO_PERIOD", "AMOUNT_PERIOD_CONVERTED",
    "DATE_UNKNOWN_FORMAT", "DATE_IMPOSSIBLE", "DATE_AMBIGUOUS_ORDER", "DATE_TWO_DIGIT_YEAR", "DATE_OUT_OF_WINDOW", "DATE_FUTURE",
    "EMAIL_NO_AT", "EMAIL_MULTIPLE_AT", "EMAIL_MISSING_LOCAL", "EMAIL_MISSING_DOMAIN", "EMAIL_INVALID_CHARS", "EMAIL_MISSING_TLD", "EMAIL_INVALID_TLD",
    "EMAIL_FREEMAIL", "EMAIL_DISPOSABLE", "EMAIL_ROLE_ADDRESS",
    "ID_MISSING", "ID_NO_NUMBER", "ID_MALFORMED", "ID_HAS_SUFFIX", "ID_DUPLICATE",
    "WEB_IS_EMAIL", "WEB_INVALID_HOST", "WEB_NO_DOT", "WEB_INVALID_TLD", "WEB_SCHEME_ADDED", "WEB_DOMAIN_MISMATCH",
)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(rows: list[dict], kind: str) -> Column:
    """A small table of plain values as one constant array<struct>, folded when planned. Empty tables are fine."""
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def shown(v) -> str:
        if isinstance(v, (list, tuple)):
            return f"array({', '.join(map(shown, v))})"
        return "null" if v is None else quoted(v) if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v).lower()

    body = ", ".join("named_struct(" + ", ".join(f"{quoted(k)}, {shown(v)}" for k, v in r.items()) + ")" for r in rows)
    return F.expr(f"cast(array({body}) as array<struct<{kind}>>)")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def warned(*pairs: tuple[Column, str]) -> Column:
    """array<string> of the codes whose condition holds, in order."""
    return F.filter(F.array(*(F.when(cond, F.lit(code)) for cond, code in pairs)), lambda x: x.isNotNull()) if pairs else F.array().cast("array<string>")


def outcome(raw: Column, failure: Column, code: Column, value: Column, warnings: Column) -> Column:
    """Success with ``code`` where ``failure`` is null; otherwise that failure code and no value.

    Failure and code are computed once: each may hold a dozen patterns.
    """
    none = F.array().cast("array<string>")

    def made(failed: Column, final: Column) -> Column:
        ok = failed.isNull()
        return F.struct(
            ok.alias("ok"),
            F.when(ok, value).alias("value"),
            final.alias("code"),
            raw.alias("raw"),
            F.replace(F.lower(final), F.lit("_"), F.lit(" ")).alias("detail"),
            F.when(ok, warnings).otherwise(none).alias("warnings"),
        )

    return let(failure, lambda failed: let(F.coalesce(failed, code), lambda final: made(failed, final)))


def first_of(*pairs: tuple[Column, str]) -> Column:
    """Code of the first condition that holds, or null."""
    out = None
    for cond, code in pairs:
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out


def has(result: Column, code: str) -> Column:
    return (result["code"] == code) | F.array_contains(result["warnings"], code)


def all_codes(result: Column) -> Column:
    return F.concat(F.array(result["code"]), result["warnings"])


def unwrap_or(result: Column, default: Column) -> Column:
    return F.coalesce(result["value"], default)


def as_json(result: Column) -> Column:
    return F.to_json(result)
