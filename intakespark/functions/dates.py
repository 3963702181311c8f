"""Dates in many notations, with day and month order learnt from the whole column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .results import first_of, let, outcome, strip, warned

# Notations, month names and words that are no dates.
JUNK = ("asdf", "test", "lead_id", "created", "date", "n/a", "na", "tbd", "-", "none", "null")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
SEPARATORS = ("-", "/", ".")
NUMERIC = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{2}|\d{4})$"
#: (kind, pattern, group of year, month, day)
NOTATIONS = (
    ("iso", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 1, 2, 3),
    ("compact", r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
    ("numeric", NUMERIC, 4, 1, 3),
    ("mdy_text", rf"(?i)^{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?[,\s]+(\d{{2}}|\d{{4}})$", 3, 1, 2),
    ("dmy_text", rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH}\.?[,\s]+(\d{{2}}|\d{{4}})$", 3, 2, 1),
    ("my_text", rf"(?i)^{_MONTH}\.?[,\s]+(\d{{4}})$", 2, 1, 0),
    ("ym", r"^(\d{4})[-/](\d{1,2})$", 1, 2, 0),
    ("iso_time", r"^(\d{4})-(\d{2})-(\d{2})[T ]\d{2}:\d{2}.*$", 1, 2, 3),
)


@dataclass(frozen=True)
class DateConfig:
    fallback_order: str = "month_first"
    order_by_separator: dict[str, str] = field(default_factory=dict)
    two_digit_year_pivot: int = 70
    min_year: int = 1990
    max_year: int = 2100
    plausible_from: str | None = None
    plausible_to: str | None = None
    reject_future: bool = False


def numeric_order(text: Column) -> tuple[Column, Column, Column]:
    """(separator, whether it proves the day first, the month first) of a date in numbers; the separator of other texts is empty."""
    s = strip(F.coalesce(text.cast("string"), F.lit("")))
    separator, a, b = F.regexp_extract(s, NUMERIC, 2), F.regexp_extract(s, NUMERIC, 1).try_cast("int"), F.regexp_extract(s, NUMERIC, 3).try_cast("int")
    return separator, F.coalesce((a > 12) & (b <= 12), F.lit(False)), F.coalesce((b > 12) & (a <= 12), F.lit(False))


def order_evidence(df: DataFrame, column: str) -> DataFrame:
    """(separator, day_first, month_first): how many values prove each order."""
    separator, day, month = numeric_order(F.col(column))
    parts = df.select(separator.alias("separator"), day.alias("day"), month.alias("month")).where(F.col("separator") != "")
    return parts.groupBy("separator").agg(F.count_if("day").alias("day_first"), F.count_if("month").alias("month_first"))


def infer_order_policy(df: DataFrame, column: str) -> DataFrame:
    """(separator, order) for separators with a strict majority of evidence. Partial counts combine before the shuffle."""
    day, month = F.col("day_first"), F.col("month_first")
    return order_evidence(df, column).where(day != month).select("separator", F.when(day > month, "day_first").otherwise("month_first").alias("order"))


def with_order_policy(df: DataFrame, column: str, name: str = "date_policy") -> DataFrame:
    """Add the learnt policy as a map to every row: one row of at most three entries, broadcast."""
    policy = infer_order_policy(df, column).agg(F.map_from_entries(F.collect_list(F.struct("separator", "order"))).alias(name))
    return df.join(F.broadcast(policy), F.lit(True))


def parse_date(text: Column, config: DateConfig | None = None, policy: Column | None = None, as_of: Column | None = None) -> Column:
    """struct result whose value has ``date`` and ``pattern``. ``policy`` is a map of separator to order."""
    c = config or DateConfig()
    today = as_of if as_of is not None else F.current_date()
    raw = F.coalesce(text.cast("string"), F.lit(""))
    s0 = F.regexp_replace(F.btrim(strip(raw), F.lit(",")), r"\s+", " ")
    if policy is None:
        policy = F.create_map(*(F.lit(x) for kv in c.order_by_separator.items() for x in kv)) if c.order_by_separator else None

    def read(s: Column) -> Column:
        kind = None
        for name, pattern, *_ in NOTATIONS:
            hit = s.rlike(pattern)
            kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        return let(kind, lambda k: let(_fields(s, k), lambda f: _close(s, k, f)))

    def _fields(s: Column, kind: Column) -> Column:
        def pick(which: int) -> Column:
            out = None
            for name, pattern, *groups in NOTATIONS:
                g = groups[which]
                got = F.regexp_extract(s, pattern, g) if g else F.lit("1")
                out = F.when(kind == name, got) if out is None else out.when(kind == name, got)
            return out

        return F.struct(pick(0).alias("y"), pick(1).alias("m"), pick(2).alias("d"), F.when(kind == "numeric", F.regexp_extract(s, NUMERIC, 2)).alias("sep"))

    def _close(s: Column, kind: Column, f: Column) -> Column:
        month_no = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(f["m"], 1, 3))).cast("int")
        first = F.when(kind.isin("mdy_text", "dmy_text", "my_text"), month_no).otherwise(f["m"].try_cast("int"))
        second, y = f["d"].try_cast("int"), f["y"].try_cast("int")
        numeric = F.coalesce(kind == "numeric", F.lit(False))
        unclear = numeric & (first <= 12) & (second <= 12)
        order = F.lit(c.fallback_order) if policy is None else F.coalesce(F.try_element_at(policy, f["sep"]), F.lit(c.fallback_order))
        day_first = numeric & (((first > 12) & (second <= 12)) | (unclear & (order == "day_first")))
        month, day = F.when(day_first, second).otherwise(first), F.when(day_first, first).otherwise(second)
        short = kind.isin("numeric", "mdy_text", "dmy_text", "my_text") & (y < 100)
        year = F.when(short & (y <= c.two_digit_year_pivot), y + 2000).when(short, y + 1900).otherwise(y)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        date = F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2)).try_cast("date")

        def end(d: Column) -> Column:
            future = d > today
            outside = F.lit(False)
            if c.plausible_from:
                outside = outside | (d < F.lit(c.plausible_from).cast("date"))
            if c.plausible_to:
                outside = outside | (d > F.lit(c.plausible_to).cast("date"))
            failure = first_of(
                (s == "", "EMPTY"),
                (F.lower(s).isin(*JUNK), "JUNK"),
                (kind.isNull(), "DATE_UNKNOWN_FORMAT"),
                (d.isNull(), "DATE_IMPOSSIBLE"),
                (~F.year(d).between(c.min_year, c.max_year), "OUT_OF_RANGE"),
                (future & F.lit(c.reject_future), "DATE_FUTURE"),
            )
            code = F.when(unclear | kind.isin("my_text", "ym"), "OK_ASSUMED").otherwise("OK")
            warnings = warned((short, "DATE_TWO_DIGIT_YEAR"), (unclear, "DATE_AMBIGUOUS_ORDER"), (outside, "DATE_OUT_OF_WINDOW"), (future, "DATE_FUTURE"))
            return outcome(raw, failure, code, F.struct(d.alias("date"), kind.alias("pattern")), warnings)

        return let(date, end)

    return let(s0, read)


def parse_date_column(df: DataFrame, column: str, name: str, config: DateConfig | None = None, as_of: Column | None = None) -> DataFrame:
    """Parse a column with the order learnt from that column."""
    return with_order_policy(df, column, "_policy").withColumn(name, parse_date(F.col(column), config, F.col("_policy"), as_of)).drop("_policy")
