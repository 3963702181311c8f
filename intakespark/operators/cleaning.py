"""From raw contact fields to typed, checked and enriched records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount
from ..functions.contacts import LeadIdConfig, domains_match, parse_email, parse_lead_id, parse_website
from ..functions.dates import infer_order_policy, parse_date
from ..functions.fit import employees_of, in_profile, is_non_buyer, size_band, source_quality, title_authority
from ..functions.results import has
from ..sources.contacts import drop_test_rows
from ..sources.settings import Settings
from .places import with_place

FIELD_RESULTS = ("id_result", "created_result", "email_result", "website_result", "budget_result")


def mark_duplicates(df: DataFrame, result: str = "id_result", order: str = "seq", name: str = "is_duplicate") -> DataFrame:
    """Mark the second and later rows of an identifier number, in file order; rows without a valid one are never marked.

    Only numbers that occur twice meet the rows again: their first rows come from partial minima, and rows without a
    number get join keys of their own, so neither those nor a frequent number needs its rows in one task (the join
    keeps one row a number on the right, which adaptive execution splits on the left). Rows without a number are
    counted under an empty one, which meets nothing: a filter on the number would be moved below the parsing and repeat it.
    """
    r = F.col(result)
    number = F.when(r["ok"], r["value"]["number"].cast("string"))
    firsts = df.select(F.coalesce(number, F.lit("")).alias("_number"), F.col(order).alias("_order")).groupBy("_number").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n"))
    marked = df.withColumn("_number", F.coalesce(number, F.concat(F.lit("?"), F.col(order).cast("string"))))
    marked = marked.join(firsts.where(F.col("_n") > 1).drop("_n"), "_number", "left")
    return marked.withColumn(name, F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_number", "_first")


def rank_duplicates(df: DataFrame, result: str = "id_result", order: str = "seq") -> DataFrame:
    """Place of each row among those of its number, by window: the form to use where the places themselves are wanted."""
    w = Window.partitionBy(F.col(result)["value"]["number"]).orderBy(order)
    return df.where(F.col(result)["ok"]).withColumn("occurrence", F.row_number().over(w))


def clean_contacts(df: DataFrame, settings: Settings | None = None, as_of: Column | None = None, parts: int | None = None) -> DataFrame:
    """Add the parse results and derived facts of every kept row. Needs seq and the canonical fields.

    Duplicates and the order of dates are learnt from one narrow column each, before the wide parse. ``parts`` deals the
    rows to so many tasks before it: a parsed row is several times as large, and the join by identifier leaves as many
    tasks as suit the rows before.
    """
    s = settings or Settings()
    kept = drop_test_rows(df, s.drop)
    policy = None
    marked = mark_duplicates(kept.withColumn("id_result", parse_lead_id(F.col("lead_id"), s.lead_id)))
    if s.infer_order:
        evidence = infer_order_policy(kept.select("created"), "created").agg(F.map_from_entries(F.collect_list(F.struct("separator", "order"))).alias("date_policy"))
        marked, policy = marked.join(F.broadcast(evidence), F.lit(True)), F.col("date_policy")
    if parts:
        marked = marked.repartition(parts)
    parsed = marked.select(
        *kept.columns,
        "id_result",
        "is_duplicate",
        parse_date(F.col("created"), s.date, policy, as_of).alias("created_result"),
        parse_email(F.col("email"), s.email).alias("email_result"),
        parse_website(F.col("website"), s.website).alias("website_result"),
        parse_amount(F.col("monthly_budget"), s.amount).alias("budget_result"),
        employees_of(F.col("employees")).alias("head_count"),
        title_authority(F.col("title"), s.titles).alias("title_level"),
        is_non_buyer(F.col("title"), s.non_buyers).alias("is_non_buyer_title"),
        in_profile(F.col("company"), F.col("notes"), s.profile).alias("is_icp"),
        source_quality(F.trim("source"), s.quality).alias("source_quality"),
    )
    mail_domain = F.when(F.col("email_result")["ok"], F.col("email_result")["value"]["domain"])
    budget = F.col("budget_result")["value"]
    return parsed.select(
        "*",
        size_band(F.col("head_count"), s.size_bands).alias("employee_band"),
        domains_match(F.col("website_result"), mail_domain).alias("domain_match"),
        F.coalesce(budget["monthly"], budget["value"]).alias("budget_monthly"),
    )


def id_display(result: Column, raw_id: Column, row: Column) -> Column:
    return F.coalesce(result["value"]["canonical"], F.nullif(F.trim(raw_id), F.lit("")), F.concat(F.lit("(row "), row.cast("string"), F.lit(")")))


def data_issues() -> Column:
    """array<string> of what is wrong with a cleaned record: failures, five of the soft codes, and empty notes."""
    names = {"id_result": "Lead ID", "created_result": "Created", "email_result": "Email", "website_result": "Website", "budget_result": "Budget"}
    out = [F.when(~F.col(r)["ok"], F.concat(F.lit(f"{n}: "), F.col(r)["code"])) for r, n in names.items()]
    soft = (("email_result", "EMAIL_FREEMAIL"), ("email_result", "EMAIL_ROLE_ADDRESS"), ("created_result", "DATE_AMBIGUOUS_ORDER"), ("budget_result", "AMOUNT_RANGE"))
    out += [F.when(has(F.col(r), code), F.lit(f"{names[r]}: {code}")) for r, code in soft]
    out += [F.when(F.col("is_duplicate"), F.lit("Lead ID: ID_DUPLICATE")), F.when(F.trim(F.coalesce("notes", F.lit(""))) == "", F.lit("Notes: EMPTY"))]
    return F.array_compact(F.array(*out))


def sort_keys(result: str = "id_result", raw: str = "lead_id", order: str = "seq", invalid_last: bool = True) -> list[Column]:
    """Sort key of identifiers: valid ones by number, suffix and prefix, the others by their text; ties in file order."""
    r = F.col(result)
    return [
        F.when(r["ok"], 0).otherwise(1 if invalid_last else -1),
        F.when(r["ok"], r["value"]["number"]).otherwise(0),
        F.when(r["ok"], r["value"]["suffix"]).otherwise(F.coalesce(F.col(raw), F.lit(""))),
        F.when(r["ok"], r["value"]["prefix"]).otherwise(""),
        F.col(order),
    ]


def sort_columns(result: str = "id_result", raw: str = "lead_id", order: str = "seq", reverse: bool = False, invalid_last: bool = True) -> list[Column]:
    """The sort key as an order; reversed, ties stay in file order."""
    *keys, last = sort_keys(result, raw, order, invalid_last)
    return [*(k.desc() if reverse else k.asc() for k in keys), last.asc()]


def sort_contacts(df: DataFrame, reverse: bool = False, invalid_last: bool = True, lead_id: LeadIdConfig | None = None) -> DataFrame:
    """Contacts in the order of their identifiers; duplicates are marked in input order first."""
    if "id_result" not in df.columns:
        df = df.withColumn("id_result", parse_lead_id(F.col("lead_id"), lead_id))
    if "is_duplicate" not in df.columns:
        df = mark_duplicates(df)
    return df.orderBy(*sort_columns(reverse=reverse, invalid_last=invalid_last))


def place_contacts(df: DataFrame, lead_id: LeadIdConfig | None = None, parts: int | None = None, invalid_last: bool = True, reverse: bool = False) -> DataFrame:
    """Add ``place``, the 1-based place of every contact by its identifier: valid ones by number, the others last, or first, by their text.

    Reversed, the whole order is turned round, and ties stay in file order.
    """
    df = df.withColumn("id_result", parse_lead_id(F.col("lead_id"), lead_id))
    *keys, last = sort_keys(invalid_last=invalid_last)
    return with_place(df, [*keys, -last if reverse else last], parts=parts, reverse=reverse)
