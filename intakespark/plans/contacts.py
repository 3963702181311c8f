"""The whole flow: read, bind, filter, learn the date order, parse, mark duplicates, read intent, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import clean_contacts, data_issues, id_display
from ..operators.intent import extract_intent
from ..operators.lexicon import Lexicon
from ..operators.scoring import score
from ..sources.settings import Settings


def process(df: DataFrame, lexicon: Lexicon | None = None, scoring: dict | None = None, as_of: Column | None = None, settings: Settings | None = None, parts: int | None = None) -> DataFrame:
    """Scored records of raw contacts (seq and the canonical fields). A scored record takes some 4 KB; ``parts`` says in how many tasks (``tasks_for``).

    The plan is one wide projection over a scan. Write the result (``process_to``), or persist it, before filtering and
    joining it: the optimiser derives constraints from all that lies below a filter, which takes it minutes on expressions of this size.
    """
    clean = clean_contacts(df, settings, as_of, parts)
    return score(extract_intent(clean, "notes", "title_level", lexicon), scoring)


def process_to(df: DataFrame, path: str, **options) -> DataFrame:
    """``process`` written as Parquet under ``path``, which driver and executors share, and read back: the form to filter and join.

    The plan ends at the table, so neither planning nor a lost executor goes back to the parsing of fields and notes.
    """
    process(df, **options).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def flat_frame(df: DataFrame) -> DataFrame:
    """The flat export: one row a record, nested results as plain columns."""
    p, r = F.col("intent"), lambda name: F.col(f"{name}_result")
    return df.select(
        F.col("seq").alias("row"),
        id_display(r("id"), F.col("lead_id"), F.col("seq")).alias("lead_id"),
        "name", "company", "title", "band", "band_label", F.col("display_score").alias("score"), F.col("score").alias("raw_score"), "route",
        p["intent_type"]["type"].alias("intent_type"),
        p["buying_stage"]["value"].alias("buying_stage"),
        p["budget_status"]["value"].alias("budget_status"),
        p["urgency"]["value"].alias("urgency"),
        p["decision_authority"]["value"].alias("authority"),
        p["pain_severity"]["value"].alias("pain"),
        p["competitive_evaluation"]["value"].alias("competitive"),
        F.bround(p["confidence"], 2).alias("confidence"),
        p["timeline_text"].alias("timeline"),
        p["timeline_days"].alias("timeline_days"),
        F.array_join(F.transform(p["problems"], lambda x: x["label"]), ", ").alias("problems"),
        F.array_join(p["categories"], ", ").alias("categories"),
        F.array_join(F.transform(p["negatives"], lambda x: x["code"]), ", ").alias("negatives"),
        F.size(p["contradictions"]).alias("contradictions"),
        "source",
        F.col("head_count").alias("employees"),
        F.col("employee_band").alias("size_band"),
        F.when(F.col("is_icp"), "Yes").when(~F.col("is_icp"), "No").otherwise("Unknown").alias("icp"),
        F.when(r("email")["ok"], r("email")["value"]["address"]).otherwise(F.col("email")).alias("email"),
        r("email")["code"].alias("email_status"),
        F.coalesce(r("website")["value"]["url"], F.lit("")).alias("website"),
        r("website")["code"].alias("website_status"),
        F.coalesce(r("created")["value"]["date"].cast("string"), F.lit("")).alias("created"),
        r("created")["code"].alias("created_status"),
        F.col("monthly_budget").alias("budget_raw"),
        "budget_monthly",
        r("budget")["code"].alias("budget_code"),
        F.size(data_issues()).alias("data_issues"),
        "notes",
    )
