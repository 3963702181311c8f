"""Reports over scored records: counts, shares, rankings and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.results import all_codes
from ..functions.texts import highlight, merge_spans
from .cleaning import FIELD_RESULTS
from .lexicon import LADDERS
from .places import with_place

BANDS = ("CONTACT_NOW", "CONSIDER", "NURTURE", "DISQUALIFY")
ACTIVE = ("CONTACT_NOW", "CONSIDER")
RAW = {"id_result": "Lead ID", "created_result": "Created", "email_result": "Email", "website_result": "Website", "budget_result": "Budget"}


def leads_per_band(df: DataFrame) -> DataFrame:
    return df.groupBy("band", "band_label").agg(F.count(F.lit(1)).alias("leads"))


def stage_by_budget(df: DataFrame) -> DataFrame:
    return df.groupBy("buying_stage", "budget_status").agg(F.count(F.lit(1)).alias("leads"))


def top_values(df: DataFrame, column: str, n: int = 12) -> DataFrame:
    """The most frequent values of a column; empty ones count as a dash; ties in value order."""
    value = F.when(F.coalesce(F.col(column), F.lit("")) == "", "—").otherwise(F.col(column))
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("leads")).orderBy(F.desc("leads"), "value").limit(n)


def source_by_band(df: DataFrame) -> DataFrame:
    """Counts of bands in each source with their share of it. The shares are summed over the counted rows, a few a source."""
    counted = df.groupBy("source", "band").agg(F.count(F.lit(1)).alias("leads"))
    return counted.withColumn("share", F.col("leads") / F.sum("leads").over(Window.partitionBy("source")))


def problem_counts(df: DataFrame) -> DataFrame:
    """Records that name each problem, from the comma-separated list."""
    each = df.select(F.explode(F.split("problems", ", ")).alias("problem")).where(F.col("problem") != "")
    return each.groupBy("problem").agg(F.count(F.lit(1)).alias("leads"))


def score_histogram(df: DataFrame, step: int = 5) -> DataFrame:
    return df.groupBy((F.floor(F.col("score") / step) * step).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("leads"))


def pipeline_value(df: DataFrame) -> DataFrame:
    return df.where(F.col("band").isin(*ACTIVE)).agg(F.bround(F.coalesce(F.sum("budget_monthly"), F.lit(0.0)), 2).alias("pipeline_value"), F.count(F.lit(1)).alias("leads"))


def kpis(df: DataFrame) -> DataFrame:
    """One row: counts a band, their part of all, mean confidence and records with issues."""
    n = F.count(F.lit(1))
    bands = [F.count_if(F.col("band") == b).alias(f"n_{b.lower()}") for b in BANDS]
    return df.agg(n.alias("leads"), *bands, F.bround(100 * F.count_if(F.col("band") == "CONTACT_NOW") / n, 1).alias("contact_now_percent"), F.bround(F.avg("confidence"), 4).alias("mean_confidence"), F.count_if(F.col("data_issues") > 0).alias("with_issues"))


def route_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("route").agg(F.count(F.lit(1)).alias("leads"))


#: Reports that ``all_reports`` counts, with the columns each is grouped by.
REPORTS = {"bands": ("band", "band_label"), "stages": ("buying_stage", "budget_status"), "types": ("intent_type",), "sources": ("source", "band"), "problems": ("problem",), "scores": ("bin",), "routes": ("route",), "all": ()}


def all_reports(df: DataFrame, step: int = 5) -> DataFrame:
    """All counts of the pipeline page from one pass and one shuffle: report, key, subkey, leads, active and pipeline_value.

    The grouping sets of ``REPORTS`` share a scan of the records and one partial aggregation, so only a few rows a task
    are shuffled, whatever the number of records. A record that names several problems counts once in every other report. ``active`` are
    records of the upper bands; pipeline_value is given for all records together. An empty frame gives no rows.
    """
    named = F.filter(F.split("problems", ", "), lambda x: x != "")
    columns = list(dict.fromkeys(c for own in REPORTS.values() for c in own))
    bins = (F.floor(F.col("score") / step) * step).cast("int").alias("bin")
    rows = df.select(*(c for c in columns if c not in ("problem", "bin")), bins, "budget_monthly", F.posexplode_outer(named).alias("nth", "problem"))
    first = F.coalesce(F.col("nth") == 0, F.lit(True))
    active = first & F.col("band").isin(*ACTIVE)
    sets = rows.withColumns({"is_first": first, "is_active": active}).groupingSets([[F.col(c) for c in own] for own in REPORTS.values()], *map(F.col, columns))
    counted = sets.agg(
        F.grouping_id(*columns).alias("without"),
        F.count_if("is_first").alias("records"),
        F.count("problem").alias("mentions"),
        F.count_if("is_active").alias("actives"),
        F.bround(F.coalesce(F.sum(F.when(F.col("is_active"), F.col("budget_monthly"))), F.lit(0.0)), 2).alias("value"),
    )
    # One bit a column, the first the highest, set where the column is left out.
    fits = {name: F.col("without") == sum(1 << len(columns) - 1 - k for k, c in enumerate(columns) if c not in own) for name, own in REPORTS.items()}
    pick = lambda place: F.coalesce(*(F.when(fits[n], F.col(own[place]).cast("string")) for n, own in REPORTS.items() if len(own) > place))
    report = F.coalesce(*(F.when(cond, n) for n, cond in fits.items()))
    is_problem = fits["problems"]
    shown = counted.where(~is_problem | F.col("problem").isNotNull())
    return shown.select(
        report.alias("report"), pick(0).alias("key"), pick(1).alias("subkey"), F.when(is_problem, F.col("mentions")).otherwise(F.col("records")).alias("leads"), F.when(~is_problem, F.col("actives")).alias("active"), F.when(report == "all", F.col("value")).alias("pipeline_value")
    )


def _unpivot(df: DataFrame) -> DataFrame:
    kinds = [F.struct(F.lit(RAW[c]).alias("field"), F.col(c)["ok"].alias("ok"), F.col(c)["raw"].alias("raw"), all_codes(F.col(c)).alias("codes")) for c in FIELD_RESULTS]
    return df.select("seq", F.explode(F.array(*kinds)).alias("x")).select("seq", "x.*")


def parse_rates(df: DataFrame) -> DataFrame:
    """Of every field: values supplied, blank, read, and the part read of those supplied."""
    given = F.trim("raw") != ""
    out = _unpivot(df).groupBy("field").agg(F.count_if(given).alias("supplied"), F.count_if(~given).alias("blank"), F.count_if(given & F.col("ok")).alias("read"))
    return out.withColumn("rate", F.bround(F.col("read") / F.greatest("supplied", F.lit(1)), 4))


def code_histogram(df: DataFrame) -> DataFrame:
    """How often every field gave each return code, with the first example in file order."""
    each = _unpivot(df).select("seq", "field", "raw", F.explode("codes").alias("code"))
    return each.groupBy("field", "code").agg(F.count(F.lit(1)).alias("n"), F.min_by("raw", "seq").alias("example"))


def duplicate_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("is_duplicate").alias("duplicates"))


def ledger_lines(df: DataFrame) -> DataFrame:
    """Ledger lines of every record with the place of their group, in the order they are shown."""
    from .scoring import GROUPS

    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("line")["group"]).cast("int")
    lines = df.select("seq", F.posexplode("ledger").alias("pos", "line"))
    return lines.select("seq", place.alias("group_place"), F.col("pos").cast("int").alias("pos"), F.col("line")["group"].alias("line_group"), F.bround(F.col("line")["points"], 1).alias("points"))


def ledger_texts(df: DataFrame) -> DataFrame:
    """What every ledger line of every record says, and the evidence it rests on, in the order they are shown."""
    lines = df.select("seq", F.posexplode("ledger").alias("pos", "line"))
    return lines.select("seq", F.col("pos").cast("int").alias("pos"), F.col("line")["label"].alias("label"), F.col("line")["evidence"].alias("evidence"))


def contradictions(df: DataFrame, intent: str = "intent") -> DataFrame:
    """One row for every dimension in which a note says two things: what was kept, what was not, by which rule, and both quotes.

    Notes without any are left out behind the explode: an inner one filters on the array's size, which the optimiser
    moves below the reading of the notes, where all dimensions would be resolved anew for each use.
    """
    rows = df.select("seq", F.explode_outer(F.col(intent)["contradictions"]).alias("c")).where(F.col("c").isNotNull())
    return rows.select("seq", *(F.col("c")[k].alias(k) for k in ("dimension", "kept", "rejected", "rule", "evidence_kept", "evidence_rejected")))


def highlighted_notes(df: DataFrame, intent: str = "intent", notes: str = "notes") -> DataFrame:
    """Every note as HTML with its evidence marked (the place of each dimension's reading, then the negative signals), and these places put together where they meet."""
    p = F.col(intent)
    raw = F.coalesce(F.col(notes), F.lit(""))
    mark = lambda x, kind: F.struct(x["start"].alias("s"), x["end"].alias("e"), F.lit(kind).alias("kind"))
    read = F.filter(F.array(*(mark(p[d], "pos") for d in LADDERS)), lambda m: m["s"].isNotNull())
    marks = F.concat(read, F.transform(p["negatives"], lambda n: mark(n, "neg")))
    merged = merge_spans(F.transform(marks, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))))
    shown = F.array_join(F.transform(merged, lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",")
    return df.select("seq", highlight(raw, marks).alias("html"), shown.alias("spans"))


def ledger_totals(df: DataFrame) -> DataFrame:
    return df.select("seq", F.bround(F.aggregate("ledger", F.lit(0.0), lambda s, x: s + x["points"]), 1).alias("ledger_total"), "score")


def top_by_score(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc("raw_score"), "row").limit(n)


def by_display(df: DataFrame) -> DataFrame:
    """The table of records, the highest display score first."""
    return df.orderBy(F.desc("score"), "row")


def by_raw(df: DataFrame) -> DataFrame:
    """The list of records, the highest raw score first; ties in file order."""
    return df.orderBy(F.desc("raw_score"), "row")


def placed_by(df: DataFrame, score: str, parts: int | None = None) -> DataFrame:
    """Add ``place`` in the falling order of a score, ties in file order, records without a score last."""
    return with_place(df, [F.col(score).isNull(), -F.col(score), F.col("row")], parts=parts)


def top_by_issues(df: DataFrame, n: int = 25) -> DataFrame:
    return df.where(F.col("data_issues") > 0).orderBy(F.desc("data_issues"), "row").limit(n)


def filter_leads(df: DataFrame, bands=None, intent_types=None, sources=None, size_bands=None, least_confidence: float = 0.0) -> DataFrame:
    """Rows that pass every given filter; an empty one filters nothing."""
    cond: Column = F.col("confidence") >= least_confidence
    for column, values in (("band", bands), ("intent_type", intent_types), ("source", sources), ("size_band", size_bands)):
        if values:
            cond = cond & F.col(column).isin(*values)
    return df.where(cond)


#: The columns of the flat export in which records are searched.
SEARCHED = ("company", "name", "email", "notes", "lead_id")


def search(df: DataFrame, query: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows in which the pattern occurs in company, name, e-mail, notes or identifier, whatever its case."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.lower(column).rlike(query.lower()), F.lit(False))
    return df.where(hit)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
