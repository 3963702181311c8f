"""Indexed search against the search of all rows, and what it reads."""

import pytest
from pyspark.sql import functions as F

from intakespark.operators.intent import extract_intent, profile_record, profile_variant, read_variant
from intakespark.operators.reports import SEARCHED, search
from intakespark.operators.search import grams_of, indexed_search, required_words, write_search_index

WORDS = ("agency", "dealer", "Örebro", "straße", "a\nb", "crm", "xx", "", "😀😀😀😀", "İstanbul", "l-17")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = [(k, f"Firm {k}", WORDS[k % len(WORDS)], f"user{k}@firm{k % 7}.com", None if k % 5 == 0 else f"said {WORDS[k * 7 % len(WORDS)]}{k} and left", f"L-{k}", "x") for k in range(400)]
    rows += [(None, "no number agency", None, None, None, None, "y")]
    df = spark.createDataFrame(rows, "row long, company string, name string, email string, notes string, lead_id string, search_block string")
    path = str(tmp_path_factory.mktemp("index"))
    write_search_index(df, path, block_rows=16)
    return df.drop("search_block"), path


def read_files(df):
    """Files and bytes that the scan of the rows took."""
    df.collect()
    found = []

    def walk(node):
        if node.nodeName().startswith("Scan"):
            found.append((node.metrics().apply("numFiles").value(), node.metrics().apply("filesSize").value()))
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName() == "ResultQueryStage" else None
        below = [inner] if inner is not None else [node.children().apply(k) for k in range(node.children().size())]
        for x in below:
            walk(x)

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)


@pytest.mark.parametrize("query", ["agency", "AGENCY|dealer", "l-1[0-9]$", "@firm3", "dealer.*left", "^firm 39", "(?:crm|agency)4", "örebro", "straße", "a\nb", "😀😀😀", "istanbul", "nothing here", "x", "", "[a-z&&[^b]]gency", "no number", "firm 1|user2", "said (?!crm)", "(agency)?left"])
def test_same_rows(spark, table, query):
    df, path = table
    got, want = (sorted(map(str, x.select(*df.columns).collect())) for x in (indexed_search(spark, path, query), search(df, query)))
    assert got == want


def test_reads_less(spark, table):
    df, path = table
    few, whole = read_files(indexed_search(spark, path, "user399")), read_files(indexed_search(spark, path, "x"))
    assert few[0] <= 2 and whole[0] == 26 and few[1] * 5 < whole[1]


def test_words_and_pieces(spark):
    assert required_words("agency|dealer") == {"agency", "dealer"} and required_words("ab|agency") == frozenset() and required_words("(") == frozenset()
    long = "word " * 40_000
    got = spark.createDataFrame([("aBcd",), ("ab",), ("",), (None,), (long,)], "t string").select(grams_of(F.col("t")).alias("g")).collect()
    assert [r.g and sorted(r.g) for r in got] == [["abc", "bcd"], [], [], None, [" wo", "d w", "ord", "rd ", "wor"]]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "row long, " + ", ".join(f"{c} string" for c in SEARCHED))
    write_search_index(df, str(tmp_path / "i"))
    assert indexed_search(spark, str(tmp_path / "i"), "agency").count() == 0


def test_stored_profiles_keep_all_fields(spark, tmp_path):
    notes = ["Evaluating tools now, can we get a demo? Would need to loop in the team. No budget until next quarter.", "", None, "We copy-paste data between HubSpot and google sheets by hand. Need help asap, it is my decision.", "You have WON $1,000,000!!! Click here."]
    rows = extract_intent(spark.createDataFrame([(k, n, f"Firm {k}") for k, n in enumerate(notes)], "seq long, notes string, company string"))
    record = dict(profile=F.col("intent"), company=F.col("company"))
    want = rows.select("seq", profile_record(**record).alias("p"))
    rows.select("seq", profile_variant(**record).alias("v")).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    got = stored.select("seq", read_variant(F.col("v"), want.schema["p"].dataType).alias("p"))
    assert got.orderBy("seq").collect() == want.orderBy("seq").collect()
    assert stored.select(F.variant_get("v", "$.quality.per_dimension.urgency.value", "string").alias("u")).where("u = 'VERY_HIGH'").count() == 1
