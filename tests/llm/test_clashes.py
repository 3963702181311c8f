"""Extra columns with awkward names, nulls and empty tables through the operators that keep all columns."""

from pyspark.sql import functions as F

from intakespark.llm import line_dedup, maglev, pii_feistel, source_mix

NAMES = ["gone", "row", "own", "chunks", "found", "done", "_copies", "_rows", "pass", "c", "d", "hash", "slot", "a.b"]


def wide(spark, with_dots=False):
    texts = ["mail jo@example.com now", None, "", "line one of a passage here\nline two of a passage here\nend", "mail jo@example.com now"]
    df = spark.createDataFrame([(k, t, "s" if k % 2 else None) for k, t in enumerate(texts)], "doc_id long, text string, source string")
    for n in NAMES:
        if "." not in n or with_dots:
            df = df.withColumn(n, F.lit(n))
    return df


def test_line_dedup(spark):
    df = wide(spark)
    out = line_dedup.remove_repeated_chunks(df)
    assert out.columns == [*df.columns, "n_lines", "n_chunks", "n_removed"] and out.count() == 5
    assert line_dedup.remove_repeated_chunks(df.limit(0)).count() == 0
    assert all(r.gone == "gone" and r.row == "row" for r in out.collect())


def test_pseudonyms(spark):
    df = wide(spark)
    rows = pii_feistel.pseudonymise(df).orderBy("doc_id").collect()
    assert [r.n_private for r in rows] == [1, 0, 0, 0, 1] and rows[0].text == rows[4].text != "mail jo@example.com now"
    assert rows[1].text is None and rows[2].text == "" and rows[0].found == "found" and rows[0].own == "own"
    assert pii_feistel.pseudonymise(df.limit(0)).count() == 0


def test_mix(spark):
    df = wide(spark)
    out = source_mix.mix_documents(df, ["doc_id"], block=2)
    assert out.columns == df.columns and {r["_copies"] for r in out.collect()} == {"_copies"}


def test_shards(spark):
    out = maglev.assign_shards(wide(spark), "doc_id")
    assert out.count() == 5 and dict(out.dtypes)["slot"] == "int"
