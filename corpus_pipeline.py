"""A corpus pipeline of five stages: quality, repeated lines, near duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents the stage
before it kept. ``run`` writes every stage's result to the shared folder as
Parquet and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakespark.llm import bpe, line_dedup, ngram_jaccard, quality, source_mix
from intakespark.llm._tables import Scratch, table
from intakespark.llm.queries import tokenizer_path

#: Near duplicates share four fifths of their five-word shingles.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored as texts without words. Repeated rows fare alike, columns stay as they are, an empty
    table gives an empty one.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rest = [c for c in docs.columns if c != "text"]
    scored = quality.score(docs.select(F.struct(*rest).alias("own"), "text"), model)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*(F.col("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that an earlier document has; documents of which nothing is left, all exact copies among them, go.

    Null texts and texts that were empty before stay. Rows alike in doc_id and text fare alike. ``n_chars`` follows the
    text where there is such a column; all other columns stay as they are. An empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c != "text"]
    cut = line_dedup.remove_repeated_runs(docs.select(F.struct(*rest).alias("own"), "doc_id", "text"))
    kept = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(source_mix.WORDS))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("own")["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in rest else None
    return kept.select(*(F.col("text") if c == "text" else changed if c == "n_chars" else F.col("own")[c].alias(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together. Rows without an id, and null, empty and wordless
    texts, all stay. Columns stay as they are; an empty table gives an empty one.
    """
    groups = ngram_jaccard.jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT).documents
    spare = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(spare, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in its sources' target shares: each document as often as the schedule takes it.

    Null and wordless texts have no size and are never taken. Null sources are a source of their own. Columns stay as
    they are; an empty table gives an empty one.
    """
    return source_mix.mix_documents(docs, ["doc_id"]).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number and the digest of the text decoded from them.

    A null text counts as empty and has no ids. Every row is kept; columns that are not named here are left out. An
    empty table gives an empty one.
    """
    coded = bpe.encode_decode(docs, tokenizer_path())
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("source_mix", mix_sources),
    ("bpe", encode_tokens),
]

#: The classifier's training cannot be stated in SQL; tests hold each stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
