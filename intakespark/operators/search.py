"""Free-text search over an index of three-sign pieces, so that a search reads the blocks of the table that can match.

The table is written in blocks of rows, each a partition, with a second table that says which pieces of text (three
signs in lower case) occur in which block. A search asks that table for the blocks that hold all pieces of a text which
every match must hold, reads these blocks only, and confirms their rows by the pattern itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import needles
from .reports import SEARCHED, search

GRAM = 3
BLOCK = "search_block"


def grams_of(text: Column) -> Column:
    """Distinct pieces of three signs of a text in lower case, in time that grows with its length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/empty").schema).parquet(f"{path}/rows")


def write_search_index(df: DataFrame, path: str, order: str = "row", block_rows: int = 65_536, columns: tuple[str, ...] = SEARCHED) -> None:
    """Write the table in blocks of rows, and where each piece of the searched columns occurs, below ``path``.

    ``order`` counts the rows: a block holds those of a run of ``block_rows`` numbers, so its size is bounded. Rows
    without a number share a block of their own. A column named search_block is replaced. Pieces are made distinct
    before the shuffle; a piece of every block has one row a block.
    """
    block = F.coalesce(F.floor(F.col(order) / block_rows), F.lit(-1)).cast("long")
    # An empty table has no blocks that could tell its columns.
    df.limit(0).drop(BLOCK).withColumn(BLOCK, block).write.parquet(f"{path}/empty")
    df.drop(BLOCK).withColumn(BLOCK, block).repartition(BLOCK).write.partitionBy(BLOCK).parquet(f"{path}/rows")
    rows = _rows(df.sparkSession, path)
    pieces = F.flatten(F.array(*(F.coalesce(grams_of(F.col(c)), F.array().cast("array<string>")) for c in columns)))
    postings = rows.select(BLOCK, F.explode(F.array_distinct(pieces)).alias("gram")).distinct()
    postings.repartitionByRange("gram").sortWithinPartitions("gram", BLOCK).write.parquet(f"{path}/grams")


def required_words(query: str) -> frozenset[str]:
    """Texts of which every match of a pattern holds one, each long enough for the index; empty where none can be named.

    Patterns that Java and Python may read differently name none: classes within classes, octal signs, and what Python does not parse.
    """
    if re.search(r"\[[^\]]*\[|\\0", query):
        return frozenset()
    try:
        words = needles(query)
    except re.error:
        return frozenset()
    return words if words and min(map(len, words)) >= GRAM else frozenset()


def candidate_blocks(postings: DataFrame, words: frozenset[str]) -> DataFrame:
    """Blocks that hold all pieces of at least one word."""
    pieces = {w: sorted({w[k : k + GRAM] for k in range(len(w) - GRAM + 1)}) for w in sorted(words)}
    met = postings.where(F.col("gram").isin(sorted({g for own in pieces.values() for g in own})))
    whole = F.lit(False)
    counted = met.groupBy(BLOCK).agg(*(F.count_if(F.col("gram").isin(own)).alias(f"n{k}") for k, own in enumerate(pieces.values())))
    for k, own in enumerate(pieces.values()):
        whole = whole | (F.col(f"n{k}") == len(own))
    return counted.where(whole).select(BLOCK)


def indexed_search(spark: SparkSession, path: str, query: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """The rows that ``search`` finds, from an index written with the same columns. A pattern that names no text of three signs reads all blocks."""
    rows = _rows(spark, path)
    words = required_words(query.lower())
    if words:
        # One number a block, which holds tens of thousands of rows.
        blocks = candidate_blocks(spark.read.parquet(f"{path}/grams"), words)
        rows = rows.join(F.broadcast(blocks), BLOCK, "left_semi")
    return search(rows, query, columns).drop(BLOCK)
