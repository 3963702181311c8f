"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all preceding turns are its
context, and only that reply is trainable. Turns after the last reply (or a
conversation without any reply) give one more example with nothing trainable,
so that the examples of a conversation together hold every turn.

A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>``. In roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a
control string, and removing one backslash before each escaped character
restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_TURN = r"(?s)<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def expand_replies(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, n_context, formatted, loss_start, loss_chars.

    ``turns`` has conv_id, turn, role and text. loss_start counts code points of ``formatted`` from 0;
    loss_chars is 0 and loss_start null where nothing is trainable. Null roles and texts count as empty. Rows
    that share a turn number are ordered by role and text; null turn numbers come first; rows with a null
    conv_id form one conversation. An empty table gives no examples. Other columns are left out.
    """
    clean = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = clean.select(
        "conv_id",
        "role",
        F.row_number().over(order).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"),
        F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat("head", "body", F.lit(END))
    reply = F.col("role") == "assistant"
    shown = rows.select("*", F.array_join(F.collect_list(piece).over(upto), "").alias("context")).where(reply | (F.col("place") == F.col("n")))
    return shown.select(
        "conv_id",
        F.col("place").cast("long").alias("example"),
        (F.col("place") - 1).cast("long").alias("n_context"),
        F.concat("context", piece).alias("formatted"),
        F.when(reply, F.length("context") + F.length("head")).cast("long").alias("loss_start"),
        F.when(reply, F.length("body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)).alias("r"), F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2)).alias("t")),
        lambda x: F.struct(unescape(x["r"]).alias("role"), unescape(x["t"]).alias("text")),
    )


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped; null where nothing is trainable."""
    return F.when(start.isNotNull(), unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int"))))
