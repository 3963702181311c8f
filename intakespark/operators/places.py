"""Places of rows in an order over the whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bounds(keys: DataFrame, parts: int, per_part: int) -> DataFrame:
    """One row: the sorted keys that cut the table into parts of about equal size, from the keys with the smallest hashes.

    The sample is the same in every run, and holds ``parts * per_part`` keys at most whatever the table's size.
    """
    sample = keys.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(parts * per_part)
    ordered = sample.agg(F.array_sort(F.collect_list("_key")).alias("_s"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("_s", F.floor(i * F.size("_s") / parts).cast("int")))
    return ordered.select(F.array_compact(cuts).alias("_bounds"))


def _part(key: Column, bounds: Column, parts: int) -> Column:
    """How many bounds are not above the key, by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.coalesce(F.get(bounds, middle) <= key, F.lit(False))
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(up, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(middle).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(parts.bit_length())), start, halve, lambda s: s["lo"])


def dealt_by_range(df: DataFrame, keys: list[Column], parts: int | None = None, per_part: int = 64) -> DataFrame:
    """Add ``_key`` (a struct of ``keys``) and ``_part``, the number of its range in their rising order, nulls first.

    Ranges are cut at keys of a sample, so that parts are of like size whatever the values: where few values are
    frequent, the later keys tell their rows apart. The keys are told to be unique together; rows that are equal in all
    of them share a part.
    """
    parts = max(2, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumn("_key", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))))
    bounds = _bounds(keyed, parts, per_part)
    # One row of less than ``parts`` keys.
    return keyed.join(F.broadcast(bounds), F.lit(True)).withColumn("_part", _part(F.col("_key"), F.col("_bounds"), parts)).drop("_bounds")


def with_place(df: DataFrame, keys: list[Column], name: str = "place", parts: int | None = None, per_part: int = 64, reverse: bool = False) -> DataFrame:
    """Add the 1-based place of every row in the rising order of ``keys``, which are unique together; reversed, counted from the end.

    The table is read for the sample, for the sizes of the parts and for the places; only the last one shuffles whole
    rows, to as many parts as asked for (by default as the session's shuffle partitions), each ranked on its own and
    moved on by the sizes of those before it. An empty table gives an empty one. Rows that are equal in all keys get
    different places in no certain order.
    """
    parts = max(2, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt_by_range(df, keys, parts, per_part)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a part.
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    # One task a part: hashing the numbers of parts would put several into one task.
    ranked = dealt.repartitionById(parts, "_part").withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_key")))
    place = F.col("_rank") + F.col("_shift")
    return ranked.join(F.broadcast(shift), "_part").withColumn(name, (F.col("_all") + 1 - place if reverse else place).cast("long")).drop("_part", "_key", "_rank", "_shift", "_all")
