"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a keyed digest and laid on a line of
tokens, which is cut into blocks of equally many tokens. The schedule is the
golden-ratio sequence: its k-th point, mapped through the cumulative shares of
the sources, names the source of slot k; the slots of a source are ranked, and
the r-th takes the source's r-th block, beginning again when all are used. So
any stretch of the schedule holds the sources in their shares, and repeats
are a whole pass apart.

Targets: every source gets its weight's part of the volume asked for, but at
most ``cap`` times its own size; what is above is dealt again by weight until
none is. The last slot of a source is trimmed, so a source's taken tokens are
its target, rounded down. The few slots by which the sequence misses a
source's quota (no more than grow with the logarithm of the schedule) close it.

All positions are sums over small buckets and then within them, so neither a
large source nor the whole schedule meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
BLOCK_TOKENS = 1024
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Slots ranked in one group, and groups a source's documents are shuffled in for each this many documents.
RUN = 65_536
GROUP_DOCS = 65_536
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _before(df: DataFrame, keys: list[str], order: str, amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over rows of the same keys that come earlier in ``order``."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(amount).over(upto), F.lit(0)).cast("long"))


def target_sizes(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Add ``target`` to rows (source, source_size).

    Sources in code point order, null last, get the weights in turn. The order is found in two steps, over the
    distinct first two characters and within them. Only a few sums a round come to the driver.
    """
    first = F.when(F.col("source").isNull(), 1).otherwise(0)
    keyed = totals.withColumn("none", first).withColumn("head", F.coalesce(F.substring("source", 1, 2), F.lit("")))
    heads = keyed.groupBy("none", "head").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("none", "head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("none", "head", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("none", "head").orderBy("source"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("ahead") + within - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = keyed.join(heads, ["none", "head"]).select("source", "source_size", turn.cast("double").alias("weight"))
    wanted, level, capped = None, None, -1
    while True:
        full = F.lit(False) if level is None else F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        got = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.count(F.when(full, 1)).alias("capped"),
            F.coalesce(F.sum(F.when(full, F.col("source_size") * cap)), F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        wanted = share * got["all"]
        if got["capped"] == capped or not got["open"]:
            break
        capped, level = got["capped"], (wanted - got["kept"]) / got["open"]
    ceiling = (F.col("source_size") * cap).cast("double")
    target = ceiling if level is None else F.least(ceiling, F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", F.coalesce(target, F.lit(0.0)))


@dataclass
class Mix:
    """``sized``: key columns, source, size and start (position on the source's line) of each document row.
    ``sources``: source, source_size, weight, target. ``schedule``: position, source, rank, block, begin and tokens.
    """

    sized: DataFrame
    sources: DataFrame
    schedule: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """One row per scheduled run of a document's words: position, rank, source, start, skip, words."""
        size = F.lit(self.block)
        last = F.col("start") + F.col("size") - 1
        cut = self.sized.where(F.col("size") > 0).select(
            "source", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))).alias("block")
        )
        got = cut.alias("c").join(self.schedule.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.block") == F.col("s.block")))
        low = F.greatest("start", F.col("s.block") * size)
        high = F.least(F.col("start") + F.col("size"), F.col("s.block") * size + F.col("tokens"))
        return got.where(high > low).select("position", "rank", "c.source", "start", (low - F.col("start")).alias("skip"), (high - low).alias("words"))

    def taken(self) -> DataFrame:
        """``sized`` with source_size, target, ``taken`` (words the mix takes, repeats counted) and ``copies`` (times it takes the first word)."""
        sums = self.pieces().groupBy("source", "start").agg(F.sum("words").alias("taken"), F.count(F.when(F.col("skip") == 0, 1)).alias("copies"))
        left, right = self.sized.alias("d"), sums.alias("p")
        same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.start") == F.col("p.start")) & (F.col("size") > 0)
        out = left.join(right, same, "left").select("d.*", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))
        by = self.sources.alias("s")
        return out.alias("d").join(by, F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target")


def plan_mix(docs: DataFrame, keys: list[str], weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK_TOKENS, seed: str = SEED) -> Mix:
    """Plan the mix of all ``docs`` (keys, source, text).

    Null texts and texts without words have size 0 and are never taken. A null source is a source like any
    other, last in order. Repeated rows are documents of their own. Rows of equal keys and size are
    interchangeable; otherwise reruns agree. An empty table gives an empty schedule. Other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).cast("binary"))
    sized = scratch.keep(docs.select(*keys, "source", word_count(F.col("text")).alias("size"), digest.alias("shuffle")))

    totals = scratch.keep(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    sources = scratch.keep(target_sizes(totals.select("source", "source_size"), weights, share, cap))

    docs_in_all = totals.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    digits = 2
    while 16**digits * GROUP_DOCS < 16 * docs_in_all:
        digits += 1
    grouped = sized.withColumn("grp", F.substring("shuffle", 1, digits))
    sums = _before(grouped.groupBy("source", "grp").agg(F.sum("size").alias("words")), ["source"], "grp", "words", "ahead").drop("words")
    within = Window.partitionBy("source", "grp").orderBy("shuffle", *keys, "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = grouped.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = (
        inner.alias("d")
        .join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.grp") == F.col("s.grp")))
        .select(*(F.col(f"d.{k}") for k in keys), "d.source", "size", (F.col("ahead") + F.col("inner")).cast("long").alias("start"))
    )
    return Mix(scratch.keep(placed), sources, scratch.keep(_schedule(sources, block)), block)


def _schedule(sources: DataFrame, block: int) -> DataFrame:
    spark = sources.sparkSession
    whole, goal = F.col("source_size"), F.floor(F.col("target")).cast("long")
    blocks = F.ceil(whole / block).cast("long")
    quota = (F.floor(goal / whole) * blocks + F.ceil(F.pmod(goal, whole) / block)).cast("long")
    plan = sources.where(goal > 0).select("source", "source_size", goal.alias("goal"), blocks.alias("blocks"), quota.alias("quota"))
    head = F.coalesce(F.substring(F.md5(F.col("source").cast("binary")), 1, 3), F.lit("~"))
    plan = plan.withColumn("head", head)
    ahead = plan.groupBy("head").agg(F.sum("quota").alias("q"))
    ahead = ahead.select("head", F.coalesce(F.sum("q").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    plan = _before(plan.join(ahead, "head"), ["head"], "source", "quota", "inside").withColumn("low", F.col("ahead") + F.col("inside")).drop("head", "ahead", "inside")
    plan = plan.withColumn("high", F.col("low") + F.col("quota"))
    got = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("slots"), F.count(F.lit(1)).alias("n")).first()
    slots, cells = int(got["slots"]), 1024
    while cells < got["n"]:
        cells *= 2
    # Each source covers whole and part cells of the unit interval; a point looks only into its own cell.
    cell = lambda at: F.floor(at / F.lit(float(max(slots, 1))) * cells)
    spans = plan.select("*", F.explode(F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(cells - 1).cast("long")))).alias("cell"))
    share = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    at = (share - F.floor(share)) * F.lit(float(slots))
    points = spark.range(slots).select(F.col("id").alias("k"), at.alias("at")).withColumn("cell", F.least(cell(F.col("at")), F.lit(cells - 1)).cast("long"))
    named = points.join(spans, "cell").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("k", "source", (F.col("k") / RUN).cast("long").alias("run"))
    runs = _before(named.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n")), ["source"], "run", "n", "ahead").drop("n")
    ranked = (
        named.withColumn("inner", F.row_number().over(Window.partitionBy("source", "run").orderBy("k")) - 1)
        .alias("p")
        .join(runs.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p.run") == F.col("r.run")))
        .select("k", "p.source", (F.col("ahead") + F.col("inner")).alias("rank"))
    )
    counted = named.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    late = (
        plan.alias("a")
        .join(counted.alias("c"), F.col("a.source").eqNullSafe(F.col("c.source")), "left")
        .select("a.*", F.coalesce("n", F.lit(0)).alias("n"))
        .where(F.col("n") < F.col("quota"))
        .select((F.lit(slots) + F.col("low")).alias("base"), "source", F.explode(F.sequence("n", F.col("quota") - 1)).alias("rank"))
        .select((F.col("base") + F.col("rank")).alias("k"), "source", "rank")
    )
    every = ranked.unionByName(late).alias("r").join(plan.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source"))).where(F.col("rank") < F.col("quota"))
    number = F.pmod("rank", "blocks")
    begin = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + number * block
    tokens = F.least(F.lit(block), F.col("source_size") - number * block, F.col("goal") - begin)
    return every.select(F.col("k").alias("position"), "r.source", "rank", number.cast("long").alias("block"), begin.cast("long").alias("begin"), tokens.cast("long").alias("tokens"))


def mix_documents(docs: DataFrame, keys: list[str], **how) -> DataFrame:
    """The mixed corpus in whole documents: every row as often as the schedule takes its first word.

    Rows that share all keys share their copies, rounded up. All columns are kept, whatever their names.
    """
    mix = plan_mix(docs, keys, **how)
    chosen = mix.taken().where(F.col("copies") > 0).groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    same = None
    for k in keys:
        on = F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}"))
        same = on if same is None else same & on
    times = F.sequence(F.lit(1), F.ceil(F.col("c._copies") / F.col("c._rows")).cast("int"))
    return docs.alias("d").join(chosen.alias("c"), same).select(F.struct("d.*").alias("d"), F.explode(times).alias("pass")).select("d.*")
