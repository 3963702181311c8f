"""N-gram Jaccard join, heavy and light sets apart.

Documents are sets of distinct word shingles (64-bit hashes). Equal sets are
first folded to one representative. Then

* light sets (few shingles) enumerate all their subsets of the sizes that a
  link can need; two light sets that share a subset of c shingles, and are
  small enough for c, are linked, with no further test;
* heavy sets scan inverted lists: a set is listed under the shingles with
  which any partner must share one (its prefix in a global order, rarest
  first), and candidates are tested on their whole texts.

The boundary between light and heavy is where the counted cost is least:
subsets to write against list entries to read, from the sizes at hand.

What counts is which documents hang together, so a list of k members is first
tested as a star (every member against the list's smallest), which takes k
tests instead of k * k / 2. The lists that still hold members of different
components are then joined in full, so no link between components is lost.

The order is by a count sketch of all shingles: 2**SKETCH_BITS counters, summed
over all documents and broadcast as one byte each. Ties and collisions only
change the order, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import Scratch
from ._textkit import constants, mix, shingle_sets
from .bpe import slices
from .components import connected_components

WORDS, PERCENT = 4, 85
SKETCH_BITS, BLOCK_BITS = 21, 15
#: Largest set that may be light.
LIGHT_MOST = 24
_MARK = constants(4, 21)


def needed(n, m, percent: int):
    """Least overlap of sets of n and m shingles that reach ``percent`` (plain numbers)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """Shingles of which a set must share one with any partner, in whatever global order."""
    return n - -(-percent * n // 100) + 1 if n else 0


def subset_sizes(n: int, percent: int) -> range:
    """Sizes of common subsets that links of a set of n shingles can need."""
    return range(-(-percent * n // 100), n + 1)


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, percent))


def _texts(part: pa.RecordBatch, at: int) -> list[bytes]:
    col = part.column(at)
    return [t or b"" for t in col.cast(pa.binary() if col.type == pa.string() else pa.large_binary()).to_pylist()]


def count_sketch(docs: DataFrame, words: int) -> bytes:
    """One byte a counter: four times the binary logarithm of how often shingles fell on it, over all documents."""
    blocks, width = 1 << SKETCH_BITS - BLOCK_BITS, 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(1 << SKETCH_BITS, np.int64), False
        for batch in batches:
            for part in slices(batch, 0):
                sets = shingle_sets(_texts(part, 0), words)
                total += np.bincount(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), minlength=1 << SKETCH_BITS)
                any_rows = True
        if any_rows:
            rows = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(blocks, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, np.uint32)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    parts = docs.select("text").mapInArrow(count, "block int, counts binary")
    # Summed in two steps, so that no task reads the counters of all partitions.
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    once = salted.groupBy("block", "salt").applyInPandas(add, "block int, counts binary")
    done = once.groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    out = np.zeros((blocks, width), np.uint32)
    for r in done:
        out[r.block] = np.frombuffer(r.counts, np.uint32)
    return np.minimum(255, 4 * np.log2(out.reshape(-1) + 1.0)).astype(np.uint8).tobytes()


def shingle_rows(docs: DataFrame, words: int, percent: int, sketch: bytes) -> DataFrame:
    """(doc_id, n, fp1, fp2, keys, small, scan): size, fingerprint and prefix of every document's set.

    ``small`` is the whole set where it may be light; ``scan`` estimates the list entries its prefix meets.
    """
    levels = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        usual = float(np.mean(2.0 ** (level / 4.0)))
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(_texts(part, 1), words)
                fp1, fp2, keys, small, scan = [], [], [], [], []
                for s in sets:
                    fp1.append(int(np.sum(mix(s ^ _MARK[0]), dtype=np.uint64).astype(np.int64)))
                    fp2.append(int(np.sum(mix(s ^ _MARK[1]), dtype=np.uint64).astype(np.int64)))
                    own = level[s >> np.uint64(64 - SKETCH_BITS)]
                    p = prefix_size(len(s), percent)
                    rank = (own.astype(np.uint64) << np.uint64(56)) | (mix(s) >> np.uint64(8))
                    first = np.argpartition(rank, p - 1)[:p] if 0 < p < len(s) else np.arange(len(s))
                    first = first[np.argsort(rank[first])]
                    keys.append(s[first].view(np.int64))
                    small.append(s.view(np.int64) if len(s) <= LIGHT_MOST else s[:0].view(np.int64))
                    scan.append(int(np.maximum(1.0, 2.0 ** (own[first] / 4.0) - usual).sum()))
                cols = [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(fp1, pa.int64()),
                    pa.array(fp2, pa.int64()),
                    _lists(keys),
                    _lists(small),
                    pa.array(scan, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "fp1", "fp2", "keys", "small", "scan"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, keys array<long>, small array<long>, scan long")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def choose_boundary(sizes: dict[int, tuple[int, int]], percent: int) -> int:
    """The largest light size: least total of subsets written and list entries read.

    ``sizes`` has (sets, list entries) by size up to LIGHT_MOST; larger sets are heavy under any choice.
    """

    def cost(x: int) -> int:
        write = sum(k * subset_count(n, percent) for n, (k, _) in sizes.items() if n <= x)
        return write + sum(s for n, (_, s) in sizes.items() if 100 * n >= percent * (x + 1))

    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


def light_links(reps: DataFrame, light: int, percent: int) -> DataFrame:
    """Links (u, v) that connect light sets just as all their links do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for rep, n, small in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = np.array(small.as_py(), np.int64).view(np.uint64)
                a, b = mix(own ^ _MARK[2]), mix(own ^ _MARK[3])
                for c in subset_sizes(n, percent):
                    at = np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)
                    for k, mixed in enumerate((a, b)):
                        out[k].append((mixed[at].sum(axis=1, dtype=np.uint64) + np.uint64(c)).view(np.int64))
                    for k, v in ((2, c), (3, n), (4, rep)):
                        out[k].append(np.full(len(at), v, np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["k1", "k2", "c", "n", "rep"])

    subsets = reps.where((F.col("n") > 0) & (F.col("n") <= light)).select("rep", "n", "small").mapInArrow(run, "k1 long, k2 long, c long, n long, rep long")
    by = ["k1", "k2", "c"]
    heads = subsets.groupBy(*by).agg(F.min(F.struct("n", "rep")).alias("head"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    # The smallest set of those that share a subset is linked with each that any of them is linked with.
    got = subsets.join(heads.select(*by, "head"), by)
    fits = (100 + percent) * F.col("c") >= percent * (F.col("n") + F.col("head.n"))
    return got.where(fits & (F.col("rep") != F.col("head.rep"))).select(F.col("rep").alias("u"), F.col("head.rep").alias("v")).distinct()


def _may_link(n: Column, m: Column, percent: int) -> Column:
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose whole texts reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                us, vs = [], []
                left, right = shingle_sets(_texts(part, 2), words), _texts(part, 3)
                for u, v, a, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), left, right):
                    if raw != last:
                        last, kept = raw, shingle_sets([raw], words)[0]
                    low, high = (a, kept) if len(a) <= len(kept) else (kept, a)
                    if not len(low):
                        continue
                    at = np.searchsorted(high, low)
                    common = int((high[np.minimum(at, len(high) - 1)] == low).sum())
                    if 100 * common >= percent * (len(a) + len(kept) - common):
                        us.append(u)
                        vs.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    texts = docs.select("doc_id", "text")
    first = pairs.join(texts.withColumnsRenamed({"doc_id": "u", "text": "a"}), "u")
    both = first.join(texts.withColumnsRenamed({"doc_id": "v", "text": "b"}), "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u long, v long")


@dataclass
class Join:
    """``documents``: doc_id, n_shingles, component_id of every row. ``links``: tested links (u, v) between representatives that span the components."""

    documents: DataFrame
    links: DataFrame
    light: int


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> Join:
    """Group documents (doc_id, text) by shared word shingles.

    Two documents link when 100 * intersection >= percent * union. Texts shorter than ``words`` words are one shingle;
    null and wordless texts have none and link with nothing. Rows that share a doc_id are one node, each row keeps its
    own n_shingles; rows with a null doc_id link with nothing and have a null component. Other columns are left out. An
    empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = count_sketch(docs, words)
    sets = scratch.keep(shingle_rows(docs, words, percent, sketch))
    known = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    firsts = (F.first(c).alias(c) for c in ("n", "keys", "small", "scan"))
    reps = scratch.keep(known.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), *firsts))

    # Rows of one doc_id with different sets hang together.
    print_ = F.struct("fp1", "fp2")
    several = scratch.keep(known.groupBy("doc_id").agg(F.min(print_).alias("a"), F.max(print_).alias("b")).where(F.col("a") < F.col("b")).select("doc_id"))
    twins = None
    if not several.isEmpty():
        placed = known.join(several, "doc_id").join(reps.select("fp1", "fp2", "rep"), ["fp1", "fp2"]).select("doc_id", "rep").distinct()
        lowest = placed.groupBy("doc_id").agg(F.min("rep").alias("low"))
        twins = placed.join(lowest, "doc_id").where(F.col("rep") != F.col("low")).select(F.col("rep").alias("u"), F.col("low").alias("v"))

    counted = reps.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.sum("scan").alias("s")).collect()
    light = choose_boundary({r.n: (r.k, r.s) for r in counted}, percent)
    easy = light_links(reps, light, percent)

    # Lists: every heavy set, and the light ones that may link with one.
    entries = reps.where(100 * F.col("n") >= percent * (light + 1)).select("rep", "n", F.posexplode("keys").alias("at", "key"))
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int")
    entries = entries.withColumn("band", band)
    heads = entries.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("low"), F.max("rep").alias("high")).where(F.col("low") < F.col("high"))
    listed = scratch.keep(entries.join(heads.select("key"), "key"))
    stars = listed.groupBy("key", "band").agg(F.min(F.struct("rep", "n")).alias("hub"))
    near = listed.join(stars, ["key", "band"]).where(F.col("rep") != F.col("hub.rep"))
    near = near.where(_may_link(F.col("n"), F.col("hub.n"), percent)).select(F.col("rep").alias("u"), F.col("hub.rep").alias("v")).distinct()
    tested = verify(near, docs, words, percent).unionByName(easy)
    tested = scratch.keep(tested if twins is None else tested.unionByName(twins))
    first = scratch.keep(connected_components(tested, scratch))

    # What is left: lists that still hold several components.
    labelled = listed.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = scratch.keep(labelled.drop("band"))
    ends = F.min("component").alias("low"), F.max("component").alias("high")
    open_keys = scratch.keep(labelled.groupBy("key").agg(*ends).where(F.col("low") < F.col("high")).select("key"))
    scratch.drop(listed, several)
    placed = reps.select("fp1", "fp2", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    if open_keys.isEmpty():
        return Join(_named(sets, placed.select("fp1", "fp2", F.col("part").alias("component"))), tested.distinct(), light)
    rest = labelled.join(open_keys, "key")
    a, b = rest.alias("a"), rest.alias("b")
    i, j, n, m = F.col("a.at"), F.col("b.at"), F.col("a.n"), F.col("b.n")
    short = F.ceil(percent * (n + m) / F.lit(100 + percent))
    # The first shingle that two sets share leaves them no more than the places after it, so it stands early in both.
    early = (i <= n - short) & (j <= m - short)
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.component") != F.col("b.component"))
    met = a.join(b, on & _may_link(n, m, percent) & early)
    pairs = met.groupBy(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"), n.alias("n"), m.alias("m")).agg(
        F.count(F.lit(1)).alias("shared"), F.max(i).alias("i"), F.max(j).alias("j")
    )
    hopeful = F.col("shared") + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j")) >= F.ceil(percent * (F.col("n") + F.col("m")) / F.lit(100 + percent))
    late = scratch.keep(verify(pairs.where(hopeful).select("u", "v"), docs, words, percent))
    bridged = late.join(first.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(first.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    # Only whole components are still to be joined, so the second pass is over their names.
    merged = connected_components(bridged.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")), scratch)

    scratch.drop(labelled, open_keys)
    placed = placed.join(merged.select(F.col("node").alias("part"), F.col("component").alias("whole")), "part", "left")
    return Join(_named(sets, placed.select("fp1", "fp2", F.coalesce("whole", "part").alias("component"))), tested.unionByName(late).distinct(), light)


def _named(sets: DataFrame, components: DataFrame) -> DataFrame:
    named = sets.select("doc_id", "n", "fp1", "fp2").join(components, ["fp1", "fp2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
