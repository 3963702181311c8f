"""Hard-negative mining with a two-dimensional block matrix multiply.

Rows are cut, where they lie, into blocks of similar labels, anchors into blocks
of their own, and both along their components into chunks. As in SUMMA, the
product of anchors and rows is laid over a grid: an anchor block's chunk goes
along its grid row, a row block's chunk along its grid column, and each pair
of chunks that meet gives a partial tile of int64 scores. Partial tiles of the
same two blocks are shuffled together and added; a finished tile is reduced at
once to the few rows per anchor (or per anchor and positive) that may still
count, so scores themselves are never kept.

Two such products are made. The first one, only of blocks whose labels may
agree, gives every anchor's positives. The second one, of all others too,
takes those with it and gives the negatives in each positive's window.

Anchors go in panels, one after another, so that the partial tiles on disk at
once stay below ``PANEL_SCORES`` whatever the number of anchors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Scratch
from ._vectors import integer_rows, narrow
from .exact_topk import products

SCALE, EVERY = 256, 100
POSITIVES, NEGATIVES = 5, 10
#: A negative scores between these hundredths of its positive's score.
LOW, HIGH = 30, 90
ROW_BLOCK, ANCHOR_BLOCK, CHUNK = 2_048, 128, 32
PANEL_SCORES = 1 << 34
NONE = np.iinfo(np.int64).min
_PACKED = "anchor boolean, uid long, dim int, chunk int, least long, most long, n int, body binary, names binary"


def _pack(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        rows: dict[int, list] = {}
        asking: dict[int, list] = {}

        def block(anchor: bool, dim: int, labels: np.ndarray, names: tuple, v: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            out = []
            for chunk, low in enumerate(range(0, max(1, dim), CHUNK)):
                body = pickle.dumps(narrow(v[:, low : low + CHUNK]))
                out.append((anchor, made, dim, chunk, int(labels[0]), int(labels[-1]), len(v), body, pickle.dumps(names) if chunk == 0 else None))
            kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split()[0] for f in _PACKED.split(", ")])

        def row_blocks(dim: int) -> Iterator[pa.RecordBatch]:
            ids, labels, asks, v = (np.concatenate(x) for x in zip(*rows.pop(dim)))
            by = np.lexsort((ids, labels))
            for low in range(0, len(by), ROW_BLOCK):
                at = by[low : low + ROW_BLOCK]
                yield block(False, dim, labels[at], (ids[at], labels[at]), v[at])
                own = np.flatnonzero(asks[at])
                asking.setdefault(dim, []).extend((int(labels[at[p]]), int(ids[at[p]]), made, int(p), v[at[p]]) for p in own)

        def anchor_blocks(dim: int) -> Iterator[pa.RecordBatch]:
            own = sorted(asking.pop(dim), key=lambda a: a[:4])
            for low in range(0, len(own), ANCHOR_BLOCK):
                label, ids, home, place, v = zip(*own[low : low + ANCHOR_BLOCK])
                labels = np.array(label, np.int64)
                yield block(True, dim, labels, (np.array(ids, np.int64), labels, np.array(home, np.int64), np.array(place, np.int64)), np.array(v))

        for batch in batches:
            ids, labels, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for dim, at, v in integer_rows(batch.column(3), scale):
                rows.setdefault(dim, []).append((ids[at], labels[at], asks[at].astype(bool), v))
                if sum(len(x[0]) for x in rows[dim]) >= 16 * ROW_BLOCK:
                    yield from row_blocks(dim)
                    if len(asking.get(dim, ())) >= 16 * ANCHOR_BLOCK:
                        yield from anchor_blocks(dim)
        for dim in list(rows):
            yield from row_blocks(dim)
        for dim in [d for d in asking if asking[d]]:
            yield from anchor_blocks(dim)

    return run


_PARTIAL = "anchors long, rows long, part binary, anchor_names binary, row_names binary, known binary"


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial tiles of the chunks that have met."""
    for batch in batches:
        left, right = batch.column("anchor_body"), batch.column("row_body")
        for k in range(batch.num_rows):
            part = products(pickle.loads(left[k].as_py()).astype(np.int64), pickle.loads(right[k].as_py()).astype(np.int64))
            one = batch.slice(k, 1)
            own = [one.column(c) for c in ("anchors", "rows")] + [pa.array([pickle.dumps(narrow(part))], pa.binary())] + [one.column(c) for c in ("anchor_names", "row_names", "known")]
            yield pa.RecordBatch.from_arrays(own, [f.split()[0] for f in _PARTIAL.split(", ")])


def add_tiles(parts: list[np.ndarray]) -> np.ndarray:
    """The sum of partial tiles in int64; one that does not fit raises."""
    if sum(max(int(p.max(initial=0)), -int(p.min(initial=0))) for p in parts) < 1 << 63:
        return sum(p.astype(np.int64) for p in parts)
    exact = sum(p.astype(object) for p in parts)
    if np.abs(exact).max(initial=0) >= 1 << 63:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    return exact.astype(np.int64)


def _tile(table: pa.Table) -> tuple:
    parts = [pickle.loads(p) for p in table.column("part").to_pylist()]
    first = next(k for k, x in enumerate(table.column("anchor_names").is_valid().to_pylist()) if x)
    names = (pickle.loads(table.column(c)[first].as_py()) for c in ("anchor_names", "row_names"))
    known = table.column("known")[first].as_py()
    return add_tiles(parts), *names, known


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, by score and then smaller id; places that hold NONE are left out."""
    fit = np.flatnonzero(score != NONE)
    if len(fit) > 4 * k:
        least = -np.partition(-score[fit], k - 1)[k - 1]
        fit = fit[score[fit] >= least]
    return fit[np.lexsort((ids[fit], -score[fit]))][:k]


_FOUND = "anchors long, place int, positive int, vec_id long, score long"


def _found(anchors: list, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array([anchors[0]] * len(rows), pa.int64()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["anchors", "place", "positive", "vec_id", "score"])


def _positives(k: int):
    def run(table: pa.Table) -> pa.Table:
        score, (_, labels, homes, places), (ids, row_labels), _ = _tile(table)
        uid = table.column("rows")[0].as_py()
        out = []
        for a in range(len(labels)):
            own = np.where(row_labels == labels[a], score[a], NONE)
            if homes[a] == uid:
                own[places[a]] = NONE
            out += [(a, -1, int(ids[p]), int(own[p])) for p in _best(own, ids, k)]
        return _found(table.column("anchors").slice(0, 1).to_pylist(), out)

    return run


def window_bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest integer between low and high hundredths of a score."""
    return -(-low * score // 100), high * score // 100


def _negatives(k: int, low: int, high: int):
    def run(table: pa.Table) -> pa.Table:
        score, (_, labels, _, _), (ids, row_labels), known = _tile(table)
        out = []
        for a, positive, positive_score in pickle.loads(known):
            least, most = window_bounds(positive_score, low, high)
            if least > most:
                continue
            fit = (row_labels != labels[a]) & (score[a] >= max(least, NONE + 1)) & (score[a] <= most)
            if fit.any():
                own = np.where(fit, score[a], NONE)
                out += [(a, positive, int(ids[p]), int(own[p])) for p in _best(own, ids, k)]
        return _found(table.column("anchors").slice(0, 1).to_pylist(), out)

    return run


def _known(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "positive", "score"))))
    return pa.table([table.column("anchors").slice(0, 1), pa.array([pickle.dumps(rows)], pa.binary())], ["anchors", "known"])


def grid(anchors: int, rows: int, chunks: int, tasks: int) -> tuple[int, int]:
    """Rows and columns of a grid of about ``tasks`` cells a chunk that sends least: anchor blocks go to each column, row blocks to each row."""
    cells = max(1, tasks // max(1, chunks))
    down = min(anchors, max(1, round((cells * anchors / max(1, rows)) ** 0.5)))
    return max(1, down), max(1, min(rows, -(-cells // max(1, down))))


def _tiles(anchors: DataFrame, rows: DataFrame, down: int, across: int, may: Column) -> DataFrame:
    """Partial tiles of all pairs of blocks that ``may`` allows."""
    cell = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("down", cell("uid", down)).withColumn("across", span(across)).alias("a")
    b = rows.withColumn("across", cell("uid", across)).withColumn("down", span(down)).alias("b")
    on = (F.col("a.dim") == F.col("b.dim")) & (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.down") == F.col("b.down")) & (F.col("a.across") == F.col("b.across"))
    met = a.join(b, on & may).select(
        F.col("a.uid").alias("anchors"),
        F.col("b.uid").alias("rows"),
        F.col("a.body").alias("anchor_body"),
        F.col("b.body").alias("row_body"),
        F.col("a.names").alias("anchor_names"),
        F.col("b.names").alias("row_names"),
        F.col("a.known").alias("known"),
    )
    return met.mapInArrow(_multiply, _PARTIAL)


def mine_hard_negatives(
    vectors: DataFrame, asks: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``asks`` holds.

    A component x counts as floor(scale * x) and a score is an inner product in integers. An anchor's positives are its
    best other rows of the same label; for each of them the best rows of other labels are returned whose score lies between ``low`` and
    ``high`` hundredths of the positive's. Better is a higher score, then a smaller id.

    Rows with a null id, a null label, a null vector, or a null or non-finite component take no part; vectors meet those
    of their own dimension. Rows that repeat an id are rows of their own: each is a candidate, each may ask, and only
    the asking row itself is left out. An anchor without a positive, and a positive without a row in its window, give no rows; so does an empty
    table. Other columns are left out. A component or a score beyond 64 bits raises OverflowError.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    asked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("vector"))
    packed = scratch.keep(asked.where(F.col("id").isNotNull() & F.col("label").isNotNull()).mapInArrow(_pack(scale), _PACKED))
    sizes = {r.anchor: r for r in packed.groupBy("anchor").agg(F.count_if(F.col("chunk") == 0).alias("blocks"), F.sum(F.when(F.col("chunk") == 0, F.col("n"))).alias("n"), (F.max("chunk") + 1).alias("chunks")).collect()}
    if True not in sizes:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors, rows = packed.where("anchor"), packed.where(~F.col("anchor"))
    panels = max(1, -(-sizes[True].n * sizes[False].n * sizes[False].chunks // PANEL_SCORES))
    tasks = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    down, across = grid(-(-sizes[True].blocks // panels), sizes[False].blocks, sizes[False].chunks, tasks)
    done = [scratch.keep(_panel(scratch, anchors.where(F.pmod(F.xxhash64("uid"), F.lit(panels)) == p), rows, down, across, positives, negatives, low, high)) for p in range(panels)]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _panel(scratch: Scratch, anchors: DataFrame, rows: DataFrame, down: int, across: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    least, most = F.col("a.least"), F.col("a.most")
    agree = (least <= F.col("b.most")) & (F.col("b.least") <= most)
    first = _tiles(anchors.withColumn("known", F.lit(None).cast("binary")), rows, down, across, agree)
    near = first.groupBy("anchors", "rows").applyInArrow(_positives(positives), _FOUND).drop("positive")
    best = Window.partitionBy("anchors", "place").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("positive", F.row_number().over(best)).where(F.col("positive") <= positives)
    held = scratch.keep(ranked)

    known = held.groupBy("anchors").applyInArrow(_known, "anchors long, known binary")
    asking = anchors.join(known.withColumnRenamed("anchors", "uid"), "uid").withColumn("known", F.when(F.col("chunk") == 0, F.col("known")))
    differ = ~((least == most) & (F.col("b.least") == F.col("b.most")) & (least == F.col("b.least")))
    second = _tiles(asking, rows, down, across, differ)
    far = second.groupBy("anchors", "rows").applyInArrow(_negatives(negatives, low, high), _FOUND)
    by = Window.partitionBy("anchors", "place", "positive").orderBy(F.desc("score"), "vec_id")
    kept = far.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    named = anchors.where(F.col("chunk") == 0).select("uid", "names").mapInArrow(_anchor_ids, "anchors long, place int, anchor_id long")
    whole = kept.join(held.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), ["anchors", "place", "positive"]).join(named, ["anchors", "place"])
    return whole.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _anchor_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uid, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = pickle.loads(names)[0]
            yield pa.RecordBatch.from_arrays([pa.array([uid] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids)], ["anchors", "place", "anchor_id"])


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS at, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.at AS a, a.vec_id AS anchor_id, r.at AS r, r.vec_id AS id, a.label = r.label AS same, CAST(list_sum(list_transform(list_zip(a.e, r.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % {EVERY} = 0 AND a.at <> r.at AND len(a.e) = len(r.e)
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= {POSITIVES}
), h AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM h WHERE rank <= {NEGATIVES}
"""
