"""Exact top-k search by inner product with a ball tree per shard.

Vectors are cut, where they lie, into shards of at most ``SHARD_ROWS`` rows.
Each shard holds a ball tree: a node knows the centre and radius of its rows,
so no row below it can score more than query . centre + |query| * radius. A
block of queries goes down the tree of one shard at a time, nodes in the order
of that bound, and leaves a node as soon as the bound of each of its queries
is below that query's k-th score so far.

Every block first searches its own shard; its k-th scores then go with it to all
other shards as a start, so that these mostly prune and send back only rows
that may still count. Each shard's best k are merged at the end.

Blocks meet shards through a join on a numbered cell, with shards dealt to as
many cells as there are blocks (``CELLS`` at most); a task holds one block and
one shard at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Scratch

K, EVERY, SCALE = 20, 20, 64
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, CELLS = 4096, 256, 512, 64
NONE = np.iinfo(np.int64).min
_PACKED = "kind string, uid long, home long, dim int, n int, cell int, body binary"


def build_tree(vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, list[tuple]]:
    """(order of rows, nodes); a node is (centre, radius, begin, end, left, right), with left < 0 in a leaf.

    Nodes are halved at the median along their widest dimension, so equal vectors do no harm.
    """
    order, nodes = np.arange(len(vectors)), []

    def add(begin: int, end: int) -> int:
        own = vectors[order[begin:end]].astype(np.float64)
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        at = len(nodes)
        nodes.append(None)
        left = right = -1
        if end - begin > leaf:
            wide = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            middle = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(own[:, wide], middle)]
            left, right = add(begin, begin + middle), add(begin + middle, end)
        nodes[at] = (centre, radius, begin, end, left, right)
        return at

    if len(vectors):
        add(0, len(vectors))
    return order, nodes


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in floating point where that is exact."""
    top = (int(np.abs(q).max(initial=0)) + 1) * (int(np.abs(v).max(initial=0)) + 1) * max(1, q.shape[1])
    if top < 1 << 52:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return q @ v.T
    exact = q.astype(object) @ v.T.astype(object)
    if np.abs(exact).max(initial=0) >= 1 << 63:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    return exact.astype(np.int64)


def search(q: np.ndarray, skip: np.ndarray, start: np.ndarray, ids: np.ndarray, v: np.ndarray, nodes: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k (scores, ids) of each query among rows v, by score and then smaller id; NONE where there are fewer.

    ``skip`` is the row that is the query itself, or -1; ``start`` a score of which k candidates are known to be
    no worse (or NONE): only rows that reach it are wanted.
    """
    best = np.full((len(q), k), NONE, np.int64)
    name = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    floor = start.copy()
    if not nodes or not len(q):
        return best, name
    length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    wide = q.astype(np.float64)

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        centre, radius = nodes[node][:2]
        # The sum may cancel, so its error is that of its terms: of centre, radius and product, each a few roundings a dimension.
        slack = (len(centre) + 16) * 2.0**-49 * (float(np.sqrt(centre @ centre)) + radius)
        return wide[who] @ centre + length[who] * (radius + slack) + 1e-6

    heap = [(0.0, 0, 0, np.arange(len(q)), bound(0, np.arange(len(q))))]
    made = 1
    while heap:
        _, _, node, who, high = heappop(heap)
        alive = high >= floor[who]
        who = who[alive]
        if not len(who):
            continue
        _, _, begin, end, left, right = nodes[node]
        if left >= 0:
            for child in (left, right):
                up = bound(child, who)
                heappush(heap, (-float(up.max()), made, child, who, up))
                made += 1
            continue
        score = products(q[who], v[begin:end])
        own = skip[who]
        inside = np.flatnonzero((own >= begin) & (own < end))
        score[inside, own[inside] - begin] = NONE
        hit = np.flatnonzero((score >= np.maximum(floor[who], NONE + 1)[:, None]).any(axis=1))
        if not len(hit):
            continue
        rows, fresh = who[hit], score[hit]
        fresh[fresh < floor[rows][:, None]] = NONE
        s = np.concatenate((best[rows], fresh), axis=1)
        i = np.concatenate((name[rows], np.where(fresh == NONE, np.iinfo(np.int64).max, ids[begin:end][None, :])), axis=1)
        top = np.lexsort((i, ~s), axis=-1)[:, :k]
        best[rows], name[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        floor[rows] = np.maximum(floor[rows], best[rows, -1])
    return best, name


def _small(v: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if not len(v) or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return v.astype(kind)
    return v


def _pack(every: int, id_at: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        made = 0
        wait: dict[int, tuple[list, list]] = {}
        asked: dict[int, list] = {}

        def rows(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["kind", "uid", "home", "dim", "n", "cell", "body"])

        def block(dim: int, size: int) -> tuple:
            nonlocal made
            made += 1
            part, asked[dim] = asked[dim][:size], asked[dim][size:]
            body = pickle.dumps((np.array([p[0] for p in part], np.int64), np.array([p[1] for p in part], np.int64), np.array([p[2] for p in part], np.int64), _small(np.array([p[3] for p in part]))))
            return ("block", base + made, int(part[0][1]), dim, len(part), 0, body)

        def shard(dim: int) -> list[tuple]:
            nonlocal made
            ids, vectors = (np.concatenate(x) for x in wait.pop(dim))
            out = []
            for at in range(0, len(ids), SHARD_ROWS):
                made += 1
                uid, own, v = base + made, ids[at : at + SHARD_ROWS], vectors[at : at + SHARD_ROWS]
                order, nodes = build_tree(v)
                own, v = own[order], v[order]
                out.append(("shard", uid, uid, dim, len(own), 0, pickle.dumps((own, _small(v), nodes))))
                asked.setdefault(dim, []).extend((int(own[p]), uid, int(p), v[p]) for p in np.flatnonzero(own % every == 0))
            while len(asked.get(dim, ())) >= BLOCK_ROWS:
                out.append(block(dim, BLOCK_ROWS))
            return out

        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = np.array(pc.list_value_length(lists).fill_null(-1).to_pylist(), np.int64)
            for dim in np.unique(sizes[sizes >= 0]).tolist():
                at = np.flatnonzero(sizes == dim)
                taken = lists.take(pa.array(at))
                x = taken.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
                fine = np.isfinite(x).all(axis=1) & ids.is_valid().to_numpy(zero_copy_only=False)[at]
                if fine.any():
                    got = wait.setdefault(dim, ([], []))
                    got[0].append(ids.take(pa.array(at[fine])).to_numpy(zero_copy_only=False).astype(np.int64))
                    units = np.floor(SCALE * x[fine])
                    if np.abs(units).max(initial=0) >= 2.0**63:
                        raise OverflowError("a component times 64 does not fit 64 bits")
                    got[1].append(units.astype(np.int64))
                    if sum(map(len, got[0])) >= 2 * SHARD_ROWS:
                        yield rows(shard(dim))
        for dim in list(wait):
            if out := shard(dim):
                yield rows(out)
        for dim in list(asked):
            if asked[dim]:
                yield rows([block(dim, BLOCK_ROWS)])

    return run


def _find(k: int, keep_floor: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            for uid, block_body, floor_body, shard_uid, shard_body in zip(*(c.to_pylist() for c in batch.columns)):
                ids, homes, places, q = pickle.loads(block_body)
                if last != shard_uid:
                    last, known = shard_uid, pickle.loads(shard_body)
                own, v, nodes = known
                start = pickle.loads(floor_body) if floor_body else np.full(len(ids), NONE, np.int64)
                skip = np.where(homes == shard_uid, places, -1)
                best, name = search(q.astype(np.int64), skip, start, own, v.astype(np.int64), nodes, k)
                r, c = np.nonzero(best != NONE)
                full = pickle.dumps(best[:, -1]) if keep_floor else None
                n = len(r) + keep_floor
                pad = [None] * keep_floor
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uid] * n, pa.int64()),
                        pa.array(ids[r].tolist() + pad, pa.int64()),
                        pa.array(homes[r].tolist() + pad, pa.int64()),
                        pa.array(places[r].tolist() + pad, pa.int64()),
                        pa.array(name[r, c].tolist() + pad, pa.int64()),
                        pa.array(best[r, c].tolist() + pad, pa.int64()),
                        pa.array([None] * len(r) + [full] * keep_floor, pa.binary()),
                    ],
                    ["uid", "query_id", "home", "place", "vec_id", "score", "floor"],
                )

    return run


_FOUND = "uid long, query_id long, home long, place long, vec_id long, score long, floor binary"


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id divides by ``every``, the k best other rows.

    Components x count as floor(64 * x); scores are integer inner products, ties go to the smaller id. A component or a
    score beyond 64 bits has no right answer in these columns and raises OverflowError.
    Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors are compared with those of
    their own dimension. Rows that repeat an id are rows of their own: each is a candidate, each asks, and only the asking
    row itself is left out. Fewer than k candidates are all returned; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    packed = scratch.keep(vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(_pack(every), _PACKED))
    shards = packed.where(F.col("kind") == "shard").select(F.col("uid").alias("shard_uid"), "dim", F.col("body").alias("shard_body"))
    blocks = packed.where(F.col("kind") == "block").select("uid", "home", "dim", F.col("body").alias("block_body"))
    cells = max(1, min(CELLS, blocks.count()))

    first = blocks.join(shards.withColumnRenamed("shard_uid", "home"), ["home", "dim"])
    seeded = scratch.keep(first.select("uid", "block_body", F.lit(None).cast("binary").alias("floor"), F.col("home").alias("shard_uid"), "shard_body").mapInArrow(_find(k, True), _FOUND))
    floors = seeded.where(F.col("floor").isNotNull()).select("uid", "floor")
    cell = F.pmod(F.xxhash64("uid"), F.lit(cells))
    ready = blocks.join(floors, "uid").withColumn("cell", cell)
    dealt = shards.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<bigint>")))
    met = ready.join(dealt, ["cell", "dim"]).where(F.col("home") != F.col("shard_uid"))
    other = met.select("uid", "block_body", "floor", "shard_uid", "shard_body").mapInArrow(_find(k, False), _FOUND)
    found = seeded.where(F.col("vec_id").isNotNull()).unionByName(other)
    order = Window.partitionBy("home", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


OP7_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) DESC, c.vec_id) AS INTEGER) AS rank
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
WHERE rank <= {K}
"""
