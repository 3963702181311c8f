"""Centroid clustering in integers, with a partial-distance search.

A vector's squared distance to a centroid is summed over the dimensions of
largest variance first, a few at a time. As soon as the partial sum is strictly
above the vector's best whole distance so far, the centroid is abandoned for
that vector; what survives is summed over all dimensions. Each vector starts
with the centroid that is nearest over the first few dimensions, so most others
go early. Distances are exact, ties go to the smaller number.

Vectors stay where they lie. A round sends the centroids (``k`` rows, never
more) to every task and gets one partial sum per cluster and task back, which
Spark adds up; so a cluster that holds most rows costs no more than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import Scratch
from ._vectors import integer_rows

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Dimensions added between two looks at the best distance, and rows handled at a time.
STEP, BLOCK_ROWS = 8, 8_192
#: Components below this have squared distances over DIM dimensions that fit 63 bits.
SAFE = 1 << 27


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, terms summed) of each row; ties go to the smaller number.

    ``order`` lists the dimensions in the order in which they are summed.
    """
    v, c = v[:, order], centroids[:, order]
    n, dim = v.shape
    span = range(0, dim, step) or range(1)
    rows, terms = np.arange(n), 0

    def squares(who: np.ndarray, to: np.ndarray, low: int) -> np.ndarray:
        gap = v[who, low : low + step] - to[..., low : low + step]
        return np.einsum("ij,ij->i", gap, gap)

    head = np.stack([squares(rows, c[j], 0) for j in range(len(c))], axis=1)
    best_at = head.argmin(axis=1)
    best = head[rows, best_at]
    for low in list(span)[1:]:
        best = best + squares(rows, c[best_at], low)
    terms += n * (len(c) * min(step, dim) + max(0, dim - step))
    guess = best_at.copy()
    for j in range(len(c)):
        who = np.flatnonzero((guess != j) & (head[:, j] <= best))
        part = head[who, j]
        for low in list(span)[1:]:
            if not len(who):
                break
            part = part + squares(who, c[j], low)
            terms += len(who) * min(step, dim - low)
            alive = part <= best[who]
            who, part = who[alive], part[alive]
        wins = (part < best[who]) | (j < best_at[who])
        best[who[wins]], best_at[who[wins]] = part[wins], j
    return best_at, best, terms


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _near(v: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most < SAFE * np.sqrt(DIM / max(1, v.shape[1])):
        at, distance, _ = nearest(v, centroids, order)
        return at, distance
    at, distance, _ = nearest_exact(v, centroids, order)
    if len(distance) and max(distance) >= 1 << 63:
        raise OverflowError("squared distances of these vectors do not fit 64 bits")
    return at, distance.astype(np.int64)


def nearest_exact(v: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``nearest`` for components of any size, in Python integers: slow, and rarely needed."""
    at, best, terms = np.zeros(len(v), np.int64), np.empty(len(v), object), 0
    for i, row in enumerate(v[:, order].tolist()):
        low = None
        for j, c in enumerate(centroids[:, order].tolist()):
            part = 0
            for x, y in zip(row, c):
                part += (x - y) ** 2
                terms += 1
                if low is not None and part > low:
                    break
            if low is None or part < low:
                low, at[i] = part, j
        best[i] = low
    return at, best, terms


@dataclass
class Clusters:
    """``vectors``: the row's id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector. ``centroids``: the final ones, in order."""

    vectors: DataFrame
    centroids: list[list[int]]


def _kept(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, units in integer_rows(batch.column(1), scale):
                if size == dim:
                    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(units.reshape(-1)))], ["id", "units"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "id long, units array<bigint>")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> Clusters:
    """Cluster vectors of ``dim`` components, each taken as floor(scale * x).

    The first centroids are the k kept vectors with the smallest SHA-256 of ``seed:id``. Each of ``rounds`` rounds
    assigns every vector to the nearest centroid and then replaces every centroid that has vectors by the floor of
    their mean; a last assignment follows.

    Null vectors, vectors of another dimension and those with a null or non-finite component take no part. Rows that
    repeat an id are vectors of their own (as first centroids in the order of their components); a row with a null id is clustered but never a
    first centroid. With fewer than k usable vectors there are fewer centroids; without any, or with an empty table,
    there are no rows. Other columns are left out. A component, distance or sum beyond 64 bits raises.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    kept = scratch.keep(_kept(vectors, id_col, vector_col, dim, scale))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.where(F.col("id").isNotNull()).select(hashed.alias("h"), "units").orderBy("h", "units").limit(k).collect()
    now = np.array([r.units for r in first], np.int64).reshape(len(first), dim)
    if not len(now):
        return Clusters(_named(spark, kept.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now, id_col), [])
    spread = kept.agg(*(F.var_pop(F.get("units", F.lit(d))).alias(str(d)) for d in range(dim))).first()
    order = np.array(sorted(range(dim), key=lambda d: (-(spread[d] or 0.0), d)), np.int64)

    for _ in range(rounds):
        now = _moved(_sums(kept, now, order).collect(), now)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                at, distance = _near(_matrix(part.column(1), dim), now, order)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    done = scratch.keep(kept.mapInArrow(assign, "id long, cluster int, distance long"))
    scratch.drop(kept)
    return Clusters(_named(spark, done, now, id_col), now.tolist())


def _sums(kept: DataFrame, now: np.ndarray, order: np.ndarray) -> DataFrame:
    """(cluster, place, total, n): k rows a dimension, and one of place -1 with the count."""
    k, dim = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                v = _matrix(batch.column(0).slice(low, BLOCK_ROWS), dim)
                at, _ = _near(v, now, order)
                by = np.argsort(at, kind="stable")
                found, starts = np.unique(at[by], return_index=True)
                safe = int(np.abs(v).max(initial=0)) < 1 << 49
                total[found] += np.add.reduceat(v[by] if safe else v[by].astype(object), starts, axis=0).astype(object)
                count += np.bincount(at, minlength=k)
        own = np.flatnonzero(count)
        if len(own):
            text = [str(x) for c in own for x in (*total[c], count[c])]
            place = np.tile(np.array([*range(dim), -1], np.int32), len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, dim + 1).astype(np.int32)), pa.array(place), pa.array(text)], ["cluster", "place", "total"])

    parts = kept.select("units").mapInArrow(run, "cluster int, place int, total string")
    return parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total"))


def _moved(sums: list, now: np.ndarray) -> np.ndarray:
    count = {r.cluster: int(r.total) for r in sums if r.place < 0}
    out = now.copy()
    for r in sums:
        if r.place >= 0:
            out[r.cluster, r.place] = int(r.total) // count[r.cluster]
    return out


def _named(spark: SparkSession, done: DataFrame, now: np.ndarray, id_col: str) -> DataFrame:
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(now.tolist())]
    own = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    each = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = done.agg(F.sum("distance").alias("inertia"))
    # At most k rows, one row and k rows.
    facts = each.join(F.broadcast(own), "cluster").join(F.broadcast(whole), F.lit(True))
    return done.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    return f"""
, a{n} AS MATERIALIZED (
  SELECT n, vec_id, e, CAST(m.j AS INTEGER) AS cluster, m.d AS distance FROM (
    SELECT v.n, v.vec_id, v.e, min(struct_pack(d := list_sum(list_transform(list_zip(v.e, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), j := c.j)) AS m FROM v CROSS JOIN c{n} c GROUP BY v.n, v.vec_id, v.e
  )
)"""


def _means_sql(n: int) -> str:
    return f"""
, c{n + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN (
    SELECT cluster, list(f ORDER BY i) AS c FROM (
      SELECT cluster, i, (s - ((s % n) + n) % n) // n AS f FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{n}) GROUP BY cluster, i)
    ) GROUP BY cluster
  ) m ON m.cluster = c.j
)"""


OP12_SQL = (
    f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS j, e AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {K})
)"""
    + "".join(_round_sql(n) + _means_sql(n) for n in range(ROUNDS))
    + _round_sql(ROUNDS)
    + f"""
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.c, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.j = cluster
"""
)
