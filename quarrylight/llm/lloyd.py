"""Centroid clustering by delta Lloyd rounds, in whole numbers.

A vector's components are floor(scale * x). Each vector's owner (its nearest centroid) and distance are persisted with
it, a table for each round. After a round only centroids that moved can change an owner: a vector is compared with the
moved centroids, and with all of them only if its own centroid moved away from it (had it stayed or come nearer, every
centroid that stayed is as far as before, and lost then). Vectors that change owners are transfers: a task sums them, minus
in the old cluster and plus in the new one, and Spark adds these few rows to the sums that are kept from round to round.
So a round reads and writes the table once, shuffles at most a row for each task and cluster, and brings one row a
cluster (their number and the dimension are parameters) to the driver. If no centroid moves, the rounds are over.

Sums and distances are whole numbers below 2^63: a component of a magnitude for which a distance could pass it ends the
query with an error, as does an overflow of a sum; a distance is computed in doubles only where these hold it exactly.

Defined results: a null vector, one of another length and one with a null or non-finite component are left out; equal
vectors are vectors each; rows that repeat a vec_id are ordered by their components as starting centroids, rows without
one come last. With fewer vectors than clusters each starts one. An empty table gives an empty one; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.store import folder_for, stage

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256.0, 2
#: Rows that are compared at once; components up to which doubles hold every distance of up to 64 dimensions exactly.
ROWS, EXACT = 4096, 1 << 22
_STATE = "kind int, vec_id long, v array<int>, owner int, distance long, cluster int, n long, sums array<long>"


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """vec_id and the whole components of each kept vector. Needs vec_id and embedding."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    most = isqrt((1 << 61) // dims)
    kept = vectors.where(F.col("embedding").isNotNull()).where(F.size("embedding") == dims).where(sound)
    part = F.transform(x, lambda e: F.when(F.abs(e * scale) < most, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for distances in 64 bits")).cast("int")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), part.alias("v"))


def starts(whole: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; k rows come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to each row of c, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and x.shape[1] <= DIMS:
        p, q = x.astype(np.float64), c.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ q.T) + (q * q).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def nearest(x: np.ndarray, c: np.ndarray, moved: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances. owner: -1 for a vector that was not compared yet; distance: to where the owner was."""
    owner, distance = owner.copy(), distance.copy()
    own = np.flatnonzero((owner >= 0) & moved[owner])
    here = ((x[own] - c[owner[own]]) ** 2).sum(1)
    afresh = owner < 0
    afresh[own[here > distance[own]]] = True
    distance[own] = here
    for rows, some in ((np.flatnonzero(~afresh), np.flatnonzero(moved)), (np.flatnonzero(afresh), np.arange(len(c)))):
        if len(rows) and len(some):
            d = squared(x[rows], c[some])
            best = d.argmin(1)  # the first of equals: the smaller number
            d, best = d[np.arange(len(rows)), best], some[best]
            better = (owner[rows] < 0) | (d < distance[rows]) | ((d == distance[rows]) & (best < owner[rows]))
            owner[rows[better]], distance[rows[better]] = best[better], d[better]
    return owner, distance


def _round(table: DataFrame, c: np.ndarray, moved: np.ndarray, first: bool) -> DataFrame:
    """Rows of kind 0: each vector with its owner; of kind 1: what a task transfers, one row a cluster."""
    k, dims = c.shape
    names = [x.split()[0] for x in _STATE.replace("<int>", "").replace("<long>", "").split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def batch(kind: int, n: int, columns: dict) -> pa.RecordBatch:
        columns["kind"] = pa.array(np.full(n, kind), pa.int32())
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, t)) for name, t in zip(names, kinds, strict=True)], names=names)

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                v = part.column("v")
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                was = np.full(len(x), -1) if first else part.column("owner").to_numpy().astype(np.int64)
                owner, distance = nearest(x, c, moved, was, np.zeros(len(x), np.int64) if first else part.column("distance").to_numpy())
                for side, sign in ((was, -1), (owner, 1)):
                    rows = np.flatnonzero((was != owner) & (side >= 0))
                    np.add.at(n, side[rows], sign)
                    np.add.at(sums, side[rows], sign * x[rows])
                yield batch(0, len(x), {"vec_id": part.column("vec_id"), "v": v, "owner": pa.array(owner, pa.int32()), "distance": pa.array(distance)})
        some = np.flatnonzero((n != 0) | sums.any(1))
        if len(some):
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * dims + 1, dims), pa.int32()), pa.array(sums[some].ravel()))
            yield batch(1, len(some), {"cluster": pa.array(some, pa.int32()), "n": pa.array(n[some]), "sums": flat})

    columns = ["vec_id", "v"] if first else ["vec_id", "v", "owner", "distance"]
    return table.select(*columns).mapInArrow(run, _STATE)


def _persisted(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with their owners, and transfers: two folders of one table."""
    spark, path = rows.sparkSession, folder_for(rows.sparkSession, name)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    read = spark.read.schema(rows.schema).parquet(path)
    return read.where("kind = 0").select("vec_id", "v", "owner", "distance"), read.where("kind = 1").select("cluster", "n", "sums")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, owner, distance) of each vector, and the centroids, k x dims at most."""
    whole = stage(whole_vectors(vectors, dims, scale), "lloyd-vectors")
    c = starts(whole, k, seed)
    if not len(c):
        return whole.select("vec_id", "v", F.lit(0).alias("owner"), F.lit(0).cast("long").alias("distance")), c.reshape(0, dims)
    moved, n, sums = np.ones(len(c), bool), np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
    state = whole
    for i in range(rounds + 1):
        state, transfers = _persisted(_round(state, c, moved, i == 0), f"lloyd-{i}")
        if i == rounds:
            break
        added = transfers.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(dims)))
        for r in added.collect():  # a row for each cluster
            n[r.cluster] += r.n
            sums[r.cluster] += np.array(r[2:], np.int64)
        now = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], c)
        moved, c = (now != c).any(1), now
        if not moved.any():
            break
    return state, c


def assignments(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    state, c = cluster(vectors, k, rounds, dims, scale, seed)
    spark = state.sparkSession
    of = {r.owner: r.total for r in state.groupBy("owner").agg(F.sum("distance").alias("total")).collect()}  # a row for each cluster
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    facts = spark.createDataFrame([(i, of.get(i, 0), sum(of.values()), h) for i, h in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    owned = state.select("vec_id", F.col("owner").alias("cluster"), "distance")
    return owned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_delta_lloyd(spark, sf_dir: str) -> DataFrame:
    return assignments(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    dot = "list_dot_product"
    steps = [
        f"""whole AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM whole ORDER BY 1 LIMIT {K})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, any_value(whole.vec_id) AS vec_id, any_value(whole.v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM
  (SELECT r, vec_id, whole.v, c, {dot}(whole.v, whole.v) - 2 * {dot}(whole.v, c{i}.v) + {dot}(c{i}.v, c{i}.v) AS d FROM whole, c{i}) AS whole GROUP BY r)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""m{i} AS (SELECT c, list(s ORDER BY j) AS v FROM (SELECT c, j, floor(sum(x) / count(*)) AS s FROM
  (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))"""
            )
    last = f"(SELECT r, vec_id, c, d FROM a{ROUNDS})"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string([x::BIGINT for x in c{ROUNDS}.v], ',')) AS centroid_sha256 FROM {last} JOIN c{ROUNDS} USING (c)"""


QUERIES = {"op13_delta_lloyd": op13_delta_lloyd}
ORACLES = {"op13_delta_lloyd": _sql()}
