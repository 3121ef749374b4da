"""Centroid clustering by sort-means, in integers.

Each round orders the other centroids by their distance from each centroid. A vector is scanned against
them in the order that its previous centroid has, and the scan stops strictly beyond twice the distance
to that one: by the triangle inequality none of the rest is nearer, and none as near.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table
from .topk import usable

#: Components are held to this in size, so that four times a squared distance of 64 of them is a long.
LARGEST = 1 << 27
ROWS = "id long, v array<int>, cluster int, distance long"


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def sort_means(x: np.ndarray, was: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of the nearest centre of each row of x, ties to the smaller number, and how many distances that took."""
    best, least, spent = was.astype(np.int64), np.zeros(len(x), np.int64), 0
    for own in np.unique(was):
        rows = np.flatnonzero(was == own)
        gaps = squares(centers, centers[own])
        reach = squares(x[rows], centers[own])
        near, at = reach.copy(), np.full(len(rows), own)
        spent += len(rows)
        active = np.arange(len(rows))
        for other in np.lexsort((np.arange(len(centers)), gaps)):
            if other == own:
                continue
            active = active[-(-gaps[other] // 4) <= reach[active]]  # the gap isn't beyond twice the distance
            if not len(active):
                break
            found = squares(x[rows[active]], centers[other])
            spent += len(active)
            better = (found < near[active]) | (found == near[active]) & (other < at[active])
            near[active[better]], at[active[better]] = found[better], other
        best[rows], least[rows] = at, near
    return best, least, spent


def assign(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """rows (id, v, cluster) with the nearest centre of each, scanned from the cluster it had."""
    width = centers.shape[1]

    def run(batches):
        for b in batches:
            x = matrix(b["v"], width)
            cluster, distance, _ = sort_means(x, b["cluster"].to_numpy(zero_copy_only=False), centers)
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "v", "cluster", "distance"])

    return rows.select("id", "v", "cluster").mapInArrow(run, ROWS)


def means(rows: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The floored mean of each cluster's vectors; an empty one keeps its centre. Tasks send sums, one row a cluster."""
    k, width = centers.shape

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            x, cluster = matrix(b["v"], width), b["cluster"].to_numpy(zero_copy_only=False)
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = rows.select("v", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>").where("n > 0")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    found = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = centers.copy()
    for r in found.collect():  # clusters times components, whatever the number of rows
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, dimensions: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of that many components.

    Components become floor(scale * x), held to LARGEST in size. The k vectors whose ids have the smallest
    SHA-256 of "seed:id" are the first centroids (fewer vectors: as many centroids; equal ids: in the order of their
    components; null ids last). Equal distances go to the smaller number. Null vectors, those of other lengths and those
    with null or non-finite components are left out; a vector with a null id and each repeated row take part as
    rows of their own. Other columns are ignored; an empty table gives no rows.

    What passes through the driver is k centroids and, for each cluster, a sum. A round writes
    the vectors with their clusters and the round before it goes.
    """
    spark, vec = vectors.sparkSession, F.col(vec_col)
    whole = F.transform(vec, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    kept = vectors.where(usable(vec) & (F.size(vec) == dimensions)).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.lit(0).alias("cluster"))
    now = Table(kept, "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = now.df.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centers = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        then, now = now, Table(assign(now.df, centers), "assigned")
        then.drop()
        centers = means(now.df, centers)
    then, now = now, Table(assign(now.df, centers).drop("v"), "assigned")
    then.drop()
    sums = {r["cluster"]: int(r["s"]) for r in now.df.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = 2**63 - 1
    ends = [(c, min(s, most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    table = spark.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.df.join(F.broadcast(table), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def cluster_sql(k: int = 16, dimensions: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> str:
    """The same by comparing every vector with every centroid."""

    def nearest(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT id, v, c, (list_inner_product(v, v) + list_inner_product(m, m) - 2 * list_inner_product(v, m))::BIGINT AS d FROM vecs, m{n}) GROUP BY id, v)"""

    def moved(n: int) -> str:
        return f"""m{n + 1} AS MATERIALIZED (SELECT m.c, coalesce(u.m, m.m) AS m FROM m{n} m LEFT JOIN (
  SELECT c, list(floor(s / n) ORDER BY i) AS m FROM (SELECT c, i, sum(x) AS s, count(*)::DOUBLE AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dimensions})) AS i FROM a{n}) GROUP BY 1, 2) GROUP BY 1) u USING (c))"""

    steps = ", ".join(f"{nearest(n)}, {moved(n)}" for n in range(rounds))
    return f"""WITH vecs AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || id)) - 1 AS c, v AS m FROM vecs ORDER BY c LIMIT {k}), {steps}, {nearest(rounds)}
SELECT id AS vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(m.m, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} a JOIN m{rounds} m ON m.c = a.c"""
