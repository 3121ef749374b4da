"""Exact top-k inner products by distributed histogram selection.

Every query scores every candidate, block by block. A block counts all of its scores in a query's current range into
the range's bins; the blocks' histograms, added up, locate the bin of the k-th best score. That bin is the next range, and
blocks are scored again, until so few scores lie at or above the range's lower edge that keeping them costs
no more than a histogram, or the range holds one value. Then what lies at or above the edge is kept, and ties go to the smaller ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, materialize

#: Rows of a block of queries and of a block of candidates; candidates scored at once; bins of a histogram; how many times k scores of
#: a query may be left when refining ends.
QUERIES, CANDIDATES, SCORED, BINS, FEW = 1024, 4096, 1024, 2048, 8
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def usable(vec: Column) -> Column:
    """The vector isn't null and neither null, NaN nor infinite anywhere."""
    inf = F.lit(float("inf"))
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles, shorter vectors filled up with zeros."""
    lists = lists.combine_chunks()
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def inner(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products as signed longs. Whole numbers below 2**53 are exact in doubles; beyond a long, scores saturate."""
    if bound < 2.0**53:
        return (q @ c.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    whole = exact(q).dot(exact(c).T) if len(q) and len(c) else np.zeros((len(q), len(c)), object)
    return np.array([[min(max(x, LOWEST), HIGHEST) for x in row] for row in whole], np.int64).reshape(len(q), len(c))


def exact_quotient(scores: np.ndarray, lo: np.ndarray, step: np.ndarray) -> np.ndarray:
    """floor((scores - lo) / step), or -1 where a score is below lo. The difference of two longs is exact as an unsigned one."""
    over = scores >= lo
    gap = scores.astype(np.uint64) - lo.astype(np.uint64)  # modulo 2**64, and so right where it isn't negative
    return np.where(over, np.minimum(gap // step.astype(np.uint64), np.uint64(1 << 40)).astype(np.int64), -1)


def top_k(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 10, scale: float = 1024.0, queries: int = QUERIES, candidates: int = CANDIDATES, bins: int = BINS) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k best other rows by inner product of floor(scale * x). An empty table gives no rows.

    is_query picks the query rows among the columns of vectors. Rows with the query's own id
    are no candidates of it; equal scores go to the smaller id; fewer than k candidates are all
    returned. Null vectors and those with null or non-finite components take no part, nor do
    rows without an id. Shorter vectors count as filled up with zeros; an empty vector scores 0.
    A repeated query row gets its list again. Scores beyond a long saturate. Extra columns are ignored.
    """
    vec = F.col(vec_col)
    kept = vectors.where(usable(vec) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = materialize(kept.withColumn("n", F.monotonically_increasing_id()), "vectors")
    floored = F.transform("v", lambda x: x.cast("double") * scale)
    square = F.aggregate(floored, F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1))
    n, n_queries, width, square = base.agg(F.count("*"), F.count_if("q"), F.max(F.size("v")), F.max(square)).first()
    schema = "query_id long, rank int, id long, score long"
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], schema)
    width, bound = max(1, width or 1), float(square or 1.0)
    top = min(HIGHEST, int(bound) + 1)
    spread = max(1, math.ceil(n_queries / queries))
    groups = max(1, math.ceil(n / candidates))
    place = F.pmod(F.xxhash64("n"), F.lit(1 << 40))
    asked = base.where("q").select("n", "id", "v", (place % spread).alias("h"))
    side = base.select(F.col("id").alias("c_id"), F.col("v").alias("c_v"), (place % groups).alias("c_g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("c_h"))

    def blocks(state: DataFrame, run, schema_: str) -> DataFrame:
        """run over each block of queries with their ranges (lo, step) and each block of candidates."""
        with_range = asked.join(state.select("n", "lo", "step"), "n")
        each = with_range.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
        return each.groupBy("g", "h").cogroup(side.groupBy("c_g", "c_h")).applyInArrow(run, schema_)

    def scores_of(q: pa.Table, c: pa.Table):
        """(ids of a slice of candidates, scores, which of them count) for the block's queries, slice by slice."""
        own, ids = q["id"].to_numpy(), c["c_id"].to_numpy()
        asked_, offered = np.floor(matrix(q["v"], width) * scale), np.floor(matrix(c["c_v"], width) * scale)
        for at in range(0, len(ids), SCORED):
            part = ids[at : at + SCORED]
            yield part, inner(asked_, offered[at : at + SCORED], bound), own[:, None] != part[None, :]

    def histogram(q: pa.Table, c: pa.Table) -> pa.Table:
        """(n, bin, c): how many of a query's scores are in each bin of its range, and as bin `bins` how many above it. Bins count down from the highest."""
        found = np.zeros((q.num_rows, bins + 1), np.int64)
        if q.num_rows and c.num_rows:
            lo, step = q["lo"].to_numpy()[:, None], q["step"].to_numpy()[:, None]
            for _, scores, real in scores_of(q, c):
                place = exact_quotient(scores, lo, step)
                inside = real & (place >= 0)
                rows, cols = np.nonzero(inside)
                at = np.minimum(place[rows, cols], bins)
                found += np.bincount(rows * (bins + 1) + at, minlength=found.size).reshape(found.shape)
        rows, cols = np.nonzero(found)
        return pa.table({"n": pa.array(q["n"].to_numpy()[rows]) if q.num_rows else pa.array([], pa.int64()), "bin": pa.array(cols.astype(np.int64)), "c": pa.array(found[rows, cols])})

    def keep(q: pa.Table, c: pa.Table) -> pa.Table:
        """The block's scores at or above each query's edge, no more than its k best of them, ties to the smaller id: the global k best are among those."""
        rows, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if q.num_rows and c.num_rows:
            c = c.sort_by("c_id")
            lo = q["lo"].to_numpy()[:, None]
            for part, found, real in scores_of(q, c):
                row, col = np.nonzero(real & (found >= lo))
                rows.append(row)
                ids.append(part[col])
                scores.append(found[row, col])
        row, id_, score = np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)
        order = np.lexsort((id_, ~score, row))  # ~x falls as x rises and can't overflow
        row, id_, score = row[order], id_[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        row, id_, score = row[best], id_[best], score[best]
        own, n_ = (q["id"].to_numpy(), q["n"].to_numpy()) if q.num_rows else (np.zeros(0, np.int64),) * 2
        return pa.table({"n": pa.array(n_[row]), "query_id": pa.array(own[row]), "id": pa.array(id_), "score": pa.array(score)})

    step = -(-(2 * top + 1) // bins)
    low = max(-top, LOWEST + 1)
    state = asked.select("n", F.lit(low).cast("long").alias("lo"), F.lit(min(step, HIGHEST)).cast("long").alias("step"), F.lit(False).alias("done"))
    state = Table(state, "ranges").df
    while not (open_ := state.where("not done")).isEmpty():
        counted = blocks(open_, histogram, "n long, bin long, c long").groupBy("n", "bin").agg(F.sum("c").alias("c"))
        down = Window.partitionBy("n").orderBy(F.desc("bin"))
        ranked = Table(counted.withColumn("sum", F.sum("c").over(down)), "histogram").df
        hit = ranked.where(F.col("sum") >= k).groupBy("n").agg(F.max_by(F.struct("bin", "sum"), "bin").alias("x"))
        moved = open_.join(hit, "n", "left")
        wide = lambda x: x.cast("decimal(20,0)")  # noqa: E731  a product of the two may leave a long, their sum with lo doesn't
        edge = (wide(F.col("lo")) + wide(F.col("x.bin")) * wide(F.col("step"))).cast("long")
        finer = F.ceil(F.col("step") / F.lit(float(bins))).cast("long")
        # A query without k candidates keeps all that it has: its edge is the lowest score.
        new = moved.select(
            "n",
            F.when(F.col("x").isNull(), F.lit(LOWEST)).otherwise(edge).alias("lo"),
            F.greatest(F.lit(1).cast("long"), finer).alias("step"),
            (F.col("x").isNull() | (F.col("step") <= 1) | (F.col("x.sum") <= FEW * k)).alias("done"),
        )
        state = Table(state.where("done").unionByName(new), "ranges").df
    found = Table(blocks(state, keep, "n long, query_id long, id long, score long"), "scores").df
    order = Window.partitionBy("n").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
