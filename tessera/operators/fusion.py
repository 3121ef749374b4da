"""Fusing ranked lists, hybrid retrieval and reranking, for batches of queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from .bm25 import top


def tagged(sources: dict[str, DataFrame]) -> DataFrame:
    """One table of hits (query_id, row_id, score, rank) with their source and its place in the order of sources."""
    parts = [df.select("query_id", "row_id", F.col("score").cast("double").alias("score"), "rank", F.lit(name).alias("source"), F.lit(i).alias("place")) for i, (name, df) in enumerate(sources.items())]
    return functools.reduce(DataFrame.unionByName, parts)


def weight_of(weights: dict[str, float] | None) -> Column:
    return functools.reduce(lambda rest, w: F.when(F.col("source") == w[0], F.lit(float(w[1]))).otherwise(rest), (weights or {}).items(), F.lit(1.0))


def finish(hits: DataFrame, part: Column, k: int, components: list[Column], name: str) -> DataFrame:
    entries = F.flatten(F.collect_list(F.array(*components)))
    fused = hits.withColumn("part", part).groupBy("query_id", "row_id").agg(F.sum("part").alias("score"), entries.alias("entries"), F.max_by("source", F.struct("score", -F.col("place"))).alias("kept"))
    ranked = top(fused, k)
    own = F.array(F.struct(F.lit(name).alias("k"), F.col("score").alias("v")))
    return ranked.withColumn("component_scores", F.map_from_entries(F.array_sort(F.concat("entries", own)))).drop("entries")


def reciprocal_rank(hits: DataFrame, k: int = C.FINAL, rrf_k: int = C.RRF_K_FIXED, weights: dict[str, float] | None = None) -> DataFrame:
    """Sum over sources of weight / (rrf_k + rank). kept is the source with the larger raw score, the earlier one of equals."""
    parts = [F.struct(F.col("source").alias("k"), F.round("score", 6).alias("v")), F.struct(F.concat("source", F.lit("_rank")).alias("k"), F.col("rank").cast("double").alias("v"))]
    return finish(hits, weight_of(weights) / (rrf_k + F.col("rank")), k, parts, "rrf")


def score_sum(hits: DataFrame, k: int = C.FINAL, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each query and source; a range of nothing counts as 1."""
    own = Window.partitionBy("query_id", "source")
    low, span = F.min("score").over(own), F.max("score").over(own) - F.min("score").over(own)
    scaled = hits.withColumn("scaled", F.when(span < 1e-9, F.lit(1.0)).otherwise((F.col("score") - low) / span))
    return finish(scaled, weight_of(weights) * F.col("scaled"), k, [F.struct(F.col("source").alias("k"), F.round("score", 6).alias("v"))], "score_sum")


METHODS: dict[str, Callable] = {"rrf": reciprocal_rank, "score_sum": score_sum}


def fuse(sources: dict[str, DataFrame], method: str = "rrf", k: int = C.FINAL, rrf_k: int = C.RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown fusion method {method!r}; there are {sorted(METHODS)}")
    extra = {"rrf_k": rrf_k} if method == "rrf" else {}
    return METHODS[method](tagged(sources), k=k, weights=weights, **extra)


def identity_rerank(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("rank") <= k)


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], Column], k: int) -> DataFrame:
    """The k best by a scorer's column; the earlier score and rank stay as pre_score and pre_rank."""
    return top(hits.withColumnRenamed("score", "pre_score").withColumnRenamed("rank", "pre_rank").withColumn("score", scorer(hits)), k)


def cross_encoder(chunks: DataFrame, questions: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], most: int = 3000, batch: int = 32) -> Callable[[DataFrame, int], DataFrame]:
    """A reranker by a model that scores (question, title and the first ``most`` characters of a chunk) pairs on the executors.

    chunks has (row_id, title, content), questions (query_id, query). The earlier score and rank
    stay as pre_score and pre_rank, and component_scores, where there are any, get the model's.
    """

    def run(batches):
        for own in batches:
            for at in range(0, own.num_rows, batch):
                some = own.slice(at, batch)
                found = score(list(zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([float(x) for x in found], pa.float64())], names=["query_id", "row_id", "model_score"])

    def reranker(hits: DataFrame, k: int) -> DataFrame:
        text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.substring("content", 1, most))
        pairs = hits.select("query_id", "row_id").join(questions.select("query_id", "query"), "query_id").join(chunks.select("row_id", text.alias("text")), "row_id").select("query_id", "row_id", "query", "text")
        scored = hits.join(pairs.mapInArrow(run, "query_id long, row_id long, model_score double"), ["query_id", "row_id"])
        if "component_scores" in hits.columns:
            own = F.create_map(F.lit("rerank"), F.round("model_score", 6))
            scored = scored.withColumn("component_scores", F.map_concat(F.map_filter("component_scores", lambda k, v: k != "rerank"), own))
        ranked = scored.withColumnRenamed("score", "pre_score").withColumnRenamed("rank", "pre_rank").withColumnRenamed("model_score", "score")
        return top(ranked, k)

    return reranker


def hybrid(sources: dict[str, DataFrame], method: str = "rrf", candidates: int = C.CANDIDATES, final: int = C.FINAL, rrf_k: int = C.RRF_K, weights: dict[str, float] | None = None, depths: dict[str, int] | None = None, reranker: Callable[[DataFrame, int], DataFrame] = identity_rerank) -> DataFrame:
    """Cuts each source to its depth, fuses (a single source passes as it is) and reranks the candidates last."""
    depths = depths or C.DEPTHS
    cut = {name: df.where(F.col("rank") <= depths.get(name, candidates)) for name, df in sources.items()}
    if len(cut) == 1:
        (name, only), = cut.items()
        fused = only.where(F.col("rank") <= max(candidates, final)).select("query_id", "row_id", "score", "rank", F.lit(name).alias("kept"))
    else:
        fused = fuse(cut, method, max(candidates, final), rrf_k, weights)
    return reranker(fused, final)


def overlap(sources: dict[str, DataFrame]) -> DataFrame:
    """(query_id, a, b, shared): rows that each pair of sources has in common."""
    hits = tagged(sources).select("query_id", "row_id", "source").distinct()
    other = hits.withColumnRenamed("source", "b")
    return hits.withColumnRenamed("source", "a").join(other, ["query_id", "row_id"]).where("a < b").groupBy("query_id", "a", "b").agg(F.count("*").alias("shared"))
