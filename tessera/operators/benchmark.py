"""Running a benchmark as one batch, sweeping fusion weights, and reports."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import materialize, numbered
from ..sources.records import put
from . import evaluate, fusion, vectors


def grid(spark: SparkSession, weights: dict[str, tuple[float, ...]], rrf_ks: tuple[int, ...]) -> DataFrame:
    """Every combination of weights (w_<source>) and rrf_k."""
    made = spark.range(1).select(F.explode(F.array(*map(F.lit, rrf_ks))).alias("rrf_k"))
    for source, values in weights.items():
        made = made.select("*", F.explode(F.array(*(F.lit(float(x)) for x in values))).alias(f"w_{source}"))
    return made


def sweep(hits: DataFrame, gold: DataFrame, n: int, weights: dict[str, tuple[float, ...]], rrf_ks: tuple[int, ...], k: int = 10) -> DataFrame:
    """(w_<source>..., rrf_k, recall, mrr, objective) for every weighting of tagged hits, in one job, retrieved once.

    recall is the mean share of a question's gold rows (query_id, row_id) among its first k,
    mrr the mean reciprocal rank, objective their sum, over n questions; one without gold scores 0.
    The grid is a literal of the caller's, so it is broadcast. best picks the best combination.
    """
    combinations = grid(hits.sparkSession, weights, rrf_ks)
    key = combinations.columns
    weight = functools.reduce(lambda rest, s: F.when(F.col("source") == s, F.col(f"w_{s}")).otherwise(rest), weights, F.lit(0.0))
    fused = hits.crossJoin(F.broadcast(combinations)).groupBy(*key, "query_id", "row_id").agg(F.round(F.sum(weight / (F.col("rrf_k") + F.col("rank"))), 6).alias("score"))
    order = Window.partitionBy(*key, "query_id").orderBy(F.desc("score"), "row_id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("size"))
    hit = ranked.join(gold, ["query_id", "row_id"]).groupBy(*key, "query_id").agg(F.min("rank").alias("first"), F.count("*").alias("found")).join(sizes, "query_id")
    figures = hit.groupBy(*key).agg(F.round(F.sum(F.col("found") / F.col("size")) / n, 6).alias("recall"), F.round(F.sum(1.0 / F.col("first")) / n, 6).alias("mrr"))
    every = combinations.join(figures, key, "left").select(*key, F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"))
    return every.withColumn("objective", F.round(F.col("recall") + F.col("mrr"), 6))


def best(figures: DataFrame, objective: str = "objective") -> DataFrame:
    """The row with the largest objective; equal ones by the other columns."""
    return figures.orderBy(F.desc(objective), *[c for c in figures.columns if c != objective]).limit(1)


def fingerprint(spec: dict) -> str:
    return hashlib.sha1(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:12]


def file_hash(path: str) -> str:
    """12 hex digits of a file's SHA-1."""
    digest = hashlib.sha1()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()[:12]


def portable_path(path: str, root: str) -> str:
    """A path below root as one relative to it, any other as its last part, so that reports of two machines agree."""
    own, base = os.path.abspath(path), os.path.abspath(root)
    return os.path.relpath(own, base).replace(os.sep, "/") if os.path.commonpath([own, base]) == base else os.path.basename(own)


def run(name: str, questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], gold: DataFrame, spec: dict, split: str | None = None, limit: int | None = None, by: tuple[str, ...] = (), singly: int = 0, warm_up: bool = True) -> dict:
    """A report of one system: filter and cut the questions, retrieve for all of them at once, score.

    retrieve takes (query_id, query) and returns (query_id, rank, unit, grade); questions may have
    the columns of by, whose values get figures of their own. A question that fails scores nothing, is
    named in errors, and the others count: retrieve may return a column error, and rows that have one say why a
    question has no hits. Where one question fails the whole batch, halves of it are asked, and halves of the half that
    fails: a few batches for each failure. singly asks so many questions alone after a warm-up, for latencies.
    """
    chosen = questions if split is None else questions.where(F.col("split") == split)
    chosen = materialize(chosen.orderBy("query_id").limit(limit) if limit else chosen, "questions")
    own, began, errors = gold.join(chosen.select("query_id"), "query_id"), time.time(), {}
    schema = "query_id long, rank int, unit string, grade int"

    def saved(asked: DataFrame) -> DataFrame:
        found = retrieve(asked)
        told = F.col("error").cast("string") if "error" in found.columns else F.lit(None).cast("string")
        return materialize(found.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("unit").cast("string").alias("unit"), F.col("grade").cast("int").alias("grade"), told.alias("error")), "ranked")

    def attempt(asked: DataFrame, first: int, last: int) -> list[DataFrame]:
        """What the questions of places first to last give; those that fail are noted."""
        try:
            return [saved(asked.where(F.col("place").between(first, last)).drop("place"))] if first <= last else []
        except Exception as e:  # noqa: BLE001  one question may fail the batch
            if first == last:
                errors[asked.where(F.col("place") == first).first()["query_id"]] = str(e)[:200]
                return []
            half = (first + last) // 2
            return attempt(asked, first, half) + attempt(asked, half + 1, last)

    n = chosen.count()
    parts = attempt(numbered(chosen, ["query_id"], "place"), 1, n)
    every = functools.reduce(DataFrame.union, parts) if parts else questions.sparkSession.createDataFrame([], schema + ", error string")
    for r in every.where("error is not null").select("query_id", "error").distinct().collect():  # a benchmark's questions
        errors[r["query_id"]] = r["error"][:200]
    hits = every.where("error is null").drop("error")
    seconds = time.time() - began
    metrics = evaluate.question_metrics(hits, own).join(chosen.select("query_id", *by), "query_id")
    rows = [r.asDict() for r in evaluate.aggregate(metrics, by).collect()]
    report = {"system": name, "spec": spec, "fingerprint": fingerprint(spec), "questions": n, "seconds": round(seconds, 3), "errors": errors}
    whole = [r for r in rows if not by or r["level"] == 2 ** len(by) - 1]
    report["retrieval"] = {k: v for k, v in whole[0].items() if k != "level" and k not in by} if whole else {}
    for c in by:
        report[f"by_{c}"] = {str(r[c]): {k: v for k, v in r.items() if k != "level" and k not in by} for r in rows if r["level"] != 2 ** len(by) - 1 and r[c] is not None}
    if singly:
        taken, ids = [], [r[0] for r in chosen.select("query_id").orderBy("query_id").limit(singly).collect() if r[0] not in errors]
        for i in [*ids[: int(warm_up)], *ids]:
            start = time.time()
            retrieve(chosen.where(F.col("query_id") == i)).collect()
            taken.append((time.time() - start) * 1000)
        taken = taken[int(warm_up) :]
        if taken:
            report["latency_ms"] = evaluate.latency(questions.sparkSession.createDataFrame([(x,) for x in taken], "value double")).first().asDict()
    return report


def save_report(report: dict, folder: str) -> str:
    """Writes a report as <system>-<fingerprint>.json into a folder, whole or not at all; returns its path."""
    return put(folder, f"{report['system']}-{report['fingerprint']}", report, indent=2, sort_keys=True)


def compare_embedders(chunks: DataFrame, questions: DataFrame, gold: DataFrame, embedders: dict, others: Callable[[DataFrame], dict[str, DataFrame]], graded: Callable[[DataFrame], DataFrame], text: str = "content", k: int = 40) -> list[dict]:
    """Reports of each embedder alone and fused with the other sources: two runs for each.

    embedders maps a name to an embedder (None: hashing), others gives the other sources' hits for
    questions, graded makes (query_id, rank, unit, grade) of hits.
    """
    out = []
    for name, embedder in embedders.items():
        table = materialize(vectors.text_vectors(chunks, text, embedder), "vectors")

        def dense(asked, table=table, embedder=embedder):
            rows = asked.select(F.col("query_id").alias("row_id"), F.col("query").alias(text))
            return vectors.dense_search(table, vectors.text_vectors(rows, text, embedder, query=True).withColumnRenamed("row_id", "query_id"), k)

        out.append(run(f"dense-{name}", questions, lambda asked, dense=dense: graded(dense(asked)), gold, {"embedder": name}))
        out.append(run(f"hybrid-{name}", questions, lambda asked, dense=dense: graded(fusion.hybrid({"dense": dense(asked), **others(asked)})), gold, {"embedder": name, "sources": "all"}))
    return out


ORDER = ("dense", "bm25", "symbol", "hybrid", "hybrid+rerank", "agentic")


def ablation(reports: list[dict]) -> str:
    """A Markdown table of reports: known systems in a fixed order, then the others by name."""
    merged: dict[str, dict] = {}
    for r in reports:
        merged.setdefault(r["system"].removeprefix("gen-"), {}).update(r.get("retrieval") or {}, **(r.get("generation") or {}))
    names = sorted(merged, key=lambda s: (ORDER.index(s) if s in ORDER else 99, s))
    columns = sorted({c for m in merged.values() for c in m})
    cell = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| system | " + " | ".join(columns) + " |", "|---" * (len(columns) + 1) + "|"]
    return "\n".join(lines + [f"| {s} | " + " | ".join(cell(merged[s].get(c)) for c in columns) + " |" for s in names])
