"""Exact dense search by blocks, and the hashing embedder."""

from __future__ import annotations

import importlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gram_buckets
from .bm25 import top

#: Rows of a block of queries and of a block of vectors.
BLOCK = 2048


def blocked(df: DataFrame, block: int) -> tuple[DataFrame, int]:
    count = max(1, -(-df.count() // block))
    return df.withColumn("blk", F.pmod(F.xxhash64("row_id"), F.lit(count))), count


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, allowed: Column | None = None, skip_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, row_id, score, rank): inner products of queries (query_id, vector) with vectors (row_id, vector).

    Every pair of a block of queries and a block of vectors is one matrix product whose local
    k best meet in one ranking; there is no threshold, negative scores stay. allowed is a
    predicate on vectors. Scores are rounded to 6 digits, ties go to the smaller row_id.
    """
    rows = vectors.where(allowed) if allowed is not None else vectors
    right, n_right = blocked(rows.select("row_id", "vector"), block)
    left, n_left = blocked(queries.select(F.col("query_id").alias("row_id"), F.col("vector")), block)
    left = left.select(F.col("row_id").alias("q_id"), F.col("vector").alias("q_v"), F.col("blk").alias("q_l"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_right - 1).cast("long"))).alias("q_r"))
    right = right.select("row_id", "vector", F.col("blk").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long"))).alias("l"))

    def run(q, v):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "row_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not q.num_rows or not v.num_rows:
            return empty
        grid = lambda t, c: np.stack(t[c].to_numpy()).astype(np.float64)
        qid, vid = q["q_id"].to_numpy(), v["row_id"].to_numpy()
        order = np.argsort(vid, kind="stable")
        scores, vid = np.round(grid(q, "q_v") @ grid(v, "vector")[order].T, 6), vid[order]
        if skip_self:
            scores[qid[:, None] == vid[None, :]] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        kept = np.take_along_axis(scores, best, axis=1)
        rows_, cols = np.nonzero(kept > -np.inf)
        return pa.table({"query_id": pa.array(qid[rows_]), "row_id": pa.array(vid[best[rows_, cols]]), "score": pa.array(kept[rows_, cols])})

    found = left.groupBy("q_l", "q_r").cogroup(right.groupBy("l", "r")).applyInArrow(run, "query_id long, row_id long, score double")
    return top(found, k)


def hashing_vectors(rows: DataFrame, text: str = "content", dimension: int = 256, counts: bool = False) -> DataFrame:
    """(row_id, vector), and the counts themselves if wanted: normalised counts of hashed character grams; a text without tokens is the zero vector.

    A text is counted where it lies, word by word, so that no gram is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        token = re.compile(r"[^ \t\n\x0b\f\r]+")
        for own in batches:
            for at in range(0, own.num_rows, 256):
                some = own.slice(at, 256)
                found = np.zeros((some.num_rows, dimension), np.int64)
                for i, t in enumerate(some.column(1).to_pylist()):
                    tokens = Counter(token.findall(t))
                    if tokens:
                        each = [gram_buckets(w, dimension) for w in tokens]
                        times = np.repeat(np.fromiter(tokens.values(), np.int64, len(tokens)), [len(x) for x in each])
                        found[i] = np.bincount(np.concatenate(each), times, dimension)
                size = np.sqrt((found * found).sum(axis=1, keepdims=True).astype(np.float64))
                arrays = [some.column(0), _lists(found / np.where(size > 0, size, 1.0)), _lists(found)]
                yield pa.RecordBatch.from_arrays(arrays[: 2 + counts], names=["row_id", "vector", "counts"][: 2 + counts])

    shape = f"row_id {rows.schema['row_id'].dataType.simpleString()}, vector array<double>" + (", counts array<long>" if counts else "")
    return rows.select("row_id", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")).mapInArrow(run, shape)


def _lists(grid: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, grid.size + 1, grid.shape[1]), pa.int32()), pa.array(grid.ravel()))


class Embedder(Protocol):
    """What turns texts into rows of a matrix; an instance is sent to the executors and loads its model there.

    Texts of questions and of documents may take different prefixes.
    """

    query_prefix: str
    document_prefix: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


def build_embedder(name: str, **options) -> Embedder | None:
    """None for the hashing embedder (hashing, test or none), which needs no model; module:name for what that makes."""
    if name in ("hashing", "test", "none"):
        return None
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"unknown embedder {name!r}")
    return getattr(importlib.import_module(module), attribute)(**options)


def encode(rows: DataFrame, embedder: Embedder, text: str = "content", query: bool = False, batch: int = 64, errors: bool = False) -> DataFrame:
    """(row_id, vector): an embedder's vectors of rows, with their prefix, of unit length; a zero vector stays."""
    prefix = getattr(embedder, "query_prefix" if query else "document_prefix", "") or ""

    def vectors_of(texts: list[str]) -> np.ndarray:
        found = np.asarray(embedder.encode([prefix + t for t in texts]), np.float64).reshape(len(texts), -1)
        size = np.sqrt((found * found).sum(axis=1, keepdims=True))
        return found / np.where(size > 0, size, 1.0)

    def run(batches: Iterator[pa.RecordBatch]):
        for own in batches:
            for at in range(0, own.num_rows, batch):
                some = own.slice(at, batch)
                texts = some.column(1).to_pylist()
                try:
                    found, said = list(vectors_of(texts)), [None] * len(texts)
                except Exception:  # noqa: BLE001  one text may fail its batch
                    if not errors:
                        raise
                    found, said = [], []
                    for text in texts:
                        try:
                            found.append(vectors_of([text])[0])
                            said.append(None)
                        except Exception as e:  # noqa: BLE001
                            found.append(None)
                            said.append(f"{type(e).__name__}: {e}"[:200])
                arrays = [some.column(0), pa.array(found, pa.list_(pa.float64())), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays[: 2 + errors], names=["row_id", "vector", "error"][: 2 + errors])

    shape = "row_id long, vector array<double>" + (", error string" if errors else "")
    return rows.select(F.col("row_id").cast("long").alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, shape)


def text_vectors(rows: DataFrame, text: str, embedder: Embedder | None, dimension: int = 256, query: bool = False, errors: bool = False) -> DataFrame:
    """(row_id, vector), and with errors why a text has none: then a text that the embedder fails at leaves the others their vectors."""
    if embedder is not None:
        return encode(rows, embedder, text, query, errors=errors)
    found = hashing_vectors(rows, text, dimension)
    return found.withColumn("error", F.lit(None).cast("string")) if errors else found
