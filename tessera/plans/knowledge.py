"""The knowledge base: chunks and the index tables built of them, saved and loaded as Parquet."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import bm25, chunking, fusion, symbols, vectors
from ..sources import files, git
from .schema import first_wins, indexed_text, with_columns
from .storage import materialize, numbered, read_bucketed, write_bucketed

TABLES = ("chunks", "blocks", "maxima", "terms", "stats", "vectors", "symbols", "edges")

#: Blocks of a bucket, as far as the session's shuffle partitions don't make more buckets.
BLOCKS_A_BUCKET = 1 << 20


def ingest(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """Chunks of a checkout: its files and its history, each id once, with row_id in the order of path and line."""
    i = config.ingestion
    parsed = with_columns(chunking.parse_files(files.scan(spark, root, i.include, i.exclude, i.max_file_bytes)).withColumn("repository", F.lit(config.repository)))
    if git.head(root) != "unknown":
        git.register(spark)
        commits = spark.read.format("commits").option("path", root).option("maxCommits", str(i.max_commits)).option("maxDiff", str(i.max_diff_chars)).load()
        parsed = parsed.unionByName(with_columns(git.commit_chunks(commits).withColumn("repository", F.lit(config.repository))))
    parsed = parsed.withColumn("commit", F.lit(git.head(root)))
    ordered = parsed.drop("row_id").withColumn("row_id", F.struct("path", "start_line", "end_line", "qualified_name", "content"))
    unique = first_wins(ordered)
    return numbered(unique.drop("row_id"), ["path", "start_line", "end_line", "qualified_name", "content"])


def touches(path: str) -> Column:
    """Whether a commit changed a file whose path has that in it."""
    return F.exists("files_changed", lambda f: F.contains(f, F.lit(path)))


def statistics(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("artifact_type", F.coalesce("symbol_type", F.lit("none")).alias("symbol_type")).agg(F.count("*").alias("n"))


@dataclass
class KnowledgeBase:
    """Chunks with their indexes; each but the chunks may be missing (None)."""

    chunks: DataFrame
    index: bm25.Bm25Index | None = None
    vectors: DataFrame | None = None
    symbols: DataFrame | None = None
    edges: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    @classmethod
    def build(cls, config: Config, chunks: DataFrame, embeddings: bool = True) -> KnowledgeBase:
        chunks = materialize(chunks, "chunks")  # parsed once, read by every index
        rows = chunks.withColumn("indexed", indexed_text())
        dense = vectors.text_vectors(rows, "indexed", vectors.build_embedder(config.embedding.model), config.embedding.dimension) if embeddings else None
        return cls(chunks, bm25.build(rows, "indexed"), dense, symbols.postings(chunks), symbols.edges(chunks), {"fingerprint": config.fingerprint()})

    def save(self, folder: str) -> str:
        """Writes every table into a new version below folder, then names it in a new numbered pointer: readers see a whole version or the one before.

        A pointer is never changed or removed, so that no reader finds none; the newest one counts.
        """
        spark, began = self.chunks.sparkSession, time.time()
        at = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex[:12]}"
        parts = {"chunks": self.chunks, "vectors": self.vectors, "symbols": self.symbols, "edges": self.edges}
        if self.index is not None:
            parts |= {"blocks": self.index.blocks, "maxima": self.index.maxima, "terms": self.index.terms, "stats": self.index.stats}
        seconds, buckets = {}, 0
        for name, df in parts.items():
            if df is not None:
                start = time.time()
                if name == "blocks":
                    buckets = write_bucketed(df, f"{at}/{name}", ("term", "window"), BLOCKS_A_BUCKET)
                else:  # maxima and terms lie by term, so that a search reads the row groups of its terms only
                    (df.repartitionByRange("term").sortWithinPartitions("term") if name in ("maxima", "terms") else df).write.parquet(f"{at}/{name}")
                seconds[name] = round(time.time() - start, 3)
        meta = self.meta | {"tables": sorted(seconds), "buckets": buckets, "seconds": seconds, "total_seconds": round(time.time() - began, 3), "built_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        _write(spark, f"{at}/meta.json", json.dumps(meta))
        newest = _pointers(spark, folder)
        _write(spark, f"{folder.rstrip('/')}/current-{(newest[-1][0] if newest else 0) + 1:09d}", at)
        return at

    @classmethod
    def load(cls, spark: SparkSession, folder: str, with_vectors: bool = True) -> KnowledgeBase:
        newest = _pointers(spark, folder)
        at = ((_read(spark, newest[-1][1]) if newest else None) or folder).strip()
        meta = json.loads(_read(spark, f"{at}/meta.json") or "{}")
        if "chunks" not in meta.get("tables", []):
            raise FileNotFoundError(f"no chunks in {at}")
        get = lambda name: spark.read.parquet(f"{at}/{name}") if name in meta["tables"] else None
        index = None
        if "blocks" in meta["tables"]:
            index = bm25.Bm25Index(read_bucketed(spark, f"{at}/blocks", ("term", "window"), meta["buckets"]), get("maxima"), get("terms"), get("stats"))
        return cls(get("chunks"), index, get("vectors") if with_vectors else None, get("symbols"), get("edges"), meta)

    def by(self, column: str, *values: str) -> DataFrame:
        """Chunks by chunk_id, path, qualified_name or symbol, in order."""
        if column not in ("chunk_id", "path", "qualified_name", "symbol"):
            raise ValueError(f"chunks aren't looked up by {column!r}")
        return self.chunks.where(F.col(column).isin(*values)).orderBy("row_id")

    def paths(self) -> DataFrame:
        return self.chunks.select("path").distinct().orderBy("path")

    def summary(self) -> DataFrame:
        return self.chunks.groupBy("artifact_type").agg(F.count("*").alias("n"))

    def sources(self, queries: DataFrame, config: Config, names: list[str] | None = None, allowed: Column | None = None, touching: str | None = None, failed: list[DataFrame] | None = None) -> dict[str, DataFrame]:
        """Hits of each source for queries (query_id, query); unknown names and missing indexes are left out.

        allowed is a predicate on chunks. It holds for every source, unless strict_filters is
        off: then symbol and git ignore it. touching keeps commits that change a file whose path has it. failed takes a table
        (query_id, error) of the questions that the embedder fails at, which have no hits then; without it the search fails.
        """
        depth, out = config.retrieval.depths, {}
        names = names or ["dense", "bm25", "symbol", "git"]
        kept = None if allowed is None else self.chunks.where(allowed).select("row_id")
        late = kept if config.retrieval.strict_filters else None
        ask = None
        if self.vectors is not None and {"dense", "git"} & set(names):
            rows = queries.select(F.col("query_id").alias("row_id"), F.col("query").alias("content"))
            ask = vectors.text_vectors(rows, "content", vectors.build_embedder(config.embedding.model), config.embedding.dimension, query=True, errors=failed is not None)
            if failed is not None:
                ask = materialize(ask, "asked")
                failed.append(ask.where("error is not null").select(F.col("row_id").alias("query_id"), "error"))
                ask = ask.where("error is null")
            ask = ask.select(F.col("row_id").alias("query_id"), "vector")
        within = lambda df, rows: df if rows is None else df.join(rows, "row_id", "left_semi")
        if "bm25" in names and self.index is not None:
            out["bm25"] = self.index.search(queries, depth["bm25"], kept)
        if "dense" in names and ask is not None:
            out["dense"] = vectors.dense_search(within(self.vectors, kept), ask, depth["dense"])
        if "symbol" in names and self.symbols is not None:
            out["symbol"] = symbols.retrieve(within(self.symbols, late), queries, depth["symbol"])
        if "git" in names and self.index is not None:
            changed = self.chunks.where("artifact_type = 'commit'")
            changed = changed if touching is None else changed.where(touches(touching))
            commits = within(changed.select("row_id"), late)
            two = {"bm25": self.index.search(queries, 2 * depth["git"], commits)}
            if ask is not None:
                two["dense"] = vectors.dense_search(within(self.vectors, commits), ask, 2 * depth["git"])
            out["git"] = fusion.reciprocal_rank(fusion.tagged(two), depth["git"]).select("query_id", "row_id", "score", "rank")
        return out


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, path) of the pointers to versions, the newest last."""
    where, fs = _path(spark, folder)
    if not fs.exists(where):
        return []
    names = [str(f.getPath()) for f in fs.listStatus(where)]
    return sorted((int(m[1]), n) for n in names if (m := re.search(r"/current-([0-9]+)$", n)))


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, written beside its place and renamed into it."""
    where, fs = _path(spark, path)
    side, _ = _path(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(side, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(side, where):
        raise FileExistsError(path)  # another writer took the number


def _read(spark: SparkSession, path: str) -> str | None:
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return None
    return "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())
