"""The chunk record and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk of a corpus. row_id fixes the order that ties are broken by.
CHUNK = (
    "row_id bigint, repository string, commit string, path string, artifact_type string, start_line int, end_line int, content string, "
    "language string, symbol string, symbol_type string, qualified_name string, parent_symbol string, imports array<string>, "
    "references array<string>, decorators array<string>, docstring string, signature string, heading_path array<string>, "
    "commit_sha string, author string, timestamp string, files_changed array<string>, extra map<string,string>, chunk_id string"
)
QUESTION = (
    "id string, question string, category string, difficulty string, expected_answer string, relevant_files array<string>, "
    "relevant_symbols array<string>, relevant_chunks array<string>, relevant_commits array<string>, source string, split string, "
    "provenance map<string,string>, reviewed boolean"
)
ARTIFACTS = ("source", "test", "doc", "commit", "config")


def chunk_id() -> Column:
    """16 hex digits over what names a chunk; missing parts are empty."""
    name = F.coalesce(F.nullif(F.col("qualified_name"), F.lit("")), F.col("symbol"))
    parts = [F.col("repository"), F.col("path"), name, F.col("symbol_type"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("commit_sha")]
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary")), 1, 16)


def location() -> Column:
    span = F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return F.when(F.col("artifact_type") == "commit", F.concat(F.lit("commit "), F.substring(F.coalesce("commit_sha", F.lit("")), 1, 10))).otherwise(span)


def title() -> Column:
    headed = F.concat(F.col("path"), F.lit(" § "), F.array_join("heading_path", " > "))
    subject = F.concat(F.lit("commit "), F.substring(F.coalesce("commit_sha", F.lit("")), 1, 10))
    return (
        F.when(F.col("artifact_type") == "commit", subject)
        .when(F.size("heading_path") > 0, headed)
        .when(F.coalesce("qualified_name", F.lit("")) != "", F.concat(F.col("path"), F.lit("::"), F.col("qualified_name")))
        .otherwise(F.col("path"))
    )


def indexed_text() -> Column:
    """Names, headings and kind of a chunk before its content; absent parts are skipped."""
    full = lambda c: F.nullif(c, F.lit(""))
    head = F.concat_ws(" | ", full(F.col("path")), full(F.col("qualified_name")), full(F.array_join("heading_path", " > ")), full(F.col("symbol_type")))
    return F.concat(head, F.lit("\n"), F.col("content"))


def with_columns(df: DataFrame) -> DataFrame:
    """df with every column of CHUNK, missing ones null or empty, and its chunk_id."""
    import re

    kinds = dict(re.findall(r"(\w+) ([^,]+(?:<[^>]*>)?)(?:, |$)", CHUNK.replace("map<string,string>", "map<string;string>")))
    for name, kind in kinds.items():
        kind = kind.replace(";", ",")
        if name not in df.columns and name != "chunk_id":
            df = df.withColumn(name, F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind))
    return df.withColumn("chunk_id", chunk_id()).select(*kinds)


def first_wins(df: DataFrame, key: str = "chunk_id", order: str = "row_id") -> DataFrame:
    """One row of each key, the first in order."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), order).alias("first"))
    return best.select(key, "first.*").select(*df.columns)
