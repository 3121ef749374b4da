"""Source trees and records as DataFrames, and back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import CHUNK, QUESTION
from .records import put, register


def glob_pattern(glob: str) -> str:
    """A regular expression for a file glob in which * also crosses slashes and a leading **/ may be nothing."""
    out = ""
    for part in re.findall(r"\[[^\]]*\]|\*\*/|\*+|\?|.", re.sub(r"^\*\*/", "", glob), re.S):
        out += "(.*/)?" if part == "**/" else ".*" if part[0] == "*" else "." if part == "?" else part.replace("[!", "[^") if part[0] == "[" and len(part) > 1 else re.escape(part)
    return f"^(.*/)?{out}$" if glob.startswith("**/") else f"^{out}$"


def scan(spark: SparkSession, root: str, include: list[str], exclude: list[str], max_bytes: int = 400_000) -> DataFrame:
    """(path, content, length) of the files below root: included by glob, not below an excluded folder, neither empty nor too large.

    Bytes that aren't UTF-8 become the replacement character.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    # binaryFile's path is a whole address; what follows the root is the path in the tree.
    path = F.regexp_replace(F.col("path"), "^[a-z]*:?/*" + re.escape(base) + "/", "")
    rows = files.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), "content", "length").where(F.col("length").between(1, max_bytes))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    names = [e for e in exclude if not re.search(r"[*?\[/]", e)]
    if names:
        rows = rows.where(~F.arrays_overlap(folders, F.array(*map(F.lit, names))))
    for e in exclude:
        rows = rows.where(~F.col("path").rlike(glob_pattern(e)))
    wanted = "|".join(f"(?:{glob_pattern(g)})" for g in include)
    return rows.where(F.col("path").rlike(wanted)).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON lines file; keys that aren't known are left out."""
    return spark.read.schema(QUESTION).json(path)


def write_questions(questions: DataFrame, path: str) -> None:
    """Questions as JSON lines, one file for each partition."""
    questions.write.mode("overwrite").json(path)


def write_audit(answers: DataFrame, path: str, n: int = 20, seed: int = 0) -> None:
    """A sheet of n answers (query_id, question, text, correctness, faithfulness) for a person to judge, as JSON lines; the same answers on every run."""
    from ..operators.evaluate import sample

    rows = sample(answers, "query_id", n, seed)
    none = F.lit(None).cast("double")
    sheet = rows.select(F.col("query_id").cast("string").alias("question_id"), "question", F.col("text").alias("answer"), F.col("correctness").alias("judge_correctness"), F.col("faithfulness").alias("judge_faithfulness"), none.alias("human_correctness"), none.alias("human_faithfulness"), F.lit("").alias("note"))
    sheet.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


AUDIT = "question_id string, question string, answer string, judge_correctness double, judge_faithfulness double, human_correctness double, human_faithfulness double, note string"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def write_trace(trace: dict, folder: str) -> str:
    """A trace (trace_id, steps, usage ...) as one JSON file of a folder; returns its path."""
    return put(folder, str(trace["trace_id"]), trace)


def write_traces(traces: DataFrame, folder: str, id_col: str = "trace_id") -> None:
    """Traces, a row each, as one JSON file each; either all of them appear or none."""
    register(traces.sparkSession)
    rows = traces.select(F.col(id_col).cast("string").alias("name"), F.to_json(F.struct(*traces.columns)).alias("body"))
    rows.write.format("records").mode("append").option("path", folder).save()


def read_trace(spark: SparkSession, folder: str, trace_id: str) -> DataFrame:
    """The trace of that id; KeyError if there is none."""
    found = read_traces(spark, folder, 1 << 30)
    found = found.where(F.col("trace_id") == trace_id) if "trace_id" in found.columns else found.limit(0)
    if found.isEmpty():
        raise KeyError(trace_id)
    return found


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of a folder of JSON files, by file name; files that aren't reports are left out."""
    found = spark.read.option("multiLine", "true").option("mode", "DROPMALFORMED").json(folder).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    needed = [c for c in ("spec", "retrieval") if c in found.columns]
    return (found.where(" and ".join(f"{c} is not null" for c in needed)) if len(needed) == 2 else found.where("false")).orderBy("file")


def read_traces(spark: SparkSession, folder: str, limit: int = 50) -> DataFrame:
    """Traces of a folder of JSON files, the file written last first; malformed ones are left out."""
    found = spark.read.option("multiLine", "true").option("mode", "DROPMALFORMED").json(folder)
    return found.withColumn("written", F.col("_metadata.file_modification_time")).orderBy(F.desc("written")).limit(limit)
