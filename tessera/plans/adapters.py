"""The driver's tables as the engine's model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("doc", "test", "config", "commit", "source")


def chunks(docs: DataFrame) -> DataFrame:
    """A chunk for each document: its whole text, of a kind that its id picks."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.lit("corpus").alias("repository"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("source").alias("folder"),
        kind.alias("artifact_type"),
        F.lit(1).alias("start_line"),
        F.size(F.split("text", "\n")).alias("end_line"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
    )


def questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def symbols(part: DataFrame) -> DataFrame:
    """Invented identifiers: Words.type_brand of every part, with one of eight questions around it."""
    camel = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.initcap(w)), "")
    tail = F.concat(F.lower(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "_")), F.lit("_"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "")))
    name = F.concat(camel, F.lit("."), tail)
    kinds = F.array(*map(F.lit, ("class", "function", "method", "module", "file", "section")))
    templates = (
        "In which file is `{}` defined, and what is it for?", "Which config flag turns {} on?",
        "What tests exercise {}?", "Who calls {} and would notice a rename?",
        "When was {}() added to the code?", "Is there a guide that explains {}?",
        "Why does {} crash with an exception?", "Which components take part in a call of {}?",
    )
    asked = F.element_at(F.array(*map(F.lit, templates)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return part.select(
        F.col("p_partkey").alias("row_id"),
        F.substring_index(name, ".", -1).alias("symbol"),
        name.alias("qualified_name"),
        F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("symbol_type"),
        F.replace(asked, F.lit("{}"), name).alias("question"),
    )
