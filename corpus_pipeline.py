"""Documents to packed training sequences: language ID, near-dedup, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the next
stage's docs, with the columns of documents but for the last. The caller writes what a stage
returns and reads it again, so that a stage starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Table, anti, free_name, held, materialize, numbered, release
from tessera.llm.lang_crf import UNDETERMINED, identify, train
from tessera.llm.mixing import mix
from tessera.llm.packing import pack
from tessera.llm.simhash import similar_documents
from tessera.plans.session import ship

#: A document whose best language holds less of its words than this is rejected.
LEAST_SCORE = 0.3
#: Near-dedup: words of a shingle and the least similarity of near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in some language: not undetermined, and with a score of at least LEAST_SCORE.

    Null, empty and letterless texts are undetermined. Every row is judged by its whole text alone, however long, repeated ones alike;
    of equally likely languages the first by name counts. An empty table stays empty; other columns, of whatever name, come along.
    """
    ship(spark)
    rest = tuple(c for c in docs.columns if c != "doc_id")
    found = identify(docs, train(docs), keep=rest)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("id" if c == "doc_id" else f"keep_{rest.index(c)}").alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates, the one with the smallest id.

    Documents are equal if their words are (A-Z lower-cased), so null and empty texts are near
    each other. Of repeated ids one row stays a component; null ids come last. Texts are compared whole, however long.
    An empty table stays empty; other columns, of whatever name, come along.
    """
    ship(spark)
    rows, number = numbered(docs)
    found = similar_documents(rows, words=SHINGLE, similarity=SIMILARITY, row_col=number)
    dropped = materialize(found.where(~F.col("kept")).select("row"), "dropped")
    return anti(rows, number, dropped).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops and repeats documents until the sources have their target weights.

    A null source is a source; documents without words aren't taken. Repeated rows are documents
    of their own; of equal choices the row that was numbered first is taken. A very long document is taken or left as a whole.
    An empty table stays empty; other columns, of whatever name, come along.
    """
    ship(spark)
    rows, number = numbered(docs)
    taken = mix(rows, row_col=number).where("copies > 0").select(F.col("row").alias(number), F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("turns"))
    turns = free_name(rows.columns, "turns_")
    return rows.join(taken.withColumnRenamed("turns", turns), number).withColumn(turns, F.explode(turns)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of every row into sequences. A null or empty text is the end token alone; repeated rows are packed each, very long texts in many pieces. An empty table gives no pieces; other columns are ignored."""
    ship(spark)
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("packing", packing)]

#: SQL has no form of any of the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = held()
    for name, stage in STAGES:
        done = Table(stage(spark, docs, sf_dir), name)
        release(before, keep=(done.path,))
        docs = done.df
    return docs
