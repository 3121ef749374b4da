"""Exact duplicates by progressive refinement: equal lengths, then equal beginnings, then equal digests of whole texts.

A scan writes each text's length and a hash of its beginning, two longs a row. Lengths that occur once
are through; of the rest, beginnings that occur once are. A second scan digests whole texts where length and
beginning occur elsewhere, and only those rows are grouped by their digests. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, materialize, sketched, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a text's beginning.
PREFIX = 256


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else. Of plain ASCII, lower changes nothing else either, and it is faster than translate."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digests: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, digest), a row for each row of docs: of texts that are equal but for the case of A-Z the row with the largest id stays.

    A null text counts as empty; texts of any length are compared whole. Of rows that share the largest id
    one stays; null ids are smaller than any, so keep_id is null only where a group has no other. Other columns
    are ignored, an empty table has no rows. digest is the SHA-256 of the lower-cased text in hexadecimal; a text
    that needn't be read to its end has none, unless digests asks for all.

    Rows are looked up in a sketch of bounded size of the beginnings that repeat: where it says
    yes by mistake, a text is digested for nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long")  # lower-casing A-Z doesn't change it
    front = F.xxhash64(lowered(F.substring(text, 1, prefix)))
    fronts = Table(docs.select(size.alias("size"), front.alias("front")), "fronts")
    sizes = materialize(fronts.df.groupBy("size").agg(F.count("*").alias("c")).where("c > 1").select("size"), "sizes")
    open_ = fronts.df.join(small(sizes), "size", "left_semi").groupBy("size", "front").agg(F.count("*").alias("c")).where("c > 1")
    twins = materialize(open_.select(F.xxhash64("size", "front").alias("key")).distinct(), "twins")
    fronts.drop()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(size, front).alias("key"))
    marked, again = sketched(rows, "key", twins)
    whole = F.sha2(lowered(F.col("text")).cast("binary"), 256)
    # The number tells rows of one id apart; it is stored beside its row.
    hashed = materialize(marked.select("id", (whole if digests else F.when(F.col(again), whole)).alias("digest"), F.col(again).alias("again"), F.monotonically_increasing_id().alias("n")), "hashed")
    first = F.max(F.struct("id", (-F.col("n")).alias("m"), "n"))
    groups = hashed.where("again").groupBy("digest").agg(F.count("*").alias("group_size"), first.alias("stays")).where("group_size > 1")
    groups = materialize(groups.select("digest", "group_size", F.col("stays.id").alias("keep_id"), F.col("stays.n").alias("keep_n")), "groups")
    met = hashed.where("again").join(small(groups), "digest", "left")
    met = met.select("id", F.when(F.col("keep_n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("n") == F.col("keep_n"), F.lit(True)).alias("kept"), "digest")
    alone = hashed.where("not again").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return met.unionByName(alone)


def exact_sql() -> str:
    return f"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.low) AS text_sha256 FROM t JOIN g USING (low)"""
