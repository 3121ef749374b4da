"""What the operators of this subpackage share: connected components, row numbers, tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Table, held, materialize, release, scratch_path, shared_dir

__all__ = ["WORD", "Table", "anti", "connected_components", "free_name", "held", "materialize", "numbered", "release", "scratch_path", "shared_dir", "sketched", "small"]

#: Words as the contracts define them: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, or with as many underscores as it takes not to be the name of a column."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs written once with a column of unique longs, and that column's name.

    A number that is derived anew in each scan follows the file splits, and so the number of
    executors; this one is stored beside its row.
    """
    name = free_name(docs.columns, "row_number_")
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


#: Bits of a sketch of keys, 64 to a row: it has 2**20 rows at most, which is what may be broadcast.
SKETCH_BITS = 1 << 26


def sketched(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, str]:
    """rows with a boolean column that is true wherever keys (one column) has the row's key, and that column's name.

    It is seldom true elsewhere, as long as keys are few next to SKETCH_BITS; what is false needs no look at
    keys. Only a sketch of bounded size moves to the rows.
    """
    name, word, bits = (free_name(rows.columns, x) for x in ("likely_", "word_", "bits_"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SKETCH_BITS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{c}`), 64) as int))")
    (only,) = keys.columns
    words = keys.select(F.floor(place(F.col(only)) / 64).alias(word), bit(only).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    words = materialize(words, "sketch")
    marked = rows.withColumn(word, F.floor(place(F.col(key)) / 64)).join(F.broadcast(words), word, "left")
    return marked.withColumn(name, F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False))).select(*rows.columns, name), name


#: Rows of a few numbers each up to which a written table is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1 << 20


def small(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has no more than BROADCAST_ROWS of them, else for a sort-merge join: the size of its files doesn't tell what a broadcast takes."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def anti(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't in keys (a written table of one column of distinct values); few of them are shuffled. A null key is in none."""
    marked, likely = sketched(rows, key, keys)
    (only,) = keys.columns
    rest = marked.where(likely).join(small(keys.withColumnRenamed(only, key)), key, "left_anti")
    return marked.where(~F.col(likely)).select(*rows.columns).union(rest.select(*rows.columns))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """Alternates large-star and small-star steps until every node hangs on its smallest reachable node.

    edges: two columns of node ids (long); direction, order and repeats don't matter; a null
    or an equal end is ignored. Returns (node, root) for every node that has an edge to another.
    An edge is kept as (greater end u, smaller end v). Minima are written before they are joined:
    both sides of a join are scans then, so that a hub's edges can be split among tasks (adaptive
    skew join) or meet broadcast minima. The driver only learns whether there is work left.
    """
    x, y = F.col(a), F.col(b)
    start = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    now = Table(start, "edges")
    for _ in range(rounds):
        # Nothing is left to do when the edges are stars: no smaller end is a greater end elsewhere.
        if now.df.select("v").distinct().join(now.df.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").isEmpty() and now.df.groupBy("u").count().where("count > 1").isEmpty():
            break
        # Large star: a node's greater neighbours go to its smallest one. Only nodes with a smaller neighbour change anything.
        least = Table(now.df.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")
        large = Table(now.df.join(least.df, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large")
        # Small star: a node's smaller neighbours go to the smallest of them.
        small_ = Table(large.df.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "small")
        moved = large.df.join(small_.df, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = Table(moved.union(small_.df.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        for old in (now, least, large, small_):
            old.drop()
        now = step
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.df.select(F.col("v"), F.col("v")).distinct())
