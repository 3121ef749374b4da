"""Symbol dictionary and symbol graph."""

from __future__ import annotations

import difflib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import extract_symbols, leaf, normalize_symbol, symbol_variants
from ..plans.storage import materialize, numbered, small
from .bm25 import top


def postings(chunks: DataFrame, cap: int = C.SYMBOL_POSTINGS) -> DataFrame:
    """(key, row_id, priority, pos): rows under every variant of their names, the first cap of each key by kind and order."""
    kinds = F.create_map(*(F.lit(x) for pair in C.TYPE_PRIORITY.items() for x in pair))
    rows = chunks.where("symbol_type is not null and symbol_type <> 'commit'").select("row_id", F.coalesce(F.element_at(kinds, F.col("symbol_type")), F.lit(C.OTHER_PRIORITY)).alias("priority"), "symbol", "qualified_name")
    names = F.array_distinct(F.concat(symbol_variants(F.coalesce("symbol", F.lit(""))), symbol_variants(F.coalesce("qualified_name", F.lit("")))))
    keyed = rows.select(F.explode(names).alias("key"), "row_id", "priority").distinct()
    order = Window.partitionBy("key").orderBy("priority", "row_id")
    return keyed.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= cap)


def lookup(index: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, name, row_id, score, rank) of names (query_id, name): the whole name scores 1.0, its variants 0.9; first seen first.

    Of a key's postings the first k are enough: fewer than k rows are known before it, so that among them are all that is
    still wanted. A key's postings go to a name as one list. Neither side is broadcast, as many names
    may come from a small file.
    """
    low = normalize_symbol(F.col("name"))
    keys = names.select("query_id", "name", F.posexplode(F.array_distinct(F.concat(F.array(low), symbol_variants(F.col("name"))))).alias("nth", "key"))
    lists = index.groupBy("key").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "row_id"))), 1, k), lambda p: p["row_id"]).alias("rows"))
    told = keys.join(lists.hint("merge"), "key").groupBy("query_id", "name").agg(F.array_sort(F.collect_list(F.struct("nth", "rows"))).alias("found"))
    exact = F.flatten(F.transform(F.filter("found", lambda x: x["nth"] == 0), lambda x: x["rows"]))
    rows = F.slice(F.array_distinct(F.flatten(F.transform("found", lambda x: x["rows"]))), 1, k)
    each = told.select("query_id", "name", exact.alias("exact"), F.posexplode(rows).alias("at", "row_id"))
    score = F.when(F.array_contains("exact", F.col("row_id")), C.EXACT_SCORE).otherwise(C.VARIANT_SCORE)
    return each.select("query_id", "name", "row_id", score.alias("score"), (F.col("at") + 1).alias("rank"))


#: Names of a block on either side of a comparison.
NAMES = 4096


def sketch(names: list[str]) -> np.ndarray:
    """64 bits of each name, one for each of its marks by a hash: a mark is a character with how many of its like stand before it."""
    out = np.zeros(len(names), np.uint64)
    bits: dict[tuple[str, int], int] = {}
    for i, name in enumerate(names):
        seen: dict[str, int] = {}
        bit = 0
        for c in name:
            seen[c] = nth = seen.get(c, 0) + 1
            if (c, nth) not in bits:
                bits[c, nth] = zlib.crc32(f"{c}{nth}".encode()) % 64
            bit |= 1 << bits[c, nth]
        out[i] = bit
    return out


def letter_counts(names: list[str]) -> np.ndarray:
    """How often each name has each of the characters that any of them has."""
    place = {c: i for i, c in enumerate(sorted(set().union(*names)))}
    out = np.zeros((len(names), max(1, len(place))), np.int32)
    for i, name in enumerate(names):
        for c in name:
            out[i, place[c]] += 1
    return out


def likely_pairs(low: list[str], keys: list[str], cutoff: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers of low, numbers of keys) of the pairs that may have a ratio of at least cutoff, and how many the sketches left.

    A pair with m matching characters has m in common in any order, so m is at most either length less the
    marks that the other lacks, and those are at least as many as the bits that its sketch lacks.
    What the sketches leave, as a matrix, is held against the characters that are in common.
    """
    a, b = np.array([len(x) for x in low], np.int32), np.array([len(x) for x in keys], np.int32)
    x, y = sketch(low), sketch(keys)
    rows, cols = [], []
    for at in range(0, len(low), 256):  # 256 times a block of keys at once
        p, q = x[at : at + 256, None], y[None, :]
        most = np.minimum(a[at : at + 256, None] - np.bitwise_count(p & ~q).astype(np.int32), b[None, :] - np.bitwise_count(q & ~p).astype(np.int32))
        row, col = np.nonzero(2 * most >= cutoff * (a[at : at + 256, None] + b[None, :]) - 1e-9)
        rows.append(row + at)
        cols.append(col)
    row, col = np.concatenate(rows), np.concatenate(cols)
    left, count = len(row), letter_counts(low + keys)
    keep = []
    for at in range(0, left, 1 << 16):
        r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
        common = np.minimum(count[r], count[len(low) + c]).sum(axis=1)
        keep.append(2 * common >= cutoff * (a[r] + b[c]) - 1e-9)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return row[keep], col[keep], left


def close_names(names: DataFrame, known: DataFrame, k: int = 10, cutoff: float = C.FUZZY_CUTOFF, block: int = NAMES) -> DataFrame:
    """(query_id, name, match, ratio): the k known names (key) most like each name by matching blocks, at least cutoff.

    Names meet in blocks whose lengths the cutoff allows. Within a block pair, bounds on what two names can have in
    common are evaluated as matrices, and only what they leave becomes pairs and is compared; no pair is lost.
    A pair goes on as a row only if it is close.
    """
    low = F.lower("name")

    # Names of one length are cut by a hash into groups of about a block.
    def cut(rows: DataFrame, c: str) -> DataFrame:
        rows = materialize(rows.withColumn("length", F.length(c)), "names")
        sizes = rows.groupBy("length").agg(F.ceil(F.count("*") / block).alias("groups"))  # a row for each length of a name
        return materialize(rows.join(F.broadcast(sizes), "length").select(c, "length", F.pmod(F.xxhash64(c), F.col("groups")).alias("g")), "cut")

    keys = cut(known.select("key").distinct().where("key <> ''"), "key").withColumnRenamed("length", "b")
    wanted = cut(names.select(low.alias("low")).distinct().where("low <> ''"), "low").withColumnsRenamed({"length": "a", "g": "h"})
    share = cutoff / (2 - cutoff)  # the least ratio of two lengths
    reach = F.sequence(F.ceil(F.col("a") * share - 1e-9), F.floor(F.col("a") / share + 1e-9))
    met = materialize(wanted.select("a", "h").distinct().select("a", "h", F.explode(F.transform(reach, lambda x: x.cast("int"))).alias("b")).join(keys.select("b", "g").distinct(), "b"), "met")

    def compare(asked: pa.Table, offered: pa.Table) -> pa.Table:
        left, right = sorted(asked["low"].to_pylist()), sorted(offered["key"].to_pylist())
        row, col, _ = likely_pairs(left, right, cutoff) if left and right else ([], [], 0)
        matcher, out = difflib.SequenceMatcher(None), []
        for r, c in zip(map(int, row), map(int, col), strict=True):  # rows come in order, so that each name is analysed once
            if matcher.b != left[r]:
                matcher.set_seq2(left[r])
            matcher.set_seq1(right[c])
            if (found := matcher.ratio()) >= cutoff:
                out.append({"low": left[r], "key": right[c], "ratio": round(found, 6)})
        return pa.Table.from_pylist(out, pa.schema([("low", pa.string()), ("key", pa.string()), ("ratio", pa.float64())]))

    blocks = ("a", "h", "b", "g")
    pairs = wanted.join(small(met), ["a", "h"]).groupBy(*blocks).cogroup(keys.join(small(met), ["b", "g"]).groupBy(*blocks)).applyInArrow(compare, "low string, key string, ratio double")
    scored = names.select("query_id", "name", low.alias("low")).join(pairs, "low")
    order = Window.partitionBy("query_id", "name").orderBy(F.desc("ratio"), "key")
    return scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("query_id", "name", F.col("key").alias("match"), "ratio")


def search(index: DataFrame, names: DataFrame, k: int = 10, cutoff: float = C.FUZZY_CUTOFF) -> DataFrame:
    """Lookup, then, for names it finds fewer than k rows of, lookup of close names at a score times their likeness."""
    exact = lookup(index, names, k)
    found = exact.groupBy("query_id", "name").agg(F.count("*").alias("n"))
    short = names.select("query_id", "name").distinct().join(found, ["query_id", "name"], "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id", "name")
    close = close_names(short, index, k, cutoff)
    far = lookup(index, close.select(F.struct("query_id", "name", "ratio").alias("query_id"), F.col("match").alias("name")), 3)
    far = far.select("query_id.query_id", F.col("query_id.name").alias("name"), "row_id", F.round(F.col("score") * F.col("query_id.ratio"), 4).alias("score"))
    far = far.groupBy("query_id", "name", "row_id").agg(F.max("score").alias("score")).join(exact, ["query_id", "name", "row_id"], "left_anti")
    both = exact.select("query_id", "name", "row_id", "score", F.lit(0).alias("tier")).unionByName(far.withColumn("tier", F.lit(1)))
    order = Window.partitionBy("query_id", "name").orderBy("tier", F.desc("score"), "row_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("tier")


def retrieve(index: DataFrame, queries: DataFrame, k: int = 10, fuzzy: bool = True) -> DataFrame:
    """Symbol hits of each query: its candidates' hits, weighted down by the candidate's place, the best of a row."""
    names = queries.select("query_id", F.posexplode(extract_symbols(F.col("query"))).alias("place", "name"))
    hits = search(index, names, k) if fuzzy else lookup(index, names, k)
    placed = hits.join(names.groupBy("query_id", "name").agg(F.min("place").alias("place")), ["query_id", "name"])
    best = placed.groupBy("query_id", "row_id").agg(F.max(F.col("score") / (1 + 0.25 * F.col("place"))).alias("score"))
    return top(best, k)


#: Places of a block of one level are 16 blocks of the level below.
FAN = 16
#: Follows whatever a name may go on with.
LAST = chr(0x10FFFF)


def aligned(lo: Column, hi: Column, levels: int) -> Column:
    """(level, block) of aligned blocks of FAN**level places that make up the places lo to hi - 1: fewer than twice FAN on each level."""
    up = lambda x, level: F.ceil(x / float(FAN**level)).cast("long")
    down = lambda x, level: F.floor(x / float(FAN**level)).cast("long")
    none, parts = F.array().cast("array<long>"), []
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    for level in range(levels):
        a, b, inner, outer = up(lo, level), down(hi, level), up(lo, level + 1) * FAN, down(hi, level + 1) * FAN
        # Blocks of the level that no block of the next one holds.
        own = F.when(inner < outer, F.concat(run(a, inner), run(outer, b))).otherwise(run(a, b))
        parts.append(F.arrays_zip(F.array_repeat(F.lit(level), F.size(own)).alias("level"), own.alias("block")))
    return F.concat(*parts)


def definition_of(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(name, row_id): the first row whose qualified name is the name, else ends with it in any case.

    Reversed, an end is a beginning, and the names with one beginning stand together in sorted order. So names and what
    is asked for are range-partitioned and numbered together; what is asked for is a range of places, cut into aligned blocks
    whose first rows are known. Nothing is compared pair by pair, however many names end alike.
    """
    wanted = names.select("name").distinct().where("name <> ''")
    rows = chunks.where("qualified_name is not null").select("row_id", "qualified_name")
    exact = wanted.join(rows, F.col("name") == F.col("qualified_name")).groupBy("name").agg(F.min("row_id").alias("exact"))
    text, none = F.reverse(F.lower("name")), F.lit(None)
    marks = (
        rows.select(F.reverse(F.lower("qualified_name")).alias("text"), F.lit(1).alias("kind"), none.cast("string").alias("name"), F.col("row_id").cast("long").alias("row_id"))
        .union(wanted.select(text, F.lit(0), "name", none.cast("long")))
        .union(wanted.select(F.concat(text, F.lit(LAST)), F.lit(2), "name", none.cast("long")))
    )
    placed = numbered(marks, ["text", "kind"], "place")
    total, levels = max(2, placed.count()), 1
    while FAN**levels < total:
        levels += 1
    ranges = placed.where("kind <> 1").groupBy("name").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    blocks = ranges.select("name", F.explode(aligned(F.col("lo") + 1, F.col("hi"), levels)).alias("x")).select("name", "x.*")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col("place") / float(FAN**n)).alias("block")) for n in range(levels))))
    firsts = placed.where("kind = 1").select("row_id", each.alias("x")).groupBy("x.level", "x.block").agg(F.min("row_id").alias("row_id"))
    ends = blocks.join(firsts, ["level", "block"]).groupBy("name").agg(F.min("row_id").alias("end"))
    return wanted.join(exact, "name", "left").join(ends, "name", "left").select("name", F.coalesce("exact", "end").alias("row_id")).where("row_id is not null")


def edges(chunks: DataFrame, cap: int = C.GRAPH_EDGES, id_col: str = "chunk_id") -> DataFrame:
    """(kind, name, target): definitions, callers, tests and importers of names, each list distinct, by target, cut to cap."""
    rows = chunks.where("artifact_type <> 'commit'").withColumn("target", F.col(id_col))
    named = rows.where("symbol is not null and symbol_type in ('class', 'function', 'method')").select(F.lit("definitions").alias("kind"), F.col("symbol").alias("name"), "target")
    called = rows.select("artifact_type", "target", F.explode(F.array_distinct(F.transform("references", leaf))).alias("name")).where(~F.col("name").isin(C.NOISE) & (F.length("name") >= 3))
    called = called.select(F.when(F.col("artifact_type") == "test", "tests").otherwise("callers").alias("kind"), "name", "target")
    who = F.coalesce(F.nullif(F.col("parent_symbol"), F.lit("")), F.nullif(F.col("qualified_name"), F.lit("")), F.col("path"))
    brought = rows.select("artifact_type", "target", who.alias("who"), F.explode("imports").alias("full"))
    importers = brought.select(F.lit("importers").alias("kind"), F.explode(F.array_distinct(F.array(F.col("full"), leaf(F.col("full"))))).alias("name"), F.col("who").alias("target"))
    tested = brought.where("artifact_type = 'test'").select(F.lit("tests").alias("kind"), leaf(F.col("full")).alias("name"), "target")
    every = named.unionByName(called).unionByName(importers).unionByName(tested)
    # Repeated edges share their place; each task cuts its own lists before anything is shuffled.
    order = Window.partitionBy("kind", "name").orderBy("target")
    return every.withColumn("pos", F.dense_rank().over(order)).where(F.col("pos") <= cap).distinct()


def impact(graph: DataFrame, chunks: DataFrame, symbols: DataFrame, limit: int = C.IMPACT_LIMIT, id_col: str = "chunk_id") -> DataFrame:
    """(symbol, relation, target, rank) of symbols (symbol): definitions, callers that aren't definitions, tests, importers, and other chunks of the defining files.

    Of a file only its first chunks meet the symbols: the limit, and as many as a symbol has definitions.
    """
    graph = materialize(graph, "graph")
    asked = symbols.select("symbol", leaf(F.col("symbol")).alias("name")).distinct()
    linked = asked.join(graph, "name").select("symbol", F.col("kind").alias("relation"), "target", "pos")
    defined = linked.where("relation = 'definitions'").select("symbol", "target")
    kept = linked.where("relation <> 'callers'").unionByName(linked.where("relation = 'callers'").join(defined, ["symbol", "target"], "left_anti").select("symbol", "relation", "target", "pos"))
    rows = chunks.select(F.col(id_col).alias("target"), "path", "row_id")
    files = defined.join(rows, "target").select("symbol", "path").distinct()
    most = limit + (defined.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0)
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(F.col("row_id").cast("int"), "target"))).where(F.col("nth") <= most).drop("nth")
    mates = files.join(first, "path").join(defined, ["symbol", "target"], "left_anti").select("symbol", F.lit("same_file").alias("relation"), "target", F.col("row_id").cast("int").alias("pos"))
    order = Window.partitionBy("symbol", "relation").orderBy("pos", "target")
    return kept.unionByName(mates).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("symbol", "relation", "target", "rank")


def mates(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, file_id, n_links): each chunk with the smallest id of its file's chunks and how many others are there: all pairs of a file as one row a chunk. A chunk without a path has none."""
    rows = chunks.select(F.col(id_col).alias("id"), "path").where("path is not null")
    files = rows.groupBy("path").agg(F.min("id").alias("file_id"), (F.count("*") - 1).alias("n_links"))
    return rows.join(files, "path").select("id", "file_id", "n_links")


def neighbours(chunks: DataFrame, ids: DataFrame, id_col: str = "chunk_id", k: int | None = None, order: str = "row_id") -> DataFrame:
    """(id, other): the other chunks of a chunk's file; with k only the first k of them in order.

    For those a file's first k + 1 chunks are enough, so no more of them meet.
    """
    rows = chunks.select(F.col(id_col).alias("other"), "path", *([F.col(order).alias("at")] if k else []))
    if k:
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("at", "other")))
        own = ids.join(rows.select("path", F.col("other").alias("id")), "id")
        met = own.join(rows.where(F.col("nth") <= k + 1), "path").where("id <> other")
        return met.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("nth"))).where(F.col("n") <= k).select("id", "other")
    return ids.join(rows, ids["id"] == rows["other"]).select("id", "path").join(rows, "path").where("id <> other").select("id", "other")
