"""Mixing sources to target weights by balanced sampling (the cube method).

Every document of a source has the same expected number of copies, target / size of the
source. Its whole part is taken outright. Its fraction is an inclusion probability, and a
vector of those is a point of a cube. The flight phase walks that point through the null space
of the constraints (token total, document total) until it is at a corner in all but a few
coordinates. It runs in blocks of documents; what a block leaves fractional (two at most) meets
the leftovers of other blocks, level by level, until one block a source is left. Only there,
for two documents a source at most, the landing gives up the document total, then the last bit.
"""

from __future__ import annotations

import functools
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Table, materialize

#: Documents of a block of the flight phase.
BLOCK = 2048
#: Probabilities this near to 0 or 1 are there.
EPS = 1e-9


def word_count(text) -> F.Column:
    """Words of a text column; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources by code point, null last, take the weights in turn.

    Together they get ``share`` of all sizes. A target stops at ``most`` times its source's
    size and the excess is shared anew by weight among the others until none is above. A source
    without words has target 0. Ranks come from a range partitioning, and the loop only brings
    three sums to the driver, so that the number of sources isn't bounded by the driver.
    """
    spark = sources.sparkSession
    ordered = sources.select("source", "source_size", F.hex(F.col("source").cast("binary")).alias("at")).repartitionByRange(F.col("source").isNull(), "at")
    ordered = materialize(ordered.sortWithinPartitions(F.col("source").isNull(), "at").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "*"), "sources")
    before = [r for r in ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first")).orderBy("part").collect()]
    shifts, at = [F.lit(-1), F.lit(0).cast("long")], 0
    for r in before:  # one row for each partition of the range partitioning
        shifts += [F.lit(r["part"]), F.lit(at - r["first"]).cast("long")]
        at += r["n"]
    offset = F.element_at(F.create_map(*shifts), F.col("part"))
    turn = (F.col("row") + offset) % len(weights)
    weight = functools.reduce(lambda rest, k: F.when(turn == k, F.lit(float(weights[k]))).otherwise(rest), range(len(weights)), F.lit(0.0))
    ranked = Table(ordered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "weights").df
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    want, level = share * total, 0.0
    for _ in range(ranked.count() + 2):  # a round caps at least one more source or ends
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        r = ranked.agg(F.sum(F.when(full, F.col("cap"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        new = (want - (r["capped"] or 0.0)) / r["open"] if r["open"] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    else:
        raise RuntimeError("the targets aren't settled")
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def settled(q: float) -> float:
    return 0.0 if q < EPS else 1.0 if q > 1 - EPS else q


def flight(p: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Moves probabilities p to 0 or 1, keeping sum(p) and sum(p * sizes), until two at most are neither.

    A window of three fractional documents has one direction that changes neither sum: the
    cross product of the two rows. The point goes along it to a face of the cube, one way or
    the other with odds that leave each document's expectation as it was, which settles one.
    """
    rng = random.Random(seed)
    out = p.astype(float).tolist()
    size = sizes.astype(float).tolist()
    window: list[int] = []
    for i, q in enumerate(out):
        if q < EPS or q > 1 - EPS:
            out[i] = float(q > 0.5)
            continue
        window.append(i)
        while len(window) == 3:
            a, b, c = window
            u, v, w = size[c] - size[b], size[a] - size[c], size[b] - size[a]
            if u == v == w == 0.0:
                u, v = 1.0, -1.0
            up = down = float("inf")
            for k, d in ((a, u), (b, v), (c, w)):
                if d > 0:
                    up, down = min(up, (1 - out[k]) / d), min(down, out[k] / d)
                elif d < 0:
                    up, down = min(up, -out[k] / d), min(down, (1 - out[k]) / -d)
            step = up if rng.random() * (up + down) < down else -down
            for k, d in ((a, u), (b, v), (c, w)):
                out[k] = settled(out[k] + step * d)
            window = [k for k in window if 0.0 < out[k] < 1.0]
    return np.array(out)


def landing(p: np.ndarray, sizes: np.ndarray, goal: float) -> np.ndarray:
    """Settles what a flight left: first without the document total, then the last one to the nearer side, then by one exchange."""
    out = p.tolist()
    left = [i for i, q in enumerate(out) if 0.0 < q < 1.0]
    while len(left) > 1:
        a, b = left[:2]
        u, v = (float(sizes[b]), -float(sizes[a])) if sizes[a] or sizes[b] else (1.0, -1.0)
        room = min([(1 - out[k]) / d if d > 0 else out[k] / -d for k, d in ((a, u), (b, v)) if d])
        for k, d in ((a, u), (b, v)):
            out[k] = settled(out[k] + room * d)
        left = [i for i in left if 0.0 < out[i] < 1.0]
    for i in left:
        out[i] = float(out[i] >= 0.5)
    return exchanged(np.array(out), sizes, goal)


def exchanged(out: np.ndarray, sizes: np.ndarray, goal: float, times: int = 10) -> np.ndarray:
    """The corner with one taken and one untaken document exchanged, while that brings the token total nearer to the goal."""
    for _ in range(times):
        missing = goal - float(out @ sizes)
        taken, free = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
        if not len(taken) or not len(free):
            break
        free = free[np.argsort(sizes[free], kind="stable")]
        wanted = sizes[taken] + missing
        at = np.searchsorted(sizes[free], wanted)
        near = [(np.abs(wanted - sizes[free[side]]), side) for side in (np.maximum(at - 1, 0), np.minimum(at, len(free) - 1))]
        gap, k, j = min((float(gaps[k := int(np.argmin(gaps))]), k, int(side[k])) for gaps, side in near)
        if gap >= abs(missing):
            break
        out[taken[k]], out[free[j]] = 0.0, 1.0
    return out


def balanced(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, chosen) for units (row, stratum, size, p): a sample balanced in each stratum on sum(p) and sum(p * size).

    row must be unique. A unit's block follows from its row, so reruns agree.
    """
    spread = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 40))
    counts = units.groupBy("stratum").agg(F.count("*").alias("n_"))
    now = units.join(counts.withColumnRenamed("stratum", "s_"), F.col("stratum") == F.col("s_")).select("row", "stratum", F.col("size").cast("double").alias("size"), "p", (spread % F.ceil(F.col("n_") / block)).cast("long").alias("block"))
    now, parts = Table(now, "flight").df, []
    blocks = (now.agg(F.max("block")).first()[0] or 0) + 1

    def settle(last: bool):
        def run(t):
            t = t.sort_by([("size", "descending"), ("row", "ascending")])  # what stays open is small
            p, size = t["p"].to_numpy(), t["size"].to_numpy()
            goal = float(p @ size)
            p = flight(p, size, zlib.crc32(t["row"][0].as_py().encode()))
            p = landing(p, size, goal) if last else p
            return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p))

        return run

    while True:
        last = blocks == 1
        moved = Table(now.groupBy("stratum", "block").applyInArrow(settle(last), now.schema), "flight").df
        parts.append(moved.where("p = 0 or p = 1").select("row", (F.col("p") == 1).alias("chosen")))
        if last:
            return functools.reduce(DataFrame.union, parts)
        now = moved.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / (block // 2)).cast("long"))
        blocks = -(-blocks // (block // 2))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, row_col: str | None = None) -> DataFrame:
    """(row, id, source, size, source_size, target, copies): how often the mix takes each row of docs. An empty table gives no rows.

    size is the row's number of words (null and empty texts: 0, copies then is 0). A row gets
    the floor or the ceiling of target / source_size copies, so never more than ``most``
    rounded up. Null is a source of its own, the last one. Repeated rows are documents of their
    own, each with its own copies. Extra columns are ignored. row_col names a column of unique
    longs that tell the rows apart; without it row only tells the rows of this result apart.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    base = docs.select(number.alias("n"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    base = materialize(base, "sizes")
    sized = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sized, weights, share, most).select(F.col("source").alias("source_"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate") + F.lit(EPS))
    rows = base.join(goal, F.col("source").eqNullSafe(F.col("source_"))).withColumn("rate", rate)
    # The row's number decides its block only among rows of equal id, so that reruns over other file splits agree where ids are unique.
    row = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.when(F.col("twin"), F.col("n").cast("string")))
    rows = rows.select("n", "id", "source", "size", "source_size", "target", whole.cast("long").alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"))
    rows = materialize(rows, "rates")
    twins = rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("id_"))
    rows = rows.join(twins, F.col("id").eqNullSafe(F.col("id_")), "left").withColumn("twin", F.col("id_").isNotNull() | F.col("id").isNull()).withColumn("row", row).drop("id_", "twin")
    rows = materialize(rows, "units")
    open_ = rows.where((F.col("size") > 0) & (F.col("p") > EPS))
    chosen = balanced(open_.select("row", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("stratum"), "size", "p"))
    chosen = chosen.select(F.col("row").alias("row_"), "chosen")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("chosen"), F.lit(False)).cast("long")).otherwise(0)
    return rows.join(chosen, F.col("row") == F.col("row_"), "left").select(F.col("n").alias("row"), "id", "source", "size", "source_size", "target", copies.alias("copies"))
