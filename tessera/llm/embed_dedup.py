"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is
the signed axis it is nearest to. Several hashes make a bucket, several tables make up for
missed buckets, and every vector also goes to the buckets that its second-nearest axes name.
Candidates of a bucket are verified by their cosine. Equal vectors are one class before any of
this, and a bucket too large for one task is cut into blocks that meet two by two. The blocks of a
bucket of M members are so many as the square root of M asks for, so that a member is sent to
that many tasks, and not to as many as would grow with M.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .simhash import forest
from .topk import matrix, usable

SEED = 7
#: Members of a bucket that is one block; one of as many blocks squared has that many times as many in each.
BLOCK = 256
#: Cosines and pairs that a task holds at once.
CELLS = 1 << 20


def signs(tables: int, hashes: int, dim: int) -> np.ndarray:
    """Three diagonals of random signs for each table and hash."""
    return np.random.Generator(np.random.PCG64(SEED)).choice(np.array([-1.0, 1.0]), (tables, hashes, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, dim = x.shape
    half = 1
    while half < dim:
        y = x.reshape(n, dim // (2 * half), 2, half)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, dim)
        half *= 2
    return x


def codes(unit: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """(rows, tables, 1 + hashes) bucket numbers: the vector's own, then one with each hash at its second-nearest axis."""
    n, width = unit.shape
    dim = 1 << max(1, (width - 1).bit_length())
    padded = np.zeros((n, dim))
    padded[:, :width] = unit
    out = np.zeros((n, tables, 1 + hashes), np.int64)
    for t, table in enumerate(signs(tables, hashes, dim)):
        first, second = np.zeros((hashes, n), np.int64), np.zeros((hashes, n), np.int64)
        for j, diagonals in enumerate(table):
            y = padded
            for d in diagonals:
                y = hadamard(y * d) / np.sqrt(dim)
            size = np.abs(y)
            rows = np.arange(n)
            for into in (first, second):
                axis = size.argmax(axis=1)
                into[j] = 2 * axis + (y[rows, axis] < 0)
                size[rows, axis] = -1.0
        for probe in range(1 + hashes):
            for j in range(hashes):
                out[:, t, probe] = out[:, t, probe] * 2 * dim + (second if probe == j + 1 else first)[j]
    return out


def units(lists, width: int) -> np.ndarray:
    """Rows of unit length, scaled first so that no square overflows."""
    x = matrix(lists, width)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98, tables: int = 6, hashes: int = 3, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept): each row with its number of links and its component. An empty table gives no rows.

    Two rows link when their labels are equal and not null, their cosine is at least the
    threshold and a bucket of some table holds both; equal vectors always link. Null, empty
    and zero vectors and those with null or non-finite components link with nothing, nor do
    vectors of different length. component_id is the smallest id reachable, kept whether
    that is the row's own; null ids have no say in it. Repeated rows are rows of their own,
    linked with each other. Extra columns are ignored. label_col None compares all rows.
    """
    label = F.col(label_col) if label_col else F.lit(0)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("v"), F.monotonically_increasing_id().alias("n"))
    base = materialize(base, "vectors")
    good = F.col("label").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    valid = base.where(good)
    classes = materialize(valid.groupBy("label", "v").agg(F.min("n").alias("c"), F.min("id").alias("least"), F.count("*").alias("m")), "classes")

    signed = classes.select("c", "label", "v", "m", F.size("v").alias("width"))

    def sign(batches):
        for batch in batches:
            widths = batch.column(4).to_numpy()
            for width in np.unique(widths).tolist():
                some = batch.filter(pa.array(widths == width))
                found = codes(units(pa.chunked_array([some.column(2)]), width), tables, hashes)
                flat = pa.array(found.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, dtype=np.int32) * (tables * (1 + hashes))), flat)
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=["c", "label", "v", "m", "width", "codes"])

    coded = materialize(signed.mapInArrow(sign, "c long, label " + dict(signed.dtypes)["label"] + ", v " + dict(signed.dtypes)["v"] + ", m long, width int, codes array<long>"), "codes")
    probes = 1 + hashes
    spot = F.posexplode("codes")
    spots = coded.select("c", "label", "width", spot.alias("pos", "code")).select("c", "label", "width", F.floor(F.col("pos") / probes).cast("int").alias("t"), "code").distinct()
    spots = materialize(spots, "spots")
    key = ["label", "width", "t", "code"]
    counts = spots.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1")
    held = spots.join(counts, key).select(*key, "c", F.ceil(F.sqrt(F.col("members") / block)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("c"), F.col("blocks").cast("long")).cast("int")
    held = held.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    held = held.select(*key, "c", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    held = held.join(coded.select("c", "v", "m", "codes"), "c")

    def verify(t):
        bi, bj, at, code = (t[x][0].as_py() for x in ("bi", "bj", "t", "code"))
        c, m, own_ = t["c"].to_numpy(), t["m"].to_numpy(), t["own"].to_numpy()
        n = len(c)
        x = units(t["v"], t["width"][0].as_py())
        where = t["codes"].combine_chunks().flatten().to_numpy().reshape(n, tables, probes)
        left, right = (np.arange(n), np.arange(n)) if bi == bj else (np.flatnonzero(own_ == bi), np.flatnonzero(own_ == bj))
        linked, links = np.arange(n), np.zeros(n)
        for some in np.array_split(left, max(1, len(left) * len(right) // CELLS)):
            a, b = np.nonzero(x[some] @ x[right].T >= threshold)
            a, b = some[a], right[b]
            if bi == bj:
                a, b = a[a < b], b[a < b]
            linked = forest(n, np.concatenate((linked, a)), np.concatenate((np.arange(n), b)))
            # A pair counts where its smallest common bucket is, so that it counts once.
            first = np.ones(len(a), bool)
            for s in range(at + 1):
                same = where[a, s][:, :, None] == where[b, s][:, None, :]
                if s == at:
                    same &= where[a, s][:, :, None] < code
                first &= ~same.any(axis=(1, 2))
            links += np.bincount(a[first], m[b[first]], n) + np.bincount(b[first], m[a[first]], n)
        out = np.flatnonzero((links > 0) | (linked != np.arange(n)))
        return pa.table({"c": pa.array(c[out]), "links": pa.array(links[out].astype(np.int64)), "peer": pa.array(c[linked[out]])})

    found = materialize(held.groupBy(*key, "bi", "bj").applyInArrow(verify, "c long, links long, peer long"), "links")
    counted = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("c", "peer"), "c", "peer").select(F.col("node").alias("c"), "root")
    led = classes.join(counted, "c", "left").join(roots, "c", "left").select("label", "v", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "c").alias("root"))
    led = materialize(led, "led")
    named = led.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = led.join(named, "root").select(F.col("label").alias("label_"), F.col("v").alias("v_"), "n_links", "component_id")
    linked = valid.join(classed, (F.col("label") == F.col("label_")) & (F.col("v") == F.col("v_"))).select("id", "n_links", "component_id")
    alone = base.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
