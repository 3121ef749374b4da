"""Exact dedup, centroid clustering and importance resampling against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_ops import clashing, docs

from tessera.llm import centroids, common, exact_dedup, queries, resample


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- exact duplicates -------------------------------------------------------------------------


def slow_groups(rows):
    """{(id, lower text): (keep_id, group_size)}"""
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def texts_for_dedup():
    rng = random.Random(13)
    long = "Long text. " * 20_000
    some = [None, "", "A", "a", "É", "é", "ÀB", "Àb", long, long.upper(), long + "x", long + "y", "x" * 256 + "1", "x" * 256 + "2", "X" * 256 + "1"]
    rows = [(i, t, None, None) for i, t in enumerate(some + some[:9])] + [(5, "twice", None, None)] * 3 + [(None, "a", None, None), (None, "no id", None, None), (None, "no id", None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [64, 1 << 26])
@pytest.mark.parametrize("prefix", [1, 256])
@pytest.mark.parametrize("rows_broadcast", [0, 1 << 20])
def test_equal_texts_are_grouped_and_the_largest_id_stays(spark, monkeypatch, bits, prefix, rows_broadcast):
    monkeypatch.setattr(common, "SKETCH_BITS", bits)
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_broadcast)
    rows = texts_for_dedup()
    found = exact_dedup.exact_duplicates(clashing(docs(spark, rows)).withColumn("digest", F.lit(1)), prefix=prefix, digests=True).collect()
    by_digest = {hashlib.sha256(lower(t).encode()).hexdigest(): v for t, v in ((t, v) for t, v in slow_groups(rows).items())}
    assert len(found) == len(rows)
    assert all((r["keep_id"], r["group_size"]) == by_digest[r["digest"]] for r in found)
    assert sorted(hashlib.sha256(lower(t).encode()).hexdigest() for _, t, *_ in rows) == sorted(r["digest"] for r in found)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(by_digest) and {r["digest"] for r in kept} == set(by_digest) and all(r["id"] == r["keep_id"] for r in kept)


def test_only_texts_that_look_alike_are_read_to_the_end(spark):
    rows = [(1, "of a length of its own", None, None), (2, "beginning one", None, None), (3, "different one", None, None), (4, "the same", None, None), (5, "THE SAME", None, None)]
    found = {r["id"]: r for r in exact_dedup.exact_duplicates(docs(spark, rows)).collect()}
    assert [i for i, r in sorted(found.items()) if r["digest"]] == [4, 5] and [i for i, r in sorted(found.items()) if r["kept"]] == [1, 2, 3, 5]
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


# --- clusters ---------------------------------------------------------------------------------


def slow_clusters(rows, k, width, scale, rounds, seed):
    """rows [(id, vector)] -> [(id, cluster, distance)], centroids; plain integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centers


@pytest.mark.parametrize("seed", range(4))
def test_clusters_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    width, k = 3, 7
    rows = [(i, [float(rng.randint(-4, 4)) / 2 for _ in range(width)]) for i in range(150)]  # many ties
    rows += rows[:20] + [(200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [1.0, float("inf"), 2.0]), (205, [1.0] * 4), (None, [1.0, 1.0, 1.0])]
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumn("cluster", F.lit("x")).repartition(5)
    found = centroids.cluster(table, k=k, dimensions=width, scale=2, seed=seed).collect()
    want, centers = slow_clusters(rows, k, width, 2, 3, seed)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in found), key=key) == sorted(want, key=key)
    total = sum(d for *_, d in want)
    assert all(r["inertia"] == total and r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest() for r in found)


def test_few_vectors_equal_vectors_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.cluster(spark.createDataFrame([], schema), dimensions=2).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None)], schema), dimensions=2).count() == 0
    found = centroids.cluster(spark.createDataFrame([(i, [1.0, 1e300]) for i in range(30)], schema), dimensions=2).collect()
    assert len(found) == 30 and {(r["cluster"], r["distance"], r["inertia"]) for r in found} == {(0, 0, 0)}


def test_the_scan_stops_before_far_centroids_and_is_exact():
    rng = np.random.default_rng(11)
    centers = rng.integers(-1000, 1000, (16, 8))
    x = centers[rng.integers(0, 16, 4000)] + rng.integers(-30, 30, (4000, 8))
    every = ((x[:, None] - centers[None]) ** 2).sum(-1)
    start = every.argmin(1)
    start[::7] = rng.integers(0, 16, len(start[::7]))
    cluster, distance, spent = centroids.sort_means(x, start, centers)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all() and spent < every.size / 3


# --- resampling -------------------------------------------------------------------------------


def slow_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text) if text else "")
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), runs


def slow_resample(rows, target, n=10_000, percent=5, least=20, seed=42):
    """[(id, n_features, weight, score, rank)]"""
    bucket = lambda run: zlib.crc32(run.encode()) % n
    s, t, own = [0] * n, [0] * n, []
    for _, text in rows:
        words, runs = slow_features(text)
        own.append((words, [bucket(r) for r in runs]))
        for b in own[-1][1]:
            s[b] += 1
    for text in target:
        for r in slow_features(text)[1]:
            t[bucket(r)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + n) / ((s[b] + 1) * (sum(t) + n)))) for b in range(n)]
    out = []
    for (i, _), (words, bs) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    asked = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(asked[: percent * len(asked) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def sortable(rows):
    return sorted(tuple((x is None, x) for x in r) for r in rows)


def test_op12_ranks_as_brute_force_does(spark):
    df = queries.queries()["op12_importance_resampling"](spark, SF)
    assert set(df.dtypes) >= {(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sortable(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()) == sortable(slow_resample(rows, target))


@pytest.mark.parametrize("size", [40, 1 << 21])
@pytest.mark.parametrize("rows_broadcast", [0, 1 << 20])
def test_resampling_of_odd_texts_in_small_slices(spark, monkeypatch, size, rows_broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_broadcast)
    rng = random.Random(12)
    word = lambda: rng.choice(["Aa", "b", "7", "Éß", "日本", "x" * 47, "x" * 48, "y" * 49, "z" * 200, "a-b", " q"])
    texts = [None, "", "- .", "one"] + [rng.choice([" ", "\n", "_"]).join(word() for _ in range(rng.randint(1, 60))) for _ in range(120)] + ["long " * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[9])] * 30 + [(None, texts[11]), (None, texts[11])]
    table = clashing(docs(spark, [(i, t, None, None) for i, t in rows])).withColumn("words", F.lit("x")).repartition(3)
    target = spark.createDataFrame([(1, "b aa b 日本 7"), (2, None)], "item_id long, text string")
    gain = resample.gains(resample.counted(table, "text", 97), resample.counted(target, "text", 97), 97)
    assert len(gain) == 97
    held = [h for h in resample.pieces((t.encode() if t else None for t in texts), size)]
    runs = {}
    for h in held:
        text, bucket, _ = resample.buckets(h, 97)
        for i, b in zip(text, bucket, strict=True):
            runs.setdefault(int(i), []).append(int(b))
    assert {i: sorted(b) for i, b in runs.items()} == {i: sorted(zlib.crc32(r.encode()) % 97 for r in f) for i, t in enumerate(texts) if (f := slow_features(t)[1])}
    found = resample.resample(table, target, percent=30, n=97).select("id", "n_features", "weight", "score", "rank").collect()
    assert sortable(map(tuple, found)) == sortable(slow_resample(rows, ["b aa b 日本 7", None], 97, 30))


def test_resampling_draws_nothing_of_nothing(spark):
    none = docs(spark, [])
    assert resample.resample(none, none).count() == 0
    few = docs(spark, [(1, "too few words", None, None)])
    assert [r["rank"] for r in resample.resample(few, none).collect()] == [None]
