"""The index of blocks: searches with and without pruning, and from where it was saved."""

import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.operators import bm25
from tessera.plans.knowledge import KnowledgeBase
from tessera.sources import git


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 80))) for _ in range(700)]
    texts += texts[:40] + [None, "", "rare only here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, content string")
    asked = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(15)] + ["rare words w1", "nothing known", ""]
    return rows, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")


def found(df):
    return sorted((r["query_id"], r["rank"], r["row_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("window", "k"), [(1, 10), (8, 1)])
def test_pruning_changes_no_row(spark, corpus, window, k):
    rows, asked = corpus
    index = bm25.build(rows, window=window)
    plain = found(index.search(asked, k, prune=False))
    assert plain and found(index.search(asked, k, prune=True)) == plain
    allowed = rows.where("row_id % 3 = 0")
    assert found(index.search(asked, k, allowed, prune=True)) == found(index.search(asked, k, allowed, prune=False))


def test_other_parameters_than_those_of_the_maxima_score_every_posting(spark, corpus):
    rows, asked = corpus
    other = found(bm25.build(rows).search(asked, 5, k1=0.7, b=0.2, prune=True))
    assert other == found(bm25.build(rows, k1=0.7, b=0.2).search(asked, 5, prune=True)) != found(bm25.build(rows).search(asked, 5))


def test_a_pruned_search_scores_fewer_postings(spark, corpus):
    rows, asked = corpus
    cost = bm25.build(rows, window=8).pruning(asked, 1).agg({"postings": "sum", "postings_read": "sum"}).first()
    assert 0 < cost["sum(postings_read)"] < 0.6 * cost["sum(postings)"]


def test_rows_that_one_batch_searches_are_scored_where_they_lie(spark, corpus, monkeypatch):
    rows, asked = corpus
    monkeypatch.setattr(bm25, "SHARE", 50)
    own, index = bm25.lists(rows), bm25.build(rows)
    plan = own.search(asked, 5)._jdf.queryExecution().executedPlan().toString()
    # The lists once, in shares of so many rows, and the best rows of each query.
    assert plan.count("Exchange hashpartitioning") == 2 and f"hashpartitioning(row_id, {-(-rows.count() // 50)})" in re.sub(r"#\d+L?", "", plan)
    assert found(own.search(asked, 5)) == found(index.search(asked, 5)) == found(bm25.search(rows, asked, 5))
    allowed = rows.where("row_id % 3 = 0")
    assert found(own.search(asked, 5, allowed)) == found(index.search(asked, 5, allowed)) == found(bm25.search(rows, asked, 5, allowed=F.col("row_id") % 3 == 0))
    assert own.search(asked, 5).columns == ["query_id", "row_id", "score", "rank"] and not found(bm25.search(rows.limit(0), asked, 3))


def test_an_empty_index_finds_nothing(spark, corpus):
    rows, asked = corpus
    index = bm25.build(rows.limit(0))
    assert index.stats.first().asDict() == {"n": 0, "avgdl": 1.0, "k1": C.BM25_K1, "b": C.BM25_B}
    assert not found(index.search(asked, 3)) and not found(index.search(asked, 3, prune=True))


def test_a_loaded_index_is_searched_without_an_exchange_of_its_blocks(spark, corpus, tmp_path):
    rows, asked = corpus
    KnowledgeBase(rows, bm25.build(rows)).save(str(tmp_path / "kb"))
    index = KnowledgeBase.load(spark, str(tmp_path / "kb")).index
    assert found(index.search(asked, 10, prune=True)) == found(bm25.build(rows).search(asked, 10))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        terms = index._asked(asked).select("query_id", "term", "w")
        windows = index._bounds(index._asked(asked)).select("query_id", "window")
        parts = index._parts(terms.join(windows, "query_id"), C.BM25_K1, C.BM25_B, ["term", "window"])
        assert parts.count()
        plan = parts._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.set(key, before)
    # Up from the blocks' scan to the join there is a sort at most.
    lines = [re.sub(r"^[\s:+*|-]*(\(\d+\) )?", "", x) for x in plan.splitlines()]
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in plan.splitlines()]
    at = next(i for i, x in enumerate(lines) if x.startswith("FileScan") and "Bucketed: true" in x)
    above = []
    while at and "SortMergeJoin" not in lines[at]:
        at = max(i for i in range(at) if depth[i] < depth[at])
        above.append(lines[at].split()[0].split("[")[0])
    assert "SortMergeJoin" in lines[at] and not {"Exchange", "AQEShuffleRead", "ShuffleQueryStage"} & set(above)


# --- commits ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def history(tmp_path_factory):
    root = tmp_path_factory.mktemp("history")
    run = ["git", "-C", str(root), "-c", "user.name=A Writer", "-c", "user.email=a@example.org"]
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    for i in range(23):
        (root / f"f{i % 4}.txt").write_text(f"line {i}\n")
        subprocess.run([*run, "add", "."], check=True)
        subprocess.run([*run, "commit", "-q", "-m", f"Change {i}", "-m", f"Body {i}\n\nwith lines"], check=True)
    return root


def test_commits_are_read_by_several_tasks(spark, history):
    git.register(spark)
    one, many = (spark.read.format("commits").option("path", str(history)).option("span", n).load() for n in (1000, 5))
    assert many.rdd.getNumPartitions() == 5 and one.rdd.getNumPartitions() == 1
    rows = sorted(map(str, one.collect()))
    assert len(rows) == 23 and sorted(map(str, many.collect())) == rows
    listed = subprocess.run(["git", "-C", str(history), "log", "--format=%H %s"], capture_output=True, text=True, check=True).stdout.split("\n")[:-1]
    assert sorted(f"{r['commit_sha']} {r['subject']}" for r in many.collect()) == sorted(listed)
    assert {tuple(r["files_changed"]) for r in many.collect()} == {(f"f{i}.txt",) for i in range(4)} and all("diff --git" in r["diff"] for r in many.collect())
    few = spark.read.format("commits").option("path", str(history)).option("maxCommits", 7).option("span", 3).load()
    assert sorted(r["subject"] for r in few.collect()) == sorted(f"Change {i}" for i in range(16, 23))


def test_a_history_that_cannot_be_read_fails(spark, history, tmp_path):
    git.register(spark)
    with pytest.raises(Exception, match="rev-parse"):
        spark.read.format("commits").option("path", str(tmp_path)).load().count()
    subprocess.run(["git", "init", "-q", str(tmp_path / "new")], check=True)
    assert spark.read.format("commits").option("path", str(tmp_path / "new")).load().count() == 0
    subprocess.run(["cp", "-r", str(history), str(tmp_path / "broken")], check=True)
    packed = subprocess.run(["git", "-C", str(tmp_path / "broken"), "rev-parse", "HEAD~9^{tree}"], capture_output=True, text=True, check=True).stdout.strip()
    (tmp_path / "broken" / ".git" / "objects" / packed[:2] / packed[2:]).unlink()
    with pytest.raises(Exception, match="git log"):
        spark.read.format("commits").option("path", str(tmp_path / "broken")).option("span", 4).load().collect()


def test_a_stream_brings_new_commits_once(spark, history, tmp_path):
    git.register(spark)
    run = ["git", "-C", str(tmp_path / "grown"), "-c", "user.name=A Writer", "-c", "user.email=a@example.org"]
    subprocess.run(["git", "clone", "-q", str(history), str(tmp_path / "grown")], check=True)
    for more in (0, 2, 0):
        for i in range(more):
            subprocess.run([*run, "commit", "-q", "--allow-empty", "-m", f"Later {i}"], check=True)
        stream = spark.readStream.format("commits").option("path", str(tmp_path / "grown")).option("span", 10).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    subjects = [r["subject"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(subjects) == sorted([f"Change {i}" for i in range(23)] + ["Later 0", "Later 1"])


def test_a_large_table_isnt_broadcast_however_few_bytes_its_file_has(spark):
    from tessera.plans import storage

    few = storage.materialize(spark.range(10).select("id", (F.col("id") % 3).alias("x")), "few")
    many = storage.materialize(spark.range(storage.BROADCAST_ROWS + 1).select((F.col("id") % 10).alias("id")), "many")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(spark.range(10).join(storage.small(few), "id"))
    joined = few.join(storage.small(many), "id", "left_semi")
    assert "Broadcast" not in plan(joined) and joined.count() == 10


def test_a_batch_is_scored_where_its_windows_lie(spark, corpus):
    rows, asked = corpus
    found = bm25.build(rows, window=8).search(asked, 3)._jdf.queryExecution().executedPlan().toString()
    # The blocks once, and the best rows of each query: nothing between the postings and their sums.
    assert found.count("Exchange hashpartitioning") == 2 and "hashpartitioning(row_id" not in found
