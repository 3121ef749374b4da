import json
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import agent, benchmark, bm25, context, evaluate, fusion, symbols, vectors
from tessera.sources import files
from tessera.streaming.ingest import stream_chunks


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, row_id long, score double, rank int")


def test_bm25_grows_with_frequency_and_skips_others(spark):
    rows = spark.createDataFrame([(1, "cat cat cat dog"), (2, "cat dog bird fish"), (3, "dog bird fish cow")], "row_id long, content string")
    q = spark.createDataFrame([(0, "cat")], "query_id long, query string")
    found = [(r["row_id"], r["rank"]) for r in bm25.search(rows, q, 10).orderBy("rank").collect()]
    assert found == [(1, 1), (2, 2)]
    masked = bm25.search(rows, q, 10, allowed=F.col("row_id") == 2).collect()
    whole = {r["row_id"]: r["score"] for r in bm25.search(rows, q, 10).collect()}
    assert [(r["row_id"], r["score"]) for r in masked] == [(2, whole[2])]


def test_fusion_rewards_agreement_and_weights(spark):
    two = {"a": hits(spark, [(0, 1, 9.0, 1), (0, 2, 8.0, 2)]), "b": hits(spark, [(0, 2, 0.5, 1), (0, 3, 0.4, 2)])}
    first = fusion.fuse(two, "rrf", 10, 60).orderBy("rank").first()
    assert first["row_id"] == 2 and {"a", "b", "a_rank", "b_rank", "rrf"} <= set(first["component_scores"]) and first["kept"] == "a"
    one = {"a": hits(spark, [(0, 1, 1.0, 1)]), "b": hits(spark, [(0, 2, 1.0, 1)])}
    order = lambda w: [r["row_id"] for r in fusion.fuse(one, "rrf", 10, 60, w).orderBy("rank").collect()]
    assert order({"a": 2.0, "b": 1.0}) == [1, 2] and order({"a": 1.0, "b": 2.0}) == [2, 1]
    assert [r["score"] for r in fusion.fuse(one, "score_sum").orderBy("row_id").collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        fusion.fuse(one, "none")
    assert fusion.hybrid({"a": two["a"]}).count() == 2


def test_dense_search_and_ties(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "row_id long, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["row_id"], r["score"]) for r in vectors.dense_search(rows, q, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, -1.0)]


def test_hashed_vectors_are_unit_or_zero(spark):
    rows = spark.createDataFrame([(1, "some words here"), (2, "")], "row_id long, content string")
    norms = {r["row_id"]: sum(x * x for x in r["vector"]) for r in vectors.hashing_vectors(rows).collect()}
    assert abs(norms[1] - 1) < 1e-9 and norms[2] == 0


def test_fuzzy_finds_a_misspelt_name(spark):
    chunks = spark.createDataFrame([(1, "allocate_slots", "mod.allocate_slots", "function")], "row_id long, symbol string, qualified_name string, symbol_type string")
    names = spark.createDataFrame([(0, "alocate_slots"), (1, "allocate_slots"), (2, "zzz")], "query_id long, name string")
    found = {r["query_id"]: r["score"] for r in symbols.search(symbols.postings(chunks), names).collect()}
    assert found[1] == 1.0 and 0.72 <= found[0] < 1.0 and 2 not in found
    assert symbols.definition_of(chunks, spark.createDataFrame([("Allocate_Slots",)], "name string")).first()["row_id"] == 1


EVIDENCE = "query_id long, row_id long, rank int, path string, start_line int, end_line int, artifact_type string, content string"


def packed(spark, rows, **named):
    return {r["row_id"]: r["decision"] for r in context.pack(spark.createDataFrame(rows, EVIDENCE), **named).collect()}


def test_packing_drops_overlaps_caps_and_the_budget(spark):
    row = lambda i, path, s, e, n=40: (0, i, i, path, s, e, "doc", "x" * n)
    assert packed(spark, [row(1, "a", 1, 10), row(2, "a", 5, 20), row(3, "a", 21, 30)], quotas={}) == {1: "kept", 2: "overlap", 3: "kept"}
    assert list(packed(spark, [row(i, "a", 10 * i, 10 * i + 1) for i in range(1, 6)], per_file=2, quotas={}).values()).count("file cap") == 3
    said = packed(spark, [row(i, f"f{i}", 1, 2, 800) for i in range(1, 21)] + [row(21, "g", 1, 2, 8)], budget=500, quotas={})
    assert list(said.values()).count("kept") == 3 and said[21] == "kept" and said[3] == "budget"
    assert "quota" in packed(spark, [row(i, f"f{i}", 1, 2, 400) for i in range(1, 9)], budget=800, quotas={"doc": 0.5}).values()


def test_scratch_tables_go_when_they_are_done_with(spark):
    from tessera.plans import storage

    rows = spark.createDataFrame([(1, "cat cat dog"), (2, "dog")], "row_id long, content string")
    before = storage.held()
    with storage.scratch():
        found = bm25.search(rows, spark.createDataFrame([(0, "cat")], "query_id long, query string"), 10).collect()
        made = storage.held() - before
    assert len(found) == 1 and made and storage.held() == before
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_spans_that_overlap_across_bands(spark):
    rows = [("f", 1, 1, 300), ("f", 2, 60, 70), ("f", 3, 200, 201), ("f", 4, 301, 400), ("g", 5, 1, 300), ("f", 6, 70, 200)]
    found = {(r["a"], r["b"]) for r in context.overlapping(spark.createDataFrame(rows, "path string, id long, start_line int, end_line int")).collect()}
    assert found == {(1, 2), (1, 3), (1, 6), (2, 6), (3, 6)}


def test_citations_inside_a_block_are_valid(spark):
    cited = context.citations(spark.createDataFrame([(0, "[a.py:3-9] [b.py:1-2] [a.py:1-400]")], "query_id long, text string"))
    blocks = spark.createDataFrame([(0, 7, 1, "a.py", 1, 10)], "query_id long, row_id long, rank int, path string, start_line int, end_line int")
    assert [(r["path"], r["valid"]) for r in context.validate_citations(cited, blocks).orderBy("pos").collect()] == [("a.py", True), ("b.py", False), ("a.py", False)]


def test_metrics_of_known_rankings(spark):
    gold = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"]), (2, [])], "query_id long, units array<string>")
    found = spark.createDataFrame([(0, 1, "x", 0), (0, 2, "a", 1), (0, 3, "b", 1), (1, 1, "a", 2)], "query_id long, rank int, unit string, grade int")
    m = {r["query_id"]: r for r in evaluate.question_metrics(found, gold).collect()}
    assert (m[0]["recall_1"], m[0]["recall_5"], m[0]["mrr"]) == (0.0, 1.0, 0.5) and 0 < m[0]["ndcg_5"] <= 1
    assert m[1]["ndcg_5"] == 1.0 and m[2]["recall_5"] == 0.0 and m[2]["first_hit_rank"] is None


def test_citation_metrics_and_agreement(spark):
    cited = spark.createDataFrame([(0, "a", True), (0, "z", False)], "query_id long, path string, valid boolean")
    gold = spark.createDataFrame([(0, ["a", "b"])], "query_id long, files array<string>")
    r = evaluate.citation_metrics(cited, gold).first()
    assert (r["n"], r["validity"], r["precision"], r["completeness"]) == (2, 0.5, 1.0, 0.5)
    sheet = spark.createDataFrame([(1.0, None), (0.5, None)], "judge double, human double")
    assert evaluate.agreement(sheet).first()["labelled"] == 0
    r = evaluate.agreement(spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (1.0, None)], "judge double, human double")).first()
    assert (r["labelled"], r["exact"], r["mae"]) == (2, 0.5, 0.5)


def test_split_and_latency(spark):
    ids = spark.range(400).select(evaluate.split(F.col("id")).alias("s"))
    assert 0.2 < ids.where("s = 'dev'").count() / 400 < 0.4
    r = evaluate.latency(spark.range(1, 11).select(F.col("id").cast("double").alias("value"))).first()
    assert (r["n"], r["p50"], r["p95"], r["max"]) == (10, 6.0, 10.0, 10.0)


def test_the_agent_stops_and_does_not_repeat(spark):
    q = spark.createDataFrame([(0, "where is it")], "query_id long, query string")
    calls = []

    def search(asked):
        calls.append(1)
        return asked.select("query_id", F.lit(len(calls)).cast("long").alias("row_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    def broken(asked):
        raise RuntimeError("no index")

    ask_same = lambda open_: open_.select("query_id", F.lit("search").alias("tool"), F.lit("again").alias("query")).distinct()
    found, notes = agent.run(q, {"search": search, "symbol_search": broken}, ask_same, lambda df: spark.createDataFrame(df.collect(), df.schema), iterations=4)
    assert found.count() == 2 and any("no index" in n["note"] for n in notes) and any(n["note"] == "unknown tool" for n in notes)


def test_reports_and_traces(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"spec": {"k": 1}, "retrieval": {"r": 0.5}}))
    (tmp_path / "b.json").write_text(json.dumps({"other": 1}))
    assert files.read_reports(spark, str(tmp_path)).count() == 1
    assert files.read_traces(spark, str(tmp_path)).count() == 2
    table = benchmark.ablation([{"system": "bm25", "retrieval": {"r": 0.5}}, {"system": "gen-bm25", "retrieval": {}, "generation": {"g": 1.0}}, {"system": "dense", "retrieval": {"r": 0.25}}])
    assert table.split("\n")[2:] == ["| dense | - | 0.250 |", "| bm25 | 1.000 | 0.500 |"]


def test_files_that_arrive_become_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"path": "a.py", "content": "def f():\n" + "    x = 1\n" * 20}) + "\n")
    stream_chunks(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stream_chunks(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["symbol"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "f"} - ({"a"} if spark.read.parquet(str(tmp_path / "out")).where("symbol = 'a'").isEmpty() else set())


def test_hashed_vectors_are_those_of_the_grams_and_shuffle_nothing(spark):
    texts = ["Ab abc  abcd\tabcde abc", "", None, " \n ", "É\u00a0Straße 𝒳𝒴𝒵𝒳 x", "a" * 3000]
    own = vectors.hashing_vectors(spark.createDataFrame(list(enumerate(texts)), "row_id long, content string"), dimension=32, counts=True)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    got = {r["row_id"]: r for r in own.collect()}
    for i, text in enumerate(texts):
        want = [0] * 32
        for w in re.findall(r"[^ \t\n\x0b\f\r]+", (text or "").lower()):
            for n in (3, 4):
                for j in range(max(len(w) - n + 1, 1)):
                    want[zlib.crc32(w[j : j + n].encode()) % 32] += 1
        size = sum(x * x for x in want) ** 0.5 or 1.0
        assert list(got[i]["counts"]) == want and list(got[i]["vector"]) == pytest.approx([x / size for x in want])
    assert vectors.hashing_vectors(spark.createDataFrame([(1, "x")], "row_id long, content string")).columns == ["row_id", "vector"]
