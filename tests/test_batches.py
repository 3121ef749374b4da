"""Sections, close names, ends of names, benchmarks with failures, model calls, traces and files that appear whole."""

import difflib
import json
import random
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
import slow_sections
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.operators import benchmark, chunking, generation, symbols, traces, vectors
from tessera.plans import session, storage
from tessera.sources import files, records

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module

# --- sections ---------------------------------------------------------------------------------


def odd_documents():
    rng = random.Random(5)
    parts = ["# A", "## B ##", "### C", "#no", "  # D", "#\tE", "####### F", "```", "~~~x", "  ```", "text", "", "   ", "Title", "===", "=====", "-----", "--", "~~~~~", "*", "***", "...", "A much longer title", "===================", "=-=", "\tIndented", "É", "ééé"]
    return ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["", "#", "# x", "Top\n===", None, "\n" * 50]


@pytest.mark.parametrize("kind", ["markdown", "rst"])
def test_sections_are_those_of_a_loop_over_lines(spark, kind):
    texts = odd_documents()
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {}
    for r in chunking.sections(rows, "text", getattr(chunking, f"{kind}_sections")).collect():
        found.setdefault(r["id"], []).append((r["first"], r["last"], r["heading_path"], r["section"]))
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        want = [(a, b, path, "\n".join(lines[a - 1 : b])) for a, b, path in getattr(slow_sections, f"{kind}_sections")(lines)]
        assert sorted(found[i]) == want, text


def test_documents_and_settings_are_cut_as_a_loop_cuts_them(spark):
    rng = random.Random(6)
    long = "\n".join(rng.choice(["words " * 20, "", "# Heading", "\t", "more " * 30]) for _ in range(400))
    rows = spark.createDataFrame([("a/x.md", long), ("b.rst", long.replace("# Heading", "Title\n=====")), ("c.yaml", "key: 1\r\n" * 500), ("d.txt", long), ("e.toml", "short"), ("f.md", None)], "path string, content string")
    found = {(r["path"], r["start_line"]): (r["end_line"], r["content"], r["heading_path"], r["artifact_type"]) for r in chunking.parse_files(rows).collect()}
    assert {p for p, _ in found} == {"a/x.md", "b.rst", "c.yaml"}
    for path, text in (("a/x.md", long), ("b.rst", long.replace("# Heading", "Title\n====="))):
        lines, want = text.split("\n"), {}
        for a, b, heads in (slow_sections.rst_sections if path.endswith("rst") else slow_sections.markdown_sections)(lines):
            for at, some in slow_sections.cut_section(a, lines[a - 1 : b], chunking.DOC_MOST):
                if len("\n".join(some).strip()) >= chunking.DOC_LEAST:
                    want[path, at] = (at + len(some) - 1, "\n".join(some), heads, "doc")
        assert {k: v for k, v in found.items() if k[0] == path} == want and want
    assert sorted(k[1] for k in found if k[0] == "c.yaml") == [1, 221, 441] and found["c.yaml", 1][1].startswith("key: 1\nkey") and found["c.yaml", 1][3] == "config"


# --- names ------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [7, 4096])
def test_close_names_are_those_of_a_scan(spark, block):
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abC_") for _ in range(rng.randint(1, 9)))
    keys, names = sorted({word().lower() for _ in range(120)}), [word() for _ in range(50)] + ["", "é_abc"]
    known = spark.createDataFrame([(k,) for k in [*keys, *keys[:5], ""]], "key string")
    found = symbols.close_names(spark.createDataFrame(list(enumerate(names)), "query_id long, name string"), known, 1000, block=block)
    want = set()
    for i, name in enumerate(names):
        for key in keys if name else []:
            ratio = difflib.SequenceMatcher(None, key, name.lower()).ratio()
            if ratio >= 0.72:
                want.add((i, key, round(ratio, 6)))
    assert {(r["query_id"], r["match"], r["ratio"]) for r in found.collect()} == want and want


def test_sketches_leave_few_of_many_pairs():
    rng = random.Random(8)
    parts = ["load", "save", "index", "query", "token", "chunk", "graph", "node", "edge", "score", "rank", "merge", "split", "parse", "write", "read"]
    name = lambda: "_".join(rng.sample(parts, rng.randint(2, 4))) + str(rng.randint(0, 99))
    keys = [name() for _ in range(100_000)]
    asked = [rng.choice(keys)[:-1] + "x" for _ in range(40)]
    row, col, left = symbols.likely_pairs(asked, keys, 0.72)
    assert len(row) <= left < 0.25 * len(asked) * len(keys) and len(row) < 0.1 * len(asked) * len(keys)
    likely = set(zip(row.tolist(), col.tolist(), strict=True))
    for i in range(3):
        m = difflib.SequenceMatcher(None)
        m.set_seq2(asked[i])
        for j in range(0, 100_000, 40):
            m.set_seq1(keys[j])
            assert (i, j) in likely or m.ratio() < 0.72


def test_names_by_their_ends(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("aB.") for _ in range(n))
    rows = [(i, word(rng.randint(1, 12))) for i in range(400)] + [(400, None), (401, "")]
    names = sorted({word(rng.randint(1, 5)) for _ in range(80)} | {rows[7][1], "zz", ""})
    found = symbols.definition_of(spark.createDataFrame(rows, "row_id long, qualified_name string"), spark.createDataFrame([(n,) for n in names], "name string"))
    want = {}
    for n in names:
        exact = [i for i, q in rows if q == n and n]
        ends = [i for i, q in rows if q and n and q.lower().endswith(n.lower())]
        if exact or ends:
            want[n] = min(exact or ends)
    assert {r["name"]: r["row_id"] for r in found.collect()} == want


def test_the_first_neighbours_of_a_file(spark):
    rows = spark.createDataFrame([(i, f"c{i:03d}", "big" if i % 4 else "small") for i in range(60)], "row_id long, chunk_id string, path string")
    found = symbols.neighbours(rows, rows.select(F.col("chunk_id").alias("id")), k=3).groupBy("id").agg(F.sort_array(F.collect_list("other")).alias("o"))
    got = {r["id"]: r["o"] for r in found.collect()}
    assert got["c001"] == ["c002", "c003", "c005"] and got["c059"] == ["c001", "c002", "c003"] and got["c000"] == ["c004", "c008", "c012"] and len(got) == 60


# --- benchmarks -------------------------------------------------------------------------------


class Picky:
    """An embedder that fails at some texts."""

    query_prefix = document_prefix = ""

    def encode(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("a bad text")
        return [[len(t), 1.0] for t in texts]


def test_a_text_that_an_embedder_fails_at_leaves_the_others(spark):
    rows = spark.createDataFrame([(i, "bad one" if i == 3 else "x" * i) for i in range(10)], "row_id long, content string")
    found = {r["row_id"]: r for r in vectors.text_vectors(rows, "content", Picky(), errors=True).collect()}
    assert found[3]["vector"] is None and found[3]["error"] == "ValueError: a bad text" and all(r["error"] is None and len(r["vector"]) == 2 for i, r in found.items() if i != 3)
    with pytest.raises(Exception, match="a bad text"):
        vectors.text_vectors(rows, "content", Picky()).collect()


def questions(spark, n):
    return spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("q"), "id").alias("query"))


def test_one_failing_question_of_many_costs_no_job_each(spark):
    rows = questions(spark, 200)
    gold = rows.select("query_id", F.array(F.lit("u")).alias("units"))
    asked = []

    def tells(some):
        asked.append(1)
        hit = some.select("query_id", F.lit(1).alias("rank"), F.lit("u").alias("unit"), F.lit(2).alias("grade"), F.when(F.col("query_id") == 77, "no such thing").alias("error"))
        return hit

    report = benchmark.run("tells", rows, tells, gold, {})
    assert report["errors"] == {77: "no such thing"} and len(asked) == 1 and report["questions"] == 200 and report["retrieval"]["n"] == 200 and report["retrieval"]["recall_10"] == pytest.approx(199 / 200)
    asked.clear()

    def breaks(some):
        asked.append(1)
        return tells(some).withColumn("rank", F.when(F.col("query_id") == 130, F.raise_error(F.lit("broken"))).otherwise(F.col("rank"))).drop("error")

    report = benchmark.run("breaks", rows, breaks, gold, {})
    assert list(report["errors"]) == [130] and "broken" in report["errors"][130] and len(asked) <= 2 * 18 and report["retrieval"]["recall_10"] == pytest.approx(199 / 200)


# --- models -----------------------------------------------------------------------------------


class Slow:
    def complete(self, prompt, system=None):
        time.sleep(0.2)
        if "fail" in prompt:
            raise RuntimeError("no")
        return prompt.upper()


def test_calls_are_made_side_by_side_and_keep_their_order(spark):
    began = time.monotonic()
    prompts = [None if i % 7 == 3 else f"fail {i}" if i % 7 == 5 else f"p{i}" for i in range(40)]
    assert list(generation.completions(prompts, Slow(), calls=10)) == [None if p is None or "fail" in p else p.upper() for p in prompts]
    assert time.monotonic() - began < 4  # 8 s one by one
    rows = spark.createDataFrame(list(enumerate(prompts)), "n long, p string").coalesce(1)
    found = generation.asked(rows, F.col("p"), Slow(), calls=10)
    assert found.columns == ["n", "p", "reply"]
    assert {r["n"]: r["reply"] for r in found.collect()} == {i: None if p is None or "fail" in p else p.upper() for i, p in enumerate(prompts)}
    assert generation.asked(rows.limit(0), F.col("p"), Slow(), rate=5.0).count() == 0


def test_a_rate_holds_for_all_threads():
    began = time.monotonic()
    assert len(list(generation.completions(["x"] * 12, generation.EchoModel(), calls=6, rate=20.0))) == 12
    assert time.monotonic() - began >= 11 / 20


def test_refusals_are_waited_for_as_the_reply_says():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            seen.append(time.monotonic())
            if self.path == "/gone":
                self.send_response(404)
                self.end_headers()
                return
            if len(seen) < 3:
                self.send_response(429)
                self.send_header("Retry-After", "0.3")
                self.end_headers()
                return
            body = json.dumps({"choices": [{"message": {"content": "yes"}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        assert generation.Retrying(generation.HttpModel(url, "m"), pause=60.0, longest=60.0).complete("x") == "yes"
        assert len(seen) == 3 and all(b - a >= 0.3 for a, b in zip(seen, seen[1:]))
        with pytest.raises(generation.Refused):
            generation.Retrying(generation.HttpModel(url + "/gone", "m"), pause=60.0).complete("x")
        assert len(seen) == 4  # asking again won't mend it
    finally:
        server.shutdown()


# --- traces and files -------------------------------------------------------------------------


def test_span_trees(spark):
    t = "trace_id string, span_id string, parent_id string, name string, started_at long, duration_ms double, tokens long, cost double"
    rows = [("t", "a", None, "ask", 0, 100.0, 1, 0.1), ("t", "b", "a", "search", 1, 60.0, 10, 0.2), ("t", "c", "b", "bm25", 2, 70.0, 100, None), ("t", "d", "a", "answer", 3, 30.0, 1000, 0.4), ("t", "x", "y", "loop", 0, 1.0, 5, 0.0), ("t", "y", "x", "loop", 0, 1.0, 5, 0.0), ("u", "b", "gone", "alone", 0, 5.0, None, None)]
    found = traces.tree(spark.createDataFrame(rows, t))
    got = {(r["trace_id"], r["span_id"]): (r["depth"], r["path"], r["own_ms"], r["all_spans"], r["all_tokens"], r["all_cost"]) for r in found.collect()}
    assert got == {("t", "a"): (0, ["a"], 10.0, 4, 1111, 0.7), ("t", "b"): (1, ["a", "b"], 0.0, 2, 110, 0.2), ("t", "c"): (2, ["a", "b", "c"], 70.0, 1, 100, None), ("t", "d"): (1, ["a", "d"], 30.0, 1, 1000, 0.4), ("u", "b"): (0, ["b"], 5.0, 1, None, None)}
    text = {r["trace_id"]: r["text"] for r in traces.render_tree(found).collect()}["t"].split("\n")
    assert [x.split()[0] for x in text] == ["ask", "search", "bm25", "answer"] and text[2].startswith("    bm25")
    assert traces.tree(spark.createDataFrame([], t)).count() == 0


def test_records_appear_together_or_not_at_all(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("t"), "id").alias("trace_id"), F.array(F.struct(F.lit("step").alias("name"))).alias("steps")).repartition(4)
    files.write_traces(rows, str(tmp_path / "a"))
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted(f"t{i}.json" for i in range(20))
    assert files.read_trace(spark, str(tmp_path / "a"), "t7").first()["steps"][0]["name"] == "step"
    broken = rows.withColumn("trace_id", F.when(F.col("trace_id") == "t19", F.raise_error(F.lit("broken"))).otherwise(F.col("trace_id")))
    with pytest.raises(Exception, match="broken"):
        files.write_traces(broken, str(tmp_path / "b"))
    assert not list((tmp_path / "b").glob("**/*.json"))
    path = records.put(str(tmp_path / "c"), "../one", {"x": 1})
    assert json.loads(open(path).read()) == {"x": 1} and [p.name for p in (tmp_path / "c").iterdir()] == ["one.json"]

    class Odd:
        def __str__(self):
            raise ValueError("can't be written")

    with pytest.raises(ValueError):
        records.put(str(tmp_path / "c"), "two", {"x": Odd()})
    assert [p.name for p in (tmp_path / "c").iterdir()] == ["one.json"]


def test_a_release_leaves_the_tables_of_other_threads(spark):
    kept, ready, done = {}, threading.Event(), threading.Event()

    def other():
        kept["table"] = storage.materialize(spark.range(5), "other")
        ready.set()
        done.wait(60)
        kept["n"] = kept["table"].count()
        storage.release()

    thread = threading.Thread(target=other)
    with storage.scratch():
        thread.start()
        assert ready.wait(60)
        inner = session.together(spark, lambda: storage.materialize(spark.range(3), "x"), lambda: storage.materialize(spark.range(4), "y"))
        paths = storage.held()
        assert [df.count() for df in inner] == [3, 4] and sum("/x-" in p or "/y-" in p for p in paths) == 2 and not any("/other-" in p for p in paths)
    assert not any("/x-" in p or "/y-" in p for p in storage.held())
    done.set()
    thread.join()
    assert kept["n"] == 5


def test_a_lookup_moves_a_list_for_each_key_and_no_row_for_each_posting(spark):
    index = spark.createDataFrame([("a", 7, 2), ("a", 8, 5), ("a", 9, 9), ("b.a", 8, 1), ("b.a", 3, 4)], "key string, row_id long, pos int")
    asked = spark.createDataFrame([(1, "b.a"), (1, "b.a"), (2, "A"), (3, "none")], "query_id long, name string")
    found = symbols.lookup(index, asked, 3)
    rows = sorted((r["query_id"], r["rank"], r["row_id"], r["score"]) for r in found.collect())
    assert rows == [(1, 1, 8, 1.0), (1, 2, 3, 1.0), (1, 3, 7, 0.9), (2, 1, 7, 1.0), (2, 2, 8, 1.0), (2, 3, 9, 1.0)]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_a_file_are_a_class_and_not_pairs(spark):
    rows = spark.createDataFrame([("c", "x"), ("a", "x"), ("b", "y"), ("d", None)], "chunk_id string, path string")
    assert sorted(map(tuple, symbols.mates(rows).collect())) == [("a", "a", 1), ("b", "b", 0), ("c", "a", 1)]


def test_dense_queries_are_every_hundredth_vector(spark):
    from tessera import catalog

    assert {r["query_id"] % 100 for r in catalog.dense_topk(spark, "/root/testdata/sf0.001").select("query_id").collect()} == {0}


def test_edges_are_cut_before_they_are_shuffled(spark):
    kind = "chunk_id string, path string, artifact_type string, symbol string, symbol_type string, `references` array<string>, imports array<string>, parent_symbol string, qualified_name string"
    rows = spark.createDataFrame([(f"t{i}", "p", "source", "one", "function", ["x.call", "call", "call"], [], None, None) for i in range(5)], kind)
    found = symbols.edges(rows.union(rows), cap=3)
    assert sorted(map(tuple, found.select("kind", "name", "target", "pos").collect())) == [(k, n, f"t{i}", i + 1) for k, n in (("callers", "call"), ("definitions", "one")) for i in range(3)]
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    at = lambda what: [i for i, x in enumerate(plan) if what in x]
    assert max(at("Exchange hashpartitioning")) < max(at("WindowGroupLimit"))
