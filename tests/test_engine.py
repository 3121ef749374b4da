import json
import sys

import pytest
import slow_sections
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.engine import Engine
from tessera.operators import chunking, dataset
from tessera.operators.generation import EchoModel
from tessera.plans.knowledge import KnowledgeBase, ingest, statistics
from tessera.sources import files, git

# Workers don't have this module: what it defines goes along with the call.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def engine(spark, checkout, tmp_path_factory):
    config = Config.load(index_path=str(tmp_path_factory.mktemp("index")))
    config.ingestion.max_commits = 10
    return Engine.build(spark, str(checkout), config)


@pytest.fixture(scope="module")
def chunks(engine):
    return [r.asDict() for r in engine.base.chunks.orderBy("row_id").collect()]


def test_chunks_have_names_parents_and_exact_lines(chunks, checkout):
    by = {c["qualified_name"]: c for c in chunks if c["qualified_name"]}
    assert by["shop.cart.ShoppingCart"]["symbol_type"] == "class" and by["shop.cart.ShoppingCart.add_item"]["parent_symbol"] == "ShoppingCart"
    assert by["shop.cart.ShoppingCart.add_item"]["docstring"].startswith("Puts an item")
    assert {"cart.add_item", "ShoppingCart"} <= set(by["shop.checkout.Checkout.run"]["references"])
    assert "shop.cart" in by["shop.checkout.Checkout.run"]["imports"]
    for c in chunks:
        if c["symbol_type"] in ("function", "method"):
            lines = (checkout / c["path"]).read_text().split("\n")
            assert c["content"].split("\n")[0] == lines[c["start_line"] - 1]
    assert by["Shop guide > Carts"]["heading_path"] == ["Shop guide", "Carts"]
    assert [c["row_id"] for c in chunks] == list(range(1, len(chunks) + 1))


def test_kinds_and_history(engine, chunks):
    assert {c["artifact_type"] for c in chunks} == {"source", "test", "doc", "commit"}
    (commit,) = [c for c in chunks if c["artifact_type"] == "commit"]
    assert commit["author"] == "A Writer" and "shop/cart.py" in commit["files_changed"] and "The tax is on top." in commit["content"]
    assert sum(r["n"] for r in statistics(engine.base.chunks).collect()) == len(chunks)


def test_ids_are_stable(spark, engine, checkout):
    again = {r[0] for r in ingest(spark, str(checkout), engine.config).select("chunk_id").collect()}
    assert again == {r[0] for r in engine.base.chunks.select("chunk_id").collect()}


def test_search_asks_every_source(engine):
    hits = engine.search(["Where is `add_item` implemented?"]).orderBy("rank").collect()
    assert hits[0]["qualified_name"] == "shop.cart.ShoppingCart.add_item"
    only = engine.search(["adding an item to the cart"], allowed=F.col("artifact_type") == "doc").collect()
    assert only and {h["artifact_type"] for h in only} == {"doc"}
    assert engine.search(["cart"], ["bm25", "nothing"]).count() > 0


def test_answers_cite_what_they_were_given(engine):
    answers, cited = engine.ask(["What does the checkout do with an empty cart?"], EchoModel())
    assert answers.first()["text"].startswith("Based on the evidence: [")
    rows = cited.collect()
    assert rows and all(r["valid"] for r in rows)


def test_impact_lists_definition_callers_and_tests(engine):
    found = engine.impact(["add_item"]).join(engine.base.chunks.select(F.col("chunk_id").alias("target"), "path"), "target").collect()
    assert {("definitions", "shop/cart.py"), ("callers", "shop/checkout.py"), ("tests", "tests/test_cart.py")} <= {(r["relation"], r["path"]) for r in found}


def test_diagnosis_and_errors(engine, spark):
    told = engine.diagnose(["shopping cart total"])
    assert told["top"].count() and told["counts"].count()
    with pytest.raises(ValueError):
        engine.search([" "])
    with pytest.raises(KeyError):
        engine.chunk("0" * 16)
    with pytest.raises(FileNotFoundError):
        KnowledgeBase.load(spark, "/tmp/there/is/nothing")


def test_an_unchanged_checkout_is_not_indexed_again(spark, engine, checkout):
    again = Engine.build(spark, str(checkout), engine.config)
    assert again.base.meta["built_at"] == engine.base.meta["built_at"]


def test_json_round_trip(spark, engine, tmp_path):
    files.write_chunks(engine.base.chunks, str(tmp_path / "chunks"))
    assert files.read_chunks(spark, str(tmp_path / "chunks")).select("chunk_id").exceptAll(engine.base.chunks.select("chunk_id")).isEmpty()


def test_questions_of_the_corpus(engine):
    found = dataset.candidates(engine.base.chunks.withColumn("subject", F.col("extra.subject")), ("debugging", "documentation", "code_lookup", "configuration", "historical", "tests", "change_impact"), engine.base.edges)
    kinds = {r["kind"] for r in found.collect()}
    assert "debugging" in kinds
    built = dataset.build(found, 10).collect()
    assert built and all(r["question"].endswith("?") for r in built)


def test_windows_leave_no_gap(spark):
    rows = spark.createDataFrame([(1, "\n".join(map(str, range(41))))], "id int, content string")
    found = [(r["start_line"], r["end_line"]) for r in chunking.windows(rows, limit=10, overlap=2).orderBy("start_line").collect()]
    assert found[0] == (1, 10) and found[-1][1] == 41 and all(b[0] <= a[1] + 1 for a, b in zip(found, found[1:]))
    assert [x for x, _ in chunking.split_long(1, list(map(str, range(41))), 10, 2)] == [a for a, _ in found]


def test_broken_python_and_deep_headings():
    rows = chunking.python_chunks("a.py", "def broken(:\n" * 10)
    assert rows and all(r["symbol_type"] == "file" for r in rows)
    paths = [p for _, _, p in slow_sections.markdown_sections("# A\n## B\n### C\n```\n# no\n```\n# D".split("\n"))]
    assert paths == [["A"], ["A", "B"], ["A", "B", "C"], ["D"]]
    assert [p for _, _, p in slow_sections.rst_sections("Top\n===\ntext\nSub\n---\nmore".split("\n"))] == [["Top"], ["Top", "Sub"]]


def test_long_sections_are_cut_at_blank_lines():
    lines = (["word " * 20] * 5 + [""]) * 4
    pieces = slow_sections.cut_section(1, lines, 300)
    assert len(pieces) == 4 and all(some[-1] == "" for _, some in pieces)
    assert sum(len(some) for _, some in pieces) == len(lines)
    assert len(slow_sections.cut_section(1, ["x" * 100] * 30, 500)) > 3


def test_globs():
    import re

    assert re.match(files.glob_pattern("**/*.py"), "setup.py") and re.match(files.glob_pattern("**/*.py"), "a/b/c.py")
    assert not re.match(files.glob_pattern("docs/*.md"), "a/docs/x.md") and re.match(files.glob_pattern("docs/*"), "docs/a/b.md")


def test_settings(tmp_path):
    config = Config.load(retrieval__final=5)
    config.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")).retrieval.final == 5 and config.fingerprint() != Config().fingerprint()
    with pytest.raises(ValueError):
        Config.load(nothing=1)
    (tmp_path / "d.json").write_text(json.dumps({"retrieval": {"nothing": 1}}))
    with pytest.raises(ValueError):
        Config.load(str(tmp_path / "d.json"))


def test_head_of_no_repository(tmp_path):
    assert git.head(str(tmp_path)) == "unknown"


class Scripted:
    """A model that plans two sub-queries and asks for one more tool call."""

    def __init__(self, tool="history", query="tax"):
        self.tool, self.query = tool, query

    def complete(self, prompt, system=None):
        if "Plan how" in prompt:
            return 'Sure: ```json\n{"category": "change_impact", "subqueries": ["cart total", "", "tax rate"], "symbols": ["ShoppingCart"],}\n```'
        if "Decide whether" in prompt:
            return json.dumps({"sufficient": False, "tool": self.tool, "query": self.query})
        return EchoModel().complete(prompt, system)


def test_a_model_refines_a_plan_and_failures_leave_the_rules(spark, engine):
    from tessera.operators import agent

    class Broken:
        def complete(self, prompt, system=None):
            raise TimeoutError("no answer")

    q = engine.queries(["Where is `add_item` implemented?"])
    ruled = agent.plan(q).first()
    assert agent.refine(agent.plan(q), Broken()).first() == ruled
    r = agent.refine(agent.plan(q), Scripted(), 2).first()
    assert r["category"] == "change_impact" and r["subqueries"] == ["Where is `add_item` implemented?", "cart total", "tax rate"] and r["symbols"] == ["add_item", "ShoppingCart"] and "impact" in r["tools"]


def test_the_agent_gathers_evidence_and_notes_tools_that_fail(engine, monkeypatch):
    hits, notes = engine.investigate(["Where is `add_item` implemented?"], Scripted())
    rows = hits.orderBy("rank").collect()
    assert rows and rows[0]["rank"] == 1 and "shop/cart.py" in {r["path"] for r in rows} and not notes
    assert any(r["artifact_type"] == "commit" for r in rows)
    answers, cited = engine.ask(["Where is `add_item` implemented?"], EchoModel(), agentic=True)
    assert answers.first()["text"].startswith("Based on") and all(r["valid"] for r in cited.collect())
    tools = dict(engine.tools())
    tools["symbol_search"] = lambda asked: asked.select("query_id", F.raise_error(F.lit("broken at run time")).cast("long").alias("row_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    monkeypatch.setattr(engine, "tools", lambda: tools)
    hits, notes = engine.investigate(["Where is `add_item` implemented?"])
    assert hits.count() and any("broken at run time" in n["note"] for n in notes)


def test_a_related_definition_joins_the_evidence(spark):
    from tessera.operators import context

    chunks = spark.createDataFrame([(1, "a", "a.py", ["x.helper", "y.other"], "use"), (2, "b", "b.py", [], "def helper"), (3, "c", "a.py", [], "def other")], "row_id long, chunk_id string, path string, references array<string>, content string")
    graph = spark.createDataFrame([("definitions", "helper", "b", 1), ("definitions", "other", "c", 1)], "kind string, name string, target string, pos int")
    packed = spark.createDataFrame([(0, 1, 1, 10, "kept"), (0, 2, 2, 10, "budget")], "query_id long, row_id long, rank int, tokens int, decision string")
    found = {r["row_id"]: (r["rank"], r["decision"]) for r in context.with_related(packed, chunks, graph, 100).collect()}
    assert found == {1: (1, "kept"), 2: (3, "kept")}
    assert context.with_related(packed, chunks, graph, 5).count() == 2


def test_commits_that_touch_a_path_and_lookups(engine):
    every = engine.search(["cart tax"], ["git"])
    assert every.count() and engine.search(["cart tax"], ["git"], touching="cart").count() and not engine.search(["cart tax"], ["git"], touching="nowhere").count()
    assert {r["path"] for r in engine.base.by("symbol", "add_item").collect()} == {"shop/cart.py"} and engine.base.paths().count() >= 4
    with pytest.raises(ValueError):
        engine.base.by("content", "x")
    assert engine.health()["ok"]


class Lengths:
    """An embedder of two numbers."""

    query_prefix, document_prefix = "ask: ", ""

    def encode(self, texts):
        return [[len(t), 1.0] if t else [0.0, 0.0] for t in texts]


def test_embedders_and_models_are_made_by_name(spark, monkeypatch):
    from tessera.operators import generation, vectors

    assert vectors.build_embedder("hashing") is None and isinstance(vectors.build_embedder("test_engine:Lengths"), Lengths)
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "row_id long, content string")
    found = {r["row_id"]: r["vector"] for r in vectors.encode(rows, Lengths()).collect()}
    assert found[2] == [0.0, 0.0] and abs(sum(x * x for x in found[1]) - 1) < 1e-9
    asked = {r["row_id"]: r["vector"] for r in vectors.text_vectors(rows, "content", Lengths(), query=True).collect()}
    assert asked[2][0] == pytest.approx(5 / 26**0.5)
    calls = []

    class Flaky:
        def complete(self, prompt, system=None):
            calls.append(prompt)
            if len(calls) < 3:
                raise OSError("busy")
            return "done"

    assert generation.Retrying(Flaky(), pause=0).complete("x") == "done" and len(calls) == 3
    with pytest.raises(OSError):
        calls.clear()
        generation.Retrying(Flaky(), attempts=2, pause=0).complete("x")
    for bad in (generation.build_model, vectors.build_embedder):
        with pytest.raises(ValueError):
            bad("nothing")


def test_a_model_behind_http(monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tessera.operators import generation

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(503 if len(seen) == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "hello"}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("SOME_KEY", "secret")
    model = generation.build_model(f"http://127.0.0.1:{server.server_port}/v1", name="m", key_variable="SOME_KEY")
    model.pause = 0
    assert model.complete("hi", "be brief") == "hello" and seen[1][0] == "Bearer secret" and [m["role"] for m in seen[1][1]["messages"]] == ["system", "user"]
    server.shutdown()


def test_evaluation_and_benchmark_reports(spark, engine, tmp_path):
    from tessera.operators import benchmark

    rows = spark.createDataFrame([(1, "Where is `add_item` implemented?", ["shop/cart.py"], [], [], ["add_item"], "code_lookup", "single_hop", "dev"), (2, "what does the checkout do", ["shop/checkout.py", "x.py"], [], [], [], "architecture", "multi_hop", "test")], "query_id long, query string, relevant_files array<string>, relevant_chunks array<string>, relevant_commits array<string>, relevant_symbols array<string>, category string, difficulty string, split string")
    metrics, evidence = engine.evaluate(rows)
    assert {r["query_id"]: r["recall_10"] for r in metrics.collect()} == {1: 1.0, 2: 0.5}
    assert evidence.where("is_gold").count() and evidence.where("not is_gold").count()
    report = engine.benchmark("hybrid", rows, singly=1)
    assert report["questions"] == 2 and report["retrieval"]["n"] == 2 and report["by_category"]["code_lookup"]["mrr"] == 1.0 and report["latency_ms"]["n"] == 1 and not report["errors"]
    path = benchmark.save_report(report, str(tmp_path / "reports"))
    assert json.loads(open(path).read())["system"] == "hybrid" and files.read_reports(spark, str(tmp_path / "reports")).count() == 1
    assert engine.benchmark("dev", rows, split="dev")["questions"] == 1

    def one_fails(asked):
        if asked.where("query_id = 2").count():
            raise RuntimeError("no")
        return asked.select("query_id", F.lit(1).alias("rank"), F.lit("shop/cart.py").alias("unit"), F.lit(1).alias("grade"))

    from tessera.operators import evaluate

    report = benchmark.run("broken", rows, one_fails, evaluate.units(rows), {})
    assert list(report["errors"]) == [2] and report["retrieval"]["recall_10"] == 0.5
    both = benchmark.compare_embedders(engine.base.chunks, rows, evaluate.units(rows), {"hashing": None, "lengths": Lengths()}, lambda asked: {"bm25": engine.base.index.search(asked, 10)}, lambda hits: evaluate.graded(engine.named(hits), rows), k=5)
    assert [r["system"] for r in both] == ["dense-hashing", "hybrid-hashing", "dense-lengths", "hybrid-lengths"] and not any(r["errors"] for r in both)


def test_files_have_hashes_and_portable_paths(tmp_path):
    import hashlib

    from tessera.operators import benchmark

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("some text")
    assert benchmark.file_hash(str(tmp_path / "a" / "x.txt")) == hashlib.sha1(b"some text").hexdigest()[:12]
    assert benchmark.portable_path(str(tmp_path / "a" / "x.txt"), str(tmp_path)) == "a/x.txt" and benchmark.portable_path("/else/where.txt", str(tmp_path)) == "where.txt"


def test_a_cross_encoder_reranks_by_title_and_content(spark, engine):
    from tessera.operators import fusion

    q = engine.queries(["cart"])
    named = engine.base.chunks.select("row_id", F.col("path").alias("title"), "content")
    reranker = fusion.cross_encoder(named, q, lambda pairs: [float("checkout" in text.split("\n")[0]) for _, text in pairs])
    hits = engine.search(q, reranker=reranker).orderBy("rank").collect()
    assert hits[0]["path"] == "shop/checkout.py" and hits[0]["score"] == 1.0 and hits[0]["pre_rank"] >= 1 and hits[0]["component_scores"]["rerank"] == 1.0


def test_the_command_line(spark, engine, checkout, tmp_path, capsys):
    from tessera import cli

    run = lambda *args: cli.main(["--set", f"index_path={engine.config.index_path}", *map(str, args)], spark)
    assert run("ingest", checkout, tmp_path / "chunks") == 0 and run("stats") == 0 and run("health") == 0
    assert run("search", "cart", "--sources", "bm25,symbol") == 0 and run("ask", "cart total", "--agentic") == 0 and run("diagnose", "cart") == 0 and run("impact", "add_item") == 0
    assert run("dataset-build", tmp_path / "q", "--size", 20) == 0 and run("dataset-validate", tmp_path / "q") == 0 and run("dataset-stats", tmp_path / "q", "--source", "auto") == 0
    assert run("benchmark", tmp_path / "q", tmp_path / "r", "--sources", "bm25", "--limit", 2) == 0 and run("report", tmp_path / "r") == 0
    assert run("audit", tmp_path / "q", tmp_path / "sheet", "--size", 2) == 0 and run("agreement", tmp_path / "sheet") == 0
    assert "hybrid" in capsys.readouterr().out


def test_traces_are_written_and_found_by_id(spark, tmp_path):
    files.write_trace({"trace_id": "t1", "steps": [{"name": "a"}]}, str(tmp_path))
    files.write_trace({"trace_id": "t2", "steps": []}, str(tmp_path))
    assert files.read_trace(spark, str(tmp_path), "t1").first()["trace_id"] == "t1"
    with pytest.raises(KeyError):
        files.read_trace(spark, str(tmp_path), "t9")
