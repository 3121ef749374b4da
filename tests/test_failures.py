"""A tool of the retrieval loop that fails: no result without its hits passes for a whole one."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera import catalog
from tessera.config import Config
from tessera.engine import Engine
from tessera.operators import agent, bm25
from tessera.operators.generation import EchoModel


def lost(asked):
    """A tool that fails when it runs."""
    return asked.select("query_id", F.raise_error(F.lit("hits lost")).cast("long").alias("row_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))


class Lost:
    def search(self, asked, k):
        return lost(asked)


@pytest.fixture(scope="module")
def engine(spark, checkout, tmp_path_factory):
    return Engine.build(spark, str(checkout), Config.load(index_path=str(tmp_path_factory.mktemp("index"))))


@pytest.mark.parametrize("broken", [("head",), ("content",), ("head", "content")])
def test_agent_run_fails_with_its_searches(spark, monkeypatch, broken):
    lists = bm25.lists
    monkeypatch.setattr(bm25, "lists", lambda rows, text="content": Lost() if text in broken else lists(rows, text))
    with pytest.raises(RuntimeError, match="tool (history|search): .*hits lost"):
        catalog.QUERIES["agent_run"](spark, SF).count()


def test_the_loop_names_the_questions_that_lack_a_tool(spark):
    q = spark.createDataFrame([(0, "where is it"), (1, "what do the docs say"), (2, "why was it changed")], "query_id long, query string")
    hit = lambda asked: asked.select("query_id", F.lit(7).alias("row_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    enough = lambda found: found.select("query_id", F.lit("search").alias("tool"), "query").where("false")
    more = lambda found: found.where("query_id = 1").select("query_id", F.lit("expand").alias("tool"), "query").distinct()
    save = lambda df: spark.createDataFrame(df.collect(), df.schema)
    failed = []
    found, notes = agent.run(q, {"search": hit, "symbol_search": lost, "expand": lost}, more, save, failed=failed)
    assert {r["query_id"] for r in found.collect()} == {0, 1, 2}
    told = {r["query_id"]: r["failed"] for r in agent.with_failures(q, failed).collect()}
    assert told[2] is None and [len(told[i]) for i in (0, 1)] == [1, 1] and told[0][0].startswith("symbol_search: ") and told[1][0].startswith("expand: ")
    for tools, inspect in (({"search": hit, "symbol_search": lost}, enough), ({"search": hit, "expand": lost}, more)):
        with pytest.raises(RuntimeError, match="hits lost"):
            agent.run(q, tools, inspect, save, whole=True)
    # What no question asks, or is unknown, takes nothing away.
    found, notes = agent.run(q, {"search": hit, "impact": lambda asked: asked.no_such_call()}, enough, save, whole=True)
    assert found.count() == 3 and {n["tool"] for n in notes} == {"impact", "history", "symbol_search"}


def test_answers_metrics_and_reports_tell_failures(spark, engine, monkeypatch):
    rows = spark.createDataFrame([(1, "Where is `add_item` implemented?", ["shop/cart.py"], [], [], ["add_item"], "code_lookup", "single_hop", "dev"), (2, "What do the docs explain about carts?", ["docs/guide.md"], [], [], [], "documentation", "single_hop", "dev")], "query_id long, query string, relevant_files array<string>, relevant_chunks array<string>, relevant_commits array<string>, relevant_symbols array<string>, category string, difficulty string, split string")
    asked = rows.select("query_id", "query")
    assert not engine.ask(asked, EchoModel(), agentic=True)[0].where("failed is not null").count()
    whole = engine.benchmark("agentic", rows, agentic=True)
    assert not whole["errors"] and whole["by_category"]["documentation"]["recall_10"] == 1.0
    tools = dict(engine.tools()) | {"symbol_search": lost}
    monkeypatch.setattr(engine, "tools", lambda: tools)
    answers = {r["query_id"]: r for r in engine.ask(asked, EchoModel(), agentic=True)[0].collect()}
    assert answers[1]["text"] and "symbol_search: " in answers[1]["failed"][0] and answers[2]["failed"] is None
    with pytest.raises(RuntimeError, match="tool symbol_search: "):
        engine.evaluate(rows, agentic=True)
    report = engine.benchmark("agentic", rows, agentic=True)
    assert list(report["errors"]) == [1] and "symbol_search" in report["errors"][1]
    assert report["by_category"]["code_lookup"]["recall_10"] == 0.0 and report["by_category"]["documentation"] == whole["by_category"]["documentation"]
