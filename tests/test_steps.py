"""What queries of several steps do only once, and what stays where it lies."""

import pytest
from conftest import SF

from tessera import catalog
from tessera.functions import text as X
from tessera.operators import bm25


@pytest.mark.parametrize(("name", "most"), [("question_metrics", 1), ("metrics_by_group", 1), ("graded_hits", 1), ("evidence_rows", 1), ("gold_units", 1), ("fusion_sweep", 3), ("agent_run", 2)])
def test_texts_are_cut_once(spark, monkeypatch, name, most):
    made, lists, exploded = [], bm25.lists, X.exploded_tokens
    monkeypatch.setattr(bm25, "lists", lambda rows, text="content": made.append(text) or lists(rows, text))
    monkeypatch.setattr(X, "exploded_tokens", lambda *a, **b: made.append("rows") or exploded(*a, **b))
    catalog.QUERIES[name](spark, SF)
    assert len(made) <= most


@pytest.mark.parametrize("name", ["context_pack", "context_related", "evidence_rendered", "evidence_rows", "citation_validate", "question_metrics", "graded_hits"])
def test_texts_stay(spark, name):
    """Hits come to the documents: these are not dealt out once more."""
    assert "REPARTITION_BY_NUM" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_gold_units_searches_nothing(spark, monkeypatch):
    monkeypatch.setattr(bm25.TermLists, "search", lambda *a, **b: pytest.fail("searched"))
    assert catalog.QUERIES["gold_units"](spark, SF).count() > 0


def test_term_counts_of_odd_words(spark):
    """Words in lower case take a short way; the others, and those that are left out, are cut as columns cut them."""
    rows = spark.createDataFrame([(1, "ab AB Ab a the The aB ab1 a_b cd_ef HTTPServer x 12 ab"), (2, None), (3, "the a")], "id long, t string")
    told = {(r[0], r[1]): r[2] for r in X.exploded_tokens(rows, ["id"], "t").groupBy("id", "term").count().collect()}
    ours = {(r["id"], p["term"]): p["tf"] for r in X.term_counts(rows, "id", "t").collect() for p in r["p"]}
    assert ours == told and ours[1, "ab"] >= 4
