import random
import re

from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as X


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def model_tokens(text):
    out = []
    for w in re.findall(C.WORD, text):
        low = w.lower()
        if len(low) > 1 and low not in C.STOPWORDS:
            out.append(low)
        out += [p for p in (x.lower() for x in re.findall(C.PART, w)) if len(p) > 1 and p != low and p not in C.STOPWORDS]
    return out


def test_tokens_agree_with_a_model_on_random_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB_ .09éßxyXYZ\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert values(spark, texts, X.tokenize(F.col("t"))) == [model_tokens(t) for t in texts]


def test_identifiers_keep_their_whole_and_their_parts(spark):
    (found,) = values(spark, ["KVCache.allocate_slots2 the X"], X.tokenize(F.col("t")))
    assert found == ["kvcache", "kv", "cache", "allocate_slots2", "allocate", "slots2"]


def test_symbols_of_a_question(spark):
    (found,) = values(spark, ["Where is `my fn`? See run_it(), Mod.Sub.name and ShoppingCart or snake_case, not éConfigThing"], X.extract_symbols(F.col("t")))
    assert found == ["my fn", "run_it", "Mod.Sub.name", "ShoppingCart", "snake_case"]


def test_categories(spark):
    asked = ["Why was this introduced?", "What would break if I change it?", "It fails with an error", "which tests cover it", "overall pipeline", "default value of x", "read the docs", "where is it", "hm"]
    assert values(spark, asked, X.classify(F.col("t"))) == ["historical", "change_impact", "debugging", "tests", "architecture", "configuration", "documentation", "code_lookup", "code_lookup"]


def test_citations_json_and_thinking(spark):
    (cited,) = values(spark, ["See [a/b.py:1-20] and [a/b.py:1-20], [c.md:x-2], [d e:1-2] [f.py:3-4]."], X.parse_citations(F.col("t")))
    assert [tuple(c) for c in cited] == [("a/b.py", 1, 20), ("f.py", 3, 4)]
    assert values(spark, ['```json\n{"a": 1,}\n```', 'so {"b": [1, 2]} it is', "none", "{broken"], X.extract_json(F.col("t"))) == ['{"a": 1}', '{"b": [1, 2]}', None, None]
    assert values(spark, ["<think>a</think> b <think>c", "d"], X.strip_thinking(F.col("t"))) == ["b", "d"]
    assert values(spark, ["2", " 3.0 ", "true", "x", None], X.tolerant_int(F.col("t"))) == [2, 3, 1, None, None]


def test_paths(spark):
    paths = ["tests/a.py", "a/test_b.py", "latest_x.py", "a/conftest.py", "b_test.py", "src/a.py"]
    assert values(spark, paths, X.is_test_path(F.col("t"))) == [True, True, False, True, True, False]
    assert values(spark, ["a/b/c.py", "a/__init__.py", "__init__.py"], X.module_name(F.col("t"))) == ["a.b.c", "a", ""]


def test_truncation_keeps_head_and_tail(spark):
    (short, long) = values(spark, ["abc", "x" * 300 + "y" * 200], X.truncate(F.col("t"), 100))
    assert short == "abc" and long.startswith("x" * 280 + "\n... [120 chars") and long.endswith("\n" + "y" * 100)


def test_terms_are_counted_where_their_texts_lie(spark):
    from conftest import SF

    from tessera import catalog

    texts = [(1, "getUserName is HTTP2Server_x the the"), (2, None), (3, "Größe İx naïve 42 4"), (1, "user name"), (4, ""), (None, "lost words")]
    rows = spark.createDataFrame(texts, "id long, content string")
    counts = X.term_counts(rows, "id", "content")
    got = {(r["id"], r["term"], r["tf"]) for r in counts.selectExpr("id", "inline(p)").collect()}
    assert got == {tuple(r) for r in X.exploded_tokens(rows, ["id"], "content").groupBy("id", "term").count().collect()}
    assert {r["id"]: r["dl"] for r in counts.collect()}.keys() == {1, 2, 3, 4, None}
    # The texts are dealt by their id once; no token is a row of an exchange.
    plan = catalog.term_frequencies(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(doc_id" in plan
