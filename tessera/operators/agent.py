"""Planning, tools and the retrieval loop, for batches of questions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import classify, extract_json, extract_symbols
from .bm25 import top
from .generation import asked


def tool_map():
    return F.create_map(*(x for name, ts in C.TOOLS.items() for x in (F.lit(name), F.array(*map(F.lit, ts)))))


def plan(questions: DataFrame) -> DataFrame:
    """questions (query_id, query) with their category, symbols, tools and sub-queries, by rules."""
    return questions.withColumn("category", classify(F.col("query"))).withColumn("symbols", extract_symbols(F.col("query"))).withColumn("tools", F.element_at(tool_map(), F.col("category"))).withColumn("subqueries", F.array("query"))


def impact_hits(impacts: DataFrame, k: int = 10) -> DataFrame:
    """Impact rows (query_id, relation, row_id, rank) as hits: definitions weigh 1, callers 0.7, others 0.6, less with rank."""
    weight = F.when(F.col("relation") == "definitions", 1.0).when(F.col("relation") == "callers", 0.7).otherwise(0.6)
    scored = impacts.withColumn("score", weight / (1 + 0.1 * (F.col("rank") - 1))).groupBy("query_id", "row_id").agg(F.max("score").alias("score"))
    return top(scored, k)


def expand_hits(neighbours: DataFrame, k: int = 5) -> DataFrame:
    """Neighbours (query_id, row_id, rank) as hits of score 0.5 / rank."""
    return top(neighbours.withColumn("score", 0.5 / F.col("rank")), k)


def merge(calls: list[DataFrame]) -> DataFrame:
    """(query_id, row_id, rrf, best, calls) of tool results (query_id, row_id, score, rank): what each row gathered."""
    every = functools.reduce(DataFrame.unionByName, [c.select("query_id", "row_id", "score", "rank") for c in calls])
    return every.groupBy("query_id", "row_id").agg(F.round(F.sum(1.0 / (C.RRF_K_FIXED + F.col("rank"))), 6).alias("rrf"), F.max("score").alias("best"), F.count("*").alias("calls"))


def finalize(evidence: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "row_id")
    return evidence.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


PLAN = """Plan how to look for the answer to a question about a code base. Reply in JSON: {{"category": one of {categories}, "subqueries": at most {most} search queries, "symbols": names of code that matter}}

Question: {query}"""
INSPECT = """Decide whether the evidence answers the question. Reply in JSON: {{"sufficient": true or false, "tool": one of {tools}, "query": what to ask the tool next}}

Question: {query}

{evidence}"""


def replies(rows: DataFrame, model, system: str = "Reply in JSON.") -> DataFrame:
    """(query_id, json): the JSON object of a model's reply to each row (query_id, prompt); null where the call fails or has none."""

    told = asked(rows.select("query_id", "prompt"), F.col("prompt"), model, system)
    return told.select("query_id", extract_json(F.col("reply")).alias("json"))


def refine(planned: DataFrame, model, subqueries: int = 3, symbols: int = 8) -> DataFrame:
    """A plan by rules with what a model makes of it: another category, more sub-queries and symbols.

    Whatever the model leaves out, gets wrong or fails at stays as the rules have it. The
    question is always the first of at most subqueries + 1 queries.
    """
    prompt = F.format_string(PLAN.format(categories=", ".join(C.TOOLS), most=subqueries, query="%s"), F.col("query"))
    told = replies(planned.select("query_id", prompt.alias("prompt")), model)
    made = told.select("query_id", F.from_json("json", "category string, subqueries array<string>, symbols array<string>").alias("m")).select(F.col("query_id").alias("id_"), "m.*")
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    both = planned.join(made.select("id_", F.col("category").alias("category_"), clean(F.col("subqueries")).alias("subqueries_"), clean(F.col("symbols")).alias("symbols_")), F.col("query_id") == F.col("id_"), "left")
    category = F.when(F.col("category_").isin(*C.TOOLS), F.col("category_")).otherwise(F.col("category"))
    longer = lambda own, more, most: F.slice(F.array_distinct(F.concat(own, F.coalesce(more, F.array().cast("array<string>")))), 1, most)
    both = both.withColumn("category", category).withColumn("subqueries", longer(F.col("subqueries"), F.col("subqueries_"), subqueries + 1)).withColumn("symbols", longer(F.col("symbols"), F.col("symbols_"), symbols))
    return both.withColumn("tools", F.element_at(tool_map(), F.col("category"))).select(*planned.columns)


def inspector(model, chunks: DataFrame, tools: list[str], evidence: int = 16) -> Callable[[DataFrame], DataFrame]:
    """What asks a model whether a question's best evidence is enough, and what to call next if not.

    A reply that says it is enough, names no known tool or no query, or fails, ends the question.
    """

    def inspect(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("best"), "row_id")
        best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= evidence)
        text = F.concat(F.lit("["), F.col("path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit("]\n"), F.substring("content", 1, 1200))
        shown = best.join(chunks.select("row_id", "path", "start_line", "end_line", "content"), "row_id", "left")
        told = shown.groupBy("query_id", "query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("evidence"))
        prompt = F.format_string(INSPECT.format(tools=", ".join(tools), query="%s", evidence="%s"), F.col("query"), F.coalesce("evidence", F.lit("")))
        reply = replies(told.select("query_id", prompt.alias("prompt")), model).select("query_id", F.from_json("json", "sufficient boolean, tool string, query string").alias("d")).select("query_id", "d.*")
        return reply.where(F.coalesce(~F.col("sufficient"), F.lit(False)) & F.col("tool").isin(*tools) & (F.trim(F.coalesce("query", F.lit(""))) != "")).select("query_id", "tool", "query")

    return inspect


def with_failures(answers: DataFrame, failed: list[DataFrame]) -> DataFrame:
    """answers with a column failed: "tool: error" of each of run's tools that failed at the question, null where none did."""
    if not failed:
        return answers.withColumn("failed", F.lit(None).cast("array<string>"))
    every = functools.reduce(DataFrame.unionByName, failed)
    return answers.join(every.groupBy("query_id").agg(F.array_sort(F.collect_set(F.concat("tool", F.lit(": "), "error"))).alias("failed")), "query_id", "left")


def run(questions: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]], inspect: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], DataFrame], iterations: int = 4, evidence: int = 16, planner: Callable[[DataFrame], DataFrame] | None = None, symbols: int = 3, failed: list[DataFrame] | None = None, whole: bool = False) -> tuple[DataFrame, list[dict]]:
    """Evidence of each question after planned tool calls and up to iterations - 1 inspected ones.

    tools maps a name to a function of (query_id, query). The first round searches for every
    sub-query of the plan and asks the other planned tools about the question, impact and
    symbol_search about its first symbols. inspect takes (query_id, query, evidence of it) and
    returns (query_id, tool, query) for the questions that want one more call; asking again for
    what was asked, or a round that brings nothing new, ends a question, and so does twice as much
    evidence as is wanted. All open questions share a round's job. save stores a table in shared
    storage, which cuts the lineage of the rounds; a tool's result is saved on its own, so that a
    tool that fails, when it is called or when it runs, is noted and skipped.

    Evidence without a failed tool's hits isn't what the loop finds, and its rows don't show it: failed
    takes a table (query_id, tool, error) of the questions of each call that failed, and whole raises the
    failure. A tool that isn't among tools, or fails where no question asks it, takes nothing away.
    """
    planned = plan(questions)
    planned = save(planner(planned) if planner else planned)
    notes: list[dict] = []

    def call(name: str, asked: DataFrame) -> DataFrame | None:
        if name not in tools:
            notes.append({"tool": name, "note": "unknown tool"})
            return None
        try:
            return save(tools[name](asked).select(F.col("query_id").cast("long").alias("query_id"), F.col("row_id").cast("long").alias("row_id"), F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank")))
        except Exception as error:  # noqa: BLE001  a tool's failure is a note, not the end, unless all evidence is wanted
            if whole and not asked.isEmpty():
                raise RuntimeError(f"tool {name}: {error}") from error
            notes.append({"tool": name, "note": str(error)[:200]})
            if failed is not None:
                failed.append(asked.select("query_id", F.lit(name).alias("tool"), F.lit(str(error)[:200]).alias("error")).distinct())
            return None

    names = sorted({t for ts in C.TOOLS.values() for t in ts})
    found = []
    for n in names:
        own = planned.where(F.array_contains("tools", n))
        if n == "search":
            own = own.select("query_id", F.explode("subqueries").alias("query"))
        elif n in ("impact", "symbol_search"):
            # Names that a plan has go to the tool one by one; without any it is asked the question.
            own = own.select("query_id", F.explode(F.when(F.size("symbols") > 0, F.slice("symbols", 1, symbols)).otherwise(F.array("query"))).alias("query"))
        else:
            own = own.select("query_id", "query")
        if (hits := call(n, own)) is not None:
            found.append(hits)
    if not found:
        return save(questions.sparkSession.createDataFrame([], "query_id long, row_id long, rrf double, best double, calls long, rank int")), notes
    calls = save(functools.reduce(DataFrame.unionByName, found))
    asked = save(planned.select("query_id", F.lit("search").alias("tool"), F.explode("subqueries").alias("next")))
    open_ = planned.select("query_id", "query")
    known = sorted(set(names) | set(tools))
    for _ in range(iterations - 1):
        merged = finalize(merge([calls]), evidence)
        wants = inspect(open_.join(merged, "query_id", "left")).select("query_id", "tool", F.col("query").alias("next"))
        full = merge([calls]).groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * evidence).select("query_id")
        wants = save(wants.join(asked, ["query_id", "tool", "next"], "left_anti").join(full, "query_id", "left_anti"))
        wanted = {r[0] for r in wants.select("tool").distinct().collect()}  # names of tools only
        got = [c for n in known if n in wanted and (c := call(n, wants.where(F.col("tool") == n).select("query_id", F.col("next").alias("query")))) is not None]
        if not got:
            break
        new = save(functools.reduce(DataFrame.unionByName, got))
        fresh = new.join(calls.select("query_id", "row_id").distinct(), ["query_id", "row_id"], "left_anti").select("query_id").distinct()
        calls, asked = save(calls.unionByName(new)), save(asked.unionByName(wants))
        open_ = save(open_.join(fresh, "query_id", "left_semi"))
    return save(finalize(merge([calls]), evidence)), notes
