"""Command line: python -m tessera.cli <command>."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .engine import Engine
from .operators import benchmark, curated, dataset, evaluate, generation
from .plans.knowledge import ingest, statistics
from .sources import files

KINDS = ("code_lookup", "configuration", "tests", "change_impact", "historical", "documentation", "debugging")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--config")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting by its dotted name, its value in JSON or as it is")
    sub = p.add_subparsers(dest="command", required=True)

    def command(verb: str, /, *positional: str, **options):
        c = sub.add_parser(verb)
        for x in positional:
            c.add_argument(x)
        for x, kind in options.items():
            flag = "--" + x.replace("_", "-")
            c.add_argument(flag, action="store_true") if kind is bool else c.add_argument(flag, type=kind)
        return c

    command("ingest", "root", "out")
    command("index", "root", force=bool)
    command("search", "question", sources=str)
    command("ask", "question", agentic=bool, sources=str)
    command("diagnose", "question")
    command("impact", "symbol")
    command("stats")
    command("health")
    command("benchmark", "questions", "reports", name=str, sources=str, split=str, limit=int, agentic=bool, singly=int)
    command("report", "reports")
    command("dataset-build", "out", size=int, seed=int)
    command("dataset-validate", "questions")
    command("dataset-stats", "questions", category=str, split=str, source=str, difficulty=str, contains=str)
    command("audit", "questions", "sheet", size=int, seed=int)
    command("agreement", "sheet")
    return p


def value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def asked(questions: DataFrame) -> DataFrame:
    """Questions of a file with the numbers and names that retrieval goes by."""
    return questions.withColumn("query_id", F.pmod(F.xxhash64("id"), F.lit(1 << 62))).withColumn("query", F.col("question"))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    config = Config.load(o.config, **{k: value(v) for k, _, v in (s.partition("=") for s in o.set)})
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    split = lambda s: s.split(",") if s else None
    if o.command == "ingest":
        chunks = ingest(spark, o.root, config)
        files.write_chunks(chunks, o.out)
        statistics(files.read_chunks(spark, o.out)).show()
        return 0
    if o.command == "index":
        Engine.build(spark, o.root, config, o.force).base.summary().show()
        return 0
    if o.command == "report":
        print(benchmark.ablation([json.loads(r[0]) for r in files.read_reports(spark, o.reports).select(F.to_json(F.struct("system", "retrieval"))).collect()]))
        return 0
    if o.command == "dataset-stats":
        chosen = evaluate.browse(files.read_questions(spark, o.questions), o.category, o.split, o.source, o.difficulty, o.contains)
        evaluate.summary(chosen).show(200, truncate=False)
        return 0
    if o.command == "agreement":
        sheet = files.read_audit(spark, o.sheet)
        for side in ("correctness", "faithfulness"):
            print(side, evaluate.agreement(sheet.select(F.col(f"judge_{side}").alias("judge"), F.col(f"human_{side}").alias("human"))).first().asDict())
        return 0
    engine = Engine.load(spark, config)
    base = engine.base
    if o.command == "search":
        engine.search([o.question], split(o.sources)).select("rank", "score", "location", "title").orderBy("rank").show(truncate=False)
    elif o.command == "ask":
        answers, cited = engine.ask([o.question], sources=split(o.sources), agentic=o.agentic)
        answers.select("text", *(["failed"] if o.agentic else [])).show(truncate=False)
        cited.select("path", "start_line", "end_line", "valid").show(truncate=False)
    elif o.command == "diagnose":
        for df in engine.diagnose([o.question]).values():
            df.show(truncate=False)
    elif o.command == "impact":
        engine.impact([o.symbol]).orderBy("relation", "rank").show(truncate=False)
    elif o.command == "health":
        print(json.dumps(engine.health()))
    elif o.command == "benchmark":
        rows = asked(files.read_questions(spark, o.questions))
        report = engine.benchmark(o.name or "hybrid", rows, split(o.sources), o.split, o.limit, o.agentic, o.singly or 0)
        print(benchmark.save_report(report, o.reports))
    elif o.command == "dataset-build":
        found = dataset.candidates(base.chunks.withColumn("subject", F.col("extra.subject")), KINDS, base.edges)
        made = dataset.build(found, o.size or 100, seed=o.seed or 0)
        made = made.withColumn("source", F.concat(F.lit("auto:"), F.col("category"))).unionByName(curated.answerable(curated.curated(spark), base.paths()), allowMissingColumns=True)
        files.write_questions(made, o.out)
        evaluate.summary(files.read_questions(spark, o.out)).show(200, truncate=False)
    elif o.command == "dataset-validate":
        names = base.chunks.select(F.coalesce("qualified_name", "symbol").alias("name")).where("name is not null")
        commits = base.chunks.where("commit_sha is not null").select(F.col("commit_sha").alias("sha"))
        problems = evaluate.dataset_problems(files.read_questions(spark, o.questions), base.paths(), base.chunks.select("chunk_id"), names, commits)
        problems.show(200, truncate=False)
        return int(not problems.isEmpty())
    elif o.command == "audit":
        rows = asked(files.read_questions(spark, o.questions))
        rows = evaluate.sample(rows, "id", o.size or 20, o.seed or 0)
        model = generation.build_model(config.model)
        answers, _ = engine.ask(rows.select("query_id", "query"), model)
        told = answers.join(rows.select("query_id", "question", F.col("expected_answer").alias("expected")), "query_id")
        judged = told.join(generation.judge(told.select("query_id", "query", "expected", "text"), model), "query_id")
        files.write_audit(judged, o.sheet, o.size or 20, o.seed or 0)
        evaluate.answer_scores(judged).show()
    else:
        base.summary().show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
