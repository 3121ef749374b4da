"""The engine's front: ingest, index, search, ask, diagnose, impact, benchmark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import Config
from .functions.text import extract_symbols
from .operators import agent, benchmark, bm25, context, evaluate, fusion, generation, symbols
from .plans.knowledge import KnowledgeBase, ingest
from .plans.schema import location, title
from .plans.storage import materialize


@dataclass
class Engine:
    spark: SparkSession
    config: Config
    base: KnowledgeBase

    @classmethod
    def build(cls, spark: SparkSession, root: str, config: Config | None = None, force: bool = False) -> Engine:
        """Ingests and indexes a checkout, unless the saved index is of the same commit and settings; returns the engine on the saved tables."""
        from .sources.git import head

        config = config or Config()
        try:
            base = KnowledgeBase.load(spark, config.index_path)
            if not force and base.meta.get("commit") == head(root) != "unknown" and base.meta.get("fingerprint") == config.fingerprint():
                return cls(spark, config, base)
        except FileNotFoundError:
            pass
        made = KnowledgeBase.build(config, ingest(spark, root, config))
        made.meta["commit"] = head(root)
        made.save(config.index_path)
        return cls.load(spark, config)

    @classmethod
    def load(cls, spark: SparkSession, config: Config | None = None) -> Engine:
        config = config or Config()
        return cls(spark, config, KnowledgeBase.load(spark, config.index_path))

    def queries(self, questions: list[str] | DataFrame) -> DataFrame:
        if isinstance(questions, DataFrame):
            return questions
        if any(not q.strip() for q in questions):
            raise ValueError("a question is empty")
        rows = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(q).alias("query")) for i, q in enumerate(questions))))
        return self.spark.range(1).select(rows.alias("q")).select("q.*")

    def search(self, questions: list[str] | DataFrame, sources: list[str] | None = None, allowed: Column | None = None, final: int | None = None, touching: str | None = None, reranker=None, failed: list[DataFrame] | None = None) -> DataFrame:
        """Fused hits with what names their chunk; texts are joined on last. reranker is one of fusion's, by default none; failed as for KnowledgeBase.sources."""
        r = self.config.retrieval
        found = self.base.sources(self.queries(questions), self.config, sources, allowed, touching, failed)
        hits = fusion.hybrid(found, r.method, r.candidates, final or r.final, r.rrf_k, r.weights, r.depths, reranker or fusion.identity_rerank)
        return self.named(hits)

    def named(self, hits: DataFrame) -> DataFrame:
        """hits with what names their chunk."""
        extra = [c for c in ("kept", "pre_score", "pre_rank", "component_scores") if c in hits.columns]
        chunks = self.base.chunks.withColumn("location", location()).withColumn("title", title())
        return hits.select("query_id", "row_id", "score", "rank", *extra).join(chunks.select("row_id", "chunk_id", "path", "start_line", "end_line", "artifact_type", "commit_sha", "qualified_name", "location", "title", "content"), "row_id")

    def tools(self) -> dict:
        """The agent's tools, each a function of (query_id, query): search, symbol_search, history, impact, expand."""
        base, k = self.base, self.config.agent.k
        numbers = base.chunks.select(F.col("chunk_id").alias("target"), "row_id")

        def impact(asked: DataFrame) -> DataFrame:
            names = asked.select("query_id", F.explode(F.when(F.size(extract_symbols(F.col("query"))) > 0, extract_symbols(F.col("query"))).otherwise(F.array("query"))).alias("symbol"))
            found = symbols.impact(base.edges, base.chunks, names.select("symbol").distinct()).join(numbers, "target")
            return agent.impact_hits(names.join(found, "symbol").select("query_id", "relation", "row_id", "rank"), 10)

        def expand(asked: DataFrame) -> DataFrame:
            """Neighbours of the chunks that the query names by id."""
            mates = symbols.neighbours(base.chunks, asked.select(F.col("query").alias("id")).distinct(), k=5)
            found = asked.select("query_id", F.col("query").alias("id")).join(mates, "id").join(numbers.withColumnRenamed("target", "other"), "other")
            return agent.expand_hits(found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("row_id"))).select("query_id", "row_id", "rank"), 5)

        every = {
            "search": lambda asked: self._searched(asked, k),
            "symbol_search": lambda asked: symbols.search(base.symbols, asked.select("query_id", F.col("query").alias("name")), 6).select("query_id", "row_id", "score", "rank"),
            "history": lambda asked: bm25.top(base.sources(asked, self.config, ["git"])["git"].select("query_id", "row_id", "score"), 6),
            "impact": impact,
            "expand": expand,
        }
        return {n: f for n, f in every.items() if n in ("search", "expand") or (base.symbols is not None and n == "symbol_search") or (base.edges is not None and n == "impact") or (base.index is not None and n == "history")}

    def _searched(self, asked: DataFrame, k: int) -> DataFrame:
        """The best k hits of each query; a question may have several queries, which are told apart by a hash of their text."""
        rows = asked.select("query_id", "query").distinct().withColumn("call", F.xxhash64("query_id", "query"))
        hits = fusion.hybrid(self.base.sources(rows.select(F.col("call").alias("query_id"), "query"), self.config), final=k, **self._fusing())
        return hits.withColumnRenamed("query_id", "call").join(rows.select("call", "query_id"), "call").select("query_id", "row_id", "score", "rank")

    def _fusing(self) -> dict:
        r = self.config.retrieval
        return {"method": r.method, "candidates": r.candidates, "rrf_k": r.rrf_k, "weights": r.weights, "depths": r.depths}

    def investigate(self, questions: list[str] | DataFrame, model: generation.Model | None = None, failed: list[DataFrame] | None = None, whole: bool = False) -> tuple[DataFrame, list[dict]]:
        """(hits, notes): what the agent gathers for each question, and which of its tools failed; failed and whole as for agent.run.

        A model refines the plans and says after each round whether the evidence is enough; the
        echo model always says so.
        """
        a, model, q = self.config.agent, model or generation.build_model(self.config.model), self.queries(questions)
        tools = self.tools()
        planner = lambda planned: agent.refine(planned, model, a.subqueries)
        inspect = agent.inspector(model, self.base.chunks, sorted(tools), a.evidence)
        found, notes = agent.run(q, tools, inspect, lambda df: materialize(df, "agent"), a.iterations, a.evidence, planner, failed=failed, whole=whole)
        return self.named(found.withColumnRenamed("rrf", "score").where(F.col("rank") <= self.config.retrieval.final)), notes

    def diagnose(self, questions: list[str] | DataFrame) -> dict[str, DataFrame]:
        """Each source's best five hits and how many each pair of sources shares."""
        found = self.base.sources(self.queries(questions), self.config)
        every = fusion.tagged(found)
        return {"top": every.where("rank <= 5"), "counts": every.groupBy("query_id", "source").agg(F.count("*").alias("n")), "overlap": fusion.overlap(found)}

    def ask(self, questions: list[str] | DataFrame, model: generation.Model | None = None, sources: list[str] | None = None, agentic: bool = False) -> tuple[DataFrame, DataFrame]:
        """(answers, checked citations) from packed evidence.

        To what fits comes one definition from another file that the best block refers to, if it fits too. agentic lets
        the agent gather the evidence; sources don't apply to it, and the answers' column failed names the tools that
        failed at a question, whose answer is from what the others found.
        """
        c, q, failed = self.config.context, self.queries(questions), []
        model = model or generation.build_model(self.config.model)
        hits = self.investigate(q, model, failed)[0] if agentic else self.search(q, sources)
        packed = materialize(context.pack(hits, c.budget, c.chunk_tokens, c.per_file, c.quotas), "packed")
        if self.base.edges is not None:
            packed = context.with_related(packed, self.base.chunks, self.base.edges, c.budget, c.chunk_tokens)
        evidence = context.render(packed, self.base.chunks, c.chunk_tokens)
        blocks = packed.where("decision = 'kept'").join(self.base.chunks.select("row_id", "path", "start_line", "end_line"), "row_id")
        answers, cited = generation.answer(q, evidence, blocks, model)
        return (agent.with_failures(answers, failed) if agentic else answers), cited

    def evaluate(self, questions: DataFrame, sources: list[str] | None = None, agentic: bool = False) -> tuple[DataFrame, DataFrame]:
        """(metrics, evidence with is_gold) of questions (query_id, query, relevant_*); a tool of the agent that fails fails it."""
        q = questions.select("query_id", "query")
        hits = materialize(self.investigate(q, whole=True)[0] if agentic else self.search(q, sources), "hits")
        return evaluate.question_metrics(evaluate.graded(hits, questions), evaluate.units(questions)), evaluate.evidence_rows(hits, questions)

    def benchmark(self, name: str, questions: DataFrame, sources: list[str] | None = None, split: str | None = None, limit: int | None = None, agentic: bool = False, singly: int = 0) -> dict:
        """A report of one way to retrieve over questions (query_id, query, relevant_*, category, split ...).

        A question that a tool of the agent fails at is among its errors and scores nothing, as one that a source fails at.
        """
        def retrieve(asked: DataFrame) -> DataFrame:
            failed: list[DataFrame] = []
            hits = self.investigate(asked.select("query_id", "query"), whole=True)[0] if agentic else self.search(asked.select("query_id", "query"), sources, failed=failed)
            found = evaluate.graded(hits, asked)
            for some in failed:  # a question that a source fails at scores nothing, whatever the others find
                found = found.join(some, "query_id", "left_anti").unionByName(some, allowMissingColumns=True)
            return found

        spec = {"sources": sources, "agentic": agentic, "split": split, "limit": limit, "config": self.config.fingerprint(), "commit": self.base.meta.get("commit")}
        by = tuple(c for c in ("category", "difficulty") if c in questions.columns)
        return benchmark.run(name, questions, retrieve, evaluate.units(questions), spec, split, limit, by, singly)

    def health(self) -> dict:
        """Which indexes there are, of which commit and when they were built."""
        have = {n: getattr(self.base, n) is not None for n in ("index", "vectors", "symbols", "edges")}
        return {"ok": have["index"], "indexes": have, "commit": self.base.meta.get("commit"), "built_at": self.base.meta.get("built_at")}

    def impact(self, names: list[str]) -> DataFrame:
        asked = self.spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("symbol"))
        return symbols.impact(self.base.edges, self.base.chunks, asked)

    def chunk(self, chunk_id: str) -> DataFrame:
        found = self.base.chunks.where(F.col("chunk_id") == chunk_id)
        if found.isEmpty():
            raise KeyError(chunk_id)
        return found
