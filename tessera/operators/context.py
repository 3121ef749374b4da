"""Packing evidence under a token budget, and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import estimate_tokens, parse_citations, truncate
from ..plans.storage import materialize, small

_SPANS = "array<struct<path:string,s:int,e:int,kind:string,tokens:int>>"


def pack(hits: DataFrame, budget: int = C.BUDGET, chunk_tokens: int = C.CHUNK_TOKENS, per_file: int = C.PER_FILE, quotas: dict[str, float] | None = None) -> DataFrame:
    """(query_id, row_id, rank, tokens, decision) for hits that carry their chunk's columns.

    In rank order, a hit is dropped when it overlaps a kept one of its file (commits don't),
    when its file has per_file kept ones, when its kind is over its quota and the total over
    80 % of the budget, or when it exceeds the budget; else it is kept. The fold is one
    aggregate over the ranked array of a query, whose depth retrieval bounds.
    """
    quotas = C.QUOTAS if quotas is None else quotas
    tokens = estimate_tokens(truncate(F.col("content"), chunk_tokens))
    item = F.struct("rank", "row_id", "path", F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("artifact_type").alias("kind"), tokens.alias("tokens"))
    ranked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    share = F.create_map(*(F.lit(x) for kind, q in quotas.items() for x in (kind, int(budget * q)))) if quotas else F.lit(None).cast("map<string,int>")
    start = F.struct(F.array().cast(_SPANS).alias("kept"), F.lit(0).alias("total"), F.array().cast("array<string>").alias("said"))

    def step(acc, x):
        kept, total = acc["kept"], acc["total"]
        overlaps = (x["kind"] != "commit") & F.exists(kept, lambda k: (k["path"] == x["path"]) & ~((k["e"] < x["s"]) | (x["e"] < k["s"])))
        used = F.aggregate(F.filter(kept, lambda k: k["kind"] == x["kind"]), F.lit(0), lambda s, k: s + k["tokens"])
        after = total + x["tokens"]
        quota = F.element_at(share, x["kind"])
        said = (
            F.when(overlaps, "overlap")
            .when(F.size(F.filter(kept, lambda k: k["path"] == x["path"])) >= per_file, "file cap")
            .when(quota.isNotNull() & (used + x["tokens"] > quota) & (after > C.SOFT_SHARE * budget), "quota")
            .when(after > budget, "budget")
            .otherwise("kept")
        )
        own = F.array(F.struct(x["path"].alias("path"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["tokens"].alias("tokens")))
        good = said == "kept"
        return F.struct(F.when(good, F.concat(kept, own)).otherwise(kept).alias("kept"), F.when(good, after).otherwise(total).alias("total"), F.concat(acc["said"], F.array(said)).alias("said"))

    folded = ranked.withColumn("said", F.aggregate("items", start, step, lambda acc: acc["said"]))
    each = folded.select("query_id", F.explode(F.arrays_zip("items", "said")).alias("z"))
    return each.select("query_id", F.col("z.items.row_id").alias("row_id"), F.col("z.items.rank").alias("rank"), F.col("z.items.tokens").alias("tokens"), F.col("z.said").alias("decision"))


def overlapping(spans: DataFrame, band: int = 64) -> DataFrame:
    """(path, a, b) of spans (path, id, start_line, end_line): pairs of one file whose lines meet, a before b.

    Spans meet in the bands of lines that both touch and a pair counts in its first one, so that
    a long file is no cross product of its spans.
    """
    first, last = F.floor(F.col("start_line") / band), F.floor(F.greatest("start_line", "end_line") / band)
    each = spans.select("path", "id", "start_line", "end_line", F.explode(F.sequence(first, last)).alias("band"))
    side = lambda x: each.select("path", "band", F.col("id").alias(x), F.col("start_line").alias(f"{x}s"), F.col("end_line").alias(f"{x}e"))
    met = side("a").join(side("b"), ["path", "band"]).where("a < b and as <= be and bs <= ae")
    return met.where(F.col("band") == F.floor(F.greatest("as", "bs") / band)).select("path", "a", "b")


def related(packed: DataFrame, chunks: DataFrame, graph: DataFrame, budget: int = C.BUDGET, chunk_tokens: int = C.CHUNK_TOKENS) -> DataFrame:
    """(query_id, row_id, tokens): one definition from another file that the top kept block refers to among its first 20 names, if it fits.

    What is looked for among the chunks is written first and as small as the questions, so that it comes to their texts.
    """
    kept = packed.where("decision = 'kept'")
    total = small(materialize(kept.groupBy("query_id").agg(F.sum("tokens").alias("total"), F.min_by("row_id", "rank").alias("row_id")), "tops"))
    tops = chunks.select("row_id", "path", "references").join(total, "row_id")
    names = tops.select("query_id", "total", "path", F.posexplode(F.slice("references", 1, 20)).alias("nth", "full")).withColumn("name", F.substring_index("full", ".", -1))
    first = graph.where("kind = 'definitions' and pos = 1").select("name", F.col("target").alias("chunk_id"))
    named = small(materialize(small(materialize(names, "names")).join(first, "name"), "named"))
    defined = chunks.select("chunk_id", F.col("row_id").alias("found"), F.col("path").alias("of"), estimate_tokens(truncate(F.col("content"), chunk_tokens)).alias("tokens")).join(named, "chunk_id").where("of <> path")
    fresh = defined.join(kept.select("query_id", F.col("row_id").alias("found")), ["query_id", "found"], "left_anti")
    best = fresh.groupBy("query_id").agg(F.min_by(F.struct("found", "total", "tokens"), "nth").alias("b"))
    return best.where(F.col("b.total") + F.col("b.tokens") <= budget).select("query_id", F.col("b.found").alias("row_id"), F.col("b.tokens").alias("tokens"))


def with_related(packed: DataFrame, chunks: DataFrame, graph: DataFrame, budget: int = C.BUDGET, chunk_tokens: int = C.CHUNK_TOKENS) -> DataFrame:
    """packed with each question's related definition, if there is one, kept as its last block."""
    found = related(packed, chunks, graph, budget, chunk_tokens)
    last = packed.groupBy("query_id").agg((F.max("rank") + 1).alias("rank"))
    more = found.join(last, "query_id").select("query_id", "row_id", "rank", "tokens", F.lit("kept").alias("decision"))
    # What was dropped under another decision gives way to the block that is kept now.
    rest = packed.join(more.select("query_id", "row_id"), ["query_id", "row_id"], "left_anti")
    return rest.select("query_id", "row_id", "rank", "tokens", "decision").unionByName(more)


def render(packed: DataFrame, chunks: DataFrame, chunk_tokens: int = C.CHUNK_TOKENS) -> DataFrame:
    """(query_id, evidence): kept blocks in order, each under a header that says how to cite it, cut to the tokens that packing counted."""
    kept = packed.where("decision = 'kept'").join(chunks, "row_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    at = F.concat(F.col("path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"))
    numbered = kept.withColumn("n", F.row_number().over(order))
    block = F.concat(F.lit("<<<EVIDENCE "), F.col("n"), F.lit(" | cite as ["), at, F.lit("]>>>\n"), truncate(F.col("content"), chunk_tokens), F.lit("\n<<<END EVIDENCE "), F.col("n"), F.lit(">>>"))
    return numbered.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("t")))), lambda x: x["t"]), "\n\n").alias("evidence"))


def citations(answers: DataFrame) -> DataFrame:
    """(query_id, pos, path, start_line, end_line): what answers (query_id, text) cite, without repeats."""
    return answers.select("query_id", F.posexplode(parse_citations(F.col("text"))).alias("pos", "c")).select("query_id", "pos", "c.*")


def validate_citations(cited: DataFrame, blocks: DataFrame, slack: int = C.CITATION_SLACK) -> DataFrame:
    """cited with the block (row_id) that it means: one of exactly its lines, else the first whose lines, widened by slack, hold it; null if none."""
    own = blocks.select("query_id", "path", F.col("row_id").alias("block"), F.col("rank").alias("at"), F.col("start_line").alias("bs"), F.col("end_line").alias("be"))
    near = cited.join(own, ["query_id", "path"], "left").where(f"block is null or (start_line >= bs - {slack} and end_line <= be + {slack})")
    exact = (F.col("bs") == F.col("start_line")) & (F.col("be") == F.col("end_line"))
    best = near.where("block is not null").groupBy("query_id", "pos").agg(F.min_by("block", F.struct((~exact).alias("far"), "at")).alias("row_id"))
    return cited.join(best, ["query_id", "pos"], "left").withColumn("valid", F.col("row_id").isNotNull())
