"""Retrieval and answer metrics, dataset checks, splits, benchmark reports, trace figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import leaf


def grade(path: Column, chunk_id: Column, commit: Column, name: Column, files: Column, chunks: Column, commits: Column, symbols: Column) -> Column:
    """2 for a gold chunk, commit or symbol (by its last part), 1 for a gold file, else 0."""
    has = lambda array, x: F.coalesce(F.array_contains(array, x), F.lit(False))
    by_name = F.exists(symbols, lambda s: leaf(s) == leaf(name))
    return F.when(has(chunks, chunk_id) | has(commits, commit) | F.coalesce(by_name, F.lit(False)), 2).when(has(files, path), 1).otherwise(0)


def gold_units(files: Column, commits: Column, chunks: Column) -> Column:
    """What counts as found: gold files and commit:sha of gold commits, or the gold chunks if there are neither."""
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    named = F.array_union(some(files), F.transform(some(commits), lambda c: F.concat(F.lit("commit:"), c)))
    return F.when(F.size(named) > 0, named).otherwise(F.array_distinct(some(chunks)))


def unit_of(artifact_type: Column, commit: Column, path: Column) -> Column:
    return F.when(artifact_type == "commit", F.concat(F.lit("commit:"), F.coalesce(commit, F.lit("")))).otherwise(path)


def is_multi_hop(difficulty: Column, files: Column) -> Column:
    """A question that is labelled so, or whose answer lies in more than one file."""
    return F.coalesce(difficulty == "multi_hop", F.lit(False)) | (F.size(F.array_distinct(F.coalesce(files, F.array().cast("array<string>")))) > 1)


def graded(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, rank, unit, grade) of hits that carry their chunk's columns, against questions (query_id, relevant_*)."""
    gold = questions.select("query_id", "relevant_files", "relevant_chunks", "relevant_commits", "relevant_symbols")
    both = hits.join(gold, "query_id")
    value = grade(F.col("path"), F.col("chunk_id"), F.col("commit_sha"), F.col("qualified_name"), F.col("relevant_files"), F.col("relevant_chunks"), F.col("relevant_commits"), F.col("relevant_symbols"))
    return both.select("query_id", "rank", unit_of(F.col("artifact_type"), F.col("commit_sha"), F.col("path")).alias("unit"), value.alias("grade"))


def units(questions: DataFrame) -> DataFrame:
    """(query_id, units) of questions."""
    return questions.select("query_id", gold_units(F.col("relevant_files"), F.col("relevant_commits"), F.col("relevant_chunks")).alias("units"))


def evidence_rows(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """hits, each with whether it is gold of its question (is_gold)."""
    found = graded(hits, questions).select("query_id", "rank", (F.col("grade") > 0).alias("is_gold"))
    return hits.join(found, ["query_id", "rank"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))


def browse(questions: DataFrame, category: str | None = None, split_: str | None = None, source: str | None = None, difficulty: str | None = None, contains: str | None = None) -> DataFrame:
    """Questions that fit everything that is given. A source also stands for its family: a fits a:b. contains ignores case."""
    for name, value in (("category", category), ("split", split_), ("difficulty", difficulty)):
        questions = questions if value is None else questions.where(F.col(name) == value)
    if source is not None:
        questions = questions.where((F.col("source") == source) | F.col("source").startswith(source + ":"))
    return questions if contains is None else questions.where(F.contains(F.lower("question"), F.lit(contains.lower())))


def summary(questions: DataFrame) -> DataFrame:
    """(category, source, split, n, multi_hop) of questions: their number and the share that is multi-hop."""
    hop = is_multi_hop(F.col("difficulty"), F.col("relevant_files")).cast("double")
    return questions.groupBy("category", "source", "split").agg(F.count("*").alias("n"), F.round(F.avg(hop), 4).alias("multi_hop"))


def answer_scores(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of an answer's figures (correctness, faithfulness, unsupported, validity, precision, completeness, as far as they are there).

    A figure that is null doesn't count in its mean; judge_failures counts rows without correctness.
    """
    names = [c for c in ("correctness", "faithfulness", "unsupported", "validity", "precision", "completeness") if c in scores.columns]
    figures = [F.round(F.avg(c), 4).alias(c) for c in names]
    failed = [F.count_if(F.col("correctness").isNull()).alias("judge_failures")] if "correctness" in names else []
    grouped = scores.groupBy(*by) if by else scores.groupBy()
    return grouped.agg(F.count("*").alias("n"), *failed, *figures)


def string_keys(value: Column) -> Column:
    """A map with its keys as text, as JSON wants them."""
    return F.transform_keys(value, lambda k, v: k.cast("string"))


def question_metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = C.METRIC_KS) -> DataFrame:
    """One row for each question of gold (query_id, units): recall, precision and ndcg at each k, mrr, first_hit_rank, n_gold.

    hits has (query_id, rank, unit, grade). A question without hits scores 0 throughout.
    """
    ranked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit", "grade"))).alias("h"))
    both = gold.join(ranked, "query_id", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<rank:int,unit:string,grade:int>>")))
    n = F.size("units")
    out = [F.col("query_id"), n.alias("n_gold")]
    dcg = lambda grades: F.aggregate(F.transform(grades, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    for k in ks:
        cut = F.slice(F.col("h"), 1, k)
        grades = F.transform(cut, lambda x: x["grade"])
        found = F.array_intersect(F.transform(F.filter(cut, lambda x: x["grade"] > 0), lambda x: x["unit"]), F.col("units"))
        missed = F.greatest(n - F.size(found), F.lit(0))
        ideal = F.slice(F.sort_array(F.concat(grades, F.array_repeat(F.lit(2), missed)), asc=False), F.lit(1), F.size(grades))
        best = dcg(ideal)
        out += [
            F.when(n > 0, F.round(F.size(found) / n, 6)).otherwise(0.0).alias(f"recall_{k}"),
            F.round(F.size(F.filter(grades, lambda g: g > 0)) / F.lit(float(k)), 6).alias(f"precision_{k}"),
            F.when(best > 0, F.round(dcg(grades) / best, 6)).otherwise(0.0).alias(f"ndcg_{k}"),
        ]
    first = F.array_min(F.transform(F.filter("h", lambda x: x["grade"] > 0), lambda x: x["rank"]))
    return both.select(*out, first.alias("first_hit_rank"), F.coalesce(F.round(1 / first, 6), F.lit(0.0)).alias("mrr"))


def aggregate(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of every metric overall and within each value of each attribute of by, in one pass of grouping sets."""
    names = [c for c in metrics.columns if c.split("_")[0] in ("recall", "precision", "ndcg", "mrr")]
    figures = [F.round(F.avg(c), 4).alias(c) for c in names] + [F.round(F.avg((F.coalesce(F.col("first_hit_rank"), F.lit(1 << 30)) <= 10).cast("double")), 4).alias("hit_rate_10"), F.count("*").alias("n")]
    if not by:
        return metrics.agg(*figures)
    sets = [[], *([F.col(c)] for c in by)]
    return metrics.groupingSets(sets, *(F.col(c) for c in by)).agg(F.grouping_id().alias("level"), *figures)


def citation_metrics(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, n, validity, precision, completeness) of cited (query_id, path, valid) against gold (query_id, files); 0 where a side is empty."""
    per = cited.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("valid")).alias("good"), F.collect_set(F.when(F.col("valid"), F.col("path"))).alias("paths"))
    both = gold.join(per, "query_id", "left")
    hit = F.size(F.array_intersect(F.coalesce("paths", F.array().cast("array<string>")), "files"))
    ratio = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, F.round(a / b, 4)).otherwise(0.0)
    return both.select("query_id", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.col("good"), F.col("n")).alias("validity"), ratio(hit, F.size("paths")).alias("precision"), ratio(hit, F.size("files")).alias("completeness"))


def agreement(pairs: DataFrame) -> DataFrame:
    """(n, labelled, exact, mae) of pairs (judge, human): pairs with both sides count."""
    both = F.col("judge").isNotNull() & F.col("human").isNotNull()
    gap = F.abs(F.col("judge") - F.col("human"))
    return pairs.agg(F.count("*").alias("n"), F.count_if(both).alias("labelled"), F.round(F.avg(F.when(both, (gap < 1e-6).cast("double"))), 4).alias("exact"), F.round(F.avg(F.when(both, gap)), 4).alias("mae"))


def split(id_: Column, dev: float = 0.3) -> Column:
    """dev or test by the first six hex digits of the id's SHA-1."""
    return F.when(F.conv(F.substring(F.sha1(id_.cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 1000 < int(dev * 1000), "dev").otherwise("test")


def sample(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same on every run: those of the smallest hash of the id."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def dataset_problems(questions: DataFrame, paths: DataFrame, chunk_ids: DataFrame, names: DataFrame, commits: DataFrame) -> DataFrame:
    """(id, problem, detail) of questions: repeated ids, empty texts, no gold, and gold that the corpus (path, chunk_id, name, sha) lacks."""
    none = F.lit(None).cast("string")
    golds = ["relevant_files", "relevant_symbols", "relevant_chunks", "relevant_commits"]
    say = lambda df, what, detail=none: df.select("id", F.lit(what).alias("problem"), detail.alias("detail"))
    repeated = questions.groupBy("id").agg(F.count("*").alias("c")).where("c > 1")
    empty = questions.where("question is null or trim(question) = ''")
    bare = questions.where(" and ".join(f"coalesce(size({g}), 0) < 1" for g in golds))

    def missing(column: str, known: DataFrame, key: str, what: str) -> DataFrame:
        each = questions.select("id", F.explode(column).alias("gold"))
        return say(each.join(known.select(F.col(key).alias("gold")).distinct(), "gold", "left_anti"), what, F.col("gold"))

    every = names.select("name").union(names.select(leaf(F.col("name"))))
    out = say(repeated, "duplicate id").unionByName(say(empty, "empty question")).unionByName(say(bare, "no gold"))
    for m in (missing("relevant_files", paths, "path", "unknown path"), missing("relevant_chunks", chunk_ids, "chunk_id", "unknown chunk"), missing("relevant_symbols", every, "name", "unknown symbol"), missing("relevant_commits", commits, "sha", "unknown commit")):
        out = out.unionByName(m)
    return out


def latency(values: DataFrame, by: tuple[str, ...] = (), value: str = "value", bins: int = 4096) -> DataFrame:
    """n, mean, p50, p95 and max; the p-th is the element at n // 2 and at min(int(.95 n), n - 1) of the sorted values.

    A group may be large, so none is sorted or collected: a histogram of each group says in
    which bin an element lies, and only the distinct values of that bin are ordered.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.struct(*by).alias("g") if by else F.lit(0).alias("g"), F.col(value).cast("double").alias("x"))
    whole = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))
    places = F.array(F.struct(F.lit("p50").alias("p"), F.floor(F.col("n") / 2).alias("i")), F.struct(F.lit("p95").alias("p"), F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1).alias("i")))
    share = F.when(F.col("high") > F.col("low"), (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    binned = rows.join(whole.select("g", "low", "high"), "g").select("g", "x", F.floor(share * bins).alias("bin"))
    upto = Window.partitionBy("g").orderBy("bin")
    counted = binned.groupBy("g", "bin").agg(F.count("*").alias("c")).withColumn("below", F.sum("c").over(upto) - F.col("c"))
    wanted = whole.select("g", F.explode(places).alias("w")).select("g", "w.p", "w.i")
    held = counted.join(wanted, "g").where("i >= below and i < below + c").select("g", "bin", "p", (F.col("i") - F.col("below")).alias("i"))
    distinct = binned.groupBy("g", "bin", "x").agg(F.count("*").alias("c"))
    inside = Window.partitionBy("g", "bin", "p").orderBy("x")
    found = distinct.join(held, ["g", "bin"]).withColumn("below", F.sum("c").over(inside) - F.col("c")).where("i >= below and i < below + c")
    picked = found.groupBy("g").agg(F.max(F.when(F.col("p") == "p50", F.col("x"))).alias("p50"), F.max(F.when(F.col("p") == "p95", F.col("x"))).alias("p95"))
    return whole.join(picked, "g").select(*([F.col(f"g.{c}") for c in by]), "n", F.round("mean", 4).alias("mean"), "p50", "p95", F.col("high").alias("max"))


def merge_reports(retrieval: DataFrame, generation: DataFrame) -> DataFrame:
    """Retrieval and generation figures of each system, whose generation name has the prefix gen-; a side may be missing."""
    own = generation.withColumn("system", F.regexp_replace("system", "^gen-", ""))
    return retrieval.join(own, "system", "full")


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of tokens at so much a million."""
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 6)
