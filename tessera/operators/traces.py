"""Figures of traces: steps with a name, a duration and a start."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize


def stages(steps: DataFrame, trace: str, name: str, duration: str) -> DataFrame:
    return steps.groupBy(trace, name).agg(F.count("*").alias("calls"), F.round(F.sum(duration), 4).alias("total"))


def recent(steps: DataFrame, trace: str, start: str, limit: int = 50) -> DataFrame:
    """The traces that were active last, newest first."""
    return steps.groupBy(trace).agg(F.max(start).alias("last_ts"), F.count("*").alias("n")).orderBy(F.desc("last_ts"), trace).limit(limit)


def usage(calls: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Totals of model calls (tokens_in, tokens_out, cost) of each trace."""
    return calls.groupBy(trace).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 6).alias("cost"))


def tree(spans: DataFrame, trace: str = "trace_id", deepest: int = 1000) -> DataFrame:
    """spans (trace, span_id, parent_id, name, started_at, duration_ms, tokens, cost) with depth, path, own_ms, and the tokens, cost and spans below, themselves included.

    A span whose parent isn't in its trace is a root, at depth 0; path is the ids from the root to the span. own_ms is a
    span's time without that of its direct children, at least 0. Spans that are each other's ancestors hang on no root and
    are left out. Depths are found level by level, each a join of the last level with the spans; sums go up along the paths.
    """
    rows = materialize(spans.select(F.col(trace).alias("trace"), "span_id", "parent_id", "name", "started_at", "duration_ms", "tokens", "cost"), "spans")
    known = rows.select(F.col("trace").alias("t"), F.col("span_id").alias("s"))
    linked = F.col("trace").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("s"))
    level = materialize(rows.join(known, linked, "left_anti").select("trace", "span_id", F.array("span_id").alias("path")), "level")
    levels = [level]
    for _ in range(deepest):
        up = level.select(F.col("trace").alias("t"), F.col("span_id").alias("s"), F.col("path").alias("above"))
        level = materialize(rows.join(up, linked).select("trace", "span_id", F.concat("above", F.array("span_id")).alias("path")), "level")
        if level.isEmpty():
            break
        levels.append(level)
    else:
        raise RuntimeError(f"spans are more than {deepest} levels deep")
    paths = materialize(functools.reduce(DataFrame.unionByName, levels), "paths")
    placed = rows.join(paths, ["trace", "span_id"])
    children = rows.where("parent_id is not null").groupBy("trace", F.col("parent_id").alias("span_id")).agg(F.sum("duration_ms").alias("of_children"))
    below = placed.select("trace", F.explode("path").alias("span_id"), "tokens", "cost").groupBy("trace", "span_id").agg(F.count("*").alias("all_spans"), F.sum("tokens").alias("all_tokens"), F.round(F.sum("cost"), 6).alias("all_cost"))
    out = placed.join(children, ["trace", "span_id"], "left").join(below, ["trace", "span_id"])
    own = F.greatest(F.lit(0.0), F.round(F.col("duration_ms") - F.coalesce("of_children", F.lit(0.0)), 4))
    return out.select(F.col("trace").alias(trace), "span_id", "parent_id", "name", "started_at", "duration_ms", (F.size("path") - 1).alias("depth"), "path", own.alias("own_ms"), "all_spans", "all_tokens", "all_cost")


def render_tree(placed: DataFrame, trace: str = "trace_id") -> DataFrame:
    """(trace, text): a line for each span of tree, below its parent and indented by its depth; siblings in the order of their ids."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.format_string("%-24s %10.1f ms %10.1f ms own", F.col("name"), F.col("duration_ms").cast("double"), F.col("own_ms").cast("double")))
    return placed.groupBy(trace).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def render(steps: DataFrame, trace: str = "trace_id") -> DataFrame:
    """A text line for each step of a trace, in order of start."""
    line = F.format_string("%-24s %10.1f ms", F.col("name"), F.col("duration_ms").cast("double"))
    return steps.groupBy(trace).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("started_at", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
