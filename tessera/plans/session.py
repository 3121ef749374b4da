"""What the engine asks of a session."""

from __future__ import annotations

import contextvars
import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from .storage import held


#: Shuffle files go when the query that wrote them has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> SparkSession:
    """Python workers of this session find this package where the driver found it, and what a query has shuffled goes at its end.

    On one machine that is enough; on a cluster the package goes along with --py-files. Steps
    are written as tables, so that no later one reads another's shuffle files.
    """
    spark.conf.set(CLEANUP, "true")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def together(spark: SparkSession, *makers: Callable[[], Any]) -> list:
    """What each of the makers returns. Their jobs are submitted side by side, so that one's few tasks leave no cores idle."""
    held()  # the threads write into the caller's line of work
    with ThreadPoolExecutor(max(1, len(makers))) as pool:
        return [f.result() for f in [pool.submit(contextvars.copy_context().run, inheritable_thread_target(spark)(m)) for m in makers]]


#: Bytes of a table's files that a task gets.
SPREAD_BYTES = 8 << 20


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A Parquet table dealt out by its key in shares of SPREAD_BYTES, to all cores at least: a small file is one row group, which one task would work on alone.

    Whatever is then counted for each key is counted where its row lies, and what a task holds doesn't grow with the table.
    """
    found, where = spark.read.parquet(path), spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return found.repartition(max(spark.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES)), key)
