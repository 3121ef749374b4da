"""Tables in the folder that driver and executors share.

Intermediate results are Parquet tables below the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import hashlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of each session that names none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a local session (one machine, as in
    tests) gets a temporary folder and any other session uses its warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if app not in _own:
            alone = master == "local" or master.startswith("local[")
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera"
        found = _own[app]
    return found.rstrip("/")


#: Paths that are in use, in the order they were made, for each line of work: a thread that is started by itself has
#: its own, and what ``together`` starts shares that of its caller. So one query's release leaves another's tables alone.
_own_paths: contextvars.ContextVar[list[tuple[SparkSession, str]]] = contextvars.ContextVar("tessera_paths")
_every: list[list[tuple[SparkSession, str]]] = []
_lock = threading.Lock()


def _paths() -> list[tuple[SparkSession, str]]:
    try:
        return _own_paths.get()
    except LookupError:
        new: list[tuple[SparkSession, str]] = []
        _own_paths.set(new)
        with _lock:
            _every.append(new)
        return new


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. It is removed by release, or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    own = _paths()
    with _lock:
        own.append((spark, path))
    return path


def held() -> frozenset[str]:
    """The paths in use in this line of work; release takes them."""
    return frozenset(path for _, path in _paths())


def release(before: frozenset[str] = frozenset(), keep: tuple[str, ...] = ()) -> None:
    """Removes what this line of work has written since ``before``, but for the paths to keep. Whatever is made of the rest must have been written."""
    for spark, path in list(_paths()):
        if path not in before and path not in keep:
            remove(spark, path)


@contextlib.contextmanager
def scratch():
    """Within it, tables are written as ever; at its end, those that it made are removed. What is to stay must have been written or collected."""
    before = held()
    try:
        yield
    finally:
        release(before)


@atexit.register
def _remove_all() -> None:
    for own in list(_every):
        for spark, path in list(own):
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder. A session that has ended leaves it be."""
    with _lock:
        for own in _every:
            own[:] = [x for x in own if x[1] != path]
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Table:
    """A DataFrame written to the shared folder and read again."""

    def __init__(self, df: DataFrame, name: str, compression: str | None = None):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, name)
        df.write.parquet(self.path, compression=compression)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df


#: Rows of a few numbers each up to which a written table is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1 << 18


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has no more than that many of them, else for a sort-merge join.

    Without that mark the size of its files would decide, and repeated values take next to nothing
    there: millions of rows in some megabytes, which a broadcast unpacks in the driver.
    """
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def numbered(rows: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """rows with a column of their places from 1 in that order.

    A range partitioning orders the partitions, each numbers its own rows, and only the number of
    rows of each partition is gathered.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = materialize(sorted_.select(F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().alias("at_"), "*"), "numbered")
    shifts, total = [F.lit(-1), F.lit(0).cast("long")], 1
    for r in table.groupBy("part_").agg(F.count("*").alias("n"), F.min("at_").alias("first")).orderBy("part_").collect():
        shifts += [F.lit(r["part_"]), F.lit(total - r["first"]).cast("long")]
        total += r["n"]
    place = F.col("at_") + F.element_at(F.create_map(*shifts), F.col("part_"))
    return table.select(place.alias(name), *rows.columns)


def _bucketed_name(path: str) -> str:
    return f"tessera_{hashlib.sha1(path.encode()).hexdigest()[:16]}"


def write_bucketed(df: DataFrame, path: str, by: tuple[str, ...], rows_a_bucket: int) -> int:
    """Writes a table hash-bucketed and sorted by some columns; returns the number of buckets. One task writes a bucket, as one file."""
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_a_bucket))
    df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(_bucketed_name(path))
    return buckets


def read_bucketed(spark: SparkSession, path: str, by: tuple[str, ...], buckets: int) -> DataFrame:
    """A table of write_bucketed, in any session: a join on those columns takes its rows as they lie."""
    name, keys = _bucketed_name(path), ", ".join(by)
    if not spark.catalog.tableExists(name):
        columns = spark.read.parquet(path).schema.toDDL()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
