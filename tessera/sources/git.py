"""Commit history as a data source: spark.read.format("commits").load(path)."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RECORD, FIELD = "\x1e", "\x1f"
#: The body ends in a field mark of its own, so that all of its lines are kept.
FORMAT = FIELD.join(["%x1e%H", "%an", "%aI", "%s", "%b", ""]).replace(FIELD, "%x1f")
SCHEMA = "commit_sha string, author string, timestamp string, subject string, body string, files_changed array<string>, diff string"


def head(path: str) -> str:
    """The commit that a checkout is at; 'unknown' where there is none."""
    done = subprocess.run(["git", "-C", path, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else "unknown"


def records(stream) -> Iterator[str]:
    """Records of a stream, read in blocks."""
    held = ""
    while block := stream.read(1 << 16):
        *whole, held = (held + block).split(RECORD)
        yield from (r for r in whole if r.strip())
    if held.strip():
        yield held


def parse(record: str, most: int) -> tuple:
    sha, author, when, subject, body, tail = record.split(FIELD, 5)
    at = tail.find("diff --git")
    names, diff = (tail, "") if at < 0 else (tail[:at], tail[at:])
    files = [line.split("\t")[-1] for line in names.splitlines() if line.startswith(":")]
    return (sha.strip(), author, when, subject, body.strip(), files, diff[:most])


def git(path: str, *args: str) -> str:
    """What a git command prints; RuntimeError with what it says if it fails."""
    done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise RuntimeError(f"git {args[0]} in {path} ended with {done.returncode}: {done.stderr.strip()[:500]}")
    return done.stdout


@dataclass
class Span(InputPartition):
    """Commits that one task reads."""

    commits: list[str]


class _History:
    """What the batch and the stream reader share: commits are listed once, and tasks read spans of them."""

    def __init__(self, options: dict):
        self.options = options

    def spans(self, *revisions: str) -> list[Span]:
        o = self.options
        which = [] if o.get("merges", "false") == "true" else ["--no-merges"]
        most = [f"--max-count={o.get('maxcommits', '3000')}"]
        found = git(o["path"], "rev-list", *which, *most, *revisions, "--").split()
        size = max(1, int(o.get("span", "200")))
        return [Span(found[at : at + size]) for at in range(0, len(found), size)] or [Span([])]

    def read(self, partition: Span) -> Iterator[tuple]:
        o = self.options
        if not partition.commits:
            return
        command = ["git", "-C", o["path"], "log", "--no-walk=unsorted", "--stdin", f"--format={FORMAT}", "--raw", "--no-abbrev"]
        command += ["--patch"] if o.get("patch", "true") == "true" else []
        with tempfile.TemporaryFile("w+") as asked, tempfile.TemporaryFile("w+") as said:
            asked.write("".join(f"{c}\n" for c in partition.commits))
            asked.seek(0)
            n = 0
            with subprocess.Popen(command, stdin=asked, stdout=subprocess.PIPE, stderr=said, text=True, errors="replace") as run:
                for record in records(run.stdout):
                    n += 1
                    yield parse(record, int(o.get("maxdiff", "4000")))
            if run.returncode or n != len(partition.commits):
                said.seek(0)
                raise RuntimeError(f"git log in {o['path']} ended with {run.returncode} after {n} of {len(partition.commits)} commits: {said.read(500).strip()}")


class _Reader(_History, DataSourceReader):
    def partitions(self):
        # A repository without a commit is empty; anything else that has no head is an error.
        git(self.options["path"], "rev-parse", "--git-dir")
        return [Span([])] if head(self.options["path"]) == "unknown" else self.spans("HEAD")


class _Stream(_History, DataSourceStreamReader):
    """Offsets are commits: a batch has what the newer one reaches and the older one doesn't."""

    def initialOffset(self):
        return {"commit": ""}

    def latestOffset(self):
        git(self.options["path"], "rev-parse", "--git-dir")
        found = head(self.options["path"])
        return {"commit": "" if found == "unknown" else found}

    def partitions(self, start, end):
        if not end["commit"] or start == end:
            return [Span([])]
        return self.spans(end["commit"], *([f"^{start['commit']}"] if start["commit"] else []))


class Commits(DataSource):
    """Options: path (a folder that driver and executors share), maxCommits, maxDiff (characters), patch, merges, span (commits of a task).

    spark.read has the history of HEAD, spark.readStream what is committed from batch to batch.
    """

    @classmethod
    def name(cls):
        return "commits"

    def schema(self):
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema):
        return _Reader(self._options())

    def streamReader(self, schema):
        return _Stream(self._options())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Commits)


def commit_chunks(commits):
    """Chunks of commits: what changed, why, and the first of the diff."""
    from pyspark.sql import functions as F

    files = F.array_join(F.transform(F.slice("files_changed", 1, 40), lambda f: F.concat(F.lit("- "), f)), "\n")
    text = F.concat_ws("\n", F.concat(F.lit("commit "), F.substring("commit_sha", 1, 10)), F.concat(F.lit("author: "), F.col("author")), F.concat(F.lit("date: "), F.substring("timestamp", 1, 10)), F.lit(""), F.col("subject"), F.nullif("body", F.lit("")), F.lit("files:"), files, F.nullif("diff", F.lit("")))
    return commits.select("*", F.lit("commit").alias("artifact_type"), F.lit("commit").alias("symbol_type"), F.lit("diff").alias("language"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.concat(F.lit("commit/"), "commit_sha").alias("path"), text.alias("content"), F.create_map(F.lit("subject"), F.col("subject"), F.lit("body"), F.col("body")).alias("extra")).drop("diff", "subject", "body")
