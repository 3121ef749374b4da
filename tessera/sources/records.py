"""Documents as files, one a row, that appear together or not at all: df.write.format("records").

Tasks write below a staging folder of the target, and what a failed or repeated task has written stays there unseen. When all have
ended, the driver moves the files of the tasks that count to their places. Readers skip names that begin with an underscore.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address or an absolute path, and the path in it."""
    found, inside = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    return found, inside.rstrip("/")


def safe(name: str) -> str:
    """name as a file's name: no separators, not hidden."""
    return name.replace("/", "_").replace("\\", "_").lstrip("._") or "record"


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has staged."""

    names: list[str] = field(default_factory=list)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.name, self.body = options["path"], options.get("name", "name"), options.get("body", "body")
        self.staging = f"_staging-{uuid.uuid4().hex}"  # one for all tasks of the job

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = place(self.path)
        own, names = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        fs.create_dir(own)
        for row in iterator:
            name = safe(str(row[self.name])) + ".json"
            with fs.open_output_stream(f"{own}/{name}") as out:
                out.write((row[self.body] or "").encode())
            names.append(f"{own}/{name}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = place(self.path)
        for m in messages:
            for staged in m.names if m else []:
                fs.move(staged, f"{root}/{staged.rsplit('/', 1)[-1]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = place(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


class Records(DataSource):
    """Options: path (a folder that driver and executors share), name and body (columns; by default name and body). A file of the same name is replaced."""

    @classmethod
    def name(cls):
        return "records"

    def schema(self):
        return "name string, body string"

    def writer(self, schema, overwrite):
        return _Writer({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)


def put(folder: str, name: str, record: dict, **how) -> str:
    """Writes one record of the driver, whole or not at all; returns its path."""
    fs, root = place(folder)
    fs.create_dir(root)
    side, path = f"{root}/_{uuid.uuid4().hex}", f"{root}/{safe(name)}.json"
    try:
        text = json.dumps(record, default=str, **how)
        with fs.open_output_stream(side) as out:
            out.write(text.encode())
        fs.move(side, path)
    except BaseException:
        if fs.get_file_info(side).type != pafs.FileType.NotFound:
            fs.delete_file(side)
        raise
    return path
