"""Answers from packed evidence. Models are a protocol; the echo model is the offline one."""

from __future__ import annotations

import importlib
import json
import threading
import time
from collections import deque
from collections.abc import Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import estimate_tokens
from .context import citations, validate_citations

#: Calls to a model that a task has under way.
CALLS = 8


class Model(Protocol):
    """What answers a prompt; an instance is sent to the executors."""

    def complete(self, prompt: str, system: str | None = None) -> str: ...


class EchoModel:
    """Cites the first blocks of the evidence that it is given; asked for JSON, it says that it has enough."""

    def __init__(self, most: int = 3):
        self.most = most

    def complete(self, prompt: str, system: str | None = None) -> str:
        import re

        if system and "JSON" in system:
            return json.dumps({"sufficient": True})
        cited = list(dict.fromkeys(re.findall(r"cite as (\[[^\]]+\])", prompt)))[: self.most]
        return "Based on the evidence: " + " ".join(cited)


class HttpModel:
    """A model behind an HTTP endpoint that takes {model, messages} and answers {choices: [{message: {content}}]}.

    The key is read from an environment variable where the call is made, so that it isn't sent along.
    """

    def __init__(self, url: str, name: str, key_variable: str | None = None, seconds: float = 120.0, tokens: int = 1024):
        self.url, self.name, self.key_variable, self.seconds, self.tokens = url, name, key_variable, seconds, tokens

    def complete(self, prompt: str, system: str | None = None) -> str:
        import os
        import urllib.error
        import urllib.request

        messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]
        headers = {"Content-Type": "application/json"}
        if self.key_variable and os.environ.get(self.key_variable):
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        body = json.dumps({"model": self.name, "messages": messages, "max_tokens": self.tokens}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.seconds) as reply:
                return json.load(reply)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            wait = (e.headers.get("Retry-After") or "").strip()
            raise Refused(e.code, float(wait) if wait.replace(".", "", 1).isdigit() else None) from e


class Refused(RuntimeError):
    """An HTTP status instead of an answer, and the seconds after which the endpoint may be asked again, if it says so."""

    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"the model's endpoint answered {status}")
        self.status, self.wait = status, wait


class Retrying:
    """A model that is asked again after a failure, with pauses that double up to a limit, or as long as the reply says.

    A refusal that asking again won't mend (a status of 400 to 499 but 408 and 429) is raised at once.
    """

    def __init__(self, model: Model, attempts: int = 4, pause: float = 1.0, longest: float = 8.0):
        self.model, self.attempts, self.pause, self.longest = model, attempts, pause, longest

    def complete(self, prompt: str, system: str | None = None) -> str:
        for nth in range(self.attempts):
            try:
                return self.model.complete(prompt, system)
            except Exception as e:  # noqa: BLE001  the last failure is raised
                status, wait = getattr(e, "status", None), getattr(e, "wait", None)
                if nth + 1 == self.attempts or (status is not None and 400 <= status < 500 and status not in (408, 429)):
                    raise
                time.sleep(min(self.longest, self.pause * 2**nth) if wait is None else wait)
        raise ValueError("a model needs an attempt at least")


class Pace:
    """Lets calls begin no more often than rate a second; threads wait for their turn."""

    def __init__(self, rate: float | None):
        self.step, self.next, self.lock = (1 / rate if rate else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        if self.step:
            with self.lock:
                at = max(self.next, time.monotonic())
                self.next = at + self.step
            time.sleep(max(0.0, at - time.monotonic()))


def completions(prompts: Iterable[str | None], model: Model, system: str | None = None, calls: int = CALLS, rate: float | None = None) -> Iterator[str | None]:
    """A model's answers in the order of the prompts, of which up to calls are under way at once; None for a null prompt and where the call fails.

    No more than twice as many prompts as calls are held.
    """
    pace = Pace(rate)

    def ask(prompt: str | None) -> str | None:
        if prompt is None:
            return None
        pace.wait()
        try:
            return model.complete(prompt, system)
        except Exception:  # noqa: BLE001  a model may fail in any way
            return None

    with ThreadPoolExecutor(max(1, calls)) as pool:
        under_way: deque[Future] = deque()
        for prompt in prompts:
            under_way.append(pool.submit(ask, prompt))
            if len(under_way) >= 2 * calls:
                yield under_way.popleft().result()
        while under_way:
            yield under_way.popleft().result()


def asked(rows: DataFrame, prompt: Column, model: Model, system: str | None = None, calls: int = CALLS, rate: float | None = None, tasks: int | None = None) -> DataFrame:
    """rows with a column reply: a model's answers to a prompt, null where there is none.

    Each task has up to calls of them under way. With a rate (calls a second, of all tasks together) rows are dealt to tasks
    partitions, of which each has its share of the rate.
    """
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.withColumn("prompt_", prompt)
    rows = rows.repartition(tasks) if rate else rows
    share = rate / tasks if rate else None

    def run(batches):
        held: deque[pa.RecordBatch] = deque()

        def prompts():
            for batch in batches:
                held.append(batch)
                yield from batch.column(batch.schema.get_field_index("prompt_")).to_pylist()

        out: list[str | None] = []
        for reply in completions(prompts(), model, system, calls, share):
            out.append(reply)
            while held and len(out) >= held[0].num_rows:
                first = held.popleft()
                some, out = out[: first.num_rows], out[first.num_rows :]
                yield pa.RecordBatch.from_arrays([*first.columns[:-1], pa.array(some, pa.string())], names=[*first.schema.names[:-1], "reply"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("reply", T.StringType())]))


def build_model(kind: str, **options) -> Model:
    """echo, none or test: the echo model; an http(s) address: the model behind it, retried; module:name: what that makes."""
    if kind in ("echo", "none", "test"):
        return EchoModel()
    if kind.startswith(("http://", "https://")):
        return Retrying(HttpModel(kind, **{"name": "default"} | options))
    module, _, attribute = kind.partition(":")
    if not attribute:
        raise ValueError(f"unknown model {kind!r}")
    return getattr(importlib.import_module(module), attribute)(**options)


def echo(packed: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, answer, cited): the echo model's answer, in DataFrame functions."""
    at = F.concat(F.lit("["), F.col("path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit("]"))
    kept = packed.where("decision = 'kept'").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= most)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", at.alias("t")))), lambda x: x["t"]), " ")
    return kept.groupBy("query_id").agg(F.concat(F.lit("Based on the evidence: "), said).alias("answer"), F.count("*").alias("cited"))


PROMPT = "Answer the question from the evidence alone and cite each claim as the evidence says.\n\nQuestion: {}\n\n{}"


def generate(questions: DataFrame, evidence: DataFrame, model: Model, calls: int = CALLS, rate: float | None = None) -> DataFrame:
    """(query_id, query, text, tokens_in, tokens_out): a model's answers to questions (query_id, query) from evidence (query_id, evidence).

    A failing call leaves a null text; the rows stay.
    """
    rows = questions.join(evidence, "query_id", "left").select("query_id", "query", F.coalesce("evidence", F.lit("")).alias("evidence"))

    prompt = F.format_string(PROMPT.format("%s", "%s"), F.coalesce("query", F.lit("")), "evidence")
    told = asked(rows.select("query_id", "query", estimate_tokens(prompt).cast("long").alias("tokens_in"), "evidence"), prompt, model, calls=calls, rate=rate)
    count = F.when(F.coalesce(F.length("reply"), F.lit(0)) > 0, estimate_tokens(F.col("reply"))).otherwise(0).cast("long")
    return told.select(F.col("query_id").cast("long").alias("query_id"), "query", F.col("reply").alias("text"), "tokens_in", count.alias("tokens_out"))


def answer(questions: DataFrame, evidence: DataFrame, blocks: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Answers, and what they cite checked against the blocks (query_id, row_id, rank, path, start_line, end_line)."""
    told = generate(questions, evidence, model)
    return told, validate_citations(citations(told.where("text is not null")), blocks)


JUDGE = 'Score the answer against the expected one. Reply in JSON: {{"correctness": 0-2, "faithfulness": 0-2}}\n\nQuestion: {}\nExpected: {}\nAnswer: {}'


def judge(answers: DataFrame, model: Model, calls: int = CALLS, rate: float | None = None) -> DataFrame:
    """(query_id, correctness, faithfulness) of answers (query_id, query, expected, text), each 0..1; null where the model's reply has none."""
    from ..functions.text import extract_json, tolerant_int

    filled = F.format_string(JUDGE.format("%s", "%s", "%s"), *(F.coalesce(c, F.lit("")) for c in ("query", "expected", "text")))
    told = asked(answers.select("query_id", "query", "expected", "text"), filled, model, "Reply in JSON.", calls, rate).select("query_id", "reply")
    found = told.withColumn("json", extract_json(F.col("reply")))
    value = lambda name: F.greatest(F.least(tolerant_int(F.get_json_object("json", f"$.{name}")), F.lit(2)), F.lit(0)) / 2
    return found.select("query_id", value("correctness").alias("correctness"), value("faithfulness").alias("faithfulness"))
