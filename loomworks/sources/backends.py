"""Text generation as a row source (SRC10, SRC11, EXT1-EXT14).

A backend is a plain object with `complete`; it is made once per task from its factory, never pickled (EXT12).  Requests of an
Arrow batch run in a bounded thread pool.  A failed request is a row with an error, not a failed batch (Q7).

Answers are written as tasks finish, so that a job that dies at its end has lost the tasks in flight only (SNK4).
"""

from __future__ import annotations

import hashlib
import json
import math
import threading
import time
import urllib.request
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .scratch import fresh_path


class Backend(Protocol):
    """EXT1, EXT2.  choices: a list of answers to one prompt, or with a suffix to what stands between the two (EXT4)."""

    def complete(self, prompt: str, attempt: int) -> str: ...

    def choices(self, prompt: str, suffix: str | None, attempt: int) -> list[str]: ...

    def token_logprobs(self, text: str) -> Sequence[float | None]: ...


@dataclass(frozen=True)
class Sampling:
    """Parameters of a stage's requests."""

    temperature: float = 1.0
    top_p: float = 1.0
    max_tokens: int = 1024
    stop: tuple[str, ...] = ()
    n: int = 1
    logprobs: int | None = None
    stream: bool = False
    extra: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Calls:
    """How a job's requests are sent.  concurrent and per_second are totals over its tasks (EXT9, EXT14)."""

    concurrent: int = 256
    retries: int = 3
    per_second: float | None = None
    #: Rows of a task, as long as there are at most MOST_TASKS: what is lost when it dies.
    flush: int = 50
    #: Where answers stay until the stage has been written; a fresh folder, unless a run is to be resumed.
    log: str | None = None


MOST_TASKS = 10_000


def cut(text: str, stop: Sequence[str]) -> str:
    """Ends the text at its first stop sequence, as a model server does."""
    ends = [i for s in stop if (i := text.find(s)) >= 0]
    return text[: min(ends)] if ends else text


class StubBackend:
    """A pure function of (prompt, attempt): for tests and dry runs."""

    def __init__(self, answer: Callable[[str, int], str] | None = None, stop: Sequence[str] = ()):
        self.answer, self.stop = answer or self.default, stop

    @staticmethod
    def default(prompt: str, attempt: int) -> str:
        return f"answer {hashlib.sha256(f'{attempt}:{prompt}'.encode()).hexdigest()[:8]}"

    def complete(self, prompt: str, attempt: int) -> str:
        return cut(self.answer(prompt, attempt), self.stop)

    def choices(self, prompt: str, suffix: str | None, attempt: int) -> list[str]:
        return [self.complete(prompt if suffix is None else f"{prompt}\0{suffix}", attempt)]

    def token_logprobs(self, text: str) -> list[float]:
        return [-(1 + b % 7) / 4 for b in text.encode()[:64]]


def base_url(url: str) -> str:
    """FN27: ends in /v1."""
    url = url.rstrip("/")
    return url if url.endswith("/v1") else url + "/v1"


class HttpBackend:
    """EXT3, EXT4, EXT6, EXT13: a server with the common completions API."""

    def __init__(self, url: str, model: str, sampling: Sampling = Sampling(), key: str = "EMPTY", timeout_s: float = 60, chat_for_fim: bool = False, prefix_key: str = "prefix", suffix_key: str = "suffix"):
        self.url, self.model, self.sampling, self.key, self.timeout = base_url(url), model, sampling, key, timeout_s
        self.chat_for_fim, self.prefix_key, self.suffix_key = chat_for_fim, prefix_key, suffix_key

    def body(self, **fields) -> dict:
        """A request: the stage's sampling, what is set in it only, then `fields`."""
        s = self.sampling
        given = {"stop": list(s.stop) or None, "logprobs": s.logprobs}
        out = {"model": self.model, "temperature": s.temperature, "top_p": s.top_p, "max_tokens": s.max_tokens, "n": s.n, "stream": s.stream}
        return out | {k: v for k, v in given.items() if v is not None} | dict(s.extra) | fields

    def _post(self, route: str, body: dict) -> list[dict]:
        """The choices, in order of their index; those of a stream are put together from its pieces."""
        request = urllib.request.Request(f"{self.url}/{route}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return streamed(answer, body["n"]) if body["stream"] else json.load(answer)["choices"]

    def choices(self, prompt: str, suffix: str | None = None, attempt: int = 1) -> list[str]:
        if suffix is None:
            return [_text(c) for c in self._post("completions", self.body(prompt=prompt))]
        if not self.chat_for_fim:
            return [_text(c) for c in self._post("completions", self.body(prompt=prompt, suffix=suffix))]
        asked = self.body(messages=[{"role": "user", "content": ""}]) | {self.prefix_key: prompt, self.suffix_key: suffix}
        return [_text(c) for c in self._post("chat/completions", asked)]

    def complete(self, prompt: str, attempt: int) -> str:
        return self.choices(prompt, None, attempt)[0]

    def token_logprobs(self, text: str) -> list[float | None]:
        """SRC11: an echo request; any error gives none."""
        try:
            return self._post("completions", self.body(prompt=text, max_tokens=0, echo=True, logprobs=1, n=1, stream=False))[0]["logprobs"]["token_logprobs"]
        except (OSError, KeyError, IndexError, TypeError, ValueError):
            return []


def _text(choice: dict) -> str:
    """What a choice says, or a piece of one, of either API."""
    held = choice.get("message") or choice.get("delta")
    return (choice.get("text") if held is None else held.get("content")) or ""


def streamed(lines: Iterable[bytes], n: int) -> list[dict]:
    """EXT3: the pieces of each choice, put together."""
    texts = [""] * n
    for line in lines:
        if line.startswith(b"data:") and line[5:].strip() != b"[DONE]":
            for choice in json.loads(line[5:])["choices"]:
                texts[choice.get("index", 0)] += _text(choice)
    return [{"text": t} for t in texts]


def retried(call: Callable[[], Any], most: int = 3, wait: Callable[[float], None] = time.sleep) -> Any:
    """EXT8: waits 2**n + 0.1 * (n + 1) seconds after the n-th failure (from 0); the last error is raised."""
    for n in range(most):
        try:
            return call()
        except Exception:
            if n == most - 1:
                raise
            wait(2**n + 0.1 * (n + 1))
    raise ValueError("no attempt was allowed")


class Pace:
    """Lets `per_second` callers of all threads through in a second; None holds none back."""

    def __init__(self, per_second: float | None, now: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep):
        self.gap, self.next, self.lock, self.now, self.wait = 1 / per_second if per_second else 0.0, 0.0, threading.Lock(), now, wait

    def __call__(self) -> None:
        if self.gap:
            with self.lock:
                at = max(self.next, self.now())
                self.next = at + self.gap
            self.wait(max(0.0, at - self.now()))


def shares(rows: int, calls: Calls, slots: int) -> tuple[int, int, float | None]:
    """(tasks, threads of a task, requests a second of a task), so that all tasks that run at a time keep to the totals."""
    tasks = max(1, min(math.ceil(rows / calls.flush), MOST_TASKS))
    if calls.concurrent < slots:
        tasks = min(tasks, max(1, calls.concurrent))
    running = min(tasks, slots)
    return tasks, max(1, calls.concurrent // running), calls.per_second / running if calls.per_second else None


def generate(df: DataFrame, factory: Callable[[], Backend], prompt: str = "prompt", attempts: int = 1, again: Callable[[str, dict], bool] | None = None, calls: Calls = Calls(), key: tuple[str, ...] = (), suffix: str | None = None, choices: bool = False, to: str = "response") -> DataFrame:
    """EXT5, EXT6, EXT9-EXT11: adds response, error and attempts; rows keep their other columns, so nothing is zipped by position (JN3).

    again(response, row): asks once more, up to `attempts` times in all.  suffix: a column that makes a request one for the text
    between prompt and suffix.  choices: response is the array of all choices (JN4: see one_per_choice).  key: columns that with the
    prompt tell rows apart; rows whose answer is in calls.log already are not asked again.  The result is a written table.
    """
    spark, columns = df.sparkSession, df.columns
    path = calls.log or fresh_path(spark, "answers")
    asked = df.withColumn("_request", F.sha2(F.to_json(F.struct(prompt, *[s for s in (suffix,) if s], *key)), 256))
    todo, known = asked, answered(spark, path)
    if known is not None:
        todo = asked.join(known.where("error is null").select("_request"), "_request", "left_anti").select(*asked.columns)
    tasks, threads, pace = shares(todo.count(), calls, spark.sparkContext.defaultParallelism)

    def ask(backend: Backend, hold: Pace, row: dict) -> tuple[Any, str | None, int]:
        def once():
            hold()
            if choices:
                return backend.choices(row[prompt], row[suffix] if suffix else None, attempt)
            return backend.choices(row[prompt], row[suffix], attempt)[0] if suffix else backend.complete(row[prompt], attempt)

        text = None
        for attempt in range(1, attempts + 1):
            try:
                text = retried(once, calls.retries)
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"[:500], attempt
            if again is None or not again(text, row):
                break
        return text, None, attempt

    kinds = (pa.list_(pa.string()) if choices else pa.string(), pa.string(), pa.int32())

    def run(batches):
        backend, hold = factory(), Pace(pace)
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                done = list(pool.map(lambda row: ask(backend, hold, row), batch.to_pylist()))
                arrays = [batch[c] for c in (*columns, "_request")] + [pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "_request", to, "error", "attempts"])

    answer = ArrayType(StringType()) if choices else StringType()
    schema = StructType([*asked.schema.fields, StructField(to, answer), StructField("error", StringType()), StructField("attempts", IntegerType())])
    # with this committer a task's file is in place when the task is done, whatever becomes of the job
    todo.repartition(tasks).mapInArrow(run, schema).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    if calls.log:
        found = found.join(asked.select("_request").distinct(), "_request", "left_semi")
        good = found.where("error is null").select("_request").distinct()
        bad = found.where("error is not null").join(good, "_request", "left_anti").dropDuplicates(["_request"])
        found = found.where("error is null").unionByName(bad)
    return found.select(*columns, to, "error", "attempts")


def answered(spark, path: str) -> DataFrame | None:
    """The answers that are kept in a folder, if there are any."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at) or not any(f.getPath().getName().startswith("part-") for f in files.listStatus(at)):
        return None
    return spark.read.parquet(path)


def one_per_choice(df: DataFrame, response: str = "response") -> DataFrame:
    """JN4: a row for each choice, with its place as `choice`; a failed request stays one row without text."""
    others = [c for c in df.columns if c != response]
    return df.select(*others, F.posexplode_outer(response).alias("choice", response))


def logprobs(df: DataFrame, factory: Callable[[], Backend], text: str = "code") -> DataFrame:
    """EXT13's first half: adds logprobs (array<double>)."""
    columns, schema = df.columns, StructType([*df.schema.fields, StructField("logprobs", ArrayType(DoubleType()))])

    def run(batches):
        backend = factory()
        for batch in batches:
            found = pa.array([list(backend.token_logprobs(t or "")) for t in batch[text].to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], found], [*columns, "logprobs"])

    return df.mapInArrow(run, schema)
