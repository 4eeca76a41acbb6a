"""Runs stages over files (STG5, STG6, STG10-STG12, SNK4): paths, resume state and sinks in one place.

Resume state is read from the output itself, so rows and keys can't part (Q8).  Model output is written once before it is
read again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FLUSH, SECTIONS, Config, call_settings, chat_settings, problem_prompt, sampling
from ..operators import chatml, ratings
from ..sources import jsonl
from ..sources.backends import Backend, Calls, Sampling
from ..sources.scratch import delete
from . import stages

#: Templates in use unless the configuration has its own.
TEMPLATES = {
    "skeletons": "Write the signature and docstring of one Python function for this problem.\n\n{{problem}}\n",
    "code": "Write the body of the function.\n\nProblem:\n{{problem}}\n\nFunction:\n{{skeleton}}\n",
    "ratings": "Rate the code from 1 to 5 in five dimensions and sum up.\n\nProblem:\n{{problem_text}}\n\nCode:\n{{code}}\n",
}


class Runner:
    """Stages over <base>/<mode>/<stage>.jsonl, with the parameters that the configuration has for each.

    backend: makes a backend for a stage's sampling.  Answers are kept beside the output until a stage's rows are appended: a run
    that dies is taken up by running the same again, and asks only for what no finished task has an answer to.
    """

    def __init__(self, spark: SparkSession, base: str, backend: Callable[[Sampling], Backend], config: Config | None = None, calls: Calls | None = None):
        self.spark, self.base, self.backend, self.config = spark, base.rstrip("/"), backend, config or Config()
        self.calls = calls or call_settings(self.config)

    def path(self, mode: str, stage: str) -> str:
        return f"{self.base}/{mode.lower()}/{stage}.jsonl"

    def seen(self, mode: str, stage: str) -> DataFrame | None:
        path = self.path(mode, stage)
        return jsonl.read_jsonl(self.spark, path, "uid string", "skip").select("uid").distinct() if jsonl.exists(self.spark, path) else None

    def setting(self, stage: str, name: str, default):
        return self.config.get(f"{SECTIONS[stage]}.{name}", default)

    def template(self, stage: str) -> str:
        return self.config.get(f"prompts.{SECTIONS[stage]}.template") or TEMPLATES[stage]

    def _run(self, mode: str, stage: str, output: str, make: Callable[..., DataFrame]) -> dict[str, int]:
        """Writes all statuses once, then appends the kept rows and drops the answers; returns the counters."""
        target = self.path(mode, output)
        at, log, sampled = f"{target}.staged", f"{target}.answers", sampling(self.config, stage)
        calls, make_backend = replace(self.calls, log=log, flush=int(self.setting(stage, "batch_write_size", FLUSH))), self.backend
        staged = make(backend=lambda: make_backend(sampled), seen=self.seen(mode, output), calls=calls)
        staged.write.mode("overwrite").parquet(at)
        done = self.spark.read.parquet(at)
        drop = [c for c in ("id", *jsonl.ORDER) if c in done.columns]
        kept = stages.kept(done)
        kept.orderBy(*drop).drop(*drop).write.mode("append").option("ignoreNullFields", "false").json(target)
        counted = dict(stages.counters(done).collect())
        delete(self.spark, log)
        return counted

    def problems(self, mode: str, n: int | None = None) -> dict[str, int]:
        n = int(self.setting("problems", "num_samples", 100)) if n is None else n
        prompt = problem_prompt(self.config, mode)
        return self._run(mode, "problems", "problems", lambda **k: stages.problems(self.spark, mode, n, prompt=prompt, **k))

    def skeletons(self, mode: str, n: int | None = None) -> dict[str, int]:
        rows = jsonl.read_problems(self.spark, self.path(mode, "problems"), self.config.get("io.source.problem_text_key", "problem_description")).drop("raw_text")
        return self._run(mode, "skeletons", "skeletons", lambda **k: stages.skeletons(rows, self.template("skeletons"), order=jsonl.ORDER, limit=n, **k))

    def code(self, mode: str, n: int | None = None) -> dict[str, int]:
        rows = jsonl.read_skeletons(self.spark, self.path(mode, "skeletons"), skip_invalid=False)
        validate = bool(self.setting("code", "validate_syntax", True))
        return self._run(mode, "code", "implementations", lambda **k: stages.implementations(rows, self.template("code"), order=jsonl.ORDER, limit=n, validate=validate, **k))

    def ratings(self, mode: str, n: int | None = None) -> dict[str, int]:
        rows = jsonl.read_implementations(self.spark, self.path(mode, "implementations"))
        checks = {"validate": bool(self.setting("ratings", "validate_scores", True)), "low": int(self.setting("ratings", "min_score", 1)), "high": int(self.setting("ratings", "max_score", 5))}
        return self._run(mode, "ratings", "ratings", lambda **k: stages.rated(rows, self.template("ratings"), order=jsonl.ORDER, limit=n, **checks, **k))

    def full(self, mode: str, n: int | None = None) -> dict[str, dict[str, int]]:
        """STG11: problems, skeletons and code."""
        return {"problems": self.problems(mode, n), "skeletons": self.skeletons(mode), "code": self.code(mode)}

    def analyze(self, folder: str) -> str:
        """STG5: the report over both modes' ratings; written beside plots (if they can be drawn) in a local folder."""
        both = ratings.by_mode(*[jsonl.read_ratings(self.spark, self.path(m, "ratings")) for m in ratings.MODES])
        scored = ratings.scores(both)
        stats = ratings.collected(ratings.statistics(scored))
        text = ratings.report(stats)
        Path(folder).mkdir(parents=True, exist_ok=True)
        Path(folder, "statistics_report.txt").write_text(text, encoding="utf-8")
        ratings.plots(stats, ratings.histogram(scored), folder)
        return text

    def convert(self, mode: str) -> dict:
        """STG6: chat records in input order, and the conversion's counters."""
        return convert_file(self.spark, self.path(mode, "ratings"), self.path(mode, "chatml"), **chat_settings(self.config))


def convert_file(spark: SparkSession, source: str, target: str, thresholds: dict[str, int] = chatml.THRESHOLDS, require_all: bool = True, fields: tuple[str, ...] = chatml.FIELDS) -> dict:
    """STG6 on files: one parse of the code, written with its status, gives both the counters and the records."""
    staged = f"{target}.staged"
    chatml.chat_status(jsonl.read_rated_lines(spark, source), thresholds, require_all).write.mode("overwrite").parquet(staged)
    done = spark.read.parquet(staged)
    rows = done.where(F.col("status") == "success").select(*[f for f in fields if f in done.columns], *jsonl.ORDER)
    jsonl.write_jsonl(rows, target)
    return chatml.conversion_stats(done).first().asDict()


def generate_candidates(spark: SparkSession, source: str, target: str, n: int = 4) -> None:
    """STG7 on files."""
    rows = jsonl.read_samples(spark, source).drop("code", "meta")
    out = stages.candidates(rows, n).orderBy(*jsonl.ORDER, "i").select("prompt", "code", "score")
    jsonl.write_jsonl(out, target)


def score_file(spark: SparkSession, source: str, target: str) -> None:
    """STG8 on files."""
    jsonl.write_jsonl(stages.scored(jsonl.read_jsonl(spark, source, "prompt string, code string, score double")), target)


def filter_file(spark: SparkSession, source: str, target: str, ratio: float = 0.5, least: int = 16) -> None:
    """STG9 on files; the order is that of the scores."""
    rows = jsonl.read_jsonl(spark, source, "prompt string, code string, score double, ppl double")
    best = stages.filtered(rows, ratio, least, *jsonl.ORDER)
    jsonl.write_jsonl(ranking_order(best), target, order=False)


def ranking_order(rows: DataFrame) -> DataFrame:
    from ..operators.ranking import by_perplexity

    return by_perplexity(rows, *jsonl.ORDER)
