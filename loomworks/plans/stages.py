"""The stages (STG1-STG4, STG7-STG11) as DataFrame -> DataFrame functions; sinks and resume state belong to the runner.

Each stage puts the anti-join and the limit before the model call, checks validity before dedup (an invalid text is never
remembered), and returns rows with a status column, of which `kept` selects the successes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python_code import syntax_valid
from ..operators import dedup, filters, ranking
from ..sources.backends import Backend, Calls, generate
from ..sources.scratch import table


def counters(staged: DataFrame) -> DataFrame:
    """AGG11: (status, rows)."""
    return staged.groupBy("status").agg(F.count("*").alias("rows"))


def kept(staged: DataFrame) -> DataFrame:
    return staged.where("status = 'kept'").drop("status", "error", "attempts")


def _finish(rows: DataFrame, status, uid_of: str, order: tuple[str, ...], seen: DataFrame | None) -> DataFrame:
    """Adds uid and status: error, then what `status` says, then duplicate (of an earlier valid row, or of `seen`), else kept.

    The first row of a uid is a map-side combined minimum of the order; it finds its row by that order, which no two rows share, so
    an answer that most rows have is no hot key.
    """
    rows = rows.withColumn("uid", T.uid16(F.coalesce(F.col(uid_of), F.lit("")))).withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise(status))
    rows = table(rows, "answered")
    first = rows.where("status is null").groupBy("uid").agg(F.min(F.struct(*order)).alias("_o"))
    if seen is not None:
        first = dedup.unseen(first, seen)
    first = first.select(*[F.col(f"_o.`{c}`").alias(f"_o{i}") for i, c in enumerate(order)], F.lit(True).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)]
    rows = rows.join(first, same, "left").drop(*[f"_o{i}" for i in range(len(order))])
    return rows.withColumn("status", F.coalesce("status", F.when(F.col("_first"), "kept").otherwise("duplicate"))).drop("_first")


def problems(spark: SparkSession, mode: str, n: int, backend: Callable[[], Backend], seen: DataFrame | None = None, prompt: str | None = None, calls: Calls = Calls()) -> DataFrame:
    """STG1: n requests of one prompt; uid of the problem text."""
    text = F.lit(prompt) if prompt is not None else T.fim_prompt() if mode == "FIM" else T.l2r_prompt()
    asked = generate(ranking.repeat_prompt(spark, text, n), backend, calls=calls, key=("id",))
    rows = asked.select("id", T.strip("response").alias("problem_description"), F.lit(mode).alias("source"), F.col("response").alias("raw_text"), "error", "attempts")
    return _finish(rows, F.when(F.col("problem_description") == "", "empty"), "problem_description", ("id",), seen)


def skeletons(rows: DataFrame, template: str, backend: Callable[[], Backend], order: tuple[str, ...], seen: DataFrame | None = None, limit: int | None = None, calls: Calls = Calls()) -> DataFrame:
    """STG2: rows with problem_text and source; the first `limit` of them."""
    asked = dedup.first_rows(rows, limit, *order).withColumn("prompt", T.skeleton_prompt(template, F.col("problem_text")))
    done = generate(asked, backend, calls=calls, key=order).withColumn("skeleton_code", T.strip("response"))
    done = done.withColumn("_valid", syntax_valid(F.col("skeleton_code"))).withColumn("function_name", T.function_name(F.col("skeleton_code")))
    status = F.when(F.col("skeleton_code") == "", "empty").when(~F.col("_valid"), "invalid_syntax")
    return _finish(done.drop("uid", "prompt", "response"), status, "skeleton_code", order, seen).drop("_valid")


def _body_again(body: str | None, row: dict) -> bool:
    """Whether a body's form asks for another request (FLT11, FLT12): it repeats the head, or has no code.  Empty text does not."""
    text = (body or "").strip()
    return bool(text) and (text.startswith("def ") or all(not s or s.startswith("#") for s in (line.strip() for line in text.split("\n"))))


def implementations(rows: DataFrame, template: str, backend: Callable[[], Backend], order: tuple[str, ...], seen: DataFrame | None = None, limit: int | None = None, validate: bool = True, attempts: int = 2, calls: Calls = Calls()) -> DataFrame:
    """STG3: rows with problem_text, skeleton_code, function_name, source."""
    asked = dedup.first_rows(rows, limit, *order).withColumn("prompt", T.code_prompt(template, F.col("problem_text"), F.col("skeleton_code")))
    done = generate(asked, backend, attempts=attempts, again=_body_again, calls=calls, key=order).withColumn("_body", T.strip("response"))
    done = done.withColumn("code", T.combine(F.col("skeleton_code"), F.col("_body")))
    done = done.withColumn("_valid", syntax_valid(F.col("code")) if validate else F.lit(True))
    status = F.when(F.col("_body") == "", "empty").when(T.starts_with_def(F.col("_body")), "wrong_format").when(~T.has_code(F.col("_body")), "no_code").when(~F.col("_valid"), "invalid_syntax")
    return _finish(done.drop("uid", "prompt", "response"), status, "code", order, seen).drop("_valid", "_body", "skeleton_code")


def _rating_again(low: int, high: int) -> Callable[[str, dict], bool]:
    titles = list(T.DIMENSIONS.values())

    def again(text: str | None, row: dict) -> bool:
        import re

        found = [re.search(r"\s+".join([*t.split(), "Score:"]) + r"\s*(\d+)", text or "", re.I | re.S) for t in titles]
        summary = re.search(r"Summary:\s*(.+?)(?:\n\n|---|\Z)", text or "", re.I | re.S)
        return bool((text or "").strip()) and not (all(m and low <= int(m[1]) <= high for m in found) and summary and summary[1].strip())

    return again


def rated(rows: DataFrame, template: str, backend: Callable[[], Backend], order: tuple[str, ...], seen: DataFrame | None = None, limit: int | None = None, validate: bool = True, low: int = 1, high: int = 5, attempts: int = 2, calls: Calls = Calls()) -> DataFrame:
    """STG4: rows with uid, problem_text, code; rows rated before go first (true resume), and uids may repeat within the input (Q9)."""
    rows = rows if seen is None else dedup.unseen(rows, seen)
    asked = dedup.first_rows(rows, limit, *order).withColumn("prompt", T.rating_prompt(template, F.col("problem_text"), F.col("code")))
    done = generate(asked, backend, attempts=attempts, again=_rating_again(low, high) if validate else None, calls=calls, key=order)
    done = done.withColumn("raw_rating_text", T.strip("response")).withColumn("ratings", T.rating(F.col("raw_rating_text"))).withColumn("summary", T.rating_summary(F.col("raw_rating_text")))
    bad = ~filters.scores_valid(F.col("ratings"), F.col("summary"), low, high) if validate else F.lit(False)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("raw_rating_text") == "", "empty").when(bad, "invalid_scores").otherwise("kept")
    return done.withColumn("status", status).drop("prompt", "response")


def candidates(samples: DataFrame, n: int = 4) -> DataFrame:
    """STG7: prompt, code, score (null) for n stand-in candidates of each sample."""
    rows = ranking.expand_candidates(samples, n)
    return rows.withColumn("code", T.stub_candidate(F.col("i"))).withColumn("score", F.lit(None).cast("double"))


def scored(rows: DataFrame) -> DataFrame:
    """STG8."""
    return ranking.with_perplexity(rows)


def filtered(rows: DataFrame, ratio: float = 0.5, least: int = 16, *ties: str) -> DataFrame:
    """STG9."""
    return ranking.filter_and_keep(rows, ratio, least, *ties)
