"""Chat records (PRJ5, PRJ6, STG6): quality, hint, signature and body, with a status per row (AGG9, AGG10)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python_code import signature_and_body, split_function
from .filters import meets_thresholds

# Thresholds of the shipped configuration.
THRESHOLDS = {"problem_design": 4, "function_definition": 4, "correctness": 4, "efficiency": 3, "readability": 4}
FIELDS = ("uid", "messages")


def messages(user: Column, assistant: Column) -> Column:
    """PRJ5: one turn of each."""
    return F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))


def chat_status(records: DataFrame, thresholds: Mapping[str, int] = THRESHOLDS, require_all: bool = True) -> DataFrame:
    """records (uid, problem_text, code, ratings, maybe json_error) with status and messages (null unless success).

    Code is parsed only for rows that pass the quality test: others reach the UDF as null.
    """
    error = F.col("json_error") if "json_error" in records.columns else F.lit(False)
    good = meets_thresholds(F.col("ratings"), thresholds, require_all)
    rows = records.withColumn("_gate", F.when(error, "json_error").when(~good, "quality")).withColumn("_code", F.when(F.col("_gate").isNull(), F.coalesce("code", F.lit(""))))
    rows = rows.withColumn("_f", split_function("_code"))
    ok = F.col("_f.signature").isNotNull() & F.col("_f.body").isNotNull() & (F.col("_f.signature") != "") & (F.col("_f.body") != "")
    rows = rows.withColumn("status", F.coalesce("_gate", F.when(ok, "success").otherwise("parse")))
    user = F.concat(T.drop_hint(F.coalesce("problem_text", F.lit(""))), F.lit("\n\n"), F.col("_f.signature"))
    return rows.withColumn("messages", F.when(F.col("status") == "success", messages(user, F.col("_f.body")))).drop("_gate", "_code", "_f")


def chat_records(records: DataFrame, thresholds: Mapping[str, int] = THRESHOLDS, require_all: bool = True, fields: Sequence[str] = FIELDS) -> DataFrame:
    """STG6's rows: successes only, with the configured fields (PRJ6)."""
    done = chat_status(records, thresholds, require_all).where("status = 'success'")
    return done.select(*[f for f in fields if f in done.columns])


def chat_record(record: Mapping, thresholds: Mapping[str, int] = THRESHOLDS, require_all: bool = True, fields: Sequence[str] = FIELDS) -> dict | None:
    """STG6r: the chat record of one rated sample, on the driver, by the same rules; None if it fails one of them."""
    scores = record.get("ratings") or {}
    reached = [(scores.get(d) or 0) >= t for d, t in thresholds.items()]
    if reached and not (all if require_all else any)(reached):
        return None
    signature, body = signature_and_body(record.get("code") or "")
    if not signature or not body:
        return None
    asked = re.sub(r"(?:^|(?<=\n))\s*Hint:.*\Z", "", record.get("problem_text") or "", flags=re.S).strip()
    turns = [{"role": "user", "content": f"{asked}\n\n{signature}"}, {"role": "assistant", "content": body}]
    return {f: v for f in fields for k, v in (("uid", record.get("uid")), ("messages", turns), ("ratings", scores)) if f == k}


def conversion_stats(status: DataFrame) -> DataFrame:
    """AGG9, AGG10: total, converted, filtered_quality, failed_parse, success_rate (percent)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = status.agg(F.count("*").alias("total"), n("success").alias("converted"), n("quality").alias("filtered_quality"), n("json_error", "parse", "error").alias("failed_parse"))
    return out.withColumn("success_rate", F.when(F.col("total") > 0, F.col("converted") / F.col("total") * 100).otherwise(0.0))
