"""JSONL, text and Parquet scans (SRC1-SRC8) and sinks (SNK1-SNK5), with the order of the lines kept as columns.

A line is stripped and blank lines are dropped before parsing.  Policies: `fail` raises on bad JSON, `skip` drops it.  A
missing path is an empty table where the caller allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ORDER = ("_file", "_block", "_row")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """SRC7: value, and the line's place (_file, _block, _row); the triple sorts as the files do."""
    if missing_ok and not exists(spark, path):
        return spark.range(0).select(F.lit("").alias("value"), F.lit("").alias("_file"), F.lit(0).cast("long").alias("_block"), F.col("id").alias("_row"))
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    return rows.withColumn("value", T.strip("value")).where("value <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str, bad: str = "fail", require: tuple[str, ...] = (), missing_ok: bool = False) -> DataFrame:
    """SRC1, SRC3-SRC6: the schema's columns and the order columns.

    require: keys that must be present; an explicit null is present (FLT9).
    """
    rows = read_lines(spark, path, missing_ok)
    parsed = F.try_parse_json("value")
    if bad == "fail":
        message = F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))
        rows = rows.withColumn("value", F.when(parsed.isNull(), F.raise_error(message).cast("string")).otherwise(F.col("value")))
    else:
        rows = rows.where(parsed.isNotNull())
    for key in require:
        rows = rows.where(F.coalesce(F.array_contains(F.json_object_keys("value"), key), F.lit(False)))
    return rows.select(F.from_json("value", schema).alias("_r"), *ORDER).select("_r.*", *ORDER)


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """PRJ1, PRJ8: nulls of each column filled by its default; a column that is missing is made."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


# The keys of a raw sample.
PROMPT_KEYS, CODE_KEYS = ("prompt", "description", "docstring"), ("code", "solution")


def samples_of(value: Column) -> list[Column]:
    """SRC2, PRJ2, PRJ3: prompt, code and meta (other keys as a map; null if none) of a JSON object."""
    entry = F.from_json(value, "map<string,string>")
    pick = lambda keys: T.first_filled(*[entry[k] for k in keys])
    rest = F.map_filter(entry, lambda k, v: ~k.isin(*PROMPT_KEYS, *CODE_KEYS))
    return [pick(PROMPT_KEYS).alias("prompt"), pick(CODE_KEYS).alias("code"), F.when(F.size(rest) > 0, rest).alias("meta")]


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """SRC2."""
    return read_lines(spark, path).select(*samples_of(F.col("value")), *ORDER)


def read_problems(spark: SparkSession, path: str, key: str = "problem_description") -> DataFrame:
    """SRC3."""
    schema = f"uid string, source string, raw_text string, `{key}` string"
    return with_defaults(read_jsonl(spark, path, schema, "skip", (key,), True).withColumnRenamed(key, "problem_text"), source="UNKNOWN")


def read_skeletons(spark: SparkSession, path: str, problem: str = "problem_text", skeleton: str = "skeleton_code", skip_invalid: bool = True) -> DataFrame:
    """SRC4."""
    schema = f"uid string, source string, `{problem}` string, `{skeleton}` string, function_name string, valid boolean"
    rows = read_jsonl(spark, path, schema, "skip", (problem, skeleton), True).withColumnsRenamed({problem: "problem_text", skeleton: "skeleton_code"})
    rows = rows.where(F.coalesce("valid", F.lit(True))) if skip_invalid else rows
    return with_defaults(rows.drop("valid"), source="UNKNOWN")


def read_implementations(spark: SparkSession, path: str) -> DataFrame:
    """SRC5."""
    rows = read_jsonl(spark, path, "uid string, source string, problem_text string, code string, function_name string", "fail", missing_ok=True)
    return with_defaults(rows, uid="", source="UNKNOWN", problem_text="", code="", function_name="")


RATED = "uid string, source string, problem_text string, code string, function_name string, ratings struct<" + ",".join(f"{d}:int" for d in T.DIMENSIONS) + ">, summary string, raw_rating_text string"


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """SRC6."""
    return read_jsonl(spark, path, RATED, "skip", ("ratings",), True)


def read_rated_lines(spark: SparkSession, path: str) -> DataFrame:
    """STG6's input: bad JSON stays as a row with json_error."""
    rows = read_lines(spark, path)
    entry = F.from_json("value", RATED)
    return rows.select(F.try_parse_json("value").isNull().alias("json_error"), entry.alias("_r"), *ORDER).select("json_error", "_r.*", *ORDER)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: distinct uids, none where there is no file."""
    return read_lines(spark, path, True).select(F.col("value").alias("uid")).distinct()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", order: bool = True) -> None:
    """SNK1, SNK2, SNK5: with nulls, in line order (if df still has it), without the order columns."""
    kept = [c for c in df.columns if c not in ORDER]
    if order and set(ORDER) <= set(df.columns):
        df = df.orderBy(*ORDER)
    df.select(*kept).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_keys(df: DataFrame, path: str) -> None:
    """SNK3: appends uids, one a line."""
    df.select("uid").write.mode("append").text(path)
