"""Tables in the shared folder, and ranks that no single task has to compute."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import delete, shared_folder


_scopes: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    return "/".join([shared_folder(spark), *_scopes[-1:], f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside go when it is left: what is wanted later is read and written elsewhere before."""
    _scopes.append(f"scratch-{uuid.uuid4().hex}")
    names = len(_named)
    try:
        yield
    finally:
        _drop(spark, names)
        delete(spark, f"{shared_folder(spark)}/{_scopes.pop()}")


_named: list[str] = []


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df as a table in buckets by keys: joins and groups by these keys, with as many partitions, don't shuffle it again."""
    spark, name = df.sparkSession, f"loomworks_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    rows.option("compression", "zstd").option("path", fresh_path(spark, "buckets")).saveAsTable(name)
    _named.append(name)
    return spark.table(name)


def _drop(spark: SparkSession, keep: int) -> None:
    while len(_named) > keep:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")


def table(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives the loss of executors."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder."""
    _drop(spark, 0)
    delete(spark, shared_folder(spark))


def buckets_for(rows: int, rows_per_bucket: int) -> int:
    return max(1, math.ceil(rows / rows_per_bucket))


def even_cut(rows: int) -> int:
    """As many parts as each has rows: the table of parts and a single part both grow with the square root of the rows."""
    return max(1, math.isqrt(max(rows, 1) - 1) + 1)


def bucket_of(key: Column, buckets: int) -> Column:
    """Equal ranges of a uniform signed 64-bit key, in its order."""
    return F.least(F.lit(buckets - 1), F.floor((F.shiftright(key, 33) + (1 << 30)) * buckets / (1 << 31)).cast("int"))


def ranked(df: DataFrame, groups: list[str], key: str, ties: list[str], buckets: int, to: str) -> DataFrame:
    """Adds the rank (from 0) of each row in its group by (key, ties), without a task for a whole group.

    key is a uniform signed 64-bit column and orders first.  Each group is cut into ranges of the key; counts per
    range are summed map-side, their prefix sums are offsets, and a window ranks within a range only.
    """
    cut = df.withColumn("_range", bucket_of(F.col(key), buckets))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*groups, "_range").count().select(*groups, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*groups, "_range").orderBy(key, *ties)
    return cut.join(offsets, [*groups, "_range"]).withColumn(to, F.row_number().over(within).cast("long") - 1 + F.col("_offset")).drop("_range", "_offset")


def hidden(df: DataFrame, *shown: str) -> DataFrame:
    """df with its columns under neutral names, and `shown` beside them: nothing that is added can clash with a column."""
    return df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)], *shown)


def restored(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The hidden columns under their own names again, those in `changed` with new values."""
    return df.select(*[changed.get(c, F.col(f"_c{i}")).alias(c) for i, c in enumerate(columns)])


def running(rows: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], none: Column) -> Column:
    """The outputs of step(state, row) -> (state, output) over an array, as an array; none: an empty array of outputs.

    An array that grows by one is copied each time, so the rows are taken in blocks of about the square root of their number.
    """

    def one(done: Column, x: Column) -> Column:
        to, out = step(done["s"], x)
        return F.struct(to.alias("s"), F.concat(done["out"], F.array(out)).alias("out"))

    def fold(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")

        def block(done: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(x, i, size), F.struct(done["s"].alias("s"), none.alias("out")), one)
            return F.element_at(F.transform(F.array(part), lambda p: F.struct(p["s"].alias("s"), F.concat(done["out"], F.array(p["out"])).alias("out"))), 1)

        cuts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        empty = F.slice(F.array(none), 1, 0)
        return F.flatten(F.aggregate(cuts, F.struct(state.alias("s"), empty.alias("out")), block)["out"])

    return F.element_at(F.transform(F.array(rows), fold), 1)
