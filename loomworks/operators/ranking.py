"""Sorting and keeping the best (SRT1, SRT2), and candidate expansion (JN5, SRC9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import table
from .filters import code_long_enough

#: Fixed value: where a row without a perplexity sorts.
MISSING = 1e9


def by_perplexity(df: DataFrame, *ties: str | Column, column: str = "ppl") -> DataFrame:
    """SRT1."""
    return df.orderBy(F.coalesce(F.col(column), F.lit(MISSING)), *ties)


def numbered(df: DataFrame, to: str, *order: str | Column) -> DataFrame:
    """Adds each row's place by `order`, from 0, without a task for all of them.

    The rows are sorted into range partitions and written; counts of the partitions are what comes before each.
    """
    spot = {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    rows = table(df.orderBy(*order).withColumns(spot), "sorted")
    size = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    size = size.select("_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("_before"))
    return rows.join(size, "_part").withColumn(to, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def first_of(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows by `order` (ascending), cut exactly; of rows that tie at the cut, any.

    Only the columns of the order are sorted; the row at the cut is a literal in a filter on df, which no shuffle touches.
    """
    if n < 1:
        return df.limit(0)
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"_k{i}") for i, o in enumerate(order)]
    slim = df.select(*keys)
    placed = numbered(slim, "_place", *slim.columns)
    last = placed.where(F.col("_place") == n - 1).first()
    if last is None:
        return df
    cut = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in slim.schema])
    mine, theirs = F.struct(*keys), F.struct(*slim.columns)
    before, same = placed.agg(F.count_if(theirs < cut), F.count_if(theirs.eqNullSafe(cut))).first()
    if before + same == n:
        return df.where(mine <= cut)
    return df.where(mine < cut).unionByName(df.where(mine.eqNullSafe(cut)).limit(n - before))


def keep_best(df: DataFrame, ratio: float, *ties: str | Column, column: str = "ppl") -> DataFrame:
    """SRT2: the best max(1, floor(n * ratio)) rows; no task sees more than a range of them."""
    n = df.count()
    return first_of(df, max(1, int(n * ratio)) if n else 0, F.coalesce(F.col(column), F.lit(MISSING)), *ties)


def filter_and_keep(df: DataFrame, ratio: float = 0.5, least: int = 16, *ties: str | Column) -> DataFrame:
    """STG9's core: FLT8, then SRT1 and SRT2."""
    return keep_best(df.where(code_long_enough(F.col("code"), least, stripped=False)), ratio, *ties)


def with_perplexity(df: DataFrame, code: str = "code", to: str = "ppl") -> DataFrame:
    """PRJ7 with FN20."""
    return df.withColumn(to, T.length_perplexity(F.coalesce(F.col(code), F.lit(""))))


def expand_candidates(df: DataFrame, n: int = 4) -> DataFrame:
    """JN5: each row n times with i from 0; none for n < 1.  A generator in place of a join."""
    if n < 1:
        return df.withColumn("i", F.lit(0).cast("long")).limit(0)
    return df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def repeat_prompt(spark: SparkSession, prompt: Column, n: int) -> DataFrame:
    """SRC9, SRT5: n rows of one prompt, with an id."""
    return spark.range(n).select("id", prompt.alias("prompt"))
