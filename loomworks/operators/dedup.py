"""Content-hash dedup and resume (AGG8, AGG11, JN1, JN2, SET1, SRT3, SRT4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking


def first_wins(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """AGG8: of rows with equal keys the first by `order`.  Plans as a window group limit before and after the shuffle."""
    spot = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_spot", spot).where("_spot = 1").drop("_spot")


def unseen(df: DataFrame, seen: DataFrame, key: str = "uid") -> DataFrame:
    """JN1, JN2: rows whose key is not in `seen`; the join's strategy is left to the optimizer and AQE."""
    return df.join(seen.select(key), key, "left_anti")


def new_rows(df: DataFrame, seen: DataFrame | None, text: str, *order: str | Column) -> DataFrame:
    """JN2 + AGG8: with uid of `text`, first wins, and without rows that earlier runs kept."""
    keyed = df.withColumn("uid", T.uid16(F.col(text)))
    return first_wins(keyed if seen is None else unseen(keyed, seen), "uid", *order)


def merged_keys(*seen: DataFrame) -> DataFrame:
    """SET1: the union of key sets."""
    out = seen[0].select("uid")
    for s in seen[1:]:
        out = out.union(s.select("uid"))
    return out.distinct()


def duplicate_counters(df: DataFrame, text: str) -> DataFrame:
    """AGG11: total, unique, duplicates."""
    uid = T.uid16(F.col(text))
    return df.agg(F.count("*").alias("total"), F.count_distinct(uid).alias("unique")).withColumn("duplicates", F.col("total") - F.col("unique"))


def first_rows(df: DataFrame, n: int | None, *order: str | Column) -> DataFrame:
    """SRT3, SRT4, SRT7: the first n by `order` (all, for None), in the partitions of a sorted table, not in one."""
    return df if n is None else ranking.first_of(df, n, *order)
