"""What both vector searches share: valid vectors, units of (query block, bucket), and the best of all units."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import buckets_for

#: Rows of a bucket and of a query block in one unit of work.
BUCKET, BLOCK = 4_096, 1_024


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of rows with an id and a vector of finite numbers only."""
    x = F.col("embedding").cast("array<double>")
    ok = F.forall(x, lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")) & ~F.isnan(v), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(ok)


def queries_of(vectors: DataFrame, every: int) -> DataFrame:
    """Each distinct (id, vector) whose id is divisible by `every`."""
    return vectors.where(F.col("vec_id") % every == 0).dropDuplicates()


def matrix(column) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    offsets = np.asarray(column.offsets)
    values, size = np.asarray(column.values)[offsets[0] : offsets[-1]], np.diff(offsets)
    wide = int(size.max()) if len(size) else 0
    if len(size) and (size == wide).all():
        return values.reshape(len(size), wide)
    out = np.zeros((len(size), wide), values.dtype)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)] = values
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x for x in (a, b))


def units(queries: DataFrame, items: DataFrame, bucket: list[str], block: str = "block") -> DataFrame:
    """Each bucket's items beside each block of queries, which differ in is_query alone; the blocks are a stated query set.

    queries: block and columns as items (without the bucket's).  items: bucket columns and blocks (array<int>): those it meets.
    """
    items = items.withColumn(block, F.explode("blocks")).drop("blocks").withColumn("is_query", F.lit(False))
    met = items.select(block, *bucket).distinct().withColumnRenamed(block, "_b")
    asked = queries.join(met, F.col(block) == F.col("_b")).drop("_b").withColumn("is_query", F.lit(True))
    return items.unionByName(asked, allowMissingColumns=True)


def all_blocks(count: int) -> Column:
    return F.sequence(F.lit(0), F.lit(buckets_for(count, BLOCK) - 1))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of found (query_id, query, vec_id, score) per query, with their rank; equal scores by id."""
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
