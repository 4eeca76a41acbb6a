"""Operator 2: exact top-k by inner product, norm-bucketed.

Plan
1. Vectors become integers; a vector's bucket is its place in a geometric grid of norms (STEP apart), cut into chunks of
   about BUCKET rows by a hash, so that equal norms, or copies of one vector, are many units.
2. Queries of like norms are a block.  The blocks first meet the chunk of greatest norms that has enough rows: its k-th product bounds each query's result.
3. A row is sent to a query block only if its norm and the greatest of the block can reach the block's least bound; buckets
   are matched with blocks first, by a table of norms and bounds.  In the unit, a query's local cosine threshold is
   bound / (its norm * the chunk's greatest norm): over 1, the query is done; below COSINE the chunk is pruned by length, in
   order of falling norms, until what is left can't reach the bound, which rises with each slice; from COSINE on it is pruned by
   length and by the feasible range of the query's largest coordinates.  What is left is verified by its product.
4. The best k of a unit go on; a window merges them per query.

No product that belongs to the result is lost.  Defined results: vectors that are null, hold nulls or non-finite numbers, or have
no id take no part.  Shorter vectors count as filled with zeros.  Rows with the query's id are its own and no candidates.
Queries that repeat are asked once; rows of one id with different vectors are different queries.
Copies among the candidates each count.  No queries, or no candidates: no rows.  Finite numbers of any size take part:
components stay doubles, and products beyond 53 bits are computed in integers of any length.  A score beyond the 64 bits of its
column is the nearest that the column holds (and ties with others there).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from . import vectors as V
from ._store import table

STEP = 1.1
COSINE = 0.5  # from this threshold on coordinates prune
SLICE = 1_024  # rows between two looks at the bound
SLACK = 1 + 1e-9  # for rounding in norms and bounds
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
_OUT = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_SQL = "query_id long, query long, vec_id long, score long"


def _norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(1, initial=0)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1))


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _unit(rows: pa.Table, k: int) -> pa.Table:
    q, p = rows.filter(rows["is_query"]), rows.filter(pa.compute.invert(rows["is_query"]))
    if not q.num_rows or not p.num_rows:
        return _OUT.empty_table()
    a, b = (x.astype(float) for x in V.same_width(V.matrix(q["embedding"]), V.matrix(p["embedding"])))
    qid, pid = np.asarray(q["vec_id"]), np.asarray(p["vec_id"])
    bound = q["bound"].fill_null(LOWEST).to_numpy().copy()
    qn, pn = _norms(a), _norms(b)
    exact = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53
    order = np.argsort(-pn, kind="stable")
    b, pn, pid = b[order], pn[order], pid[order]
    af, bf = (a, b) if exact else (_integers(a), _integers(b))
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2] * len(qid)

    def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x @ y.T if exact else np.clip(x @ y.T, LOWEST, HIGHEST)).astype(np.int64)

    def reach(i, j) -> np.ndarray:
        with np.errstate(over="ignore"):
            return qn[i] * pn[j] * SLACK

    def take(i: int, at: np.ndarray, score: np.ndarray) -> None:
        """The best of what query i has and of rows `at`; its bound rises to the k-th."""
        good = (score >= bound[i]) & (pid[at] != qid[i])
        if not good.any():
            return
        score, ids = np.concatenate([best[i][0], score[good]]), np.concatenate([best[i][1], pid[at[good]]])
        first = np.lexsort((ids, score.view(np.uint64) ^ np.uint64(HIGHEST)))[:k]  # falling scores, which can't all be negated
        best[i] = score[first], ids[first]
        if len(first) == k:
            bound[i] = max(bound[i], score[first[-1]])

    top = reach(slice(None), 0)
    cosine = np.where(top > 0, bound / np.where(top > 0, top, 1), np.where(bound > 0, 2.0, -2.0))
    by_length = np.flatnonzero((cosine <= 1) & (cosine < COSINE))
    for i in range(0, len(by_length), 256):
        live = by_length[i : i + 256]
        for j in range(0, len(pid), SLICE):
            live = live[reach(live, j) >= bound[live]]
            if not len(live):
                break
            at = np.arange(j, min(j + SLICE, len(pid)))
            for row, x in zip(live, products(af[live], bf[at])):
                take(row, at, x)
    unit_b = b / np.where(pn > 0, pn, 1)[:, None]
    for i in np.flatnonzero((cosine <= 1) & (cosine >= COSINE)):
        n = int((reach(i, slice(None)) >= bound[i]).sum())  # norms fall
        keep, t, unit = np.ones(n, bool), cosine[i] * (1 - 1e-9), a[i] / qn[i]
        for f in np.argsort(-np.abs(unit))[:3]:
            width = math.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-9
            keep &= np.abs(unit_b[:n, f] - unit[f] * t) <= width + (1 - t) * abs(unit[f])
        at = np.flatnonzero(keep)
        if len(at):
            take(i, at, products(af[i : i + 1], bf[at])[0])
    size = [len(s) for s, _ in best]
    i, names = np.repeat(np.arange(len(best)), size), np.asarray(q["query"])
    score, ids = (np.concatenate([x[j] for x in best]) for j in (0, 1))
    return pa.Table.from_arrays([pa.array(qid[i]), pa.array(names[i]), pa.array(ids), pa.array(score)], schema=_OUT)


def _whole(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double, which holds it: from 2**53 on doubles are whole."""
    y = F.greatest(F.least(x * scale, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)


def _most(vector: str) -> Column:
    return F.coalesce(F.array_max(F.transform(vector, lambda x: F.abs(x))), F.lit(0.0))


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k largest integer inner products."""
    rows = V.valid(vectors).withColumn("embedding", F.transform("embedding", lambda x: _whole(x, scale))).withColumn("most", _most("embedding"))
    share = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most")))
    norm = F.when(F.col("most") > 0, F.least(F.col("most") * F.sqrt(share), F.lit(sys.float_info.max))).otherwise(0.0)
    rows = table(rows.withColumn("norm", norm).withColumn("grid", F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(STEP))).otherwise(-(1 << 20))), "vectors")
    most = rows.agg(F.max("most")).first()[0] or 0.0
    narrow = "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "double"  # what is sent
    rows = rows.withColumn("embedding", F.col("embedding").cast(f"array<{narrow}>")).drop("most")
    grid = rows.groupBy("grid").agg(F.count("*").alias("n"), F.max("norm").alias("top")).withColumn("chunks", F.ceil(F.col("n") / V.BUCKET))
    items = rows.join(grid, "grid").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("chunks")).cast("int"))
    asked = V.queries_of(rows.select("vec_id", "embedding", "norm", "grid"), every)
    count = asked.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # blocks of queries of like norms: the grid's counts say where a norm's queries begin, a hash spreads them from there
    held = asked.groupBy("grid").agg(F.count("*").alias("held"))
    held = held.withColumn("before", F.sum("held").over(Window.orderBy("grid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held"))
    place = F.col("before") + F.pmod(F.xxhash64("vec_id", "embedding"), F.col("held"))
    asked = asked.join(held, "grid").withColumns({"block": F.floor(place / V.BLOCK).cast("int"), "query": F.xxhash64("embedding")}).drop("grid", "held", "before")
    top = grid.where(F.col("n") > k).orderBy(F.col("grid").desc()).limit(1).first() or grid.orderBy(F.col("grid").desc()).first()
    first = (F.col("grid") == top["grid"]) & (F.col("chunk") == 0)
    columns = ["vec_id", "embedding", "grid", "chunk"]
    head = V.units(asked.drop("norm"), items.where(first).select(*columns, V.all_blocks(count).alias("blocks")), ["grid", "chunk"]).withColumn("bound", F.lit(None).cast("long"))
    head = table(head.groupBy("block", "grid", "chunk").applyInArrow(W.grouped(lambda t: _unit(t, k)), _SQL), "first")
    bound = head.groupBy("query_id", "query").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    bound = bound.select(F.col("query_id").alias("vec_id"), "query", "bound")
    asked = table(asked.join(bound, ["vec_id", "query"], "left"), "asked")
    # blocks that a bucket's, then those that a row's norm can still reach
    least = asked.groupBy("block").agg(F.min(F.coalesce(F.col("bound").cast("double"), F.lit(float("-inf")))).alias("least"), F.max("norm").alias("far"))
    met = grid.join(least, F.col("top") * F.col("far") * SLACK >= F.col("least")).groupBy("grid").agg(F.collect_list(F.struct("block", "far", "least")).alias("met"))
    blocks = F.transform(F.filter("met", lambda x: F.col("norm") * x["far"] * SLACK >= x["least"]), lambda x: x["block"])
    rest = items.where(~first).join(met, "grid").select(*columns, blocks.alias("blocks"))
    tail = V.units(asked.drop("norm"), rest, ["grid", "chunk"]).groupBy("block", "grid", "chunk").applyInArrow(W.grouped(lambda t: _unit(t, k)), _SQL)
    return V.best(head.unionByName(tail), k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
