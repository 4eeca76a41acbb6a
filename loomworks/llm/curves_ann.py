"""Operator 10: nearest neighbours by shifted space-filling curves.

Plan
1. Equal vectors are one node, with the smallest ids of its rows and how often each occurs; they meet within a batch first, so a
   vector of any number of copies is one row a batch.  From here on a copy costs nothing and ties can't hide each other.
2. A node is projected to DIMS directions, shifted, and ordered along a Hilbert curve; CURVES times, each with directions
   of its own (all orthogonal, as long as there are enough) and a shift of its own.  Spark range-partitions the orders by
   (curve, key, node); counts of the partitions make places within them ranks on the curve, whatever partition a node is in.
3. The width of the key windows is measured, not set: for at most SAMPLE queries (the first by a hash of the vector) the true
   neighbours are found by one scan of all nodes; the width is the least at which the share `recall` of them lies within it on
   one curve at least.  Data with structure gets narrow windows, data without gets wide ones.
4. Each curve's order is cut into chunks of CHUNK ranks.  A query goes to all chunks that its window reaches, on either side of
   any partition; in a chunk its best by coarse codes (a byte per component) are picked.
5. The findings of all curves merge, and the best KEEP * k of each query are reranked by exact cosines on the original vectors.

Defined results: as for the exact search; zero vectors take no part either.  Equal scores are ordered by id.  A table without
queries, or with one row, gives no rows.  Shorter vectors count as filled with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from . import vectors as V
from ._store import buckets_for, table

CURVES, DIMS, BITS = 4, 8, 7
#: Ranks of a range partition, of a chunk, and of a block of queries.
PART, CHUNK, BLOCK = 65_536, 8_192, 131_072
#: Queries whose true neighbours set the windows' width, and the share of these that must lie in them.
SAMPLE, RECALL = 256, 0.99
KEEP = 4
_PAIR = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("near", pa.float64())])
_PAIR_SQL = "query long, node long, near double"
_RESULT_SQL = "query_id long, rank int, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of unsigned coordinates) along the Hilbert curve: Skilling's transform, for all rows at once."""
    x, n = cells.astype(np.int64).T.copy(), cells.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def directions(width: int, seed: int) -> list[np.ndarray]:
    """For each curve an orthonormal set of directions; sets are orthogonal to each other until the space is used up."""
    rng, dims = np.random.default_rng([seed, width]), min(DIMS, width)
    found: list[np.ndarray] = []
    while len(found) < CURVES:
        fresh = np.linalg.qr(rng.standard_normal((width, min(width, CURVES * dims))))[0]
        found += [fresh[:, i : i + dims] for i in range(0, fresh.shape[1] - dims + 1, dims)]
    return found[:CURVES]


def curve_keys(unit: np.ndarray, curve: int, along: np.ndarray, seed: int) -> np.ndarray:
    """Keys of unit vectors on one curve, with a shift of its own."""
    shift = np.random.default_rng([seed, curve]).random(along.shape[1])
    place = unit @ along * np.sqrt(unit.shape[1])
    cells = (np.clip((place + 4) / 8, 0, 1) + shift / 2) / 1.5 * ((1 << BITS) - 1)
    return hilbert(cells.astype(np.int64), BITS)


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; each is first brought to components of at most 1, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(1, initial=0)[:, None]
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _read(column, kind: np.dtype, width: int) -> np.ndarray:
    return W.flat(column, kind)[0].reshape(-1, width).astype(float)


def _vectors(batch, kind: np.dtype, width: int) -> np.ndarray:
    """A batch's vectors, filled to the width with zeros, -0 as 0; equal vectors have equal bytes."""
    rows = V.matrix(batch["embedding"])
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))).astype(kind) + kind.type(0)


def _distinct(batches, kind: np.dtype, width: int, k: int):
    """Of each batch every vector once, with the k + 1 smallest ids that it has there, and how often (k at most)."""
    for batch in batches:
        rows = np.ascontiguousarray(_vectors(batch, kind, width))
        if not len(rows):
            continue
        ids, name = np.asarray(batch["vec_id"]), rows.view(f"V{rows.itemsize * width}").ravel()
        _, first, of = np.unique(name, return_index=True, return_inverse=True)
        pairs, times = np.unique(np.stack([of.ravel(), ids]), axis=1, return_counts=True)
        spot = np.arange(len(times)) - np.searchsorted(pairs[0], pairs[0])
        keep = spot <= k
        node, ids, times = pairs[0][keep], pairs[1][keep], np.minimum(times[keep], k)
        found = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(times.astype(np.int64))], ["id", "n"])
        ends = pa.array(np.searchsorted(node, np.arange(len(first) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([W.blobs(rows[first], np.arange(len(first) + 1)), pa.ListArray.from_arrays(ends, found)], ["vector", "ids"])


def _asked(batches, kind: np.dtype, width: int):
    for batch in batches:
        rows = _vectors(batch, kind, width)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], W.blobs(rows, np.arange(len(rows) + 1))], ["query_id", "vector"])


def _keys(batches, kind: np.dtype, width: int, seed: int):
    along = directions(width, seed)
    for batch in batches:
        unit = _units(_read(batch["vector"], kind, width))
        for curve in range(CURVES):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), curve, np.int32)), pa.array(curve_keys(unit, curve, along[curve], seed)), batch["node"]], ["curve", "key", "node"])


def _place(batches):
    """A range partition's number, and each row's place in it."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        spot = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch["curve"], pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(spot), batch["node"]], ["curve", "part", "spot", "node"])


def _top(near: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest; of equal ones the first by `order`."""
    at = np.flatnonzero(near > -2)
    if len(at) > most:
        at = at[near[at] >= np.partition(near[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((order[at], -near[at]))[:most]]


def _pairs(out: list) -> pa.RecordBatch:
    q, node, near = (np.concatenate(x) if x else np.zeros(0) for x in zip(*out)) if out else (np.zeros(0),) * 3
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(node.astype(np.int64)), pa.array(near.astype(float))], schema=_PAIR)


def _scan(batches, kind: np.dtype, width: int, names: np.ndarray, unit: np.ndarray, k: int):
    """The true neighbours of the sample among the nodes of each batch."""
    for batch in batches:
        rows, node = _units(_read(batch["vector"], kind, width)), np.asarray(batch["node"])
        near, out = unit @ rows.T, []
        near[names[:, None] == node] = -2
        for name, x in zip(names, near):
            at = _top(x, node, k)
            out.append((np.full(len(at), name), node[at], x[at]))
        yield _pairs(out)


def _codes(batches, kind: np.dtype, width: int):
    """A byte per component: the angle between two codes is that of their vectors up to rounding."""
    for batch in batches:
        unit = _units(_read(batch["vector"], kind, width))
        code = np.rint(unit / np.abs(unit).max(1)[:, None] * 127).astype(np.int8)
        yield pa.RecordBatch.from_arrays([batch["node"], W.blobs(code, np.arange(len(code) + 1))], ["node", "code"])


def _window(rows: pa.Table, width: int, window: int, most: int) -> pa.Table:
    """A chunk of a curve and the queries of a block whose windows reach it: per query the best of its window here."""
    q, p = rows.filter(rows["is_query"]), rows.filter(pa.compute.invert(rows["is_query"]))
    if not q.num_rows or not p.num_rows:
        return _PAIR.empty_table()
    a, b = (W.flat(x["code"], np.int8)[0].reshape(-1, width).astype(np.float32) for x in (q, p))
    a, b = (x / np.sqrt((x * x).sum(1))[:, None] for x in (a, b))
    names, node = np.asarray(q["node"]), np.asarray(p["node"])
    at, spot = np.asarray(q["rank"]), np.asarray(p["rank"])
    out = []
    for i in range(0, len(a), 512):
        near = a[i : i + 512] @ b.T
        near[(np.abs(at[i : i + 512, None] - spot) > window) | (names[i : i + 512, None] == node)] = -2
        for name, x in zip(names[i : i + 512], near):
            found = _top(x, node, most)
            out.append((np.full(len(found), name), node[found], x[found]))
    return pa.Table.from_batches([_pairs(out)])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with that of b: dot product over the product of lengths.  Sums run from the first component to the last.

    Rows are first brought near 1 by a power of two, which changes no digit, so that squares neither overflow nor vanish.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None]) for x in (a, b))
    total = lambda x: np.add.accumulate(x, 1)[:, -1]
    return total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


def _rerank(batches, kind: np.dtype, width: int):
    """Exact cosines of pairs of vectors."""
    for batch in batches:
        score = cosines(*(_read(batch[c], kind, width) for c in ("asking", "vector")))
        yield pa.RecordBatch.from_arrays([batch["query"], pa.array(score), batch["ids"]], ["query", "score", "ids"])


def _ranks(nodes: DataFrame, count: int, kind: np.dtype, width: int, seed: int) -> DataFrame:
    """(curve, rank, node): each node's place on each curve."""
    keyed = nodes.select("node", "vector").mapInArrow(lambda it: _keys(it, kind, width, seed), "curve int, key long, node long")
    ordered = keyed.repartitionByRange(buckets_for(count * CURVES, PART), "curve", "key", "node").sortWithinPartitions("curve", "key", "node")
    placed = table(ordered.mapInArrow(_place, "curve int, part int, spot long, node long"), "curves")
    size = placed.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("spot").alias("low"))  # a partition may hold the end of one curve and the start of the next
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = size.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("offset"))
    return table(placed.join(offset, ["curve", "part"]).select("curve", (F.col("spot") + F.col("offset")).alias("rank"), "node"), "ranks")


def _measured(nodes: DataFrame, ranks: DataFrame, asked: DataFrame, kind: np.dtype, width: int, k: int, recall: float) -> int:
    """The width at which the share `recall` of the sample's true neighbours lies in a window."""
    sample = nodes.join(asked.select(F.col("query").alias("node")).distinct(), "node", "left_semi").orderBy(F.xxhash64("vector"), "node").limit(SAMPLE).select("node", "vector").collect()
    names = np.array([r[0] for r in sample], np.int64)
    unit = _units(np.frombuffer(b"".join(r[1] for r in sample), kind).reshape(-1, width).astype(float))
    found = nodes.select("node", "vector").mapInArrow(lambda it: _scan(it, kind, width, names, unit, k), _PAIR_SQL)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("near").desc(), "node"))
    pairs = [(r[0], r[1]) for r in found.withColumn("at", best).where(F.col("at") <= k).select("query", "node").collect()]
    wanted = nodes.sparkSession.createDataFrame([(n,) for n in sorted({*names.tolist(), *(n for _, n in pairs)})], "node long")
    place: dict[int, dict[int, int]] = {}
    for r in ranks.join(F.broadcast(wanted), "node").collect():  # at most SAMPLE * (k + 1) nodes
        place.setdefault(r["node"], {})[r["curve"]] = r["rank"]
    apart = [min(abs(place[q][c] - place[n][c]) for c in range(CURVES)) for q, n in pairs]
    return int(np.quantile(apart, recall, method="higher")) if apart else 0


def _blocks(first, last, size: int, most: int):
    """The cuts of `size` ranks that ranks first to last touch."""
    cut = lambda x: F.floor(F.greatest(F.lit(0), F.least(F.lit(most), x)) / size).cast("int")
    return F.sequence(cut(first), cut(last))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, seed: int = 10, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score (cosine): the k nearest found of each query (rows whose id is divisible by `every`).

    recall: the share of the true neighbours of a sample of queries that must lie in the windows.
    """
    spark, kind = vectors.sparkSession, np.dtype(np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64)
    rows = V.valid(vectors).where(F.exists("embedding", lambda x: x != 0))
    wide = rows.agg(F.max(F.size("embedding"))).first()[0]
    if not wide:
        return spark.createDataFrame([], _RESULT_SQL)
    once = rows.mapInArrow(lambda it: _distinct(it, kind, wide, k), "vector binary, ids array<struct<id:long,n:long>>")
    once = once.groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("all"))
    times = lambda i: F.aggregate(F.filter("all", lambda x: x["id"] == i), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    low = F.slice(F.array_sort(F.array_distinct(F.col("all.id"))), 1, k + 1)
    once = once.select("vector", F.transform(low, lambda i: F.struct(i.alias("id"), F.least(times(i), F.lit(k)).alias("n"))).alias("ids"))
    nodes = table(once.withColumn("node", F.monotonically_increasing_id()), "nodes")
    count = nodes.count()
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(lambda it: _asked(it, kind, wide), "query_id long, vector binary").distinct()
    asked = table(asked.join(nodes.select("vector", F.col("node").alias("query")), "vector").select("query_id", "query"), "asked")
    ranks = _ranks(nodes, count, kind, wide, seed)
    window, last = _measured(nodes, ranks, asked, kind, wide, k, recall), count - 1
    # each node's codes beside its ranks, and whether it asks; then to the chunks
    spots = ranks.groupBy("node").agg(F.collect_list(F.struct("curve", "rank")).alias("spots"))
    coded = nodes.select("node", "vector").mapInArrow(lambda it: _codes(it, kind, wide), "node long, code binary").join(spots, "node")
    queries = asked.select(F.col("query").alias("node")).distinct()
    flat = lambda df: df.select("node", "code", F.explode("spots").alias("s")).select("node", "code", "s.curve", "s.rank")
    items, asking = flat(coded), flat(coded.join(queries, "node", "left_semi"))
    chunk = F.floor(F.col("rank") / CHUNK).cast("int")
    items = items.withColumns({"chunk": chunk, "is_query": F.lit(False), "block": F.explode(_blocks(chunk * CHUNK - window, chunk * CHUNK + CHUNK - 1 + window, BLOCK, last))})
    asking = asking.withColumns({"chunk": F.explode(_blocks(F.col("rank") - window, F.col("rank") + window, CHUNK, last)), "is_query": F.lit(True), "block": F.floor(F.col("rank") / BLOCK).cast("int")})
    most = KEEP * k
    found = items.unionByName(asking).groupBy("curve", "chunk", "block").applyInArrow(W.grouped(lambda t: _window(t, wide, window, most)), _PAIR_SQL)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("near").desc(), "node"))
    found = found.groupBy("query", "node").agg(F.max("near").alias("near")).withColumn("at", best).where(F.col("at") <= most)
    found = found.select("query", "node").union(queries.select("node", "node"))  # a query's own node may hold copies
    found = table(found, "found")
    pairs = found.join(nodes.select("node", "vector", "ids"), "node").join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("asking")), "query")
    scored = pairs.select("query", "asking", "vector", "ids").mapInArrow(lambda it: _rerank(it, kind, wide), "query long, score double, ids array<struct<id:long,n:long>>")
    per = scored.select("query", F.transform("ids", lambda x: F.struct((-F.col("score")).alias("far"), x["id"].alias("id"), x["n"].alias("n"))).alias("rows"))
    per = per.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"))  # (KEEP * k + 1) nodes of some ids each
    others = F.filter("rows", lambda x: x["id"] != F.col("query_id"))
    copies = F.flatten(F.transform(others, lambda x: F.array_repeat(F.struct(x["id"].alias("vec_id"), (-x["far"]).alias("score")), x["n"].cast("int"))))
    out = asked.join(per, "query").select("query_id", F.posexplode(F.slice(copies, 1, k)).alias("at", "r"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "r.vec_id", "r.score")


#: The true neighbours.  Where all queries are in the sample and all their neighbours must be in windows, they are what is found.
NEAREST_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) / (q.size * c.size) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
