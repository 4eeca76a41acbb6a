"""Operator 3: uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix (law `rows`).

Plan
1. Equal rows are counted, map-side first, and numbered.  Rows fall into parts by a hash, as many parts as a part has rows.
2. The matrix (part x shard) is drawn exactly, by halving groups of parts: hypergeometric variates of what the group holds of each
   shard, so that each part's counts sum to its size and each shard's to its own, which differ by one at most.  It is
   control data of parts x shards numbers, and grows with the square root of the rows (10**10 rows: 100,000 parts).
3. Each part is permuted by a hash key (a window over one part) and dealt out by its row of the matrix.
4. Each shard is permuted again by another key.  Ranks come from ranges of the key and prefix sums of their counts, so
   no task holds a shard.

Everything on rows is DataFrame functions.  The draw depends on the seed and the rows, so reruns and retries agree.

Defined results: a null text has no bytes, so size 1 and CRC 0.  A null doc_id is a value like any other.  Repeated rows are dealt
like others, each for itself.  With fewer rows than shards the first shards have one row each.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import even_cut, ranked, table

#: Copies of a row that are spread out together.
ROWS = 5_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows drawn without replacement are among the `good`: inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def log_choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - peak
    if u < 0:
        return mode
    up, down, p_up, p_down = mode, mode, peak, peak
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode  # what rounding leaves of the tails


def _split(good: np.ndarray, bad: np.ndarray, draws: np.ndarray, rng: np.random.Generator, exact: random.Random) -> np.ndarray:
    """Hypergeometric variates for arrays of urns; numpy's sampler is exact up to a thousand million rows, larger urns are inverted."""
    small = (good < 10**9) & (bad < 10**9)
    out = np.zeros(len(good), np.int64)
    out[small] = rng.hypergeometric(good[small], bad[small], draws[small])
    for i in np.flatnonzero(~small):
        out[i] = hypergeometric(exact, int(good[i]), int(bad[i]), int(draws[i]))
    return out


def communication_matrix(parts: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts of each part's rows for each shard: a uniform assignment, given all sums.

    All parts' rows are one urn with the shards' capacities.  Each round halves every group of parts and draws what the left half
    has of each shard, so that a round is `shards` draws for all groups at once.
    """
    rng, exact, rows = np.random.default_rng(seed), random.Random(seed), sum(parts)
    wide = 1 << max(0, (len(parts) - 1).bit_length())
    size = np.array(parts + [0] * (wide - len(parts)), np.int64)
    held = np.array([[rows // shards + (s < rows % shards) for s in range(shards)]], np.int64)
    while len(held) < wide:
        groups = size.reshape(2 * len(held), -1).sum(1)
        want, left = groups[::2].copy(), np.zeros_like(held)
        rest = held.sum(1)
        for s in range(shards):
            rest = rest - held[:, s]
            left[:, s] = _split(held[:, s], rest, want, rng, exact)
            want -= left[:, s]
        held = np.stack([left, held - left], 1).reshape(-1, shards)
    return held[: len(parts)]


def shard_rows(df: DataFrame, by: list[str], shards: int = 16, seed: int = 1) -> DataFrame:
    """Adds shard (int) and slot (long, from 0 without gaps): a uniform shuffle of df's rows, which `by` (atomic columns) make up.

    Equal rows are counted first and numbered when they are spread out again: each has keys of its own, whatever their number.
    """
    named = df.groupBy(*by).agg(F.count("*").alias("_times"))
    blocks = named.select(*by, "_times", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / ROWS))).alias("_block"))
    last = F.least(F.col("_times"), (F.col("_block") + 1) * ROWS) - 1
    each = blocks.select(*by, F.explode(F.sequence(F.col("_block") * ROWS, last)).alias("_copy"))
    keys = [F.xxhash64(F.lit(seed + i), *by, "_copy") for i in range(3)]
    parts = max(8, even_cut(df.count()))
    dealt = table(each.select(*by, F.pmod(keys[0], F.lit(parts)).cast("int").alias("_part"), keys[1].alias("_key"), keys[2].alias("_slot_key")), "dealt")
    sizes = dict(dealt.groupBy("_part").count().collect())  # about the square root of the rows
    rows = sum(sizes.values())
    ends = np.cumsum(communication_matrix([sizes.get(p, 0) for p in range(parts)], shards, seed), 1).tolist()
    text = json.dumps([{"_part": p, "_ends": e} for p, e in enumerate(ends)])
    plan = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<_part:int,_ends:array<bigint>>>")))
    local = F.row_number().over(Window.partitionBy("_part").orderBy("_key", *by)) - 1
    dealt = dealt.withColumn("_local", local).join(plan, "_part")
    dealt = dealt.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_local"))))
    sent = table(dealt.drop("_part", "_key", "_local", "_ends"), "shards")
    return ranked(sent, ["shard"], "_slot_key", by, even_cut(-(-rows // shards)), "slot").drop("_slot_key")


def document_shards(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_rows(rows, ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
