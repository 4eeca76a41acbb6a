"""Operator 7: packing token sequences by cutting-stock column generation.

Plan
1. One scan tokenizes; a document's ids are cut into full sequences, then a half if more than that is left, then a tail of
   at most half a sequence; each piece leaves as one row.  Whole tails of over a half could not share sequences; with one
   more cut they can.  Where to cut depends on the document's length alone, so ids need no second scan.
2. The histogram of piece lengths (at most `capacity` rows, summed map-side) is all that the driver sees.
3. `patterns`: the linear program over patterns (how many tails of each length fill one sequence) by column
   generation: revised simplex on the lengths' demands, an unbounded knapsack by dynamic programming prices the columns.
   The solution is rounded down; what is left, under one sequence per length, is packed best fit decreasing.
4. Tails are ranked within their length (ranges of a hash key with prefix sums of their counts, so no task holds a
   length) and ranks are looked up in the table of patterns: sequence and offset.

Defined results: a null or empty text is one piece, the end id.  Rows that repeat are packed each.  An empty table gives no rows.
A sequence shorter than the capacity is padded to it, or not at all where its length is a power of two.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import even_cut, ranked, table

CAPACITY = 1024
#: How far the linear program's solution may be from its least, as a share.
GAP = 1e-5
END = 0
_LAST_LATIN = 0x24F


class Encoder:
    """ids as `tokenizers` gives them.  Latin texts go through the faster library with the same vocabulary and merges."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        self.path, self.exact, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or not text or any(s in text for s in self.special) or max(text) > chr(_LAST_LATIN):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def id_type(path: str) -> str:
    """The narrowest type that all ids of a tokenizer fit in: what pieces are written and sent in."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    most = max([END, *held["model"]["vocab"].values(), *(t["id"] for t in held.get("added_tokens", []))])
    return "<u2" if most < 1 << 16 else "<u4"


def _unpack(batches, width: str):
    """Ids as lists again."""
    for batch in batches:
        value, size = W.flat(batch["ids"], np.dtype(width))
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(value.astype(np.int32)))
        yield batch.set_column(batch.schema.get_field_index("ids"), "ids", ids)


def _tokenize(batches, files: tuple, capacity: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("key", pa.int64())] + [("ids", pa.binary())] * with_ids)
    encode, width = Encoder(*files), id_type(files[0])

    def flush():
        arrays = [pa.array(rows[f.name], f.type) for f in schema]
        for x in rows.values():
            x.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    rows: dict[str, list] = {f.name: [] for f in schema}
    for batch in batches:
        for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), batch["text"]):
            ids = np.array([*encode(text.as_py() or ""), END], "<u4")
            full = len(ids) // capacity * capacity
            cuts = [*range(0, full, capacity), *[full] * (full < len(ids)), *[full + capacity // 2] * (len(ids) - full > capacity // 2), len(ids)]
            for start, stop in zip(cuts, cuts[1:]):
                piece = ids[start:stop]
                for name, x in zip(rows, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), key)):
                    rows[name].append(x)
                if with_ids:
                    rows["ids"].append(piece.astype(width).tobytes())
            if len(rows["start"]) >= 10_000:
                yield flush()
        W.release()
    yield flush()


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best total value of sizes within the capacity, each any number of times, and how many of each."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    size, worth = sizes[order], value[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            got = best[c - size[: fits[c]]] + worth[: fits[c]]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], i
    count, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[order[pick[c]]] += 1
            c -= size[pick[c]]
    return float(best[capacity]), count


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """A feasible basis: (patterns as columns, how often, the size that each uses up).

    Each pattern holds the largest size still asked for and the best fill from the others, abundant ones first, and is used
    until some size is used up.  No later pattern has that size, so the patterns are independent.
    """
    m = len(sizes)
    left, columns, often, row = demand.copy(), [], [], []
    for _ in range(m):
        live = np.array([i for i in range(m) if i not in row])
        big = live[-1]
        worth = sizes[live] * (1 + 1e-3 * left[live] / max(left[live].max(), 1e-9))
        _, fill = knapsack(worth, sizes[live], capacity - int(sizes[big]))
        column = np.zeros(m)
        column[live] = fill
        column[big] += 1
        has = np.flatnonzero(column)
        ratio = left[has] / column[has]
        used = has[int(ratio.argmin())]
        n = max(0.0, ratio.min())
        left = np.maximum(left - n * column, 0)
        left[used] = 0
        columns.append(column)
        often.append(n)
        row.append(int(used))
    return np.array(columns).T, np.array(often), row


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Their product in this thread (the driver's BLAS may wait for threads that it does not get)."""
    return np.einsum("ij,j->i", matrix, vector)


def _exchange(inverse: np.ndarray, d: np.ndarray, out: int) -> None:
    """The inverse after column `out` of the basis became the one of which d is the inverse's product."""
    row = inverse[out] / d[out]
    inverse -= d[:, None] * row
    inverse[out] = row


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often): a basic solution of min sum(x) subject to patterns.T @ x = demand, x >= 0.

    Each round prices a new column and exchanges one of the basis.  It ends when no column has a reduced cost below zero, or
    when the solution is proven to be within `gap` (a share) of the least: no solution is below the sum of sizes over the
    capacity, nor below the present one over the best column's value (Farley's bound).  Demands are changed by less than a
    millionth, each by its own amount, so no two exchanges tie and no basis comes back.
    """
    demand = demand * (1 + 1e-7 * (1 + np.arange(len(sizes))) / len(sizes))
    least = float(sizes @ demand) / capacity
    columns, often, row = first_basis(sizes, demand, capacity)
    basis, inverse, x = np.zeros_like(columns), np.eye(len(sizes)), np.zeros(len(sizes))
    for column, n, out in zip(columns.T, often, row):
        _exchange(inverse, times(inverse, column), out)
        basis[:, out], x[out] = column, n
    while True:
        best, column = knapsack(inverse.sum(0), sizes, capacity)
        least = max(least, x.sum() / max(best, 1.0))
        if best <= 1 + 1e-7 or x.sum() - least <= gap * least:
            break
        d = times(inverse, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        n = ratio[out]
        x = np.maximum(x - n * d, 0)
        x[out] = n
        _exchange(inverse, d, out)
        basis[:, out] = column
    return basis.T.round().astype(np.int64), x


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """[(pattern {length: how many}, sequences)] that hold all of the histogram, each length to its exact count."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    out: list[tuple[dict[int, int], int]] = []
    whole = sizes == capacity
    if whole.any():
        out.append(({capacity: 1}, int(left[whole][0])))
    sizes, left = sizes[~whole], left[~whole].copy()
    if len(sizes):
        columns, x = column_generation(sizes, left.astype(float), capacity, gap)
        for i in np.argsort(-x):
            n = int(x[i] + 1e-6)
            has = columns[i] > 0
            if n > 0 and has.any():
                n = min(n, int((left[has] // columns[i][has]).min()))
                if n > 0:
                    left -= n * columns[i]
                    out.append(({int(s): int(k) for s, k in zip(sizes[has], columns[i][has])}, n))
        open_: list[tuple[int, dict[int, int]]] = []  # (room, pattern) of the last sequences, best fit decreasing
        import bisect

        for s, n in zip(sizes[::-1].tolist(), left[::-1].tolist()):
            for _ in range(n):
                at = bisect.bisect_left(open_, s, key=lambda b: b[0])
                room, pattern = open_.pop(at) if at < len(open_) else (capacity, {})
                pattern[s] = pattern.get(s, 0) + 1
                bisect.insort(open_, (room - s, pattern), key=lambda b: b[0])
        out += [(p, 1) for _, p in open_]
    return out


def slots(chosen: list[tuple[dict[int, int], int]]) -> list[dict]:
    """For each length, ranges of ranks: [first, last) go to sequences from `sequence` on, `each` of them in one, from `at` on."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in chosen:
        at = 0
        for size, each in sorted(pattern.items(), reverse=True):
            first = taken.get(size, 0)
            taken[size] = first + n * each
            rows.append({"length": size, "first": first, "last": first + n * each, "each": each, "sequence": sequence, "at": at})
            at += size * each
        sequence += n
    return rows


def pack_documents(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    tokenizer: file of a `tokenizers` tokenizer.  ranks, pattern: the same vocabulary for `tiktoken`, if there is one.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    files = (tokenizer, ranks, pattern)
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, key long" + ", ids binary" * with_ids
    # repeated rows get keys of their own; the pieces are written before any key is used
    texts = docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id", "text", F.monotonically_increasing_id()).alias("key"), "text")
    pieces = table(texts.mapInArrow(lambda it: _tokenize(it, files, capacity, with_ids), columns), "pieces")
    pieces = pieces.withColumn("key", F.xxhash64("key", "start"))
    histogram = dict(pieces.groupBy(F.col("length").cast("int")).count().collect())
    place = json.dumps(slots(patterns(histogram, capacity)))
    kind = "array<struct<length:bigint,first:bigint,last:bigint,each:bigint,sequence:bigint,at:bigint>>"
    ranges = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(place), kind)))
    ranges = ranges.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "last", "each", "sequence", "at"))).alias("ranges"))
    placed = ranked(pieces, ["length"], "key", ["doc_id", "start", "ids_crc32"], even_cut(max(histogram.values(), default=0)), "rank").join(ranges, "length")
    spot = F.element_at(F.filter("ranges", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["last"])), 1)
    placed = placed.withColumn("_r", spot).withColumn("_n", F.col("rank") - F.col("_r.first"))
    sequence = F.col("_r.sequence") + F.floor(F.col("_n") / F.col("_r.each"))
    offset = F.col("_r.at") + F.pmod(F.col("_n"), F.col("_r.each")) * F.col("length")
    placed = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), *["ids"] * with_ids)
    if not with_ids:
        return placed
    width = id_type(tokenizer)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString() if f.name != 'ids' else 'array<int>'}" for f in placed.schema)
    return placed.mapInArrow(lambda it: _unpack(it, width), schema)
