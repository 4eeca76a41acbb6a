"""Operator 1: exact self-join of documents on the Jaccard similarity of their word n-grams, by vertical partitioning.

Plan
1. `_profiles`: one scan gives each text's set size and a 128-bit name of its n-gram set.  Equal sets are one
   node from here on, so copies are never paired.  The same scan keeps a Misra-Gries summary of its n-grams; from the summaries
   come the hot n-grams (in over 1/(2*HOT) of all texts, and in HEAVY at least; at most 2*HOT times the mean set size of them, so
   their broadcast is bounded) and from the names the hot nodes (at most HOT).
2. `_shared`: n-grams are dealt by ranges of their hash.  A range's task sees all texts that have an n-gram of it and keeps
   only n-grams of two or more nodes, with their document frequency.  Hot n-grams need no count, hot nodes are sent once.
3. `_survivors`: a node's n-grams in global order (frequency, hash).  A pair at the threshold must share an n-gram within
   the first n - ceil(t*n) + 1 of both, so a node whose unshared n-grams fill that prefix has no partner.
4. `_homes`: a prefix n-gram proposes its most central node; the one that most of a node's prefix n-grams propose is its
   home, so near copies come to lie in the same blocks.
5. `_meetings`: small homes are pooled, and nodes are cut into blocks; a block meets, in chunks, the nodes of its own home and those
   of other homes that share a prefix n-gram with it.
6. `_partial`: the global order is cut into FRAGMENTS fragments of about equal weight.  A task has one fragment of one meeting:
   segments of the nodes' n-grams.  It counts the partial overlaps of all pairs.  Segments know how many n-grams are before and
   behind them, so a pair that even full overlap there can't lift to the threshold is left out; any other is sent on.
7. `_total`: partial overlaps are summed per pair; a pair at the threshold is a link.  What leaves the task is a row per
   node: how many rows it links to (copies counted), and the least node of its component within the task.
8. Link counts are summed per node; components of all tasks' components, by smallest name with pointer jumping.

Each pair at or over the threshold is summed in one task of 7 only.

Defined results: null or empty texts, and texts without words, have an empty set, no link, and are their own component.
Repeated rows are one node each and come out once per row.  A null doc_id counts only where its component has
no other id.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._store import hidden, restored, table

HOT = 500
#: n-grams of a range of hashes; n-grams of a block, and of a chunk that it meets.
RANGE, BLOCK, CHUNK = 4_000_000, 400_000, 1_600_000
#: Fragments of the global order.
FRAGMENTS = 4
#: Bytes of text that leave a scan together; n-grams that are summed up together.
SLICE, PILE = 2 << 20, 2_000_000
#: What is in fewer texts is no burden to a task; a node counts as this many n-grams at least, so that a task's pairs are bounded.
HEAVY, LIGHT = 1_000, 1_600
#: Counters of a summary: an n-gram in more than one of so many of a task's n-grams is never missed.
COUNTERS = 500_000
#: So many hits cost as much as one step of a product of matrices.
DENSE = 100
_HOT_DF = 0xFFFF  # frequencies count up to one less


class Summary:
    """Misra and Gries: counts that are too low by at most one in COUNTERS of all that was added."""

    def __init__(self):
        self.seen, self.hits, self.pile, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, value: np.ndarray) -> None:
        self.pile.append(value)
        self.held += len(value)
        if self.held >= PILE:
            self.settle()

    def settle(self) -> None:
        new, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.pile]), return_counts=True)
        self.pile, self.held = [], 0
        self.seen, back = np.unique(np.concatenate([self.seen, new]), return_inverse=True)
        self.hits = np.bincount(back, np.concatenate([self.hits, times]), len(self.seen)).astype(np.int64)
        if len(self.seen) > COUNTERS:
            self.hits -= np.partition(self.hits, len(self.hits) - COUNTERS - 1)[len(self.hits) - COUNTERS - 1]
            self.seen, self.hits = self.seen[self.hits > 0], self.hits[self.hits > 0]

    def over(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        keep = self.hits >= least
        return self.seen[keep], self.hits[keep]


def _profile(batches, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("token", pa.int64()), ("hits", pa.int64())])
    summary, texts = Summary(), 0
    for batch in batches:
        for a, b in W.slices(batch["text"]):
            part = batch.slice(a, b - a)
            value, bounds = W.shingle_sets(part["text"], k)
            names, n = W.set_names(value, bounds), np.diff(bounds)
            node = W.blobs(names, np.arange(len(n) + 1))
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_hash"], pa.array(n), pa.compute.if_else(pa.array(n > 0), node, pa.scalar(None, pa.binary())), none, none], schema=schema)
            texts += len(n)
            summary.add(value)
    seen, hits = summary.over(max(8, texts // (2 * HOT)))
    none = pa.nulls(len(seen), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(seen), pa.binary()), pa.array(seen.view(np.int64)), pa.array(hits)], schema=schema)


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    return table(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lambda it: _profile(it, k), "doc_id long, text_hash long, n long, node binary, token long, hits long"), "profiles")


_SENT = pa.schema([("range", pa.int32()), ("hot", pa.bool_()), ("nodes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
_SHARED = pa.schema([("node", pa.binary()), ("hot", pa.bool_()), ("shared", pa.int64()), ("tokens", pa.binary()), ("dfs", pa.binary())])


def _send(batches, k: int, ranges: int, hot_tokens: np.ndarray, hot_nodes: np.ndarray, hot_ids: np.ndarray):
    """hot_nodes: sorted names; hot_ids: the doc_id that alone sends each of them."""
    for batch in batches:
        for a, b in W.slices(batch["text"], SLICE):
            part = batch.slice(a, b - a)
            value, bounds = W.shingle_sets(part["text"], k)
            yield from _packed(value, np.diff(bounds), W.set_names(value, bounds), part["doc_id"], ranges, hot_tokens, hot_nodes, hot_ids)


def _packed(value, size, name, doc_id, ranges, hot_tokens, hot_nodes, hot_ids):
    """A row per range for the sets of some texts; of equal sets one goes."""
    if len(value):
        key = np.ascontiguousarray(name).view("V16").ravel()
        _, first = np.unique(key, return_index=True)
        sends = np.zeros(len(size), bool)
        sends[first] = True
        sends &= size > 0
        if len(hot_nodes):
            at = np.minimum(np.searchsorted(hot_nodes, name[:, 0]), len(hot_nodes) - 1)
            ids = doc_id.fill_null(-1).to_numpy(zero_copy_only=False)
            is_hot = (hot_nodes[at] == name[:, 0]) & (size > 0)
            sends = np.where(is_hot, hot_ids[at] == ids, sends)
        keep = np.repeat(sends, size)
        text, value = np.repeat(np.arange(len(size), dtype=np.int32), size)[keep], value[keep]
        is_hot = np.isin(value, hot_tokens) if len(hot_tokens) else np.zeros(len(value), bool)
        for hot in (False, True):
            v, t = value[is_hot == hot], text[is_hot == hot]
            if not len(v):
                continue
            f = W.fragment_of(v, ranges) if not hot else W.fragment_of(name[t, 0], ranges)
            order = np.argsort(f.astype(np.uint16) if ranges < 65536 else f, kind="stable")
            f, v, t = f[order], v[order], t[order]
            head = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (t[1:] != t[:-1])]))  # of each (range, text)
            group = np.flatnonzero(np.concatenate([[True], f[head][1:] != f[head][:-1]]))
            counts = np.diff(np.append(head, len(v))).astype(np.uint32)
            ends = np.append(group, len(head))
            yield pa.RecordBatch.from_arrays([pa.array(f[head[group]].astype(np.int32)), pa.array(np.full(len(group), hot)), W.blobs(name[t[head]], ends), W.blobs(counts, ends), W.blobs(v, np.append(head, len(v))[ends])], schema=_SENT)


def _meet(sent: pa.Table) -> pa.Table:
    """The n-grams of a range that two or more nodes have; hot ones, and their nodes, pass through."""
    out = []
    for hot in (False, True):
        rows = sent.filter(pa.compute.equal(sent["hot"], hot))
        if not rows.num_rows:
            continue
        nodes = W.flat(rows["nodes"], np.uint64)[0].reshape(-1, 2)
        counts, value = W.flat(rows["counts"], np.uint32)[0].astype(np.int64), W.flat(rows["tokens"], np.uint64)[0]
        names, node = np.unique(np.ascontiguousarray(nodes).view("V16").ravel(), return_inverse=True)
        node = np.repeat(node.ravel().astype(np.int32), counts)
        if not hot and len(value):
            order = np.argsort(value)
            value = value[order]
            keep = np.zeros(len(value), bool)  # beside an equal n-gram
            keep[1:] = value[1:] == value[:-1]
            keep[:-1] |= keep[1:]
            value, node = value[keep], node[order[keep]]
            del order
        order = np.lexsort((node, value))
        value, node = value[order], node[order]
        if len(value):
            fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (node[1:] != node[:-1])])
            value, node = value[fresh], node[fresh]
            head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            size = np.diff(np.append(head, len(value)))
            df = np.repeat(size, size)
            if hot:
                df = np.full(len(value), _HOT_DF)
            keep = df > 1
            value, node, df = value[keep], node[keep], np.minimum(df[keep], _HOT_DF if hot else _HOT_DF - 1).astype(np.uint16)
        if not len(value):
            continue
        order = np.argsort(node, kind="stable")
        value, node, df = value[order], node[order], df[order]
        head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        ends = np.append(head, len(value))
        names = names[node[head]].view(np.uint64).reshape(-1, 2)
        out.append(pa.Table.from_arrays([W.blobs(names, np.arange(len(head) + 1)), pa.array(np.full(len(head), hot)), pa.array(np.diff(ends)), W.blobs(value, ends), W.blobs(df, ends)], schema=_SHARED))
    return pa.concat_tables(out) if out else _SHARED.empty_table()


def _shared(docs: DataFrame, k: int, profiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row per range and node: its n-grams there that other nodes have too."""
    texts, grams = profiles.where("n is not null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = max(8, -(-grams // RANGE))
    hot = profiles.where("token is not null").groupBy("token").agg(F.sum("hits").alias("hits")).where((F.col("hits") * 2 * HOT >= texts) & (F.col("hits") >= HEAVY))
    hot_tokens = np.sort(np.array([r[0] for r in hot.select("token").collect()], np.int64).view(np.uint64))
    copied = nodes.where((F.col("copies") * HOT >= texts) & (F.col("copies") >= HEAVY) & F.col("low").isNotNull())
    copied = sorted((np.frombuffer(r[0], np.uint64)[0], r[1]) for r in copied.select("node", "low").collect())
    hot_nodes, hot_ids = np.array([x[0] for x in copied], np.uint64), np.array([x[1] for x in copied], np.int64)
    sent = docs.select("doc_id", "text").mapInArrow(lambda it: _send(it, k, ranges, hot_tokens, hot_nodes, hot_ids), "range int, hot boolean, nodes binary, counts binary, tokens binary")
    return W.by_group(sent, ranges, "range", _meet, "node binary, hot boolean, shared long, tokens binary, dfs binary")


def _place(value: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Where n-grams stand in the global order, as whole numbers over 0."""
    return (df.astype(np.int64) << 47) | (value >> np.uint64(17)).astype(np.int64)


def _order(batches, percent: int):
    """Each node's shared n-grams in global order, those of its prefix, and FRAGMENTS evenly spaced places."""
    schema = pa.schema([("node", pa.binary()), ("n", pa.int64()), ("copies", pa.int64()), ("lone", pa.int64()), ("grams", pa.int64()), ("tokens", pa.binary()), ("dfs", pa.binary()), ("prefix", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            value, df = np.frombuffer(b"".join(r["tokens"]), np.uint64), np.frombuffer(b"".join(r["dfs"]), np.uint16)
            order = np.lexsort((value, df))
            value, df = value[order], df[order]
            lone = r["n"] - len(value)
            prefix = r["n"] - -(-percent * r["n"] // 100) + 1 - lone
            marks = _place(value, df)[(np.arange(FRAGMENTS) * 2 + 1) * len(value) // (2 * FRAGMENTS)]
            rows.append({"node": r["node"], "n": r["n"], "copies": r["copies"], "lone": lone, "grams": len(value), "tokens": value.tobytes(), "dfs": df.tobytes(), "prefix": value[:prefix].view(np.int64), "marks": marks})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _survivors(docs: DataFrame, k: int, percent: int, profiles: DataFrame, nodes: DataFrame) -> DataFrame:
    cold, hot = ~F.col("hot"), F.col("hot")
    per_node = _shared(docs, k, profiles, nodes).groupBy("node").agg(
        F.sum(F.when(cold, F.col("shared")).otherwise(0)).alias("shared"),
        F.collect_list(F.when(cold, F.struct("tokens", "dfs"))).alias("parts"),
        F.max(F.when(hot, F.struct("shared", "tokens", "dfs"))).alias("hot"),  # copies of a node send the same
    )
    per_node = per_node.withColumn("shared", F.col("shared") + F.coalesce("hot.shared", F.lit(0)))
    joined = per_node.join(nodes.select("node", "n", "copies"), "node").where((F.col("n") - F.col("shared")) < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    parts = F.concat("parts", F.when(F.col("hot").isNotNull(), F.array(F.struct("hot.tokens", "hot.dfs"))).otherwise(F.array().cast("array<struct<tokens:binary,dfs:binary>>")))
    joined = joined.withColumn("parts", parts).select("node", "n", "copies", F.col("parts.tokens").alias("tokens"), F.col("parts.dfs").alias("dfs"))
    return table(joined.mapInArrow(lambda it: _order(it, percent), "node binary, n long, copies long, lone long, grams long, tokens binary, dfs binary, prefix array<long>, marks array<long>"), "survivors", "lz4")


def _homes(postings: DataFrame) -> DataFrame:
    """(node, home): for each node that shares a prefix n-gram, the node that most of its prefix n-grams propose."""
    centre = postings.groupBy("token").agg(F.min(F.struct((F.col("lone") / F.col("n")).alias("odd"), F.col("node"))).alias("c"), F.count("*").alias("m")).where("m > 1").select("token", F.col("c.node").alias("centre"))
    votes = postings.join(centre, "token").groupBy("node", "centre").count()
    return table(votes.groupBy("node").agg(F.max(F.struct("count", "centre")).alias("h")).select("node", F.col("h.centre").alias("home")), "homes")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by links, for each node that has one.

    Each round takes the least component among neighbours, then jumps to that component's own; rounds grow with
    the logarithm of the longest path.  All is joins and map-side combined minima on written tables.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = table(both.union(links.select(F.col(b), F.col(a))).where("u <> v").distinct(), "edges")
    labels = table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("component")).withColumnRenamed("u", "node"), "labels")
    while True:
        seen = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("low"))
        lower = labels.join(seen, F.col("node") == F.col("u")).select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        to = labels.select(F.col("node").alias("at"), F.col("component").alias("to"))
        jumped = lower.join(to, F.col("component") == F.col("at"), "left").select("node", "old", F.least("component", F.coalesce("to", "component")).alias("component"))
        jumped = table(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where("old != component").isEmpty():
            return labels


_UNIT = "home binary, i long, chunk long"
_SEGMENT = pa.schema([("home", pa.binary()), ("i", pa.int64()), ("chunk", pa.int64()), ("fragment", pa.int32()), ("is_x", pa.bool_()), ("inner", pa.bool_()), ("node", pa.binary()), ("n", pa.int64()), ("copies", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("tokens", pa.binary())])
_PARTIAL = pa.schema([("home", pa.binary()), ("i", pa.int64()), ("chunk", pa.int64())] + [(f"{side}_{c}", pa.binary()) for side in "xy" for c in ("node", "n", "copies")] + [("x", pa.binary()), ("y", pa.binary()), ("overlap", pa.binary())])
_LINK = pa.schema([("node", pa.binary()), ("to", pa.binary()), ("links", pa.int64())])


def _segments(batches, pivots: np.ndarray):
    """Each node's n-grams cut at the pivots of the global order; a segment knows how many are before and behind it."""
    for batch in batches:
        out: list = []
        for r in batch.to_pylist():
            value, df = np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["dfs"], np.uint16)
            cuts = [0, *np.searchsorted(_place(value, df), pivots, "left").tolist(), len(value)]
            for f, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    out.append({"home": r["home"], "i": r["i"], "chunk": r["chunk"], "fragment": f, "is_x": r["is_x"], "inner": r["inner"], "node": r["node"], "n": r["n"], "copies": r["copies"], "head": a, "tail": len(value) - b, "tokens": value[a:b].tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT)


def _overlaps(xv: np.ndarray, xd: np.ndarray, yv: np.ndarray, yd: np.ndarray, wide: int, deep: int) -> np.ndarray:
    """How many n-grams each of `wide` sets shares with each of `deep`: from an inverted list, and where many of both sides have
    an n-gram, as a product of matrices."""
    total = np.zeros((wide, deep), np.int32)
    order = np.argsort(xv, kind="stable")
    tokens, owner = xv[order], xd[order]
    lo, hi = np.searchsorted(tokens, yv, "left"), np.searchsorted(tokens, yv, "right")
    hit = hi > lo
    lo, size, d = lo[hit], (hi - lo)[hit], yd[hit]
    starts, back, times = np.unique(lo, return_inverse=True, return_counts=True)
    first = np.zeros(len(starts), np.int64)
    first[back] = size  # how many of xs have the n-gram; times: how many of ys
    common = first * times * DENSE > wide * deep
    columns = np.flatnonzero(common)
    for i in range(0, len(columns), 2_048):
        part = columns[i : i + 2_048]
        place = np.full(len(starts), -1)
        place[part] = np.arange(len(part))
        left, right = np.zeros((wide, len(part)), np.float32), np.zeros((deep, len(part)), np.float32)
        at = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(first[part])[:-1]]), first[part]) + np.arange(first[part].sum())
        left[owner[at], np.repeat(np.arange(len(part)), first[part])] = 1
        mine = place[back] >= 0
        right[d[mine], place[back][mine]] = 1
        total += (left @ right.T).astype(np.int32)
    rare = ~common[back]
    lo, size, d = lo[rare], size[rare], d[rare]
    for a in range(0, len(lo), 20_000):  # bounds the expanded lists
        s, l, y = size[a : a + 20_000], lo[a : a + 20_000], d[a : a + 20_000]
        at = np.repeat(l - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(s.sum())
        np.add.at(total.reshape(-1), owner[at] * deep + np.repeat(y, s), 1)
    return total


def _needed(xn: np.ndarray, yn: np.ndarray, percent: int) -> np.ndarray:
    """The overlap from which sets of these sizes link."""
    return -(-(xn[:, None] + yn[None, :]) * percent // (100 + percent))


def _partial(rows: pa.Table, percent: int) -> pa.Table:
    """Partial overlaps in one fragment, of a block's nodes with a chunk's: one row, of the pairs that may still link."""
    xs, ys = rows.filter(rows["is_x"]), rows.filter(pa.compute.invert(rows["is_x"]))
    if not xs.num_rows or not ys.num_rows:
        return _PARTIAL.empty_table()
    (xv, xs_), (yv, ys_) = (W.flat(t["tokens"], np.uint64) for t in (xs, ys))
    wide, deep = xs.num_rows, ys.num_rows
    total = _overlaps(xv, np.repeat(np.arange(wide), xs_), yv, np.repeat(np.arange(deep), ys_), wide, deep)
    x, y = ({c: np.asarray(t[c]) for c in ("n", "copies", "head", "tail")} for t in (xs, ys))
    # within a block each pair has the lesser name as x
    names = [np.array(t["node"].to_pylist(), "S16") for t in (xs, ys)]
    alive = (total > 0) & (~np.asarray(ys["inner"])[None, :] | (names[0][:, None] < names[1][None, :]))
    rest = np.minimum(x["head"][:, None], y["head"]) + np.minimum(x["tail"][:, None], y["tail"])
    i, j = np.nonzero(alive & (total + rest >= _needed(x["n"], y["n"], percent)))
    (ui, i_at), (uj, j_at) = (np.unique(k, return_inverse=True) for k in (i, j))
    one = lambda data: pa.array([np.ascontiguousarray(data).tobytes()], pa.binary())
    sides = [one(v) for t, v, u in ((xs, x, ui), (ys, y, uj)) for v in (np.frombuffer(b"".join(t["node"].to_pylist()), "V16")[u], v["n"][u], v["copies"][u])]
    return pa.Table.from_arrays([*(rows[c].slice(0, 1) for c in ("home", "i", "chunk")), *sides, one(i_at.astype(np.uint16)), one(j_at.astype(np.uint16)), one(total[i, j].astype(np.uint32))], schema=_PARTIAL)


def _total(rows: pa.Table, percent: int) -> pa.Table:
    """Sums the fragments' partial overlaps per pair: per node its links, and the least node that they lead to.

    A pair that a fragment left out is below the threshold, and so is the sum of its other overlaps.
    """
    read = lambda c, kind: [np.frombuffer(b, kind) for b in rows[c].to_pylist()]
    every, at = {}, {}
    for side in "xy":
        names = read(f"{side}_node", "S16")
        unique, first, back = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        n, copies = (np.concatenate(read(f"{side}_{c}", np.int64))[first] for c in ("n", "copies"))
        starts = np.cumsum([0, *map(len, names)])
        at[side] = np.concatenate([back[s:][p] for s, p in zip(starts, read(side, np.uint16))])
        every[side] = (unique, n, copies)
    (xname, xn, xc), (yname, yn, yc) = every["x"], every["y"]
    total = np.zeros((len(xname), len(yname)), np.int64)
    np.add.at(total, (at["x"], at["y"]), np.concatenate(read("overlap", np.uint32)))
    x, y = np.nonzero((total > 0) & (total >= _needed(xn, yn, percent)))
    names, of = np.unique(np.concatenate([xname, yname]), return_inverse=True)
    x_of, y_of = of[: len(xname)][x], of[len(xname) :][y]
    links = np.bincount(x_of, yc[y], len(names)) + np.bincount(y_of, xc[x], len(names))
    least, before = np.arange(len(names)), None
    while before is None or (least != before).any():
        before = least.copy()
        np.minimum.at(least, x_of, before[y_of])
        np.minimum.at(least, y_of, before[x_of])
        least = least[least]
    out = np.flatnonzero(links)
    whole = lambda k: pa.array([n.ljust(16, b"\0") for n in names[k].tolist()], pa.binary())
    return pa.Table.from_arrays([whole(out), whole(least[out]), pa.array(links[out].astype(np.int64))], schema=_LINK)


def _meetings(nodes: DataFrame, postings: DataFrame, home: DataFrame) -> DataFrame:
    """(home, i, chunk, node, is_x, inner): the blocks' nodes, and in chunks those that they meet."""
    x = table(nodes.select("node", F.greatest("grams", F.lit(LIGHT)).alias("grams")).join(home, "node"), "homes")
    size = x.groupBy("home").agg(F.sum("grams").alias("all"))
    small = F.col("all") <= BLOCK // 4  # small homes share one, about half a block each
    pools = max(1, -(-2 * (size.where(small).agg(F.sum("all")).first()[0] or 0) // BLOCK))
    pool = F.concat(F.lit("pool "), F.pmod(F.xxhash64("home"), F.lit(pools)).cast("string")).cast("binary")
    x = table(x.join(size, "home").select("node", "grams", F.when(small, pool).otherwise(F.col("home")).alias("home")), "pooled")
    x = x.join(x.groupBy("home").agg(F.ceil(F.sum("grams") / BLOCK).alias("blocks")), "home")
    x = table(x.select("node", "grams", "home", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("i")), "blocks")
    # blocks of one home meet each other; of two blocks the lesser asks
    own = x.select("node", "grams", "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i"))).alias("at"), "i")
    own = own.select("node", "grams", "home", F.col("at").alias("i"), (F.col("at") == F.col("i")).alias("inner"))
    posted = postings.select("token", "node").join(x, "node")
    asks = posted.select("token", F.col("home").alias("to"), F.col("i").alias("at")).distinct()
    other = posted.join(asks, "token").where(F.col("to") < F.col("home")).select("node", "grams", F.col("to").alias("home"), F.col("at").alias("i"), F.lit(False).alias("inner")).distinct()
    y = table(own.unionByName(other), "asked")
    chunks = y.groupBy("home", "i").agg(F.ceil(F.sum("grams") / CHUNK).alias("chunks"), F.count("*").alias("met")).where("met > 1")
    right = y.join(chunks, ["home", "i"]).select("home", "i", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "node", F.lit(False).alias("is_x"), "inner")
    left = x.join(chunks, ["home", "i"]).select("home", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "node", F.lit(True).alias("is_x"), F.lit(True).alias("inner"))
    return left.unionByName(right)


def _links(nodes: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """(node, to, links): per meeting and node, how many rows it links to, and the least node of its component there."""
    marks = nodes.select(F.explode("marks").alias("mark")).agg(F.percentile_approx("mark", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1_000)).first()[0]
    pivots = np.unique(np.array(marks or [], np.int64))
    met = _meetings(nodes, postings, _homes(postings)).join(nodes.select("node", "n", "copies", "tokens", "dfs"), "node")
    cut = met.mapInArrow(lambda it: _segments(it, pivots), f"{_UNIT}, fragment int, is_x boolean, inner boolean, node binary, n long, copies long, head long, tail long, tokens binary")
    names = ", ".join(f"{f.name} binary" for f in _PARTIAL if pa.types.is_binary(f.type) and f.name != "home")
    partial = cut.groupBy("home", "i", "chunk", "fragment").applyInArrow(W.grouped(lambda t: _partial(t, percent)), f"{_UNIT}, {names}")
    return partial.groupBy("home", "i", "chunk").applyInArrow(W.grouped(lambda t: _total(t, percent)), "node binary, to binary, links long")


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, component (its name; null for an empty set), text_hash, links.

    Two texts link when 100 * intersection >= percent * union of their sets of k-word n-grams.  links: how many other rows a
    row links to, copies counted; components are those of these links.
    """
    profiles = _profiles(docs, k)
    rows = profiles.where("n is not null")
    copies = table(rows.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("low")), "nodes")
    nodes = _survivors(docs, k, percent, profiles, copies)
    postings = table(nodes.select("node", "n", "lone", F.explode("prefix").alias("token")), "postings", "lz4")
    blocks = table(_links(nodes, postings, percent), "links")
    labels = components(blocks, "node", "to")
    linked = blocks.groupBy("node").agg(F.sum("links").alias("links"))
    lowest = copies.drop("n").join(labels, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = lowest.groupBy("component").agg(F.min("low").alias("component_id"))
    named = lowest.join(least, "component").select("node", "component", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component", "text_hash", F.coalesce("links", F.lit(0)).alias("links"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, with all columns: of each component the row with the smallest doc_id (null last, then text hash).

    Of rows equal in doc_id and text one stays.  Texts with an empty set all stay, one for each doc_id and text.
    """
    found = ngram_jaccard_join(docs, k, percent)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"))
    first = found.where("component is not null").groupBy("component").agg(F.min(row).alias("r")).select("r.stay_id", "r.stay_hash")
    stay = first.union(found.where("component is null").select("doc_id", "text_hash").distinct())
    rows = hidden(docs, "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("text_hash") == F.col("stay_hash")), "left_semi")
    once = Window.partitionBy("doc_id", "text_hash").orderBy("text")
    return restored(kept.withColumn("once", F.row_number().over(once)).where("once = 1"), docs.columns, text=F.col("text"))


JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM s),
u AS (SELECT doc_id, unnest(grams) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS low FROM n UNION SELECT l.y, r.low FROM r JOIN l ON r.doc_id = l.x)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(low) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""
