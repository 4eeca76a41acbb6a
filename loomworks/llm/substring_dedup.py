"""Operator 9: removal of repeated passages by seed and extend on winnowed anchors.

A window is `length` consecutive words.  Its anchor is the smallest hash among its k-word grams (the leftmost of equals):
it depends on the window's words alone, so all occurrences of a window have the same anchor at the same place.

Plan
1. The documents are put into buckets by a key of id and text; both joins below leave them where they are.
2. `_seeds`: one scan winnows each text; only anchors leave it (about 2 of length - k + 2 words), by ranges of their
   hash.  An anchor met twice within a batch of texts is known to be shared there, and one row stands for all its occurrences.
3. `_shared`: all occurrences of an anchor meet; those of anchors that occur twice or more go back to their documents.  Most words
   lie near none and are done.
4. `_extend`: each shared anchor is extended to the left and to the right, to every window that it anchors.  Extensions are
   compared by a 128-bit name of all their words, once per occurrence: matches are not made pair by pair, which would be quadratic
   in a passage's copies.  Of a batch's equal windows only the first goes on; the others are repeats already.
5. `_repeats`: per window, the first of all (smallest doc_id, then start); any later one is a repeat.
6. `_cut`: a text's overlapping repeats are one maximal repeat, and its words go.

Work is linear in the input, however often a passage occurs.

Defined results: a null text has no words.  A null doc_id is later than any other.  Rows with the same doc_id tie (neither is
earlier than the other at the same start).  Texts with fewer words than a window are kept whole.  Words are kept unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import bucketed, buckets_for, table

#: Anchors or windows in a task; bytes of text in a bucket, and buckets at most.
FRAGMENT, BUCKET, BUCKETS = 4_000_000, 32 << 20, 50_000
KEY = ["k1", "k2"]  # of a row: two hashes of its id and text
_SEEDS = pa.schema([("fragment", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("anchors", pa.binary()), ("common", pa.binary())])
_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("anchors", pa.binary())])
_SPANS = pa.schema([("fragment", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("late", pa.binary()), ("counts", pa.binary()), ("windows", pa.binary()), ("starts", pa.binary())])
_GONE = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("starts", pa.binary())])


def _keys(batch) -> np.ndarray:
    return np.stack([np.asarray(batch[c]) for c in KEY], 1)


def _one(data: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(data).tobytes()], pa.binary())


def _anchors(words: W.Words, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word of each window, place of its anchor gram, hashes of all grams)."""
    grams, _ = words.grams(k)
    w = length - k + 1
    n = len(words.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    best, step = grams.copy(), 1  # least hash of `step` grams from each place on
    while step * 2 <= w:
        best = np.minimum(best[: len(best) - step], best[step:])
        step *= 2
    least = np.minimum(best[:n], best[w - step : w - step + n])
    whole = np.flatnonzero(words.text[:n] == words.text[length - 1 :])
    # the leftmost place in the window with that hash: next place at or after the start whose hash equals it
    place = np.full(n, -1)
    for j in range(w - 1, -1, -1):
        hit = grams[j : j + n] == least
        place[hit] = np.flatnonzero(hit) + j
    return whole, place[whole], grams


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    fresh = np.zeros(len(keys[0]), bool)
    fresh[0] = True
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(fresh), len(fresh))


def _seeds(batches, k: int, length: int, fragments: int):
    for batch in batches:
        doc, value = [], []
        for a, b in W.slices(batch["text"]):
            words = W.Words(batch["text"].slice(a, b - a))
            _, place, grams = _anchors(words, k, length)
            place = np.unique(place)
            doc.append(words.text[place] + a)
            value.append(grams[place])
        doc, value = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((doc, np.int64), (value, np.uint64)))
        if not len(value):
            continue
        keys = _keys(batch)

        def send(to: int, d: np.ndarray, v: np.ndarray, common: pa.Array) -> pa.RecordBatch:
            order = np.argsort(d, kind="stable")
            d, v = d[order], v[order]
            e = _groups(d)
            return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), _one(keys[d[e[:-1]]]), _one(np.diff(e).astype(np.uint32)), _one(v), common], schema=_SEEDS)

        order = np.argsort(value, kind="stable")
        doc, value = doc[order], value[order]
        ends = _groups(value)
        many = np.diff(ends) > 1
        common, lone = value[ends[:-1][many]], np.repeat(~many, np.diff(ends))
        if not lone.all():  # anchors shared within the batch: their texts learn it at once
            yield send(int(keys[0, 1] % fragments), doc[~lone], value[~lone], pa.array([None], pa.binary()))
        d, v = doc[lone], value[lone]
        f, g = W.fragment_of(v, fragments), W.fragment_of(common, fragments)  # values ascend, so these do
        for i in np.union1d(f, g).tolist():
            (a, b), (c, e) = (np.searchsorted(x, (i, i + 1)) for x in (f, g))
            yield send(i, d[a:b], v[a:b], _one(common[c:e]))


def _rows_of(sent: pa.Table, *columns: tuple[str, type]) -> list[np.ndarray]:
    """Of all rows one after another: for each value its text's place, the texts' keys, and the named columns."""
    counts = W.flat(sent["counts"], np.uint32)[0]
    return [np.repeat(np.arange(len(counts)), counts), W.flat(sent["keys"], np.int64)[0].reshape(-1, 2), *(W.flat(sent[c], t)[0] for c, t in columns)]


def _per_row(d: np.ndarray, value: np.ndarray, keys: np.ndarray, schema: pa.Schema) -> pa.Table:
    order = np.argsort(d, kind="stable")
    d, value = d[order], value[order]
    e = _groups(d)
    own = keys[d[e[:-1]]]
    return pa.Table.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), W.blobs(value, e)], schema=schema)


def _shared(sent: pa.Table) -> pa.Table:
    """Anchors of each text that occur more than once; rows without `common` know it and pass."""
    out = []
    known = pa.compute.is_null(sent["common"])
    for rows, passing in ((sent.filter(known), True), (sent.filter(pa.compute.invert(known)), False)):
        d, keys, value = _rows_of(rows, ("anchors", np.uint64))
        if not passing:
            common = W.flat(rows["common"], np.uint64)[0]
            every = np.sort(np.concatenate([value, common, common]))
            e = _groups(every)
            twice = every[e[:-1][np.diff(e) > 1]]
            keep = np.zeros(len(value), bool)
            if len(twice):
                keep = twice[np.minimum(np.searchsorted(twice, value), len(twice) - 1)] == value
            d, value = d[keep], value[keep]
        if len(d):
            out.append(_per_row(d, value, keys, _FOUND))
    return pa.concat_tables(out) if out else _FOUND.empty_table()


def _extend(batches, k: int, length: int, fragments: int):
    """Windows around shared anchors: of a batch's equal ones, the first to their fragment, the others as repeats."""
    for batch in batches:
        doc, start, name = [], [], []
        found = batch["anchors"].to_pylist()
        for a, b in W.slices(batch["text"]):
            words = W.Words(batch["text"].slice(a, b - a))
            whole, place, grams = _anchors(words, k, length)
            if not len(whole):
                continue
            text = words.text[whole]
            ends = np.searchsorted(text, np.arange(b - a + 1))
            keep = np.zeros(len(whole), bool)
            for i in range(b - a):
                if ends[i + 1] > ends[i]:
                    at = slice(ends[i], ends[i + 1])
                    keep[at] = np.isin(grams[place[at]], np.frombuffer(b"".join(found[a + i]), np.uint64))
            whole, text = whole[keep], text[keep]
            doc.append(text + a)
            start.append(whole - words.first[text])
            name.append(words.names(length)[whole])
        if not doc:
            continue
        doc, start, name = np.concatenate(doc), np.concatenate(start), np.concatenate(name)
        if not len(doc):
            continue
        keys, late = _keys(batch), np.asarray(batch["doc_id"].is_null())
        ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((start, ids[doc], late[doc], name[:, 1], name[:, 0]))
        doc, start, name = doc[order], start[order], name[order]
        e = _groups(name[:, 0], name[:, 1])
        head = np.repeat(e[:-1], np.diff(e))
        first = (ids[doc] == ids[doc[head]]) & (late[doc] == late[doc[head]]) & (start == start[head])
        f = np.where(first, W.fragment_of(name[:, 0], fragments), -1)
        order = np.lexsort((doc, f))
        doc, start, name, f = doc[order], start[order], name[order], f[order]
        e = _groups(f)
        for a, b in zip(e[:-1], e[1:]):
            known, r = f[a] < 0, _groups(doc[a:b])
            own = doc[a:b][r[:-1]]
            to = int(keys[own[0], 1] % fragments) if known else int(f[a])
            windows = pa.array([None], pa.binary()) if known else _one(name[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), _one(keys[own]), _one(ids[own]), _one(late[own].astype(np.uint8)), _one(np.diff(r).astype(np.uint32)), windows, _one(start[a:b].astype(np.uint32))], schema=_SPANS)


def _repeats(sent: pa.Table) -> pa.Table:
    """Starts of windows that occur earlier; rows without `windows` are known repeats and pass."""
    out = []
    known = pa.compute.is_null(sent["windows"])
    for rows, passing in ((sent.filter(known), True), (sent.filter(pa.compute.invert(known)), False)):
        d, keys, ids, late, start = _rows_of(rows, ("ids", np.int64), ("late", np.uint8), ("starts", np.uint32))
        if not passing:
            name = W.flat(rows["windows"], np.uint64)[0].reshape(-1, 2)
            order = np.lexsort((start, ids[d], late[d], name[:, 1], name[:, 0]))
            d, start, name = d[order], start[order], name[order]
            e = _groups(name[:, 0], name[:, 1])
            head = np.repeat(e[:-1], np.diff(e))
            later = (ids[d] != ids[d[head]]) | (late[d] != late[d[head]]) | (start != start[head])
            d, start = d[later], start[later]
        if len(d):
            out.append(_per_row(d, start, keys, _GONE))
    return pa.concat_tables(out) if out else _GONE.empty_table()


def _cut(batches, length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.int64()))])
    for batch in batches:
        for a, b in W.slices(batch["text"], 8 << 20):
            n, gone, kept, removed = [], [], [], []
            for text, starts in zip(batch["text"].slice(a, b - a), batch["starts"].slice(a, b - a).to_pylist()):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # splits at the six space characters
                n.append(len(words))
                spans: list[int] = []
                if starts:
                    at = np.unique(np.frombuffer(b"".join(starts), np.uint32)).astype(np.int64)
                    edge = np.flatnonzero(np.diff(at) > length)  # where a maximal repeat ends
                    begin, end = at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)] + length
                    spans = np.stack([begin, end], 1).ravel().tolist()
                    gone.append(int((end - begin).sum()))
                    words = [w for i, j in zip([0, *spans[1::2]], [*spans[::2], len(words)]) for w in words[i:j]]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
                removed.append(spans)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, schema.field("removed").type)], schema=schema)


def _digest(batches, length: int):
    for batch in _cut(batches, length):
        hashes = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch["kept"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], batch["n_removed"], pa.array(hashes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_windows(docs: DataFrame, k: int = 8, length: int = 20) -> DataFrame:
    """docs (doc_id, text) with starts: binary runs of the first words of windows that occur earlier (or null)."""
    letters = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    fragments, buckets = max(12, buckets_for(letters // 40, FRAGMENT)), min(max(12, buckets_for(letters, BUCKET)), BUCKETS)
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(9), "doc_id", "text").alias("k2"))
    seeds = named.mapInArrow(lambda it: _seeds(it, k, length, fragments), "fragment int, keys binary, counts binary, anchors binary, common binary")
    shared = table(W.by_group(seeds, fragments, "fragment", _shared, "k1 long, k2 long, anchors binary"), "anchors", "lz4")
    placed = bucketed(named, KEY, buckets)
    near = placed.join(_together(shared, "anchors", buckets), KEY)
    spans = near.mapInArrow(lambda it: _extend(it, k, length, fragments), "fragment int, keys binary, ids binary, late binary, counts binary, windows binary, starts binary")
    gone = table(W.by_group(spans, fragments, "fragment", _repeats, "k1 long, k2 long, starts binary"), "repeats", "lz4")
    return placed.join(_together(gone, "starts", buckets), KEY, "left")


def _together(found: DataFrame, column: str, buckets: int) -> DataFrame:
    """All of a row's findings, in the documents' buckets."""
    return found.repartition(buckets, *KEY).groupBy(*KEY).agg(F.collect_list(column).alias(column))


def substring_dedup(docs: DataFrame, k: int = 8, length: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space), removed (word spans)."""
    return repeated_windows(docs, k, length).select("doc_id", "text", "starts").mapInArrow(lambda it: _cut(it, length), "doc_id long, n_words long, n_removed long, kept string, removed array<long>")


def substring_digest(docs: DataFrame, k: int = 8, length: int = 20) -> DataFrame:
    """As substring_dedup, with kept_sha256 in place of the kept words."""
    return repeated_windows(docs, k, length).select("doc_id", "text", "starts").mapInArrow(lambda it: _digest(it, length), "doc_id long, n_words long, n_removed long, kept_sha256 string")


DEDUP_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
y AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM x),
z AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM y),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM z WHERE k > 1) GROUP BY doc_id),
t AS (SELECT doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN len(gone) = 0 THEN ws ELSE list_filter(ws, lambda v, j: NOT list_contains(gone, j)) END, ' '), '')) AS kept_sha256 FROM t
"""
