"""Words of whole Arrow batches as 64-bit hashes, without a Python object per word.

A hash is a sum over a word's bytes of a random 64-bit number per byte value times a power of an odd constant,
then mixed; it depends on nothing but the bytes, so all tasks agree on it.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SPACES = bytes([0x20, *range(0x09, 0x0E)])
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_KEYS = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GRAM_KEYS = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes whose words are hashed together; a longer text is hashed in pieces, and only its words' numbers are held for all of it.
PIECE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(chars: bytes = SPACES) -> np.ndarray:
    at = np.zeros(256, bool)
    at[list(chars)] = True
    return at


def folded(keys: np.ndarray = BYTE_KEYS) -> np.ndarray:
    """Byte keys under which A-Z count as a-z."""
    keys = keys.copy()
    keys[65:91] = keys[97:123]
    return keys


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system: workers live on and share an executor's memory with later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def grouped(part):
    """A group's function that gives its memory back when it is done; what small groups leave behind is used again anyway."""

    def run(rows: pa.Table) -> pa.Table:
        try:
            return part(rows)
        finally:
            if rows.nbytes > 1 << 20:
                release()

    return lambda rows: run(rows)


def runs_of(batches, column: str):
    """Tables of the rows with one value of a column, which are one after another in a partition."""
    held: list = []
    for batch in batches:
        at = np.asarray(batch[column])
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and held[-1][column][0].as_py() != at[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def by_group(df, groups: int, column: str, part, schema: str):
    """part(table) of the rows of each group, numbered from 0 in a column: a partition is a group, so none holds two large ones."""
    from pyspark.sql import functions as F

    def run(batches):
        for rows in runs_of(batches, column):
            yield from part(rows).to_batches()
            release()

    return df.repartitionById(groups, F.col(column)).sortWithinPartitions(column).mapInArrow(run, schema)


def slices(column: pa.Array, most: int = 1 << 21):
    """(from, to) of runs of rows with about `most` bytes of text; a longer text is a run of its own."""
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        release()
        at = to


def _piece_end(data: np.ndarray, sep: np.ndarray, cuts: np.ndarray, at: int) -> int:
    """The end of the piece of about PIECE bytes from `at` on: a text's end, or the first separator behind PIECE bytes."""
    if len(data) - at <= PIECE:
        return len(data)
    place = at + PIECE
    end = int(cuts[np.searchsorted(cuts, place)])
    while place < end:
        found = np.flatnonzero(sep[data[place : min(place + 4096, end)]])
        if len(found):
            return place + int(found[0])
        place += 4096
    return end


def _hashed(data: np.ndarray, cuts: np.ndarray, keys: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of each word; no word lies across a cut."""
    inside = ~sep[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads, tails = cuts[cuts < len(data)], cuts[cuts > 0] - 1
    starts[heads], ends[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    size = end - start
    if not len(size):
        return start, end, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    powers = np.multiply.accumulate(np.full(int(size.max()), POWER, np.uint64))
    return start, end, mix(np.add.reduceat(keys[data[at]] * powers[np.arange(len(at)) - np.repeat(first, size)], first) + size.astype(np.uint64) * GRAM_KEYS[63])


class Words:
    """Words of a run of texts: hash, first byte and end of each; first[i] is the first word of text i."""

    def __init__(self, column: pa.Array, keys: np.ndarray = BYTE_KEYS, sep: np.ndarray | None = None):
        data, offsets = buffers(column)
        self.data, self.offsets = data, offsets
        sep = separators() if sep is None else sep
        cuts = np.unique(offsets)
        pieces, at = [], 0
        while at < len(data):  # pieces end at a separator or with a text
            to = _piece_end(data, sep, cuts, at)
            pieces.append((at, *_hashed(data[at:to], cuts[(cuts >= at) & (cuts <= to)] - at, keys, sep)))
            at = to
        together = lambda found, kind: np.concatenate(found) if found else np.zeros(0, kind)
        self.start, self.end = (together([p[0] + p[i] for p in pieces], np.int64) for i in (1, 2))
        self.hash = together([p[3] for p in pieces], np.uint64)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(column)), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        total = np.full(n, k, np.uint64) * GRAM_KEYS[62]
        for i in range(k):
            total += self.hash[i : i + n] * GRAM_KEYS[i]
        return mix(total), self.text[:n] == self.text[k - 1 :]


    def names(self, k: int) -> np.ndarray:
        """A 128-bit name, in two columns, of the k words from each word on, whatever text they lie in."""
        n = max(0, len(self.hash) - k + 1)
        total = np.zeros((n, 2), np.uint64)
        for i in range(k):
            total[:, 0] += self.hash[i : i + n] * GRAM_KEYS[i]
            total[:, 1] += mix(self.hash[i : i + n] ^ GRAM_KEYS[61]) * GRAM_KEYS[30 + i % 30]
            total[:, 1] = (total[:, 1] << np.uint64(7)) | (total[:, 1] >> np.uint64(57))
        return mix(total)


def shingle_sets(column: pa.Array, k: int = 5, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, ascending, one after another, and where each text's begin.

    A text of fewer words is one shingle of all its words; a text without words has none.
    """
    words = Words(column, folded() if keys is None else keys)
    grams, whole = words.grams(k)
    text, value = words.text[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        rest = np.zeros(len(short), np.uint64)
        for j, i in enumerate(short):
            own = words.hash[words.first[i] : words.first[i + 1]]
            rest[j] = (own * GRAM_KEYS[: len(own)]).sum(dtype=np.uint64)
        rest += words.count[short].astype(np.uint64) * GRAM_KEYS[62]
        order = np.argsort(np.concatenate([text, short]), kind="stable")
        text, value = np.concatenate([text, short])[order], np.concatenate([value, mix(rest)])[order]
    bounds = np.searchsorted(text, np.arange(len(column) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        value[a:b].sort()
    if len(value):
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        value, text = value[keep], text[keep]
    return value, np.searchsorted(text, np.arange(len(column) + 1))


def set_names(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit name of each set, whatever its order, as an array of two columns; zeros for an empty set."""
    names = np.zeros((len(bounds) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        for i in (0, 1):
            names[full, i] = mix(np.add.reduceat(mix(value ^ GRAM_KEYS[40 + i]), bounds[:-1][full]) + np.diff(bounds)[full].astype(np.uint64) * GRAM_KEYS[50 + i])
    return names


def fragment_of(value: np.ndarray, fragments: int) -> np.ndarray:
    """Equal ranges of the hashes, in their order."""
    return ((value >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per slice of data between neighbouring bounds."""
    data = np.ascontiguousarray(data)
    offsets = np.asarray(bounds, np.int64) * data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    if len(offsets) == 1:
        return pa.array([], pa.binary())
    wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return wide.cast(pa.binary())


def flat(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all binary values of a column, one after another, and how many each value has."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([x.cast(pa.large_binary()) for x in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    item = np.dtype(dtype).itemsize
    data = np.frombuffer(data[offsets[0] : offsets[-1]] if data is not None else b"", dtype)
    return data, np.diff(offsets) // item


def to_table(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows[f.name] if isinstance(rows[f.name], pa.Array) else pa.array(rows[f.name], f.type) for f in schema], schema=schema)
