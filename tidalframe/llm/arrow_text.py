"""Vectorised text primitives over Arrow string columns.

Everything works on the raw UTF-8 bytes of a whole batch at once, so the cost per word is a few
array passes instead of a Python call.  A word is a maximal run of bytes outside 0x20 and
0x09-0x0D; those bytes never occur inside a multi-byte UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes of text handled at once, unless one text alone is longer.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            step = np.full(size, base, U64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def flatten(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, joined, and the n + 1 offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Batches regrouped to about `limit` bytes of text each; a longer single text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = np.cumsum(np.diff(flatten(batch.column(batch.schema.get_field_index(text)))[1]))
        first = 0
        while first < batch.num_rows:
            done = int(at[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(at, done + limit - size, "right"))) if size < limit else first
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(at[last - 1]) - done
                first = last
            if size >= limit or first < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each combination of long keys, from batches sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        columns = [now[k].to_numpy() for k in keys]
        new = np.zeros(now.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = True
        edges = np.flatnonzero(new)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield now.slice(a, b - a)
        rest = now.slice(edges[-1])
    if rest is not None:
        yield rest


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words; with `lower`, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = _power_tables(len(data))
    running = np.empty(len(data) + 1, U64)
    running[0] = 0
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power, out=running[1:])
    return mix((running[ends] - running[starts]) * inverse[starts])


_LAGS = [U64(int(x) | 1) for x in _RNG.integers(1, 2**62, 64)]


def shingle_hashes(words: np.ndarray, docs: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, text by text, and n_docs + 1 offsets.

    A text with 1 to k - 1 words gives its whole word sequence as its one shingle.
    """
    n_words = np.bincount(docs, minlength=n_docs) if len(docs) else np.zeros(n_docs, np.int64)
    first = np.concatenate([[0], np.cumsum(n_words)])
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    if not len(words):
        return np.zeros(0, U64), offsets
    out = np.empty(offsets[-1], U64)
    if len(words) >= k:
        total = np.zeros(len(words) - k + 1, U64)
        for j in range(k):
            total += words[j : len(words) - k + 1 + j] * _LAGS[j]
        whole = docs[: len(words) - k + 1] == docs[k - 1 :]
        owner = docs[: len(words) - k + 1][whole]
        place = offsets[owner] + np.flatnonzero(whole) - first[owner]
        out[place] = mix(total[whole])
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        own = words[first[d] : first[d + 1]]
        total = np.zeros(1, U64)
        for j in range(len(own)):
            total += own[j : j + 1] * _LAGS[j]
        out[offsets[d]] = mix(total + U64(len(own)))[0]
    return out, offsets


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes, sorted and without repeats, and the new offsets."""
    parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for d in range(len(offsets) - 1):
        a, b = offsets[d], offsets[d + 1]
        if b > a:
            x = np.sort(hashes[a:b])
            if b - a > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            parts.append(x)
            sizes[d] = len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Wrapping sums of values[offsets[i]:offsets[i + 1]]."""
    running = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=running[1:])
    return running[offsets[1:]] - running[offsets[:-1]]
