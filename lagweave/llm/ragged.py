"""NumPy kernels over the bytes of many texts at once.

An Arrow string column already is one byte buffer with offsets. These kernels find words or
pre-tokens in that buffer, hash them, and gather variable-length pieces, without making a
Python object per word. All of them look at whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone. Kernels that gain nothing from words seen before take the smaller slices.
SLICE_BYTES, SMALL_SLICE_BYTES = 4 << 20, 1 << 20

U64 = np.uint64
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: Word separators: space and the bytes 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold at most ``limit`` bytes (or one row)."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls become empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pack_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``text_bytes`` for a list of byte strings."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = (x ^ (x >> U64(30))) * _MIX_A
    x = (x ^ (x >> U64(27))) * _MIX_B
    return x ^ (x >> U64(31))


def lanes(buf: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word at each byte, zeros beyond the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes get equal hashes."""
    at, sizes = lanes(buf), ends - starts
    out = mix(sizes.astype(U64) + U64(0x9E3779B97F4A7C15))
    live, done = np.arange(len(starts)), 0
    while len(live):
        lane, left = at[starts[live] + done], sizes[live] - done
        short = np.flatnonzero(left < 8)
        lane[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        out[live] = mix(out[live] ^ lane)
        live, done = live[left > 8], done + 8
    return out


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` of each pair, one after another."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    first = np.cumsum(sizes) - sizes
    return flat[np.arange(total) + np.repeat(starts - first, sizes)]


def bounds(sizes: np.ndarray) -> np.ndarray:
    """0 and the running totals."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs (low, high) of items whose sizes sum to at most ``limit``, or of one larger item."""
    total, low = bounds(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(total, total[low] + limit, "right")) - 1)
        yield low, high
        low = high


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The sum of ``values[edges[i] : edges[i + 1]]`` for each i; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def unique_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of one span of each distinct content, and for each span the position of its content there.

    Spans are matched by hash and then compared byte by byte; if two contents ever share a
    hash, the slice is matched by its bytes instead, so the answer is exact.
    """
    hashes = span_hashes(buf, starts, ends)
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if _all_equal(buf, starts, ends, index[inverse]):
        return index, inverse
    raw, seen = buf.tobytes(), {}
    inverse = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)
    return np.unique(inverse, return_index=True)[1], inverse


def _all_equal(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    sizes = ends - starts
    if not np.array_equal(sizes, sizes[other]):
        return False
    at = lanes(buf)
    live = np.flatnonzero(other != np.arange(len(other)))
    done = 0
    while len(live):
        a, b, left = at[starts[live] + done], at[starts[other[live]] + done], sizes[live] - done
        short = np.flatnonzero(left < 8)
        mask = (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        a[short] &= mask
        b[short] &= mask
        if not np.array_equal(a, b):
            return False
        live, done = live[left > 8], done + 8
    return True
