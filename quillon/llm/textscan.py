"""Numpy helpers that find and hash the words of a whole Arrow batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ASCII white space: 0x20 and 0x09-0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Words longer than this are hashed one by one; the others eight bytes at a time, all at once.
_LONG = 64


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offset where each text begins (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # more than one chunk is left only above 2 GB
            column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks])
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``raw``, and for each text the index of its first word (one more at the end)."""
    inside = ~separator[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; hashes by different seeds are independent of each other.

    Words of up to 64 bytes are chained eight bytes at a time: each step mixes what was before with the next bytes, so
    equal results for different words under one seed say nothing of another seed. Longer words take XXH3.
    """
    import xxhash

    first = np.random.default_rng([seed, 6]).integers(0, 1 << 63, 2, dtype=np.uint64)
    length = ends - starts
    out = mix(first[0] + length.astype(np.uint64) * (first[1] | np.uint64(1)))
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8) if len(starts) else padded
    rest = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    at = np.flatnonzero(length <= _LONG)
    done = 0
    while len(at):
        chunk = eights[starts[at] + done].view("<u8").ravel() & rest[np.minimum(length[at] - done, 8)]
        out[at] = mix((out[at] ^ chunk) * np.uint64(0x9E3779B97F4A7C15))
        done += 8
        at = at[length[at] > done]
    for i in np.flatnonzero(length > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return out


def multipliers(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The hash of each run of ``width`` hashes, by position of its first; runs cross texts, so callers mask those."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k, m in enumerate(multipliers(width, seed)):
        out += hashes[k : k + n] * m
    return mix(out)


def window_starts(first_word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index at which each whole window of a text begins, and the index of its text."""
    counts = np.maximum(np.diff(first_word) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - before[text] + first_word[:-1][text], text


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as compressed differences."""
    import zstandard

    steps = np.diff(values, prepend=values.dtype.type(0))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(steps) or int(steps.max()) < 1 << (8 * w))
    planes = steps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), dtype=np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64))


def pack_plain(values: np.ndarray) -> bytes:
    """Integers in any order, byte planes compressed apart."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_plain(blob: bytes, dtype: str) -> np.ndarray:
    import zstandard

    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()
