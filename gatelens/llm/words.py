"""Words, their hashes and hashed word windows, shared by the text operators.

Texts are handled as UTF-8 bytes: ``bytes.split()`` splits at exactly the characters x20 and x09 to x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every ASCII character but digits and letters into a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
MOST_CACHED = 100_000


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def in_parts(column: pa.Array, size: int = 500) -> Iterator[pa.Array]:
    """A column some texts at a time, so that what is made of them stays small; an empty one as one empty part."""
    for start in range(0, max(1, len(column)), size):
        yield column.slice(start, size)


class WordHashes(dict):
    """64-bit hashes of words, computed once per word; emptied when large, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes, so that the leading ones can choose a bucket."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(ids: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash for each run of ``width`` ids; one less than ``width`` fewer values than ids."""
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    n, h = len(ids) - width + 1, np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * MULTIPLIERS[which] + ids[k : k + n]
    return mixed(h)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by leading bits: hashes in sorted order fall into contiguous buckets."""
    return ((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def bucket_slices(sorted_hashes: np.ndarray, buckets: int):
    """``(bucket, slice)`` for each bucket that holds some of the sorted hashes."""
    own = bucket_of(sorted_hashes, buckets)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.r_[starts[1:], len(own)]):
        yield int(own[a]), slice(int(a), int(b))


def by_bytes(column: pa.Array, most: int = 4_000_000) -> Iterator[pa.Array]:
    """A string column in slices of consecutive texts of ``most`` bytes, or of one longer text; an empty one as one empty slice."""
    sizes = np.array(pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    part = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(1, int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
        yield column.slice(a, b - a)


def windows_of(ids: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` ids within each of the texts that ``lengths`` cuts ``ids`` into, and their number per text."""
    h = window_hashes(ids, width)
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(h)]
    return h[np.arange(len(h)) + width <= ends], np.maximum(lengths - width + 1, 0)
