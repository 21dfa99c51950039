"""Words, their hashes and hashes of runs of words, for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
OTHER = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts ([^\\x20\\x09-\\x0D]+, null: none), and the number of words before each text and at the end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    return words.filter(pa.array(real)), before[ends - ends[0]]


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    coded = words.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    known = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def runs(h: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive words, whatever text they are of; another odd base gives another hash."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n, base, np.uint64))
        back = np.cumprod(np.full(n, pow(base, -1, 2**64), np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
        return mix((total[size:] - total[:-size]) * back[: n - size + 1])


def places(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each word, and its place in it."""
    sizes = np.diff(ends)
    text = np.repeat(np.arange(len(sizes)), sizes)
    return text, np.arange(ends[-1] - ends[0]) - ends[:-1][text]
