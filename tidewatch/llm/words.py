"""Words of UTF-8 texts as 64-bit hashes, computed over whole Arrow batches with numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Null and empty texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; chunks end at white space or at the end of a text, so memory does not grow with a text.
CHUNK = 1 << 20
_MIX = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: What ends a token when only letters count: every ASCII character but A-Z and a-z.
_NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of uint64 values, one for each seed."""
    x = values + np.uint64(_MIX * (2 * seed + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(lower: bool, apart: np.ndarray) -> np.ndarray:
    folded = np.arange(256, dtype=np.uint64)
    if lower:
        folded[65:91] += 32
    table = mix(folded, 7)
    table[apart] = 0
    return table


_TABLES = {(lower, letters): _letters(lower, _NO_LETTER if letters else _SPACE) for lower in (False, True) for letters in (False, True)}


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offset of each text and of the end."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_chunk(data: np.ndarray, base: int, limits: np.ndarray, table: np.ndarray,
                apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in the whole buffer) and hashes of the words of a chunk that begins at base."""
    space = apart[data]
    fresh = np.empty(len(data), dtype=bool)
    fresh[0] = True
    fresh[1:] = space[:-1]
    fresh[limits] = True
    starts = np.flatnonzero(fresh & ~space)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, lengths)
    power = np.full(int(lengths.max()), _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    return starts + base, mix(np.add.reduceat(table[data[starts[0] :]] * power[at], starts - starts[0]))


def hash_words(texts: pa.Array, lower: bool = True, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their byte offsets in the joined texts, and the first word of each text (one more for the end).

    letters: words are runs of letters; ASCII characters of other kinds stand between words.
    """
    data, offsets = text_buffer(texts)
    table, apart = _TABLES[lower, letters], _NO_LETTER if letters else _SPACE
    edges = np.unique(offsets)
    starts, hashes, begin = [], [], 0
    while begin < len(data):
        end = min(begin + CHUNK, len(data))
        while end < len(data) and not apart[data[end - 1]]:
            ahead = data[end : end + CHUNK]
            gap = np.flatnonzero(apart[ahead])
            stop = edges[np.searchsorted(edges, end)]
            end = min(int(stop), end + (int(gap[0]) + 1 if len(gap) else len(ahead)))
            if end == stop:
                break
        inside = edges[np.searchsorted(edges, begin) : np.searchsorted(edges, end)] - begin
        found, values = _hash_chunk(data[begin:end], begin, inside, table, apart)
        starts.append(found)
        hashes.append(values)
        begin = end
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return hashes, starts, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of width words, and the first run of each text (one more for the end).

    A text with fewer words has its whole sequence as its one run; a text without words has none.
    """
    words = np.diff(first)
    counts = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    begin = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], counts) + np.repeat(first[:-1], counts)
    span = np.repeat(np.minimum(words, width), counts)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        there = span > k
        out[there] = mix(out[there] * np.uint64(0x9FB21C651E98DF25) + hashes[at[there] + k], k + 1)
    return out, begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and the first of each text (one more for the end)."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(begin)))


def as_lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """uint64 values as an Arrow array of lists of signed longs."""
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))
