"""Byte-level BPE encoding and decoding by a rank queue with a hierarchical bitmap.

The pairs of a pre-token wait in one bucket per merge rank, as positions of a linked list of tokens. A bitmap in levels of
256-bit words says which buckets hold something, so that a find-first-set per level gives the lowest rank. The leftmost
position of a bucket comes first. An entry whose pair has changed since is stale and is skipped. A pre-token of n bytes takes
O(n log n) steps, so that pre-tokens of any length can be encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.batches import slices

#: Encoded pre-tokens that a worker remembers, in each generation of two tables; only speed and memory (about 170 bytes each) depend on it.
REMEMBERED = 600_000
#: Longer pre-tokens are encoded anew each time.
REMEMBERED_CHARS = 64
#: Buckets that one word of the bitmap stands for: two levels cover 65,536 ranks at a step each.
BITS = 8
WORD = 1 << BITS
#: Bytes of a pre-token whose positions fit one machine word.
SHORT = 60
_ENDS, _BEFORE = list(range(1, SHORT + 1)), list(range(-1, SHORT - 1))
_BYTES_OF = [range(max(n - 1, 0)) for n in range(SHORT + 1)]
#: Fixed value: the pre-token pattern for which splitting at single spaces first is known to change nothing.
SPACED_PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file (base64 of the bytes, then the rank, per line).

    It is a file of the installation, the same on every machine; it is read once by the driver and sent to the tasks.
    """
    del spark
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes pre-tokens one after another; the queue is empty between them, so its buckets and bitmap are used again."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        size = max(ranks.values(), default=0) + 1
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.positions = [0] * size  # the buckets of short pre-tokens
        self.lower = [0] * (size // WORD + 1)  # a bit for each bucket that holds something

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token; every single byte must have a rank."""
        ranks, buckets, lower = self.ranks, self.buckets, self.lower
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n <= SHORT:
            return self._short(piece, n)
        end = list(range(1, n + 1))  # where the token that starts at a position ends
        before = list(range(-1, n))  # where the token before it starts
        pair = [ranks.get(piece[i : i + 2], -1) for i in range(n)]  # rank of the token at a position with the next one
        pair[-1] = -1
        upper = 0  # a bit for each word of the lower level that is not zero
        for i, rank in enumerate(pair):
            if rank >= 0:
                bucket = buckets[rank]
                if not bucket:
                    word = rank >> BITS
                    lower[word] |= 1 << (rank & WORD - 1)
                    upper |= 1 << word
                heappush(bucket, i)
        while upper:
            word = (upper & -upper).bit_length() - 1
            bits = lower[word]
            rank = word << BITS | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                bits &= bits - 1
                lower[word] = bits
                if not bits:
                    upper &= upper - 1
            if pair[i] != rank:
                continue  # a stale entry
            gone = end[i]
            stop = end[i] = end[gone]
            pair[gone] = -1
            if stop < n:
                before[stop] = i
                fresh = ranks.get(piece[i : end[stop]], -1)
                pair[i] = fresh
                if fresh >= 0:
                    bucket = buckets[fresh]
                    if not bucket:
                        word = fresh >> BITS
                        lower[word] |= 1 << (fresh & WORD - 1)
                        upper |= 1 << word
                    heappush(bucket, i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                fresh = ranks.get(piece[left:stop], -1)
                if fresh != pair[left]:
                    pair[left] = fresh
                    if fresh >= 0:
                        bucket = buckets[fresh]
                        if not bucket:
                            word = fresh >> BITS
                            lower[word] |= 1 << (fresh & WORD - 1)
                            upper |= 1 << word
                        heappush(bucket, left)
        out, i = [], 0
        while i < n:
            stop = end[i]
            out.append(ranks[piece[i:stop]])
            i = stop
        return out


    def _short(self, piece: bytes, n: int) -> list[int]:
        """The same queue for a pre-token of few bytes: a bucket is a bitmap of positions as well, and the leftmost is its first set bit."""
        get, buckets, lower = self.ranks.get, self.positions, self.lower
        end, before = _ENDS[:n], _BEFORE[:n]
        pair = [get(piece[i : i + 2]) for i in _BYTES_OF[n]]
        upper = 0
        for i, rank in enumerate(pair):
            if rank is not None:
                held = buckets[rank]
                buckets[rank] = held | 1 << i
                if not held:
                    word = rank >> BITS
                    lower[word] |= 1 << (rank & WORD - 1)
                    upper |= 1 << word
        pair.append(None)
        while upper:
            word = (upper & -upper).bit_length() - 1
            bits = lower[word]
            rank = word << BITS | (bits & -bits).bit_length() - 1
            held = buckets[rank]
            i = (held & -held).bit_length() - 1
            held &= held - 1
            buckets[rank] = held
            if not held:
                bits &= bits - 1
                lower[word] = bits
                if not bits:
                    upper &= upper - 1
            if pair[i] != rank:
                continue  # a stale entry
            gone = end[i]
            stop = end[i] = end[gone]
            pair[gone] = None
            if stop < n:
                before[stop] = i
                fresh = pair[i] = get(piece[i : end[stop]])
                if fresh is not None:
                    held = buckets[fresh]
                    buckets[fresh] = held | 1 << i
                    if not held:
                        word = fresh >> BITS
                        lower[word] |= 1 << (fresh & WORD - 1)
                        upper |= 1 << word
            else:
                pair[i] = None
            left = before[i]
            if left >= 0:
                fresh = get(piece[left:stop])
                if fresh != pair[left]:
                    pair[left] = fresh
                    if fresh is not None:
                        held = buckets[fresh]
                        buckets[fresh] = held | 1 << left
                        if not held:
                            word = fresh >> BITS
                            lower[word] |= 1 << (fresh & WORD - 1)
                            upper |= 1 << word
        out, i = [], 0
        while i < n:
            stop = end[i]
            out.append(get(piece[i:stop]))
            i = stop
        return out


class Remembered(dict):
    """Keeps the last values computed for keys: a full generation becomes the older one, and what is asked for returns from it."""

    def __init__(self, compute: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class TextEncoder:
    """Whole texts to their ids as bytes of int32.

    A text whose words stand apart by single spaces falls into pieces at the spaces, each of which the pattern splits in the
    same way whatever stands around it; the ids of frequent pieces are remembered. Other texts go through the pattern whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.matches = regex.compile(pattern).findall
        # Whether a piece at a space depends on its neighbours: white space beside a space, at the start or at the end.
        self.uneven = re.compile(r" \s|^\s| $").search if pattern == SPACED_PATTERN else lambda text: True
        encoder = Encoder(ranks)
        self.token = Remembered(lambda piece: array("i", encoder.encode(piece.encode("utf-8"))).tobytes(), remembered).__getitem__
        self.after_space = Remembered(lambda piece: self._by_pattern(" " + piece), remembered).__getitem__

    def _by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.token, self.matches(text)))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.uneven(text):
            return self._by_pattern(text)
        first, *others = text.split(" ")
        return self._by_pattern(first) + b"".join(map(self.after_space, others))


_ENCODERS: dict[tuple[str, int, int], TextEncoder] = {}


def _encoder(ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> TextEncoder:
    """The encoder of this Python worker, with what it remembers from earlier tasks; one vocabulary at a time."""
    key = (pattern, hash(tuple(ranks.items())), remembered)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(ranks, pattern, remembered)
    return _ENCODERS[key]


class Joined:
    """Texts of small ids, joined for lists of ids by copying whole runs of bytes."""

    def __init__(self, of_id: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in of_id], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.pool = np.frombuffer(b"".join(of_id), dtype=np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all lists one after another, and the first of each list (one more for the end)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ids) else 0) - np.repeat(ends - lengths - self.starts[ids], lengths)
        return self.pool[at], np.concatenate(([0], ends))[np.cumsum(np.concatenate(([0], counts)))]


def _vocabulary(ranks: dict[bytes, int]) -> list[bytes]:
    of_id = [b""] * (max(ranks.values(), default=0) + 1)
    for token, rank in ranks.items():
        of_id[rank] = token
    return of_id


def _encoded(texts: pa.Array, ids_of: TextEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each text has."""
    blobs = [ids_of(t) for t in texts.to_pylist()]
    return np.frombuffer(b"".join(blobs), dtype=np.int32), np.array([len(b) // 4 for b in blobs], dtype=np.int64)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids",
           remembered: int = REMEMBERED) -> DataFrame:
    """docs with ids_col: the token ids of the whole text; each match of pattern is encoded on its own.

    A null or empty text has no ids. There are no special tokens: their spellings are ordinary text. ids_col replaces a column
    of that name; all other columns are kept. remembered: as REMEMBERED, for executors that other work has filled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary, about 50,000 short entries
    names = [c for c in docs.columns if c != ids_col]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(shared.value, pattern, remembered)
        for batch in slices(batches, text_col):
            ids, counts = _encoded(batch.column(batch.schema.get_field_index(text_col)), ids_of)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.record_batch([batch.column(batch.schema.get_field_index(c)) for c in names] + [lists], names=names + [ids_col])

    schema = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn(ids_col, F.lit(None).cast("array<int>")).schema
    return docs.mapInArrow(compute, schema)


def decode(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """rows with bytes_col: the bytes that the ids of ids_col stand for; null or no ids give no bytes, an unknown id an error."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    names = [c for c in rows.columns if c != bytes_col]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined(_vocabulary(shared.value))
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                column = batch.column(batch.schema.get_field_index(ids_col))
                counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                data, ends = joined(column.flatten().to_numpy(zero_copy_only=False), counts)
                decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [
                    None, pa.py_buffer(np.ascontiguousarray(ends.astype(np.int32))), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.record_batch([batch.column(batch.schema.get_field_index(c)) for c in names] + [decoded],
                                      names=names + [bytes_col])

    schema = rows.select(*[F.col(f"`{c}`") for c in names]).withColumn(bytes_col, F.lit(None).cast("binary")).schema
    return rows.mapInArrow(compute, schema)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: its text encoded and the ids decoded again in one pass, so that neither
    ids nor bytes leave the task. Ids are digested in decimal, joined by commas; null and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(shared.value, pattern)
        of_id = _vocabulary(shared.value)
        tokens, decimals = Joined(of_id), Joined([b"%d," % i for i in range(len(of_id))])
        for batch in slices(batches, "_text"):
            ids, counts = _encoded(batch.column(1), ids_of)
            (data, ends), (digits, stops) = tokens(ids, counts), decimals(ids, counts)
            decoded = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            named = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(stops[:-1], stops[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(counts), pa.array(named, pa.string()), pa.array(decoded, pa.string())],
                                  names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(compute, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
