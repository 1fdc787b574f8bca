"""Context-triggered piecewise hashes of documents, and their likeness by edit distance.

A rolling hash over seven bytes ends a piece wherever it hits a multiple of the block size, so that pieces find each other
again after an insertion. Each piece gives one character. A fingerprint holds the characters at a block size fitted to the text
and at twice that size; two fingerprints compare where they have a block size in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import mix

WINDOW = 7
SMALLEST = 3  # the least block size; others are this times a power of two
CHARACTERS = 64  # of a signature; its last character covers whatever is left of the text
BLOCK = 1 << 20  # bytes hashed at a time
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_BYTES = mix(np.arange(256, dtype=np.uint64), 61)
_TURNS = [np.uint64(int(x) | 1) for x in mix(np.arange(WINDOW, dtype=np.uint64), 67)]


def _rolling(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Hashes of the windows that end at the bytes begin..end."""
    low = max(0, begin - WINDOW + 1)
    values = _BYTES[data[low:end]]
    out = np.zeros(end - begin, dtype=np.uint64)
    skip = begin - low
    for back in range(WINDOW):
        if back <= skip:
            out += values[skip - back : skip - back + len(out)] * _TURNS[back]
        elif back - skip < len(out):
            out[back - skip :] += values[: len(out) - (back - skip)] * _TURNS[back]
    return mix(out, 3) >> np.uint64(16)


def _signature(data: np.ndarray, size: int, rolled: np.ndarray | None) -> str:
    """One character for each piece at this block size."""
    sums, carry = [], np.uint64(0)
    for begin in range(0, len(data), BLOCK):
        values = rolled if rolled is not None else _rolling(data, begin, min(begin + BLOCK, len(data)))
        edges = np.flatnonzero(values % np.uint64(size) == 0) + 1
        totals = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values, 9))))
        cuts = totals[np.concatenate(([0], edges, [len(values)]))]
        parts = cuts[1:] - cuts[:-1]
        parts[:1] += carry  # as an array, so that it wraps around silently
        sums.append(parts[:-1])
        carry = parts[-1]
    ends_open = len(data) > 0 and (len(edges) == 0 or edges[-1] < len(values))
    pieces = np.concatenate([*sums, np.array([carry] if ends_open else [], dtype=np.uint64)]) if sums else np.zeros(0, np.uint64)
    if len(pieces) > CHARACTERS:
        pieces = np.append(pieces[: CHARACTERS - 1], pieces[CHARACTERS - 1 :].sum(dtype=np.uint64))
    return _LETTERS[(mix(pieces, 5) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """block size:signature:signature at twice the size. Equal texts have equal ones; an empty text has "3::"."""
    data = np.frombuffer(text, dtype=np.uint8)
    size = SMALLEST
    while size * CHARACTERS < len(data):
        size *= 2
    rolled = _rolling(data, 0, len(data)) if 0 < len(data) <= BLOCK else None
    # Texts with few different bytes have few edges: smaller blocks until half of the characters are used.
    first = _signature(data, size, rolled)
    while size > SMALLEST and len(first) < CHARACTERS // 2:
        size //= 2
        first = _signature(data, size, rolled)
    return f"{size}:{first}:{_signature(data, 2 * size, rolled)}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: how little editing turns one signature into the other, at the best block size that both have; else 0.

    Equal fingerprints are alike by 1; null with anything gives null.
    """
    def part(c: Column, i: int) -> Column:
        return F.split(c, ":")[i]

    def same(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(F.least(F.length(x), F.length(y)) > 0, 1 - F.levenshtein(x, y) / longest).otherwise(F.lit(0.0))

    size_a, size_b = part(a, 0).cast("long"), part(b, 0).cast("long")
    return (F.when(a == b, F.lit(1.0))
            .when(size_a == size_b, F.greatest(same(part(a, 1), part(b, 1)), same(part(a, 2), part(b, 2))))
            .when(size_a == 2 * size_b, same(part(a, 1), part(b, 2)))
            .when(2 * size_a == size_b, same(part(a, 2), part(b, 1)))
            .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .otherwise(F.lit(0.0)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text counts as empty. Only id and text are read; an empty table gives an empty result."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["id"], "fingerprint": pa.array(
                [fingerprint((t or "").encode()) for t in batch["text"].to_pylist()], pa.string())})
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        compute, "doc_id long, fingerprint string")


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row's text, of its successor's, and of its text with the end taken from the successor.

    The successor is the next row by id, then text, nulls last as if empty; after the last comes the first. The edited text has its last
    floor(n_chars / 4) characters replaced by as many (or all) first ones of the successor. Rows are range-partitioned by id
    once; the first row of each range is sent to the range before it as well, so that no range waits for another. Only id and text
    are read; an empty table gives an empty result. Rows of one id, as those without any, lie in one range.
    Output: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint.
    """
    spark = docs.sparkSession
    last = (1 << 63) - 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = rows.select(F.coalesce("id", F.lit(last)).alias("key"))  # rows without an id follow the greatest one
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.unique(np.array(keys.where(F.col("key") < last).approxQuantile(
        "key", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else [], dtype=np.float64).astype(np.int64))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch["key"].to_numpy()
            part = np.searchsorted(cuts, key, side="right")
            if len(key):
                part_of, at = np.unique(part, return_index=True)
                least = [int(key[part == p].min()) for p in part_of]
                yield pa.record_batch({"part": pa.array(part_of.astype(np.int32)), "least": pa.array(least, pa.int64())})
    firsts = sorted((r["part"], r["least"]) for r in keys.mapInArrow(numbered, "part int, least long")
                    .groupBy("part").agg(F.min("least").alias("least")).collect())  # one row per range
    before = {least: firsts[i - 1][0] for i, (_, least) in enumerate(firsts)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "next", "key", "nameless", "text"]
        for batch in batches:
            nameless = batch["id"].is_null()
            key = batch["id"].fill_null(last).to_numpy()
            part = np.searchsorted(cuts, key, side="right").astype(np.int32)
            yield pa.record_batch([pa.array(part), pa.array(np.zeros(len(key), np.int32)), pa.array(key), nameless, batch["text"]], names=names)
            also = np.array([i for i, k in enumerate(key.tolist()) if k in before], dtype=np.int64)
            if len(also):
                to = pa.array([before[k] for k in key[also].tolist()], pa.int32())
                at = pa.array(also)
                yield pa.record_batch([to, pa.array(np.ones(len(also), np.int32)), pa.array(key[also]), nameless.take(at), batch["text"].take(at)],
                                      names=names)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # part, id, text, fingerprint of the row whose successor has not come yet
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                out = []
                columns = (batch[c].to_pylist() for c in ("part", "next", "key", "nameless", "text"))
                for part, is_next, key, nameless, text in zip(*columns, strict=True):
                    if is_next and (held is None or held[0] != part):
                        continue  # of rows that share the first id of the next range, the first was enough
                    own = fingerprint(text.encode())
                    if held is not None:
                        n = len(held[2])
                        edited = (held[2][: n - n // 4] + text[: n // 4]).encode()
                        out.append((held[1], n, hashlib.sha256(edited).hexdigest(), held[3],
                                    fingerprint(edited), own))
                    held = None if is_next else (part, None if nameless else key, text, own)
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.string()] * 4), strict=True)],
                                          names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])

    return (rows.mapInArrow(placed, "part int, next int, key long, nameless boolean, text string")
            .repartition(parts, "part").sortWithinPartitions("part", "next", "key", "nameless", "text")
            .mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                  "next_fingerprint string"))
