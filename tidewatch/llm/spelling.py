"""Spelling variants of words: a dictionary of node pairs of two tries.

1. Words are counted over all texts.
2. The words are sorted, and a prefix is numbered by the first word that has it and its length: these are the nodes of the trie. The
   reversed words give the trie of suffixes in the same way. Each task numbers its own range; what a range shares with the
   ones before it is carried over its border, one row per range.
3. A word that leaves out position i is the pair (prefix node before i, suffix node after i), and a word as it is, cut before i,
   is the pair (prefix node, suffix node) around that gap. Two words whose left-out pairs are equal differ by one replaced code point;
   a left-out pair that equals a gap pair is an insertion. Equal pairs mean equal texts, so neighbours are exact.
4. A pair is held by at most one word as it is and one left-out word per letter of the alphabet, so groups are small by nature.

A letter can be inserted at several places of a run of equal letters; only the last place of a run counts, so each two neighbours meet once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import slices
from tidewatch.llm.words import text_buffer
from tidewatch.session import stored

LEAST_CHARS = 6
LEAST_COUNT = 5
FACTOR = 5  # a form is so many times as frequent as its variant
TYPO_EVERY = 199
HELD_BYTES = 32 << 20  # bytes of distinct words that a task counts before it sends them on
#: [A-Za-zÀ-ÿ]+ in UTF-8, of texts whose A-Z are lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LETTER_BYTE = re.compile(rb"[a-z]|\xc3[\x80-\xbf]")


def with_typo(run: bytes, hashed: int) -> bytes:
    """The run without its code point hashed % length, if hashed is a multiple of TYPO_EVERY."""
    if hashed % TYPO_EVERY:
        return run
    letters = _LETTER_BYTE.findall(run)
    at = hashed % len(letters)
    return b"".join(letters[:at] + letters[at + 1 :])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()
    held_bytes = 0
    for batch in slices(batches, "text"):
        data, offsets = text_buffer(batch.column(1))
        raw = data.tobytes().lower()  # bytes.lower() changes A-Z alone
        for i, doc in enumerate(batch.column(0).to_pylist()):
            seed = crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(_RUN.findall(raw[offsets[i] : offsets[i + 1]])).items():
                word = with_typo(run, crc32(run, seed))
                if len(word) >= LEAST_CHARS and len(word) - word.count(b"\xc3") >= LEAST_CHARS:
                    if word not in held:
                        held_bytes += len(word) + 100
                    held[word] += n
        if held_bytes > HELD_BYTES:
            yield _as_batch(held)
            held, held_bytes = Counter(), 0
    yield _as_batch(held)


def _as_batch(held: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())],
                                      ["word", "n"])


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the lower-cased runs of letters of all texts, misspelt where the hash of document and run says so, that have
    LEAST_CHARS code points and occur LEAST_COUNT times. Null texts have no words, a null key hashes as an empty one; rows that
    share a key or a text all count."""
    slim = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = slim.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a sorted range: its place, and for each of its prefixes the place of the first word in the range that has it."""
    part, at, last, firsts = TaskContext.get().partitionId(), 0, "", []
    for batch in slices(batches, "word"):
        out = []
        for word in batch.column(0).to_pylist():
            keep = _shared(last, word) + 1 if firsts else 0
            firsts = firsts[:keep] + [at] * (len(word) + 1 - keep)
            out.append((at, firsts))
            last, at = word, at + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()),
             pa.array([o[1] for o in out], pa.list_(pa.int64())), batch.column(0), batch.column(1)],
            ["part", "at", "firsts", "word", "n"])


def numbered(words: DataFrame, longest: int) -> DataFrame:
    """(id, word, n, nodes) of a table (word, n) of distinct words: id is the word's place in the order of code points, nodes the numbers
    of its prefixes from the empty one to the whole word. A prefix is first word * (longest + 1) + length.

    The driver sees one row per range: its size, its first and last word, and the places of the last word's prefixes.
    """
    ranged = stored(words.repartitionByRange("word").sortWithinPartitions("word")
                    .mapInArrow(_ranged, "part long, at long, firsts array<long>, word string, n long"), "trie-ranges")
    ends = ranged.groupBy("part").agg(
        F.count(F.lit(1)).alias("size"), F.min("word").alias("first"), F.max(F.struct("word", "firsts")).alias("last"))
    before, last, places, rows = 0, "", [], []
    for part, size, first, (end, firsts) in sorted(tuple(r) for r in ends.collect()):
        carried = places[: _shared(last, first) + 1]
        rows.append((part, before, carried))
        places = [carried[i] if f == 0 and i < len(carried) else before + f for i, f in enumerate(firsts)]
        before, last = before + size, end
    if before * (longest + 1) >= 2**63:
        raise ValueError("too many words of such length to number the nodes in 64 bits")
    borders = words.sparkSession.createDataFrame(rows, "part long, before long, carried array<long>")

    def number(first, i):
        place = F.when((first == 0) & (i < F.size("carried")), F.get("carried", i)).otherwise(F.col("before") + first)
        return place * (longest + 1) + i

    return ranged.join(F.broadcast(borders), "part").select(
        (F.col("before") + F.col("at")).alias("id"), "word", "n", F.transform("firsts", number).alias("nodes"))


#: What a pair is to a word: the word without a position, the same at the last place of a run of equal letters, the word as it is.
_OUT, _OUT_LAST, _GAP = 0, 1, 2


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (prefix node, suffix node) of each word."""
    for batch in slices(batches, "word"):
        word, heads, tails = (batch.column(batch.schema.get_field_index(c)) for c in ("word", "heads", "tails"))
        if not len(word):
            continue
        sizes = np.diff(heads.offsets.to_numpy()).astype(np.int64)
        heads, tails = heads.flatten().to_numpy(), tails.flatten().to_numpy()
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(heads)) - begin[owner]
        length = sizes[owner] - 1
        letters = np.frombuffer("".join(word.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        whole = at < length  # positions of letters; the others are the gap after the last one
        of_letter = owner[whole]
        changes = np.ones(len(letters), dtype=bool)
        changes[:-1] = (letters[1:] != letters[:-1]) | (of_letter[1:] != of_letter[:-1])
        rows = np.concatenate((owner, of_letter))
        kinds = np.concatenate((np.full(len(owner), _GAP), np.where(changes, _OUT_LAST, _OUT))).astype(np.int8)
        suffix = np.concatenate((tails[begin[owner] + length - at], tails[(begin[owner] + length - 1 - at)[whole]]))
        prefix = np.concatenate((heads, heads[whole]))
        ids, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "n"))
        for i in range(0, len(rows), 1 << 16):
            some = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix[some]), pa.array(suffix[some]), pa.array(ids[rows[some]]), pa.array(n[rows[some]]), pa.array(kinds[some])],
                ["prefix", "suffix", "id", "n", "kind"])


def neighbours(numbers: DataFrame, longest: int) -> DataFrame:
    """(id, n_near, best): how many words each word is near to, and (n, -id) of the most frequent one, the first in code-point order
    of equals; only words that have any. numbers: as numbered() returns it."""
    turned = numbered(numbers.select(F.reverse("word").alias("word"), F.col("id").alias("n")), longest)
    both = numbers.withColumnRenamed("nodes", "heads").join(
        turned.select(F.col("n").alias("id"), F.col("nodes").alias("tails")), "id")
    pairs = both.mapInArrow(_pairs, "prefix long, suffix long, id long, n long, kind byte")
    groups = pairs.groupBy("prefix", "suffix").agg(
        F.collect_list(F.struct("n", (-F.col("id")).alias("id"), "kind")).alias("words")).where(F.size("words") > 1)
    own = groups.select(F.explode("words").alias("own"), "words")

    def near(w):
        replaced = (w["kind"] < _GAP) & (F.col("own.kind") < _GAP) & (w["id"] != F.col("own.id"))
        return replaced | (w["kind"] == _GAP) & (F.col("own.kind") == _OUT_LAST) | (w["kind"] == _OUT_LAST) & (F.col("own.kind") == _GAP)

    found = own.select((-F.col("own.id")).alias("id"), F.filter("words", near).alias("near")).where(F.size("near") > 0)
    best = F.array_max(F.transform("near", lambda w: F.struct(w["n"].alias("n"), w["id"].alias("id"))))
    return found.select("id", F.size("near").cast("long").alias("c"), best.alias("best")).groupBy("id").agg(
        F.sum("c").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of a table (id, form): forms are followed to the last one, twice as far in each round. A form is at least FACTOR times as
    frequent as its word, so chains are short and never circles."""
    found = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = stored(found.join(further, "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = longer.select("id", "root")
        if longer.where("moved").isEmpty():
            return found


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of vocabulary().

    form: the most frequent word at one inserted, deleted or replaced code point, the first in code-point order of equals, if it is
    FACTOR times as frequent; else null. root: the last form that forms lead to, the word itself if it has none. Only the key
    and the text of docs are read. An empty table gives an empty result.
    """
    words = stored(vocabulary(docs, key, text), "vocabulary")
    longest = words.agg(F.coalesce(F.max(F.length("word")), F.lit(0))).first()[0]
    if not longest:
        return words.select("word", *(F.lit(None).cast(kind).alias(c) for c, kind in (
            ("form", "string"), ("root", "string"), ("n", "long"), ("n_near", "long"), ("form_n", "long"))))
    numbers = stored(numbered(words, longest), "trie")
    near = neighbours(numbers, longest)
    joined = stored(numbers.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best.n") >= FACTOR * F.col("n"), F.col("best")).alias("best")), "near-words")
    forms = joined.where("best is not null").select("id", (-F.col("best.id")).alias("form"))
    texts = joined.select("id", "word")
    roots = _roots(forms).join(texts.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    named = forms.join(texts.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form").select("id", "form_word")
    return joined.join(named.join(roots, "id"), "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near",
        F.col("best.n").alias("form_n"))
