"""Quality rules as a short-circuit cascade.

1. Counters that every document gets (words, symbols, repeated lines and words) decide the base rules.
2. Each further rule is timed and tried on a sample of documents; rules are then ordered by rejections per cost, counting only what
   the rules before leave over.
3. Every document runs through the rules in that order and leaves at its first rejection.

A document is kept if no rule rejects it, so the order decides the time and never the verdict. Null and empty texts have no words and
fail the base rules. Rows that share an id or a text are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import slices
from tidewatch.llm.words import hash_words, shingles, text_buffer

SAMPLE_DOCS = 2000  # documents, on average, that costs and rejections are estimated on
COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = pa.schema([*((c, pa.int64()) for c in COUNTERS), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

_SPACES = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_NO_ASCII_LETTER = bytes(b for b in range(256) if not (65 <= b < 91 or 97 <= b < 123))
_WITHOUT_LETTER = re.compile(rb"(?<!\S)[^A-Za-z\x80-\xff\s]+(?!\S)")
_BULLET = re.compile(rb"[ \t]*(?:[-*]|\xe2\x80\xa2)")
_IN_WORD = np.array([b not in _SPACES and b & 0xC0 != 0x80 for b in range(256)])
_SYMBOL = np.array([b in b"#*$%&|<>" for b in range(256)])


@dataclass(frozen=True)
class Document:
    """What a rule sees: the text in UTF-8, its lines that hold a word, and the counters."""

    text: bytes
    lines: list[bytes]
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


def _symbols(d: Document) -> bool:
    return 10 * d.n_symbols > d.n_words


def _word_length(d: Document) -> bool:
    return d.word_chars < 3 * d.n_words or d.word_chars > 10 * d.n_words


def _same_lines(d: Document) -> bool:
    return 100 * d.n_dup_lines > 30 * len(d.lines)


def _capitals(d: Document) -> bool:
    letters = d.text.translate(None, _NO_ASCII_LETTER)
    return 2 * (len(letters) - len(letters.translate(None, _UPPER))) > len(letters)


def _no_letters(d: Document) -> bool:
    return 100 * len(_WITHOUT_LETTER.findall(d.text)) > 20 * d.n_words


def _one_word(d: Document) -> bool:
    return 100 * max(Counter(d.text.split()).values(), default=0) > 20 * d.n_words


def _bullets(d: Document) -> bool:
    return 100 * sum(_BULLET.match(line) is not None for line in d.lines) > 90 * len(d.lines)


def _ellipses(d: Document) -> bool:
    return 100 * sum(line.rstrip(_SPACES).endswith((b"...", b"\xe2\x80\xa6")) for line in d.lines) > 30 * len(d.lines)


#: More symbols than a tenth of the words; words of less than 3 or more than 10 characters on average; more than 30 % repeated lines; more
#: than half of the ASCII letters are capitals; more than a fifth of the words have no letter, or are one and the same word; more than
#: 90 % of the lines begin with a bullet; more than 30 % end with an ellipsis.
RULES = (Rule("bullets", _bullets), Rule("capitals", _capitals), Rule("ellipses", _ellipses), Rule("no_letters", _no_letters),
         Rule("one_word", _one_word), Rule("same_lines", _same_lines), Rule("symbols", _symbols), Rule("word_length", _word_length))


def base_fails(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _inside(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set flags of each text."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def _repeated_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them lie in windows of three words that the text has twice or more."""
    hashes, _, first = hash_words(texts, lower=False)
    windows, begin = shingles(hashes, first, 3)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    order = np.lexsort((windows, owner))
    same = (windows[order][1:] == windows[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    found = np.flatnonzero(twice)
    covered = np.zeros(len(hashes) + 2, dtype=bool)
    at = found - begin[owner[found]] + first[owner[found]]
    for k in range(3):
        covered[at + k] = True
    return np.diff(first), _inside(covered, first)


def _documents(texts: pa.Array) -> Iterator[Document]:
    data, offsets = text_buffer(texts)
    n_words, n_repeat = _repeated_words(texts)
    chars, symbols = _inside(_IN_WORD[data], offsets), _inside(_SYMBOL[data], offsets)
    raw = data.tobytes()
    for i in range(len(texts)):
        text = raw[offsets[i] : offsets[i + 1]]
        lines = [line for line in text.split(b"\n") if line.strip(_SPACES)]
        yield Document(text, lines, int(n_words[i]), int(chars[i]), int(symbols[i]), len(lines) - len(set(lines)), int(n_repeat[i]))


def _judged(texts: pa.Array, rules: Sequence[Rule]) -> dict[str, np.ndarray]:
    counts = np.zeros((len(texts), len(COUNTERS)), dtype=np.int64)
    failed, kept = np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=bool)
    for i, d in enumerate(_documents(texts)):
        counts[i] = [getattr(d, c) for c in COUNTERS]
        failed[i] = base_fails(counts[i, 0], counts[i, 4])
        kept[i] = not failed[i] and not any(rule.rejects(d) for rule in rules)
    return {**{c: counts[:, k] for k, c in enumerate(COUNTERS)}, "base_failed": failed, "kept": kept}


def profile(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(pattern, docs, nanos): documents of a sample that pass the base rules, by the set of rules that reject them (bit k: rules[k]),
    and the time each rule took over them. At most 2 ** len(rules) rows, whatever the sample holds."""
    rows = docs.count()
    picked = docs.select(F.col(f"`{text}`").alias("text"))
    if rows > sample_docs:
        picked = picked.sample(fraction=sample_docs / rows, seed=1)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found: dict[int, np.ndarray] = {}
            for d in _documents(batch.column(0)):
                if base_fails(d.n_words, d.n_repeat_words):
                    continue
                took, pattern = np.zeros(len(rules) + 1, dtype=np.int64), 0
                took[-1] = 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter_ns()
                    pattern |= rule.rejects(d) << k
                    took[k] = time.perf_counter_ns() - began
                found[pattern] = found.get(pattern, 0) + took
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array([int(t[-1]) for t in found.values()], pa.int64()),
                 pa.array([t[:-1].tolist() for t in found.values()], pa.list_(pa.int64()))], ["pattern", "docs", "nanos"])

    parts = picked.mapInArrow(tried, "pattern long, docs long, nanos array<long>")
    nanos = F.array(*[F.sum(F.col("nanos")[k]) for k in range(len(rules))]) if rules else F.array().cast("array<bigint>")
    return parts.groupBy("pattern").agg(F.sum("docs").alias("docs"), nanos.alias("nanos"))


def ordered(rules: Sequence[Rule], patterns: Sequence[tuple[int, int, Sequence[int]]]) -> list[Rule]:
    """The rules by rejections per cost: again and again the one that rejects most, for its time, of what the ones before leave over.

    patterns: rows of profile(). Rules that reject nothing more follow, the cheapest first; ties keep the order given.
    """
    docs = sum(p[1] for p in patterns) or 1
    cost = [max(1.0, sum(p[2][k] for p in patterns) / docs) for k in range(len(rules))]
    left, out = list(patterns), []
    while len(out) < len(rules):
        rejected = [sum(n for p, n, _ in left if p >> k & 1) for k in range(len(rules))]
        best = min((k for k in range(len(rules)) if k not in out), key=lambda k: (-rejected[k] / cost[k], cost[k]))
        out.append(best)
        left = [p for p in left if not p[0] >> best & 1]
    return [rules[k] for k in out]


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[Rule]:
    """The order in which the cascade asks the rules."""
    return ordered(rules, [tuple(row) for row in profile(docs, rules, text, sample_docs).collect()])


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES,
           sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(key, the counters, base_failed, kept) of every row. Other columns of docs are not read."""
    order = plan(docs, rules, text, sample_docs)
    slim = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = _judged(batch.column(1), order)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[f.name], f.type) for f in _SCHEMA)], [key, *_SCHEMA.names])

    kinds = ", ".join([*(f"{c} long" for c in COUNTERS), "base_failed boolean", "kept boolean"])
    return slim.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, {kinds}")


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects."""
    order = plan(docs, rules, text, sample_docs)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(_judged(batch.column(at), order)["kept"]))

    return docs.mapInArrow(run, docs.schema)
