"""Toxic passages as maximum-scoring segments of token log-odds, with an extreme-value calibration.

Tokens score the log-odds of toxic against clean documents under a Dirichlet prior; only tokens whose log-odds stand out from
chance are in the lexicon, all others cost a little each. A linear scan finds every maximal segment. Karlin-Altschul statistics,
fitted to clean documents, say how often a segment of such a score comes by chance in a text of that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import slices
from tidewatch.llm.labels import fold, logistic, probability, sample
from tidewatch.llm.segments import maximal_segments
from tidewatch.llm.words import hash_words
from tidewatch.session import stored

TRAINING_DOCS = 20_000  # labelled documents that lexicon and calibration are fitted to
PRIOR = 0.1  # the Dirichlet prior counts for this share of the sample's tokens
DRIFT = -0.25  # score of a token outside the lexicon
SIGNIFICANT = 4.0  # standard errors that a token's log-odds must be away from 0
CHANCE = 0.05  # a segment is significant if fewer of its score are expected in the text
THRESHOLD = 0.5
SEGMENTS = "array<struct<first int, last int, score double, expected double>>"


def lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, log-odds, and share in clean text of the tokens that tell toxic from clean, from rows of (text, label).

    A token counts once for each document. Tokens whose odds chance would explain are left out: with at most at_most documents to count, the lexicon is bounded.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, _, first = hash_words(batch["text"], letters=True)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            token, code = np.unique(hashes[new], return_inverse=True)
            toxic = batch["label"].to_numpy()[owner[new]]
            yield pa.record_batch({"token": pa.array(token.view(np.int64)),
                                   "t": pa.array(np.bincount(code, weights=toxic, minlength=len(token))),
                                   "c": pa.array(np.bincount(code, weights=1 - toxic, minlength=len(token)))})

    counts = stored(rows.mapInArrow(count, "token long, t double, c double")
                    .groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "tokens")
    total = counts.agg(F.sum("t"), F.sum("c")).first()
    toxic, clean = float(total[0] or 0), float(total[1] or 0)
    if not toxic or not clean:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    weight = PRIOR * (toxic + clean)
    t, c = F.col("t") + PRIOR * (F.col("t") + F.col("c")), F.col("c") + PRIOR * (F.col("t") + F.col("c"))
    odds = F.log(t / (toxic + weight - t)) - F.log(c / (clean + weight - c))
    found = (counts.select("token", odds.alias("odds"), F.sqrt(1 / t + 1 / c).alias("error"), (c / (clean + weight)).alias("share"))
             .where(F.abs("odds") >= SIGNIFICANT * F.col("error")).orderBy("token").collect())
    tokens = np.array([r["token"] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return (tokens[order], np.array([r["odds"] for r in found], dtype=float)[order],
            np.array([r["share"] for r in found], dtype=float)[order])


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # ascending hashes
    odds: np.ndarray
    decay: float  # lambda
    rate: float  # K
    calibration: np.ndarray
    prior: float

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Tokens per text, and all maximal segments of each text."""
        hashes, _, first = hash_words(texts, letters=True)
        counts = np.diff(first)
        found: list[list[tuple[int, int, float]]] = [[] for _ in counts]
        if len(self.tokens) and len(hashes):
            place = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
            at = np.flatnonzero(self.tokens[place] == hashes)
            owner = np.searchsorted(first, at, side="right") - 1
            edges = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(at)) if len(at) else at
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                doc = owner[lo]
                found[doc] = maximal_segments(at[lo:hi] - first[doc], self.odds[place[at[lo:hi]]], DRIFT)
        return counts, found

    def expected(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Segments of at least this score that chance gives a clean text of n tokens."""
        return self.rate * n * np.exp(-self.decay * score)

    def evidence(self, n: np.ndarray, found: list[list[tuple[int, int, float]]]) -> np.ndarray:
        """Per text: minus the log probability of its best segment by chance (Gumbel tail), and that of its significant ones."""
        out = np.zeros((len(found), 2))
        for i, segments in enumerate(found):
            if segments:
                e = self.expected(np.array([s[2] for s in segments]), n[i])
                p = -np.expm1(-e.min())
                out[i, 0] = np.log1p(-np.log(max(p, 1e-300)))
                out[i, 1] = np.log1p((e <= CHANCE).sum())
        return out


def _decay(odds: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1 over clean tokens, those outside the lexicon included."""
    values, weights = np.append(odds, DRIFT), np.append(share, max(1 - share.sum(), 1e-9))

    def total(x: float) -> float:
        return float((weights * np.exp(np.minimum(x * values, 700))).sum())

    low, high = 1e-9, 1.0
    while total(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return (low + high) / 2


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, at_most: int = TRAINING_DOCS) -> Model:
    """A model of labels.toxic from at most at_most documents outside the held-out fold.

    To the driver come the lexicon and two numbers for each of these documents. With labels of one kind only, every text gets
    the same score.
    """
    rows = sample(docs, labels, "toxic", folds, held_out, at_most)
    tokens, odds, share = lexicon(rows)
    decay = _decay(odds, share) if len(odds) and odds.max() > 0 else 1.0
    plain = Model(tokens, odds, decay, 1.0, np.zeros(3), 0.5)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, found = plain.segments(batch["text"])
            yield pa.record_batch({"id": batch["id"], "label": batch["label"], "n": pa.array(n), "found": pa.array(
                [[s[2] for s in segments] for segments in found], pa.list_(pa.float64()))})

    scored = stored(rows.mapInArrow(best, "id long, label int, n long, found array<double>"), "segments")
    kept = scored.select("label", "n", F.array_max("found").alias("top")).collect()
    n = np.array([r["n"] for r in kept], dtype=float)
    label = np.array([r["label"] for r in kept], dtype=float)
    top = np.array([0.0 if r["top"] is None else r["top"] for r in kept])
    clean = (label == 0) & (n > 0)
    rate = float(clean.sum() / (n[clean] * np.exp(-decay * top[clean])).sum()) if clean.any() else 1.0
    prior = float(label.mean()) if len(label) else 0.5
    model = Model(tokens, odds, decay, rate, np.zeros(3), prior)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(0, 0, s) for s in scores] for scores in batch["found"].to_pylist()]
            both = model.evidence(batch["n"].to_numpy().astype(float), found).reshape(-1, 2)
            yield pa.record_batch({"id": batch["id"], "label": batch["label"], "best": pa.array(both[:, 0]), "count": pa.array(both[:, 1])})

    seen = sorted(scored.mapInArrow(evidence, "id long, label int, best double, count double").collect())
    both = np.array([r[2:] for r in seen], dtype=float).reshape(-1, 2)
    return Model(tokens, odds, decay, rate, logistic(both, np.array([r["label"] for r in seen], dtype=float)), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, segments) of every row; segments are the significant toxic passages as token numbers from 0, inclusive.

    Tokens are runs of letters (of any script), lower-cased (A-Z). Null and empty texts have no passages and score like any
    text without toxic tokens. Equal texts score alike; only id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            n, found = own.segments(batch["text"])
            passages = [[{"first": f, "last": e, "score": s, "expected": x} for f, e, s in segments
                         if (x := float(own.expected(np.array(s), n[i]))) <= CHANCE] for i, segments in enumerate(found)]
            kind = pa.list_(pa.struct({"first": pa.int32(), "last": pa.int32(), "score": pa.float64(), "expected": pa.float64()}))
            yield pa.record_batch({"doc_id": batch["id"], "score": pa.array(probability(own.evidence(n, found), own.calibration)),
                                   "segments": pa.array(passages, kind)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(compute, f"doc_id long, score double, segments {SEGMENTS}")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, segments) of every row, by a model that has not seen the held-out fold."""
    found = score(docs, train(docs, labels, folds, held_out))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "segments")
