"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line is described by its own make-up and by that of the lines before and after it; the chain adds
how states follow one another. Forward-backward gives each line's probability of being good; the mean over a document, weighted
by the length of lines, is calibrated into its score.
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
from tidewatch.llm.words import hash_words, mix, text_buffer

TRAINING_DOCS = 4000  # labelled documents that the model is fitted to
TRAINING_LINES = 250_000  # of all of them together, which come to the driver
ROUNDS = 150
THRESHOLD = 0.7

_KINDS = np.zeros(256, dtype=np.int8)  # 0: other letters
_KINDS[65:91] = 1
_KINDS[48:58] = 2
_KINDS[[32, 9, 11, 12, 13]] = 3
_KINDS[[44, 46]] = 4
_KINDS[[c for c in range(33, 127) if not (chr(c).isalnum() or c in (44, 46))]] = 5
_KINDS[124] = 6
OWN = 14


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all non-empty lines with those of their neighbours, the lines' bytes, and the first line of each text."""
    data, offsets = text_buffer(texts)
    owner_edge = np.zeros(len(data) + 1, dtype=bool)
    owner_edge[offsets] = True
    solid = data != 10
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1] | owner_edge[1:-1]
    starts = np.flatnonzero(fresh)
    first = np.searchsorted(starts, offsets)
    n = len(starts)
    own = np.zeros((n, OWN))
    if not n:
        return np.zeros((0, 3 * OWN + 1)), np.zeros(0), first
    lengths = np.add.reduceat(solid, starts, dtype=np.int64).astype(float)
    kinds = _KINDS[data]
    for k in range(1, 7):
        own[:, k - 1] = np.add.reduceat((kinds == k) & solid, starts, dtype=np.int64) / lengths
    hashes, at, _ = hash_words(texts)
    line = np.searchsorted(starts, at, side="right") - 1
    words = np.bincount(line, minlength=n).astype(float)
    some = np.maximum(words, 1)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line))
    h, o = hashes[order], line[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    total = np.zeros(n, dtype=np.uint64)
    np.add.at(total, line, mix(hashes, 11))
    doc = np.searchsorted(first, np.arange(n), side="right") - 1
    _, code, times = np.unique(mix(total) + mix(doc.astype(np.uint64), 2), return_inverse=True, return_counts=True)
    own[:, 6] = np.log1p(lengths) / 8
    own[:, 7] = np.log1p(words) / 6
    own[:, 8] = np.minimum(lengths / some, 40) / 20
    own[:, 9] = np.bincount(line, weights=same, minlength=n) / some
    own[:, 10] = np.bincount(o, weights=new, minlength=n) / some
    own[:, 11] = np.log1p(times[code] - 1) / 3
    own[:, 12] = words == 0
    own[:, 13] = own[:, 0] > 0.5
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = doc[1:] == doc[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    return np.column_stack([own, before, after, np.ones(n)]), lengths, first


def _positions(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place in a chain, the chains that have it (longest first) and their lines at that place."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    alive = len(order)
    for t in range(int(counts.max(initial=0))):
        while alive and counts[order[alive - 1]] <= t:
            alive -= 1
        yield order[:alive], first[:-1][order[:alive]] + t


def forward_backward(unary: np.ndarray, follow: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For log potentials (line x state, state x state): states' probabilities per line, expected transitions, log of the sum.

    Chains are first[i]..first[i+1]; each step is normalised, so chains of any length neither under- nor overflow.
    """
    n = len(unary)
    shift = unary.max(axis=1, initial=-np.inf) if n else np.zeros(0)
    u, a = np.exp(unary - shift[:, None]), np.exp(follow)
    alpha, beta, scale = np.zeros((n, 2)), np.ones((n, 2)), np.ones(n)
    places = list(_positions(first))
    for t, (_, lines) in enumerate(places):
        now = u[lines] if t == 0 else (alpha[lines - 1] @ a) * u[lines]
        scale[lines] = now.sum(axis=1)
        alpha[lines] = now / scale[lines][:, None]
    for _, lines in reversed(places[1:]):
        beta[lines - 1] = ((u[lines] * beta[lines]) @ a.T) / scale[lines][:, None]
    marginal = alpha * beta
    marginal /= np.maximum(marginal.sum(axis=1, keepdims=True), 1e-300)
    later = np.setdiff1d(np.arange(n), first[:-1][np.diff(first) > 0])
    both = np.zeros((2, 2))
    if len(later):
        both = a * np.einsum("ni,nj->ij", alpha[later - 1], u[later] * beta[later] / scale[later][:, None])
    return marginal, both, float(np.log(scale).sum() + shift.sum())


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # features -> log potential of "good"
    follow: np.ndarray  # state x state log potentials
    calibration: np.ndarray
    prior: float

    def score(self, features: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
        unary = np.column_stack([np.zeros(len(features)), features @ self.weights])
        good = forward_backward(unary, self.follow, first)[0][:, 1]
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        weight = np.bincount(owner, weights=lengths, minlength=len(first) - 1)
        mean = np.bincount(owner, weights=lengths * good, minlength=len(first) - 1) / np.maximum(weight, 1)
        return np.where(weight > 0, probability(mean[:, None], self.calibration), self.prior)


def _fit(features: np.ndarray, lengths: np.ndarray, first: np.ndarray, label: np.ndarray) -> Model:
    """Conditional likelihood by Adam; lines take the label of their document."""
    state = np.repeat(label, np.diff(first)).astype(int)
    weights, follow = np.zeros(features.shape[1]), np.zeros((2, 2))
    later = np.setdiff1d(np.arange(len(state)), first[:-1][np.diff(first) > 0])
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[later - 1], state[later]), 1)
    m, v = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    n = max(1, len(state))
    for step in range(1, ROUNDS + 1 if len(state) else 1):
        marginal, both, _ = forward_backward(np.column_stack([np.zeros(len(features)), features @ weights]), follow, first)
        slope = np.concatenate([features.T @ (state - marginal[:, 1]), (seen - both).ravel()]) / n
        slope -= 1e-4 * np.concatenate([weights, follow.ravel()])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, follow = weights + move[:-4], follow + move[-4:].reshape(2, 2)
    prior = float(label.mean()) if len(label) else 0.5
    raw = Model(weights, follow, np.array([1.0, 0.0]), prior)
    unary = np.column_stack([np.zeros(len(features)), features @ weights])
    good = forward_backward(unary, follow, first)[0][:, 1]
    owner = np.repeat(np.arange(len(label)), np.diff(first))
    weight = np.bincount(owner, weights=lengths, minlength=len(label))
    mean = np.bincount(owner, weights=lengths * good, minlength=len(label)) / np.maximum(weight, 1)
    some = weight > 0
    return Model(raw.weights, raw.follow, logistic(mean[some][:, None], label[some].astype(float)), prior)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, at_most: int = TRAINING_DOCS) -> Model:
    """A model of labels.quality from whole documents outside the held-out fold: at most at_most of them, and with at most
    TRAINING_LINES lines together.

    Only the features of these lines (a bounded number) come to the driver. Documents are taken by a hash of their id; one that
    does not fit any more is passed over. Without labels every score is 0.5.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = [sum(map(bool, (t or "").split("\n"))) for t in batch["text"].to_pylist()]
            yield pa.record_batch({"id": batch["id"], "label": batch["label"], "lines": pa.array(lines, pa.int64())})

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            features, lengths, first = line_features(batch["text"])
            rows = [np.column_stack([features[a:b], lengths[a:b]]).astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch({"id": batch["id"], "label": batch["label"], "lines": pa.array(rows, pa.binary())})

    labelled = sample(docs, labels, "quality", folds, held_out, at_most)
    sizes = labelled.mapInArrow(counted, "id long, label int, lines long").withColumn("place", F.xxhash64("id", "label")).collect()
    taken, room = [], TRAINING_LINES
    for r in sorted(sizes, key=lambda r: (r["place"], r["id"], r["label"])):
        if r["lines"] <= room:
            taken.append((r["id"], r["label"]))
            room -= r["lines"]
    chosen = docs.sparkSession.createDataFrame(taken, "id long, label int")  # at_most rows
    rows = labelled.join(F.broadcast(chosen), ["id", "label"]).select("id", "text", "label").mapInArrow(
        compute, "id long, label int, lines binary").collect()
    rows.sort(key=lambda r: (r["id"], r["label"]))
    parts = [np.frombuffer(bytes(r["lines"]), dtype=np.float32).reshape(-1, 3 * OWN + 2).astype(float) for r in rows]
    lines = np.concatenate(parts) if parts else np.zeros((0, 3 * OWN + 2))
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(int)
    return _fit(lines[:, :-1], lines[:, -1], first, np.array([r["label"] for r in rows], dtype=int))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the calibrated, length-weighted probability that its lines are good.

    Lines end at \\n; empty lines don't count. Null, empty and newline-only texts get the share of good documents in the
    training sample. Equal texts get equal scores; only id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.record_batch({"doc_id": batch["id"], "score": pa.array(shared.value.score(*line_features(batch["text"])))})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a model that has not seen the held-out fold."""
    found = scores(docs, train(docs, labels, folds, held_out))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold; scored where they are, without a shuffle, so that rows that share an id or a text are
    judged one by one and all columns stay.

    The text is the column `text`. Null and blank texts score the share of good documents in the training sample, so all of them
    go or all stay. An empty table gives an empty result, and without labels no row reaches the usual threshold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_out))
    names = docs.columns

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text"))
            good = shared.value.score(*line_features(texts)) >= threshold
            yield pa.record_batch(batch.columns, names=names).filter(pa.array(good))

    return docs.mapInArrow(compute, docs.schema)
