"""Labelled documents for fitting, and small fits on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import slices
from tidewatch.llm.words import hash_words, shingles
from tidewatch.session import stored


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, at_most: int) -> DataFrame:
    """(id, text, label) of at most at_most labelled documents outside the held-out fold, the same ones in every run.

    The documents with the least hashes of their id are taken. Labels other than 0 and 1 are left out. Of documents with the
    same label and the same min-hash over three words, as copies and most near copies have, one is taken, so that a group of
    copies does not count as often as it has members.
    """
    chosen = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & (fold(F.col("_id"), folds) != held_out)).distinct()
              .orderBy(F.xxhash64("_id"), "_id", "label").limit(at_most))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("id", "text", "label")  # at_most rows
    once = (found.mapInArrow(_with_least, "id long, text string, label int, least long")
            .groupBy("least", "label").agg(F.min(F.struct("id", "text")).alias("d")))
    return stored(once.select("d.id", "d.text", "label"), "labelled")


def _with_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of the text's runs of three words; 0 for a text without words."""
    for batch in slices(batches, "text"):
        hashes, _, first = hash_words(batch["text"])
        values, begin = shingles(hashes, first, 3)
        some = np.diff(begin) > 0
        least = np.zeros(batch.num_rows, dtype=np.uint64)
        if some.any():
            least[some] = np.minimum.reduceat(values, begin[:-1][some])
        yield pa.record_batch({"id": batch["id"], "text": batch["text"], "label": batch["label"], "least": pa.array(least.view(np.int64))})


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights (the last one for a constant) of a logistic regression by Newton's method; without both classes, a constant."""
    x = np.column_stack([x, np.ones(len(y))])
    weights = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        weights[-1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return weights
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
