"""Isolation forest (Liu, Ting and Zhou, ICDM 2008) trained and scored by Spark tasks.

The model is a table of nodes. Nodes are numbered like a binary heap: the root is 1, the children
of i are 2i and 2i+1. A leaf has feature -1.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TREES = 100
TREE_ROWS = 256
SEED = 42
THRESHOLD_PERCENTILE = 0.05
DEFAULT_MODEL_THRESHOLD = -0.05
EULER = 0.5772156649
NODES = "tree int, node int, feature int, threshold double, rows int"
_HASH_RANGE = 2 ** 40
_OVERSAMPLE = 4  # rows drawn per tree before the exact cut, as a multiple of the tree size


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, value))


def tree_samples(features: DataFrame, id_col: str, n: int, trees: int = TREES,
                 tree_rows: int = TREE_ROWS, seed: int = SEED) -> DataFrame:
    """``min(tree_rows, n)`` rows for every tree, chosen by hashes of the row id.

    A row gets a few tickets, each drawn with the same chance and naming one tree, so that the work
    per row does not grow with the number of trees. More rows are drawn per tree than needed, then
    cut exactly. The choice does not depend on partitioning or on retried tasks.
    """
    row_id = F.col(id_col)
    share = _OVERSAMPLE * tree_rows / n
    if share >= 1:
        copies = features.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    else:
        tickets = max(1, ceil(share * trees))
        chance = int(share * trees / tickets * _HASH_RANGE)

        def drawn(ticket: Column) -> Column:
            return F.pmod(F.xxhash64(row_id, ticket, F.lit(seed)), F.lit(_HASH_RANGE)) < chance

        named = F.transform(F.filter(F.sequence(F.lit(0), F.lit(tickets - 1)), drawn),
                            lambda t: F.pmod(F.xxhash64(row_id, t, F.lit(seed + 1)), F.lit(trees)).cast("int"))
        # with one ticket most rows of a large table go with a plain filter
        picked = features.where(drawn(F.lit(0))) if tickets == 1 else features
        copies = picked.withColumn("tree", F.explode(F.array_distinct(named)))
    cut = W.partitionBy("tree").orderBy(F.xxhash64(id_col, "tree", F.lit(seed + 2)), id_col)
    return (copies.withColumn("_n", F.row_number().over(cut)).where(F.col("_n") <= tree_rows).drop("_n"))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, int, float, int]]:
    """Nodes (number, feature, threshold, rows) of one random tree."""
    out, todo = [], [(1, 0, np.arange(len(x)))]
    while todo:
        node, depth, rows = todo.pop()
        sub = x[rows]
        low, high = sub.min(axis=0), sub.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varying):
            out.append((node, -1, 0.0, len(rows)))
            continue
        f = int(rng.choice(varying))
        cut = float(rng.uniform(low[f], high[f]))
        if cut >= high[f]:  # rounding in a very narrow range; both sides must get rows
            cut = float(low[f])
        left = sub[:, f] <= cut
        out.append((node, f, cut, len(rows)))
        todo += [(2 * node, depth + 1, rows[left]), (2 * node + 1, depth + 1, rows[~left])]
    return out


def fit(features: DataFrame, id_col: str, columns: list[str], trees: int = TREES,
        tree_rows: int = TREE_ROWS, seed: int = SEED, n: int | None = None) -> DataFrame:
    """The nodes table. Each tree grows in its own task from at most ``tree_rows`` rows."""
    n = features.count() if n is None else n
    if n == 0:
        raise ValueError("no rows to train on")
    limit = int(np.ceil(np.log2(max(min(tree_rows, n), 2))))
    renamed = features.select(F.col(f"`{id_col}`").alias("_id"),
                              *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(columns)])
    names = [f"f{i}" for i in range(len(columns))]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_id")[names].to_numpy(dtype=float)
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        frame = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "rows"])
        frame.insert(0, "tree", tree)
        return frame

    return tree_samples(renamed, "_id", n, trees, tree_rows, seed).groupBy("tree").applyInPandas(build, NODES)


@dataclass(frozen=True)
class Forest:
    """The nodes as arrays ``[tree, node]``; small whatever the training data, as tree sizes are fixed."""

    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray  # of node i at 2i and 2i+1; a leaf is its own child
    path: np.ndarray  # depth of a leaf plus the mean path its rows would still take
    levels: int
    norm: float

    @staticmethod
    def collect(nodes: DataFrame) -> Forest:
        table = nodes.toPandas()  # at most trees * (2 * tree_rows - 1) rows
        number, row_count = table["node"].to_numpy(), table["rows"].to_numpy()
        tree = np.unique(table["tree"], return_inverse=True)[1]
        shape = (int(tree.max()) + 1, int(number.max()) + 1)
        inner = table["feature"].to_numpy() >= 0
        depth = np.floor(np.log2(number))
        feature = np.zeros(shape, dtype=np.intp)
        threshold = np.full(shape, np.inf)
        children = np.tile(np.repeat(np.arange(shape[1]), 2), (shape[0], 1))
        path = np.zeros(shape)
        feature[tree[inner], number[inner]] = table["feature"].to_numpy()[inner]
        threshold[tree[inner], number[inner]] = table["threshold"].to_numpy()[inner]
        for side in (0, 1):
            children[tree[inner], 2 * number[inner] + side] = 2 * number[inner] + side
        path[tree, number] = depth + average_path(row_count)
        return Forest(feature, threshold, children, path, int(depth.max()),
                      float(average_path(row_count[number == 1].max())))

    def decision(self, x: np.ndarray) -> np.ndarray:
        """0.5 minus the anomaly score; lower is more anomalous."""
        if self.norm == 0:
            return np.zeros(len(x))
        values, start = x.ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        for feature, threshold, children, path in zip(self.feature, self.threshold, self.children, self.path):
            node = np.ones(len(x), dtype=np.intp)
            for _ in range(self.levels):
                right = values.take(start + feature.take(node)) > threshold.take(node)
                node = children.take(2 * node + right)
            total += path.take(node)
        return 0.5 - np.power(2.0, -total / len(self.feature) / self.norm)


def decision_column(forest: Forest, inputs: list[Column]) -> Column:
    """The decision value as one vectorised expression over Arrow batches."""
    @F.pandas_udf("double")
    def decide(*series: pd.Series) -> pd.Series:
        return pd.Series(forest.decision(np.column_stack([s.to_numpy(dtype=float) for s in series])))
    return decide(*inputs)


def score(df: DataFrame, nodes: DataFrame | None, columns: list[str], threshold: float,
          rounded: bool = True) -> DataFrame:
    """Add ``if_score`` and ``if_flag``; without a model 0.0 and false.

    A feature the frame lacks counts as 0. The flag compares the unrounded value.
    """
    if nodes is None:
        return df.withColumns({"if_score": F.lit(0.0), "if_flag": F.lit(False)})
    present = set(df.columns)
    inputs = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)
              for c in columns]
    raw = df.withColumn("_decision", decision_column(Forest.collect(nodes), inputs))
    shown = F.round("_decision", 4) if rounded else F.col("_decision")
    return (raw.withColumns({"if_flag": F.col("_decision") < threshold, "if_score": shown})
            .drop("_decision"))
