"""Exact top-k search by inner product as a Voronoi kNN join.

With one more component sqrt(M - |p|^2) for data (M the largest squared norm) and 0 for queries, order by inner product is order by
distance. Pivots divide data and queries into groups. A summary of each group (radius, and the k least distances to its pivot)
bounds how far the k-th neighbour of any query of a group can be; only data that may be within that bound is sent to the group.
There, data and queries meet in blocks of bounded size, and the best of the blocks are merged.

Vectors that are equal after rounding are one, with its k + 1 least ids: no more of them can be among the best of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import stored

PIVOTS = 64
QUERY_BLOCK = 512  # queries that meet a block of data
DATA_BLOCK = 4096
SCALE = 64
EXACT = float(1 << 53)


def rounded(vector: Column) -> Column:
    """floor(64 * x) of each component as a long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & (F.size(vector) > 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of float64, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _grouped(rows: DataFrame, pivots: np.ndarray, largest: float) -> DataFrame:
    """rows of (vec, ids) with the nearest pivot of the data point, its distance, and the same for the vector as a query."""
    width = pivots.shape[1] - 1
    own = (pivots**2).sum(axis=1)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["vec"], width)
            square = (v**2).sum(axis=1)
            extra = np.sqrt(np.maximum(largest - square, 0))
            cross = v @ pivots[:, :-1].T
            columns = {"vec": batch["vec"], "ids": batch["ids"], "queries": batch["queries"]}
            for name, more, norm in (("data", extra, np.full(len(v), largest)), ("query", np.zeros(len(v)), square)):
                distance = np.sqrt(np.maximum(norm[:, None] + own[None, :] - 2 * (cross + more[:, None] * pivots[:, -1]), 0))
                near = distance.argmin(axis=1)
                columns[f"{name}_group"] = pa.array(near.astype(np.int32))
                columns[f"{name}_distance"] = pa.array(distance[np.arange(len(v)), near] if len(v) else np.zeros(0))
            yield pa.record_batch(columns)
    return rows.mapInArrow(compute, "vec array<long>, ids array<long>, queries array<long>, data_group int, data_distance double, "
                                    "query_group int, query_distance double")


def _reach(groups: DataFrame, pivots: np.ndarray, k: int) -> np.ndarray:
    """For each group of queries and group of data, the least distance to its pivot at which a data point must be sent, or inf.

    A query at u from pivot i has k + 1 points within u + |i, j| + (the least distances to pivot j): theirs is the bound of its
    k-th neighbour other than itself. A point at d from pivot j is at least |i, j| - u - d away.
    """
    n = len(pivots)
    near = F.row_number().over(W.partitionBy("data_group").orderBy("data_distance"))
    copies = F.size("ids")
    least = (groups.select("data_group", "data_distance", copies.alias("copies"), near.alias("r")).where(F.col("r") <= k + 1)
             .collect())  # at most pivots * (k + 1) rows
    radius = np.full(n, -1.0)
    for row in groups.where(F.size("queries") > 0).groupBy("query_group").agg(F.max("query_distance").alias("u")).collect():
        radius[row["query_group"]] = row["u"]
    apart = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0))
    reach = np.full((n, n), np.inf)
    for i in np.flatnonzero(radius >= 0):
        far = sorted((radius[i] + apart[i, r["data_group"]] + r["data_distance"], r["copies"]) for r in least)
        seen, bound = 0, np.inf
        for distance, copies_here in far:
            seen += copies_here
            if seen >= k + 1:
                bound = distance
                break
        reach[i] = apart[i] - radius[i] - bound
        reach[i] -= 1e-6 * (1 + np.abs(apart[i]) + (bound if np.isfinite(bound) else 0))
    return reach


def top_k(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, the k others of highest inner product
    after rounding, ties to the lesser id.

    Vectors that are null, empty or hold null or non-finite components, and rows without id, take no part. Vectors of
    different lengths count as filled up with zeros. Rows that share an id are points and queries of their own; only the
    query's own row is not a neighbour. With fewer than k others, all are returned. Sums beyond 2**53 are refused.
    """
    spark = rows.sparkSession
    plain = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), rounded(F.col(vector_col)).alias("vec"))
    # k + 1 least ids of each vector, cut before the shuffle as well as after it
    order = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    ids = (plain.withColumn("r", order).where(F.col("r") <= k + 1).groupBy("vec")
           .agg(F.array_sort(F.collect_list("id")).alias("ids")))
    # queries of a vector are as many as they are; they stay rows of their own
    asked = plain.where(F.pmod("id", F.lit(every)) == 0)
    points = stored(ids, "points")
    facts = points.select(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("s"),
                          F.size("vec").alias("w")).agg(F.max("s"), F.max("w")).first()
    if facts[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    largest, width = float(facts[0]), int(facts[1])
    if largest >= EXACT:
        raise ValueError("inner products of these vectors are beyond exact arithmetic")
    chosen = points.orderBy(F.xxhash64("vec")).limit(PIVOTS).select("vec").collect()
    pivots = np.zeros((len(chosen), width + 1))
    for i, row in enumerate(chosen):
        pivots[i, : len(row["vec"])] = row["vec"]
        pivots[i, -1] = np.sqrt(max(largest - (pivots[i, :-1] ** 2).sum(), 0))
    wanted = asked.select("vec").distinct().withColumn("queries", F.array(F.lit(1).cast("long")))
    grouped = stored(_grouped(points.join(wanted, "vec", "left").withColumn(
        "queries", F.coalesce("queries", F.expr("cast(array() AS array<long>)"))), pivots, largest), "grouped")
    reach = _reach(grouped, pivots, k)

    # Where a point goes: every group of queries that it may matter to, at a block number that bounds what meets in a task.
    active = np.flatnonzero(np.isfinite(reach).any(axis=1)).tolist()
    limits = spark.createDataFrame([(int(j), int(i), float(reach[i, j])) for i in active for j in range(len(pivots))],
                                   "data_group int, group int, reach double")  # pivots squared rows
    sent = grouped.join(F.broadcast(limits), "data_group").where(F.col("data_distance") >= F.col("reach")).select(
        "group", "vec", "ids")
    query_rows = grouped.where(F.size("queries") > 0).select(F.col("query_group").alias("group"), "vec")
    size_of = {r["group"]: r["count"] for r in sent.groupBy("group").count().collect()}
    asked_of = {r["group"]: r["count"] for r in query_rows.groupBy("group").count().collect()}
    sizes = spark.createDataFrame([(g, -(-size_of.get(g, 0) // DATA_BLOCK) or 1, -(-asked_of.get(g, 0) // QUERY_BLOCK) or 1) for g in active],
                                  "group int, blocks int, parts int")
    some = F.pmod(F.xxhash64("vec"), F.col("blocks"))
    part = F.pmod(F.xxhash64("vec", F.lit(1)), F.col("parts"))
    data_side = sent.join(F.broadcast(sizes), "group").select(
        "group", some.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec", "ids")
    query_side = query_rows.join(F.broadcast(sizes), "group").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), "vec")
    at = [F.col("group").cast("long"), F.col("block").cast("long"), F.col("part").cast("long")]
    data_side = data_side.select(F.xxhash64(*at).alias("meet"), "vec", "ids")
    query_side = query_side.select(F.xxhash64(*at).alias("meet"), F.col("vec").alias("wanted"))

    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = {"vec": [], "score": [], "ids": []}
        if len(queries) and len(data):
            q, d = (_matrix(pa.array(list(x), pa.list_(pa.int64())), width) for x in (queries["wanted"], data["vec"]))
            least = np.array([x[0] for x in data["ids"]])
            for begin in range(0, len(q), 64):
                scores = q[begin : begin + 64] @ d.T  # whole numbers below 2**53: exact
                for row, vec in zip(scores, queries["wanted"][begin : begin + 64], strict=True):
                    # k + 1 distinct points hold k others; of those that tie at the border all come, to be ranked by id
                    border = np.partition(row, -(k + 1))[-(k + 1)] if len(row) > k else -np.inf
                    hit = np.flatnonzero(row >= border)
                    hit = hit[np.lexsort((least[hit], -row[hit]))][: k + 1]
                    out["vec"].append(vec)
                    out["score"].append(row[hit].astype(np.int64))
                    out["ids"].append([list(x) for x in data["ids"].iloc[hit]])
        return pd.DataFrame(out)

    met = query_side.groupBy("meet").cogroup(data_side.groupBy("meet")).applyInPandas(
        solve, "vec array<long>, score array<long>, ids array<array<long>>")
    near = met.select("vec", F.explode(F.arrays_zip("score", "ids")).alias("n")).select(
        "vec", F.col("n.score").alias("score"), F.explode("n.ids").alias("vec_id"))
    best = F.row_number().over(W.partitionBy("vec").orderBy(F.col("score").desc(), "vec_id"))
    # a query's own id is one of the k + 1 at most; queries of an equal vector share its list
    listed = near.withColumn("r", best).where(F.col("r") <= k + 1).groupBy("vec").agg(
        F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    own_score = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x)
    own = F.array_position(F.transform("near", lambda n: (n["vec_id"] == F.col("id")) & (n["score"] == own_score)), True)
    others = F.slice(F.filter("near", lambda n, i: i + 1 != own), 1, k)
    answers = asked.join(listed, "vec").select("id", F.posexplode(others).alias("at", "n"))
    return answers.select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"),
                          F.col("n.score").alias("score"))
