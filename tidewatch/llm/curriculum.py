"""Mixing sources to target weights by a time-varying curriculum, in DataFrame expressions only.

The weight of a source is a piecewise linear function of training time (0 to 1). Its integral is the source's share of all
words; a share that asks for more than `most` times the source is cut there and the excess goes to the others by weight. The
cumulative demand of a source, inverted, gives the time at which each of its documents (and each repetition) is due, and the
mix is sorted by that time. A source's documents follow one another in the order of a hash of their id. Running totals are
built from slices of a bounded number of rows, so that a source with a large share of all rows is spread over many tasks.

Whole texts are moved once: sizes alone say when each piece of a source is due, so a document goes straight to the parts of the mix
that its piece reaches into, and its own time is worked out there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import stored

SLICE_ROWS = 1024  # aimed at; a slice's rows are ordered in one task
PART_ROWS = 2048  # of the mix, at least, in a partition
PIECES = 8  # of each source for every partition of the mix; a piece lies in one partition or, at its ends, in two
_NEAR = 1e-9  # of the time from 0 to 1: more than rounding makes
#: The part of a weight schedule between two times, and the area before and under it.
SEGMENT = "array<struct<t0 double, t1 double, w0 double, w1 double, area0 double, area1 double>>"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t \\n \\v \\f \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def schedule(*knots: tuple[float, float]) -> str:
    """SQL for the segments of a piecewise linear weight, given as (time, weight) from time 0 to time 1."""
    area, parts = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        under = (t1 - t0) * (w0 + w1) / 2
        parts.append(f"named_struct('t0', {t0}D, 't1', {t1}D, 'w0', {w0}D, 'w1', {w1}D, 'area0', {area}D, 'area1', {area + under}D)")
        area += under
    return f"cast(array({', '.join(parts)}) AS {SEGMENT})"


#: Schedules with the integrals 1, 2 and 3: fading out, level, and coming in.
SCHEDULES = (schedule((0, 1.5), (1, 0.5)), schedule((0, 2.0), (1, 2.0)), schedule((0, 1.5), (0.5, 3.0), (1, 4.5)))


def _targets(sized: DataFrame, schedules: tuple[str, ...], most: float) -> DataFrame:
    """(key, source_size, target, segments) per source. Sources in order of code points, null last, take the schedules in turn.

    Filling up: in order of the weight at which a source reaches its limit, the first k are held at their limits and the rest
    share what is left by weight, for the least k at which none of the rest is above its limit.
    """
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("key").substr(1, 1), "key")  # one row per source
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(schedules)))
    segments = F.array(*[F.expr(s) for s in schedules])
    sources = stored(sources.withColumn("segments", segments[turn]), "sources")
    weight = F.element_at("segments", -1)["area1"]
    limit = F.col("source_size") * F.lit(float(most))
    by_limit = W.orderBy(F.col("limit") / F.col("weight"), "key")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    # Sources are held while the level of the rest is at or above their own; the first that is not sets the level.
    filled = (sources.withColumn("weight", weight).withColumn("limit", limit).withColumn("level", level)
              .withColumn("free", F.col("level") * F.col("weight") <= F.col("limit")))
    common = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        by_limit.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(F.coalesce(common * F.col("weight"), F.col("limit")), F.col("limit"))
    return filled.select("key", "source_size", target.alias("target"), "segments")


def _due(words: Column) -> Column:
    """Time at which the cumulative demand of the row's source reaches words."""
    area = words / F.col("target") * F.element_at("segments", -1)["area1"]
    inside = F.element_at(F.filter("segments", lambda s: (s["area1"] >= area) | (s["t1"] >= 1)), 1)
    t0, rest = inside["t0"], area - inside["area0"]
    slope = (inside["w1"] - inside["w0"]) / (inside["t1"] - inside["t0"])
    root = F.sqrt(F.greatest(inside["w0"] * inside["w0"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(t0 + 2 * rest / (inside["w0"] + root), F.lit(1.0))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         schedules: tuple[str, ...] = SCHEDULES, most: int = 3) -> DataFrame:
    """Per row of docs: id, size in words, source_size, the source's target, and copies: an array of (copy, words, position).

    A source's documents are taken in one order, over and over until the target is met; the last one is taken only as far as
    the target goes, so a source's words add up to its target, rounded. No document is taken more than `most` times. Null and
    blank texts have no words and no copies; a null source is a source of its own; rows that repeat count each on their own.
    A source without words has target 0, and an empty table gives an empty result. Rows of one id, source and size that are
    told apart by nothing else are interchangeable. Other columns are not read. The same rows give the same result.
    """
    sized = stored(docs.select(F.col(id_col).alias("id"), _key(source_col), word_count(F.col(text_col)).alias("size")), "sizes")
    return _planned(sized, schedules, most)


def _key(source_col: str) -> Column:
    source = F.col(source_col)
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string"))).alias("key")


def _place() -> Column:
    """Where a row of an id stands in its source, from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64("id", F.lit(20)), 11).cast("double") / F.lit(float(1 << 53))


def _copy(k: Column) -> Column:
    """(copy, words, position) of the row's k-th copy."""
    start = F.col("_begin") + k * F.col("source_size")
    words = F.least(F.col("size"), F.greatest(F.round("target").cast("long") - start, F.lit(0).cast("long")))
    return F.struct(k.cast("int").alias("copy"), words.alias("words"), _due(start + words / 2).alias("position"))


def _planned(sized: DataFrame, schedules: tuple[str, ...], most: int) -> DataFrame:
    """The plan of (id, key, size)."""
    targets = _targets(sized, schedules, float(most))
    # The hash of the id says in which slice of its source a row lies. Sources are cut alike, as the largest needs it, so that
    # they need not meet their rows for it.
    place = _place()
    counts = sized.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    slices = F.lit(int(counts.agg(F.max(F.ceil(F.col("n") / SLICE_ROWS))).first()[0] or 1))
    sliced = sized.withColumn("place", place).withColumn("slice", F.floor(F.col("place") * slices).cast("long"))
    totals = sliced.groupBy("key", "slice").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (totals.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
               .join(targets, "key"))
    within = W.partitionBy("key", "slice").orderBy("place", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (sliced.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .join(offsets, ["key", "slice"]).withColumn("_begin", F.col("offset") + F.col("_before")))
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), _copy), lambda c: c["words"] > 0)
    return placed.select("id", F.col("key").alias("source_key"), "size", "source_size", "target",
                         copies.alias("copies"))


def in_order(planned: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by position; documents without a copy are left out."""
    return (planned.select("id", F.explode("copies").alias("c")).select("id", "c.copy", "c.words", "c.position")
            .orderBy("position", "id", "copy"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          schedules: tuple[str, ...] = SCHEDULES, most: int = 3) -> DataFrame:
    """The rows of docs in training order, a row once for each copy of its document; columns as in docs.

    Documents stay whole: the one at which a source's target falls is taken if at least half of it is within the target.
    Rows that share an id are taken together, as often as the first of them; rows without an id that share text and source
    are taken together as well.
    """
    known = F.col(f"`{id_col}`")
    known = known.cast("string" if dict(docs.dtypes)[id_col] == "string" else "long")
    named = F.coalesce(known, F.xxhash64(F.lit(0), F.col(f"`{text_col}`"), F.col(f"`{source_col}`")).cast(docs.select(known).schema[0].dataType))
    rows = docs.select(F.struct("*").alias("row"), named.alias("id"))
    sized = stored(docs.select(named.alias("id"), _key(f"`{source_col}`"), word_count(F.col(f"`{text_col}`")).alias("size")), "sizes")
    if sized.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        by_row = docs.select(F.struct("*").alias("row"), named.alias("id"), _key(f"`{source_col}`"), word_count(F.col(f"`{text_col}`")).alias("size"))
        return _in_parts(by_row, sized, schedules, most)
    counted = (_planned(sized, schedules, most)
               .withColumn("copies", F.filter("copies", lambda c: 2 * c["words"] >= F.col("size")))
               .groupBy("id").agg(F.min_by("copies", F.struct("source_key", "size")).alias("copies")).where(F.size("copies") > 0))
    return (rows.join(counted, "id").withColumn("c", F.explode("copies")).orderBy("c.position", "id", "c.copy").select("row.*"))


def _in_parts(rows: DataFrame, sized: DataFrame, schedules: tuple[str, ...], most: int) -> DataFrame:
    """row of (row, id, key, size), whose ids are all different, in training order. sized: the rows without row.

    A piece of a source, of which there is a bounded number, is due from the time of its first word to that of its last one. It goes
    whole to each part of the mix that has some of this time, where it is ordered and what is due in other parts is left out.
    """
    spark = rows.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), sized.count() // PART_ROWS))
    piece = F.floor(_place() * (PIECES * parts)).cast("int").alias("piece")
    earlier = W.partitionBy("key").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = (sized.groupBy("key", piece).agg(F.sum("size").alias("words"))
              .withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
              .join(_targets(sized, schedules, float(most)), "key"))
    start = F.col("offset") + F.col("copy") * F.col("source_size")
    copies = stored(pieces.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).where(start < F.round("target"))
                    .withColumns({"from": _due(start) - _NEAR, "to": _due(start + F.col("words")) + _NEAR}), "pieces")
    shares = [n / parts for n in range(1, parts)]
    edges = (copies.agg(F.percentile("from", shares, F.col("words"))).first()[0] if shares else None) or []
    edges = F.array(*[F.lit(float("-inf")), *map(F.lit, edges), F.lit(float("inf"))])
    into = F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda t: (F.get(edges, t) <= F.col("to")) & (F.get(edges, t + 1) > F.col("from")))
    reached = copies.select("key", "piece", F.struct("copy", into.alias("parts")).alias("into"), "offset", "source_size", "target", "segments")
    reached = reached.groupBy("key", "piece").agg(F.collect_list("into").alias("into"), *[F.first(c).alias(c) for c in ("offset", "source_size", "target", "segments")])
    sent = (rows.withColumn("place", _place()).withColumn("piece", F.floor(F.col("place") * (PIECES * parts)).cast("int"))
            .join(F.broadcast(reached), ["key", "piece"]).withColumn("into", F.explode("into"))
            .select("row", "id", "key", "size", "place", "piece", "offset", "source_size", "target", "segments", "into.copy", F.explode("into.parts").alias("part")))
    within = W.partitionBy("part", "key", "piece", "copy").orderBy("place", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    due = (sent.repartitionById(parts, F.col("part"))
           .withColumn("_begin", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
           .withColumn("c", _copy(F.col("copy"))).where((F.col("c.words") > 0) & (2 * F.col("c.words") >= F.col("size")))
           .where((F.col("c.position") >= F.get(edges, F.col("part"))) & (F.col("c.position") < F.get(edges, F.col("part") + 1))))
    return due.sortWithinPartitions("c.position", "id", "copy").select("row.*")
