"""The trie of conversation prefixes, with totals over subtrees by a roll-up in bands of depth.

1. Turns are sorted over all conversations and numbered range by range, so a conversation of any length spreads over tasks. A range's
   first conversation may begin in an earlier one; one row per range carries the count over.
2. A turn becomes two 64-bit digests. A prefix is named by its length and the exclusive-or of its turns' digests, each mixed
   with its place: 128 bits, and a parent's name follows from a node's own.
3. A node's members, their least id and the nodes' children are counted with map-side combine; the ids that end at a node are
   joined in runs of RUN consecutive numbers and digested as a stream.
4. Sums over subtrees: nodes explode only to their ancestors inside the band of HEIGHT levels that they are in. The band roots, whose
   sums then cover their band, form a trie that is HEIGHT times as flat and is rolled up in the same way; its completed totals go to the
   nodes of the band above each. A trie of depth d takes about log(d) / log(HEIGHT) such steps, and no node explodes to more than HEIGHT.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import stored

HEIGHT = 8  # levels of a band
SLICE = 4096  # turns of a conversation that one window takes
RUN = 1024  # consecutive conversation ids that are joined to one text
_NONE = hashlib.sha256().hexdigest()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation inside a sorted range, from 1."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        convs = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.append(True, convs[1:] != convs[:-1]))
        at = np.arange(1, len(convs) + 1) - np.repeat(starts, np.diff(np.append(starts, len(convs))))
        if convs[0] == last:
            first = int(starts[1]) if len(starts) > 1 else len(convs)
            at[:first] += seen
        last, seen = convs[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(convs), part)), *batch.columns, pa.array(at)],
                                         ["part", *batch.schema.names, "at"])


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv, pos, d1, d2, chars) of a table of turns (conv_id, turn, role, text): places from 1, digests and code points of the text.

    Turns follow in order of turn (null first), role and text; null roles and texts are empty. Rows without conv_id belong to no
    conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    plain = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                                     role.alias("role"), text.alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    slim = plain.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.xxhash64("role", "text").alias("d1"), F.xxhash64("text", "role", F.lit(1)).alias("d2"),
        F.length("text").cast("long").alias("chars"))
    ranged = stored(slim.mapInArrow(_numbered, "part long, conv long, d1 long, d2 long, chars long, at long"), "turns")
    ends = ranged.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "at")).alias("last"))
    carried, last, seen = [], None, 0
    for part, first, (conv, at) in sorted(tuple(r) for r in ends.collect()):  # one row per range
        before = seen if first == last else 0
        if before:
            carried.append((part, first, before))
        last, seen = conv, at + (before if conv == first else 0)
    pos = F.col("at")
    if carried:
        borders = rows.sparkSession.createDataFrame(carried, "part long, conv long, before long")
        ranged = ranged.join(F.broadcast(borders), ["part", "conv"], "left")
        pos = pos + F.coalesce("before", F.lit(0))
    return ranged.select("conv", pos.alias("pos"), "d1", "d2", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, depth, d1, d2, chars, n): the turns of each rebuilt conversation, and a row of depth 0; n is their number.

    A conversation c takes the first h turns of conversation c - c % 100, h being the unsigned crc32 of decimal c modulo 6, and goes on
    with its own turns after its first h.
    """
    heads = turns.where(F.col("pos") <= 5).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("pos", "d1", "d2", "chars"))).alias("head"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(6)).cast("int")
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).select(
        "conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    convs = convs.join(heads.select(F.col("conv").alias("base"), "head"), "base", "left")
    head = F.coalesce("head", F.array())
    taken = F.least(F.size(head), F.col("h"))
    convs = stored(convs.select("conv", "h", taken.alias("taken"), F.slice(head, F.lit(1), taken).alias("head"),
                                (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    own = turns.join(convs.select("conv", "h", "taken", "n"), "conv").where(F.col("pos") > F.col("h")).select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "d1", "d2", "chars", "n")
    zero = F.lit(0).cast("long")
    root = F.array(F.struct(zero.alias("pos"), zero.alias("d1"), zero.alias("d2"), zero.alias("chars")))
    taken_over = convs.select("conv", F.explode(F.concat(root, "head")).alias("t"), "n").select(
        "conv", F.col("t.pos").alias("depth"), "t.d1", "t.d2", "t.chars", "n")
    return taken_over.unionAll(own)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, a, b, pa, pb, chars, ends) of the rows of rebuilt(): each prefix by its own name and its parent's; ends: the whole
    conversation is this prefix. A long conversation is named slice by slice, and the slices' totals are carried on."""
    zero = F.lit(0).cast("long")
    x, y = (F.when(F.col("depth") == 0, zero).otherwise(F.xxhash64("depth", d, F.lit(k))) for k, d in enumerate(("d1", "d2")))
    cut = rows.select("conv", F.col("depth").cast("long").alias("depth"), F.floor(F.col("depth") / SLICE).alias("slice"),
                      x.alias("x"), y.alias("y"), "chars", (F.col("depth") == F.col("n")).alias("ends"))
    order = W.partitionBy("conv", "slice").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    named = cut.withColumns({"a": F.bit_xor("x").over(order), "b": F.bit_xor("y").over(order)})
    if (rows.agg(F.max("n")).first()[0] or 0) >= SLICE:
        before = W.partitionBy("conv").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        carried = cut.groupBy("conv", "slice").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).select(
            "conv", "slice", F.bit_xor("x").over(before).alias("ca"), F.bit_xor("y").over(before).alias("cb")).where("slice > 0")
        named = named.join(carried, ["conv", "slice"], "left").withColumns(
            {c: F.col(c).bitwiseXOR(F.coalesce(f"c{c}", zero)) for c in ("a", "b")})
    return named.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"),
                        F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "chars", "ends")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's texts, joined by commas, of rows sorted by node."""
    node, state = None, None

    def out(done: list) -> pa.RecordBatch:
        columns = [*zip(*((*n, d) for n, d in done), strict=True)] or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["depth", "a", "b", "ends_sha256"])

    for batch in batches:
        done = []
        for *key, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids")), strict=True):
            if key != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield out(done)
    if node is not None:
        yield out([(node, state.hexdigest())])


def end_digests(paths: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): digest of the ids of the conversations that end at a node, ascending and joined by commas."""
    run = F.shiftright("conv", RUN.bit_length() - 1)
    runs = paths.where("ends").groupBy("depth", "a", "b", run.alias("run")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    texts = runs.select("depth", "a", "b", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return texts.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "run").mapInArrow(
        _digested, "depth long, a long, b long, ends_sha256 string")


def rolled_up(paths: DataFrame, nodes: DataFrame, deepest: int, sums: list[str]) -> DataFrame:
    """(depth, a, b, sums): the sums of each node over its subtree, itself included.

    paths: (conv, depth, a, b), every prefix of every conversation; nodes: (depth, a, b, conv_id, sums), conv_id being one of the
    node's conversations. Depths are consecutive from 0 to deepest.
    """
    key = ["depth", "a", "b"]
    band = F.floor(F.col("depth") / HEIGHT)
    lines = paths.groupBy("conv", band.alias("band")).agg(F.array_sort(F.collect_list(F.struct(*key))).alias("line"))
    if deepest >= HEIGHT:
        lines = stored(lines, "bands")

    def sent(rows: DataFrame, above: Column) -> DataFrame:
        return rows.select(F.explode(above).alias("up"), *sums).select("up.*", *sums)

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(*(F.sum(s).alias(s) for s in sums))

    here = nodes.withColumns({"conv": F.col("conv_id"), "band": band}).join(lines, ["conv", "band"])
    inside = added(sent(here, F.slice("line", F.lit(1), (F.col("depth") % HEIGHT + 1).cast("int"))))
    if deepest < HEIGHT:
        return inside
    inside = stored(inside, "inside-bands")
    level = (F.col("depth") / HEIGHT).cast("long").alias("depth")
    tops = stored(nodes.where(F.col("depth") % HEIGHT == 0).select(*key, "conv_id").join(inside, key).select(
        level, "a", "b", "conv_id", *sums), "band-roots")
    flat = paths.where(F.col("depth") % HEIGHT == 0).select("conv", level, "a", "b")
    done = stored(rolled_up(flat, tops, deepest // HEIGHT, sums), "completed-roots")
    below = done.join(tops.select(*key, "conv_id"), key).where("depth > 0").select(
        F.col("conv_id").alias("conv"), (F.col("depth") - 1).alias("band"), *sums).join(lines, ["conv", "band"])
    between = inside.where(F.col("depth") % HEIGHT > 0).unionByName(sent(below, F.slice("line", F.lit(2), F.lit(HEIGHT))))
    return added(between).unionByName(done.withColumn("depth", F.col("depth") * HEIGHT))


def trie(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every distinct prefix of the rebuilt
    conversations of a table of turns (conv_id, turn, role, text); other columns are not read.

    A node is named by its least conversation and its depth. Repeated rows are turns of their own. A table without conversations
    has no nodes, not even a root.
    """
    paths = stored(prefixes(rebuilt(numbered_turns(rows))), "prefixes")
    key = ["depth", "a", "b"]
    nodes = stored(paths.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("pa").alias("pa"),
                                           F.min("pb").alias("pb"), F.min("chars").alias("chars")), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children"))
    deepest, least = nodes.agg(F.max("depth"), F.min("conv_id")).first()
    own = stored(nodes.join(children, key, "left").select(
        *key, "pa", "pb", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "counted-nodes")
    sums = ["n_leaves", "saved_tokens"]
    totals = rolled_up(paths.select("conv", *key), own.select(*key, "conv_id", *sums), deepest or 0, sums)
    # the root has the most children by far, and its least conversation is the least of all
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                           F.col("conv_id").alias("parent_conv_id")).where("depth > 1")
    deep = own.where("depth > 1").join(parents, ["depth", "pa", "pb"], "left")
    top = own.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).cast("long"))
    whole = top.unionByName(deep).drop(*sums).join(totals, key).join(end_digests(paths), key, "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums,
                        F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
