"""Near-duplicate groups of documents by a chosen-path similarity join over word shingles.

1. Each document becomes its set of distinct shingles, named by a hash of the set; equal sets are one vertex.
2. Every vertex gets min-hashes. Independent trees branch the vertices by chosen min-hash tokens: a node is split by further
   tokens until it is small, and the members of a small node are compared exhaustively by their sketches.
3. Vertices that look alike anywhere form clusters. A cluster's full sets meet once, in groups of bounded size, and only
   links that hold on the full sets are kept. Components of these links are the result.
4. Members of clusters that are too large to meet in full, and vertices that the trees part too often because their nodes had
   to be split, are joined exactly: two sets at the threshold share one of their rarest shingles (prefix filter).

A link is missed only when the trees separate a pair everywhere, which for a vertex that is not joined exactly has a computed
chance of at most MISS at the threshold, or when its sketches look unlike by more than 4.2 standard errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import runs, slices
from tidewatch.llm.components import components
from tidewatch.llm.words import as_lists, distinct, hash_words, mix, shingles
from tidewatch.session import stored

COORDINATES = 64  # min-hashes of a set
TREES = 12
PER_LEVEL = 2  # tokens that a level of a tree branches by
NODE = 256  # members that are compared exhaustively
LEVELS = 12
BLOCK = 128  # a cluster beyond NODE members meets in pairs of blocks
BLOCKED = 4096  # a cluster beyond this is branched by trees once more, and what they leave is joined exactly
MISS = 1e-5  # a vertex whose pairs at the threshold are parted by all trees with a higher chance is joined exactly
HUBS = 32  # if the vertices to join exactly meet in more nodes each on average, those near the hub of a group are connected first
BUCKETS = 1 << 16  # in which shingles are counted to tell rare ones
NODE_ROWS = 50_000  # of tree nodes, and
SET_ROWS = 4_000  # of full sets, that a task gets at least where they are counted
BROADCAST_ROWS = 500_000  # vertex names of 16 bytes that may be broadcast
_FACTORS = mix(np.arange(COORDINATES, dtype=np.uint64), 91) | np.uint64(1)


def _dealt(df: DataFrame, key: str, rows: int | None, per_task: int) -> DataFrame:
    """df sorted by key in partitions that hold all rows of a key; no more of them than rows, if known, are worth."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(key)
    if rows is not None and rows < per_task * parts:
        dealt = dealt.coalesce(max(1, math.ceil(rows / per_task)))
    return dealt.sortWithinPartitions(key)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, set: ascending distinct shingle hashes) of (id, text)."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, _, first = hash_words(batch["text"])
            yield pa.record_batch({"id": batch["id"], "set": as_lists(*distinct(*shingles(hashes, first, width)))})
    return docs.mapInArrow(compute, "id long, set array<long>")


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per row of (id, text): size of its set, name of the set, and min-hashes as tokens (two per tree) and bytes."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, _, first = hash_words(batch["text"])
            values, begin = distinct(*shingles(hashes, first, width))
            sizes = np.diff(begin)
            some = sizes > 0
            at = begin[:-1][some]
            name = np.zeros(len(sizes), dtype=np.uint64)
            least = np.zeros((len(sizes), COORDINATES), dtype=np.uint32)
            if len(at):
                name[some] = mix(np.add.reduceat(mix(values, 3), at) + sizes[some].astype(np.uint64), 5)
                for k, factor in enumerate(_FACTORS):
                    least[some, k] = np.minimum.reduceat(values * factor, at) >> np.uint64(32)
            paths = np.stack([mix(mix(least[:, 2 * t].astype(np.uint64), t) + least[:, 2 * t + 1], t) for t in range(TREES)], 1)
            yield pa.record_batch({
                "id": batch["id"], "n": pa.array(sizes), "vertex": pa.array(name.view(np.int64)),
                "paths": pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * TREES),
                                                  pa.array(paths.reshape(-1).view(np.int64))),
                "sketch": pa.array([r.tobytes() for r in (least >> np.uint32(13)).astype(np.uint8)], pa.binary())})
    return docs.mapInArrow(compute, "id long, n long, vertex long, paths array<long>, sketch binary")


def _roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the least member of each member's component."""
    root = np.arange(len(linked))
    while True:
        new = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(new, root)[np.minimum(new, root)]
        if (new == root).all():
            return root
        root = new


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def _branch(nodes: DataFrame, alike: float, level: int, rows: int | None) -> DataFrame:
    """One level over (node, tree, vertex, sketch): star links inside small nodes, members of large ones for the next level.

    Output (kind 0: vertex a looks like b, also through others; kind 1: node a now holds vertex b).
    """
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, whole in runs(batches, "node", NODE):
            vertex = rows["vertex"].to_numpy()
            if not whole:
                tree = rows["tree"].to_numpy().astype(np.uint64)
                sketch = _bytes(rows["sketch"], COORDINATES)
                node = rows["node"].to_numpy().view(np.uint64).copy()
                for k in range(PER_LEVEL):
                    chosen = mix(tree * np.uint64(1009) + np.uint64(PER_LEVEL * level + k), 17) % np.uint64(COORDINATES)
                    node = mix(node + sketch[np.arange(len(tree)), chosen.astype(np.int64)], k + 1)
                yield pa.record_batch({"kind": pa.array(np.ones(len(tree), np.int32)), "a": pa.array(node.view(np.int64)),
                                       "b": rows["vertex"], "tree": rows["tree"], "sketch": rows["sketch"]})
                continue
            found_a, found_b = [], []
            sizes = np.diff(starts)
            several = np.flatnonzero(sizes > 1)
            if not len(several):
                continue
            sketch = _bytes(rows["sketch"], COORDINATES)
            pairs = starts[several[sizes[several] == 2]]
            hit = pairs[(sketch[pairs] == sketch[pairs + 1]).sum(axis=1) >= alike * COORDINATES]
            found_a.append(vertex[hit + 1])
            found_b.append(vertex[hit])
            for g in several[sizes[several] > 2]:
                own = slice(starts[g], starts[g + 1])
                some = sketch[own]
                same = np.zeros((len(some), len(some)), dtype=np.int16)
                for k in range(COORDINATES):
                    same += some[:, k, None] == some[None, :, k]
                root = _roots(same >= alike * COORDINATES)
                moved = np.flatnonzero(root != np.arange(len(some)))
                found_a.append(vertex[own][moved])
                found_b.append(vertex[own][root[moved]])
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            if len(a):
                yield pa.record_batch({"kind": pa.array(np.zeros(len(a), np.int32)), "a": pa.array(a), "b": pa.array(b),
                                       "tree": pa.nulls(len(a), pa.int32()), "sketch": pa.nulls(len(a), pa.binary())})
    return _dealt(nodes, "node", rows, NODE_ROWS).mapInArrow(compute, "kind int, a long, b long, tree int, sketch binary")


def _looks_alike(vertices: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Star links (a, b) between vertices that share a small node of some tree and look alike by their sketches; and (vertex) of
    those that all trees part from a vertex at the threshold with a chance of more than MISS.

    A pair shares a tree's first node with threshold ** 2, and stays together with threshold ** PER_LEVEL at every split.
    """
    alike = threshold - 4.2 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    nodes = vertices.select(F.posexplode("paths").alias("tree", "node"), "vertex", "sketch")
    links = split = left = None
    for level in range(LEVELS):
        out = stored(_branch(nodes, alike, level, left), "branches")
        here = out.where("kind = 0").select("a", "b")
        links = here if links is None else links.unionAll(here)
        deeper = out.where("kind = 1").select(F.col("a").alias("node"), "tree", F.col("b").alias("vertex"), "sketch")
        nodes, left = deeper, deeper.count()
        if not left:
            break
        split = deeper.select("vertex", "tree") if split is None else split.unionAll(deeper.select("vertex", "tree"))
    else:
        # Members that share this many tokens are copies but for a few words: each is linked to the node's least vertex.
        least = nodes.groupBy("node").agg(F.min("vertex").alias("b"))
        links = links.unionAll(nodes.join(least, "node").select(F.col("vertex").alias("a"), "b"))
    whole = math.log1p(-threshold**2)  # log of the chance that a tree without splits parts a pair
    if TREES * whole > math.log(MISS):
        return links, vertices.select("vertex")
    if split is None:
        return links, vertices.select("vertex").limit(0)
    depth = split.groupBy("vertex", "tree").agg(F.count(F.lit(1)).alias("d"))
    more = F.sum(F.log1p(-F.pow(F.lit(threshold), 2 + PER_LEVEL * F.col("d"))) - whole)
    return links, depth.groupBy("vertex").agg(more.alias("more")).where(F.col("more") + TREES * whole > math.log(MISS)).select("vertex")


def _verified(meetings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) star links of the components inside each group of (node, vertex), confirmed on the full sets of (vertex, set)."""
    meetings = stored(meetings, "meetings")
    groups = meetings.join(sets, "vertex").select("node", "vertex", "set")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, whole in runs(batches, "node", 1 << 30):
            vertex = rows["vertex"].to_numpy()
            lists = rows["set"]
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            for g in np.flatnonzero(np.diff(starts) > 1):
                lo, hi = starts[g], starts[g + 1]
                m = hi - lo
                own = values[offsets[lo] : offsets[hi]]
                sizes = np.diff(offsets[lo : hi + 1])
                owner = np.repeat(np.arange(m), sizes)
                order = np.argsort(own, kind="stable")
                own, owner = own[order], owner[order]
                first = np.append(True, own[1:] != own[:-1])
                code = np.cumsum(first) - 1
                shared = np.bincount(code)[code] > 1
                code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
                common = np.zeros((m, m), dtype=np.float64)
                cut = np.searchsorted(code, np.arange(0, (code[-1] if len(code) else 0) + 4097, 4096))
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    if j > i:
                        there = np.zeros((4096, m), dtype=np.float32)
                        there[code[i:j] % 4096, owner[i:j]] = 1
                        common += there.T @ there
                union = sizes[:, None] + sizes[None, :] - common
                root = _roots(100 * common >= percent * union)
                moved = np.flatnonzero(root != np.arange(m))
                if len(moved):
                    yield pa.record_batch({"a": pa.array(vertex[lo:hi][moved]), "b": pa.array(vertex[lo:hi][root[moved]])})
    return _dealt(groups, "node", meetings.count(), SET_ROWS).mapInArrow(compute, "a long, b long")


def _meetings(clusters: DataFrame) -> DataFrame:
    """(node, vertex) so that any two members of a cluster of (vertex, cluster) share a node of at most NODE members."""
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")), "cluster")
    blocks = F.ceil(F.col("m") / (BLOCK * 0.75))
    block = F.pmod(F.xxhash64("vertex"), blocks)
    pairs = F.when(F.col("m") <= NODE, F.array(F.xxhash64("cluster", F.lit(-1)))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1),
                    lambda other: F.xxhash64("cluster", F.least(other, block), F.greatest(other, block))))
    return sized.where(F.col("m") <= BLOCKED).select(F.explode(pairs).alias("node"), "vertex")


def _deep_nodes(vertices: DataFrame, huge: DataFrame) -> DataFrame:
    """(node, vertex) of small nodes of every tree, and of nodes that tokens don't split any more with blocks of theirs, for
    the members of clusters beyond BLOCKED."""
    nodes = vertices.join(huge.select("vertex"), "vertex", "left_semi").select(
        F.posexplode("paths").alias("tree", "node"), "vertex", "sketch")
    small = None
    for level in range(LEVELS):
        counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("m"))
        sized = stored(nodes.join(counts, "node"), "nodes")
        done = sized.where((F.col("m") > 1) & (F.col("m") <= NODE)).select("node", "vertex")
        small = done if small is None else small.unionAll(done)
        nodes = sized.where(F.col("m") > NODE)
        if nodes.isEmpty():
            return small
        tokens = [F.expr(f"substring(sketch, int(pmod(xxhash64(tree, {level}, {k}), {COORDINATES})) + 1, 1)")
                  for k in range(PER_LEVEL)]
        nodes = nodes.select("tree", F.xxhash64("node", *tokens).alias("node"), "vertex", "sketch")
    least = nodes.groupBy("node").agg(F.min("vertex").alias("least"), F.count(F.lit(1)).alias("m"))
    block = F.xxhash64("node", F.pmod(F.xxhash64("vertex"), F.ceil(F.col("m") / BLOCK)))
    joined = nodes.join(least, "node")
    rest = joined.select(block.alias("node"), "vertex")
    return small.unionAll(rest).unionAll(joined.select(block.alias("node"), F.col("least").alias("vertex"))).distinct()


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of (vertex, set) fall into each of BUCKETS."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_bucket(batch["set"].flatten().to_numpy()), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for row in sets.select("set").mapInArrow(compute, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def _bucket(values: np.ndarray) -> np.ndarray:
    return (mix(values.view(np.uint64), 23) % np.uint64(BUCKETS)).astype(np.int64)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(vertex, tokens, common) of (vertex, set): so many of a set's rarest shingles that two sets at the threshold share one of
    them, and how common the set's shingles are on average."""
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, sizes = batch["set"].flatten().to_numpy(), batch["set"].value_lengths().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            count = shared.value[_bucket(values)]
            order = np.lexsort((values, count, owner))
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            some = place < (sizes + 1 + (-percent * sizes) // 100)[owner]
            mean = np.bincount(owner, weights=count, minlength=len(sizes)) / np.maximum(sizes, 1)
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner[some], minlength=len(sizes))))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order][some]))
            yield pa.record_batch({"vertex": batch["vertex"], "tokens": tokens, "common": pa.array(mean)})
    return sets.mapInArrow(compute, "vertex long, tokens array<long>, common double")


def _apart(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, vertex, label, m, hub) of prefix shingles with m vertices that don't all have the same of labels (vertex, label),
    which only those in some link have; hub is the vertex with the most common shingles."""
    named = prefixes.join(labels, "vertex", "left")  # before there is a row for each shingle
    rows = named.select(F.explode("tokens").alias("token"), "vertex", F.coalesce("label", "vertex").alias("label"), "common")
    groups = rows.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.max_by("vertex", F.struct("common", "vertex")).alias("hub"),
                                       F.min("label").alias("low"), F.max("label").alias("high"))
    return stored(rows.join(groups.where("low <> high").select("token", "m", "hub"), "token"), "apart")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (vertex, label) after links (a, b) have tied some of them together."""
    ends = links
    for end in ("a", "b"):
        named = labels.select(F.col("vertex").alias(end), F.col("label").alias("label_" + end))
        ends = ends.join(named, end, "left").withColumn("label_" + end, F.coalesce("label_" + end, end))
    tied = stored(components(ends, "label_a", "label_b"), "tied")
    old = labels.join(tied.withColumnRenamed("id", "label"), "label", "left").select(
        "vertex", F.coalesce("component", "label").alias("label"))
    new = tied.join(labels, tied["id"] == labels["vertex"], "left_anti").select(
        F.col("id").alias("vertex"), F.col("component").alias("label"))
    return stored(old.unionAll(new), "labels")


def _around_hubs(apart: DataFrame) -> DataFrame:
    """(node, vertex): the vertices of large groups in blocks, each with the group's hub."""
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.col("m") / BLOCK))).cast("long")
    node = F.xxhash64("hub", F.pmod(F.xxhash64("vertex"), blocks))
    rows = apart.where(F.col("m") > NODE).select(node.alias("node"), "vertex", "hub")
    return rows.select("node", "vertex").unionAll(rows.select("node", F.col("hub").alias("vertex"))).distinct()


def _across(apart: DataFrame) -> DataFrame:
    """(node, vertex) so that any two vertices of a group that are not connected yet share a node of about NODE members.

    The largest connected part of a large group meets the others in pairs of blocks, but not itself.
    """
    parts = apart.where(F.col("m") > NODE).groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = parts.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("c"))
    size = BLOCK * 0.75
    rows = apart.join(largest, "token").withColumns({
        "inner": F.ceil(F.col("c") / size).cast("long"), "outer": F.ceil((F.col("m") - F.col("c")) / size).cast("long")})
    hashed = F.xxhash64("vertex")
    inner, outer = F.pmod(hashed, "inner"), F.pmod(hashed, "outer")
    every_inner, every_outer = (F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("inner", "outer"))
    nodes = F.when(F.col("label") == F.col("main"), F.transform(every_outer, lambda o: F.xxhash64("token", F.lit(0), o, inner))).otherwise(
        F.concat(F.transform(every_inner, lambda i: F.xxhash64("token", F.lit(0), outer, i)),
                 F.transform(every_outer, lambda o: F.xxhash64("token", F.lit(1), F.least(o, outer), F.greatest(o, outer)))))
    small = apart.where(F.col("m") <= NODE).select(F.col("token").alias("node"), "vertex")
    return small.unionAll(rows.select(F.explode(nodes).alias("node"), "vertex"))


def _joined_exactly(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """labels (vertex, label) of connected vertices after all vertices of (vertex, set) that are linked on their sets have been
    tied together."""
    prefixes = stored(_prefixes(sets, percent), "prefixes")
    apart = _apart(prefixes, labels)
    if _across(apart).count() > HUBS * sets.count():  # most of a large group is connected by one comparison of each vertex
        hubs = stored(_verified(_around_hubs(apart), sets, percent), "hubs")
        labels = _relabelled(labels, hubs)
        apart = _apart(prefixes, labels)
    if apart.isEmpty():
        return labels
    rest = stored(_verified(_across(apart), sets, percent), "rest")
    return labels if rest.isEmpty() else _relabelled(labels, rest)


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs, linked where 100 * common >= percent * union.

    Texts are lower-cased (A-Z). A text with fewer than width words has its whole sequence as its one shingle; null, empty and
    blank texts have none and are linked with nothing. Rows that share an id are one document. A row without an id is linked
    with nothing: its component_id is null and it is kept. An empty table gives an empty result. Other columns are not read.
    """
    rows = stored(_sketches(_numbered(docs, id_col, text_col), width), "sketches")
    usable = rows.where("id is not null and n > 0")
    vertices = stored(usable.groupBy("vertex").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("paths").alias("paths"),
                                                   F.first("sketch").alias("sketch")), "vertices")
    # Different sets of this size or less are never linked: one shingle more or less is too much.
    least = math.ceil(percent / (100 - percent))
    found, unsure = _looks_alike(vertices.where(F.col("n") >= least), percent / 100)
    clusters = stored(components(found)
                      .select(F.col("id").alias("vertex"), F.col("component").alias("cluster")), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCKED)
    huge = stored(clusters.join(sizes, "cluster", "left_semi"), "huge")
    met = _meetings(clusters)
    if not huge.isEmpty():
        met = met.unionAll(_deep_nodes(vertices, huge))

    def sets_of(names: DataFrame) -> DataFrame:
        # One text for each vertex; its set is computed where it is needed instead of being kept for all.
        wanted = names.join(vertices.select("vertex", "id"), "vertex")
        wanted = F.broadcast(wanted) if names.count() <= BROADCAST_ROWS else wanted
        texts = _numbered(docs, id_col, text_col).join(wanted, "id").select(F.col("id"), "text")
        return _named_sets(texts, width)

    verified = _verified(met, sets_of(clusters.select("vertex")), percent)
    same = components(verified).select(F.col("id").alias("vertex"), F.col("component").alias("label"))
    exactly = stored(huge.select("vertex").unionAll(unsure).distinct(), "exactly")
    if not exactly.isEmpty():
        sets = stored(sets_of(exactly).join(exactly, "vertex", "left_semi"), "exact-sets")  # read four times
        same = _joined_exactly(sets, stored(same, "labels"), percent)
    same = same.withColumnRenamed("label", "group")
    placed = vertices.select("vertex", "id").join(same, "vertex", "left")
    group = F.coalesce("group", "vertex")
    whole = placed.groupBy(group.alias("group")).agg(F.min("id").alias("component_id"))
    by_vertex = placed.select("vertex", group.alias("group")).join(whole, "group").select("vertex", "component_id")
    ids = usable.select("id", "vertex").join(by_vertex, "vertex")
    by_id = stored(ids.groupBy("id").agg(F.min("component_id").alias("component_id"), F.max("component_id").alias("other")), "ids")
    if not by_id.where("component_id <> other").isEmpty():  # an id with several texts ties their groups together
        least = ids.select("id", F.col("component_id").alias("other")).join(by_id.select("id", "component_id"), "id")
        tied = components(least, "other", "component_id").select(F.col("id").alias("component_id"), "component")
        by_id = by_id.join(tied, "component_id", "left").select("id", F.coalesce("component", "component_id").alias("component_id"))
    out = rows.select("id", "n").join(by_id.select("id", "component_id"), "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _named_sets(texts: DataFrame, width: int) -> DataFrame:
    """(vertex, set), once for each set, of (id, text)."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, _, first = hash_words(batch["text"])
            values, begin = distinct(*shingles(hashes, first, width))
            sizes = np.diff(begin)
            name = np.zeros(len(sizes), dtype=np.uint64)
            some = sizes > 0
            if some.any():
                name[some] = mix(np.add.reduceat(mix(values, 3), begin[:-1][some]) + sizes[some].astype(np.uint64), 5)
            yield pa.record_batch({"vertex": pa.array(name.view(np.int64)), "set": as_lists(values, begin)})
    return texts.mapInArrow(compute, "vertex long, set array<long>")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_groups does not keep; rows with an id that is kept all stay."""
    dropped = stored(near_groups(docs, width, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("id")), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return rows.join(dropped, "id", "left_anti").select("row.*")
