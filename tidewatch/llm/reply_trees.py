"""Conversations from reply trees: the best root-to-leaf paths of each tree, each formatted as one text with its loss mask.

Paths are found by iterative self-joins that double the distance looked up, so a tree of depth d takes about log2(d) joins, keyed by
(conversation, message). Only the paths chosen by rank are spelled out.

Template, for each turn: "### Role:", a new line, the escaped text, "</turn>", a new line. In texts, a backslash becomes \\s, ### becomes
\\h and </turn> becomes \\t, so neither control string occurs inside a text and the split at them is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import stored

START, END = "### ", "</turn>\n"
_ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"), ("\n", "\\n"))
_NAMED = {"system": "System", "user": "User", "assistant": "Assistant"}


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escape(text: Column) -> Column:
    return _replaced(text, _ESCAPES)


def unescape(text: Column) -> Column:
    return _replaced(text, tuple((b, a) for a, b in reversed(_ESCAPES)))


def _role_name(role: Column) -> Column:
    other = F.concat(F.lit("~"), _replaced(role, _ROLE_ESCAPES))
    return reduce(lambda c, n: F.when(role == n, F.lit(_NAMED[n])).otherwise(c), _NAMED, other)


def _role_of(name: Column) -> Column:
    other = _replaced(F.substr(name, F.lit(2)), tuple((b, a) for a, b in reversed(_ROLE_ESCAPES)))
    return reduce(lambda c, n: F.when(name == _NAMED[n], F.lit(n)).otherwise(c), _NAMED, other)


def as_tree(rows: DataFrame) -> DataFrame:
    """(conv, msg, parent, role, text, score) of a table of turns (conv_id, turn, role, text): each turn answers the one before.

    Turns that share a number follow in order of role and text, a null turn comes first. Null roles and texts are empty. Rows
    without conv_id belong to no conversation and are left out. Turns of a conversation are ordered in one task, as its text is
    one value in the end.
    """
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    plain = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbered = plain.withColumn("msg", F.row_number().over(order).cast("long"))
    return numbered.select("conv", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text",
                           F.lit(0.0).alias("score"))


def once(messages: DataFrame) -> DataFrame:
    """messages with one row for each (conv, msg): the first by parent (null first), role, text and score. ``paths`` and
    ``conversations`` expect such a table, as a message that is there twice would be on twice as many paths."""
    first = F.min(F.struct(F.col("parent").isNotNull().alias("answers"), "parent", "role", "text", "score"))
    return messages.groupBy("conv", "msg").agg(first.alias("m")).select("conv", "msg", "m.parent", "m.role", "m.text", "m.score")


def _jumps(messages: DataFrame) -> list[DataFrame]:
    """Tables (conv, msg, up, total, steps): up is 2**i replies above msg, or null where the root is passed; in the last one
    it is null for every message that a root is above. A parent that is not there makes a root."""
    slim = stored(messages.select("conv", "msg", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    known = slim.select("conv", F.col("msg").alias("parent"), F.lit(True).alias("there"))
    first = slim.join(known, ["conv", "parent"], "left").select(
        "conv", "msg", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).alias("steps"))
    tables, left = [stored(first, "jumps")], None
    while True:
        now = tables[-1].where("up is not null").count()
        if now in (0, left):  # replies that run in a circle never reach a root
            return tables
        left = now
        own, above = tables[-1], tables[-1].select("conv", F.col("msg").alias("up"), F.col("up").alias("far"),
                                                   F.col("total").alias("more"), F.col("steps").alias("further"))
        done = own.where("up is null")
        longer = own.where("up is not null").join(above, ["conv", "up"]).select(
            "conv", "msg", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"),
            (F.col("steps") + F.col("further")).alias("steps"))
        tables.append(stored(done.unionAll(longer), "jumps"))


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(conv, leaf, rank, msg, above): the messages of the chosen paths, above counting the replies between msg and the leaf.

    A branch is ranked by the mean score of its messages (null: 0), then the lesser leaf; best: how many of a tree are taken, all
    by default. Messages whose replies run in a circle are on no path. Each (conv, msg) must be there once (see ``once``).
    """
    tables = _jumps(messages)
    answered = messages.where("parent is not null").select("conv", F.col("parent").alias("msg")).distinct()
    leaves = tables[-1].where("up is null").join(answered, ["conv", "msg"], "left_anti")
    rank = F.row_number().over(W.partitionBy("conv").orderBy((F.col("total") / F.col("steps")).desc(), "msg"))
    chosen = leaves.select("conv", F.col("msg").alias("leaf"), rank.alias("rank"), "msg", F.lit(0).alias("above"))
    found = stored(chosen if best is None else chosen.where(F.col("rank") <= best), "paths")
    for i, table in enumerate(tables[:-1]):
        up = table.where("up is not null").select("conv", "msg", "up")
        more = found.join(up, ["conv", "msg"]).select("conv", "leaf", "rank", F.col("up").alias("msg"),
                                                      (F.col("above") + F.lit(2**i)).alias("above"))
        found = stored(found.unionAll(more), "paths")
    return found


def conversations(messages: DataFrame, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss): each chosen path as one text; loss holds the (begin, end) of the escaped texts of the
    role to learn, in characters from 0, end exclusive. An empty table gives an empty result."""
    turns = paths(messages, best).join(messages.select("conv", "msg", "role", "text"), ["conv", "msg"])
    head = F.concat(F.lit(START), _role_name(F.col("role")), F.lit(":\n"))
    pieces = turns.select("conv", "leaf", "rank", "above", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len(END))
    order = W.partitionBy("conv", "leaf").orderBy(F.col("above").desc())
    begin = F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    placed = pieces.withColumn("begin", begin)
    turn = F.struct((-F.col("above")).alias("at"), F.concat("head", "body", F.lit(END)).alias("text"), F.when(
        F.col("role") == learn, F.struct(F.col("begin"), (F.col("begin") + F.length("body")).alias("end"))).alias("loss"))
    grouped = placed.groupBy("conv", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(F.col("conv").alias("conv_id"), "leaf", "rank",
                          F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
                          F.filter(F.transform("turns", lambda t: t["loss"]), lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.split(formatted, END)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(t: Column) -> Column:
        colon = F.instr(t, ":\n")
        name = F.substr(t, F.lit(len(START) + 1), colon - F.lit(len(START) + 1))
        return F.struct(_role_of(name).alias("role"), unescape(F.substr(t, colon + 2)).alias("text"))
    return F.transform(turns, turn)


def learned(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(
        formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
