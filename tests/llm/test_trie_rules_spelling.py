"""The prefix trie, the rule cascade and the spelling variants against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import prefix_trie, rule_cascade, spelling

TURNS = "conv_id long, turn long, role string, text string, a long, depth long, conv long, part long, band long, line string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    # a prefix by the number of its parent and its last turn, so that long conversations stay cheap
    numbers, members, ends, parent, last = {}, defaultdict(set), defaultdict(list), {0: None}, {0: (0, 0)}
    for c in sorted(whole):
        node = 0
        members[0].add(c)
        for d, turn in enumerate(whole[c], 1):
            up, node = node, numbers.setdefault((node, turn), len(numbers) + 1)
            parent[node], last[node] = up, (d, len(turn[1]))
            members[node].add(c)
        ends[node].append(c)
    leaves, saved, fan = Counter(), Counter(), Counter(parent.values())
    for n in sorted(members, reverse=True):  # a child has the greater number
        leaves[n] += n not in fan
        saved[n] += (len(members[n]) - 1) * last[n][1]
        if parent[n] is not None:
            leaves[parent[n]] += leaves[n]
            saved[parent[n]] += saved[n]
    return {(min(m), last[n][0], None if parent[n] is None else min(members[parent[n]]), len(m), fan[n], leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()}


def run_trie(spark, rows):
    return prefix_trie.trie(spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "x") for r in rows], TURNS)).collect()


def test_trie_against_brute_force(spark, monkeypatch):
    """Shared beginnings, absent and short bases, negative ids, null turns, roles and texts, ties and repeated rows."""
    rng = random.Random(3)
    lines = ["hi", "é", "", None, "a longer one"]
    rows = [(c, t, rng.choice(["user", None]), rng.choice(lines)) for c in [*range(-120, -90), *range(0, 230), *range(501, 560)]
            for t in range(rng.randint(1, 4))]
    rows += [(c, t, "user", "hot") for c in range(1000, 1400) for t in range(9)]  # a conversation that hundreds share
    rows += [(1401, None, "user", "x"), (1401, None, "user", "x"), (1401, 2, "user", "b"), (1401, 2, "user", "a"), (1500, None, None, None)]
    rows += [(None, 1, "user", "no id"), (8_999_999_999_999_999_999, 0, "user", "far")]
    got = run_trie(spark, rows)
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_trie(rows)


@pytest.mark.parametrize("cut", [16, 4096])
def test_trie_of_long_conversations(spark, monkeypatch, cut):
    """Several levels of bands, and conversations that are named slice by slice."""
    monkeypatch.setattr(prefix_trie, "SLICE", cut)
    rows = [(c, t, "user", f"turn {t % 7}" if t < 300 + 200 * (c % 3) else f"own {c}") for c in range(7, 12) for t in range(600 + 5 * c)]
    assert {tuple(r) for r in run_trie(spark, rows)} == brute_trie(rows)


def test_trie_without_conversations(spark):
    assert run_trie(spark, []) == [] and run_trie(spark, [(None, 1, "user", "x")]) == []


def test_conversations_over_borders_of_ranges(spark):
    """One conversation holds nearly all rows, over several ranges."""
    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, 5).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
                                      F.lit("user").alias("role"), F.lit("x").alias("text"))
    turns = prefix_trie.numbered_turns(rows).collect()
    assert sorted(t.pos for t in turns if t.conv == 5) == list(range(1, 19_001))
    assert {t.pos for t in turns if t.conv != 5} == {1}


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, same = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    letters = re.findall("[A-Za-z]", text)
    bad = (10 * symbols > n or not 3 * n <= chars <= 10 * n or 100 * same > 30 * len(lines)
           or 2 * sum("A" <= c <= "Z" for c in letters) > len(letters)
           or 100 * sum(not re.search("[A-Za-z]|[^\x00-\x7f]", x) for x in w) > 20 * n or 100 * max(Counter(w).values(), default=0) > 20 * n
           or 100 * sum(bool(re.match("[ \t]*[-*•]", x)) for x in lines) > 90 * len(lines)
           or 100 * sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines) > 30 * len(lines))
    return n, chars, symbols, same, len(covered), failed, not failed and not bad


@pytest.fixture(scope="module")
def rule_docs(spark, odd_docs, prose):
    texts = [prose(200).upper(), "\n".join("- " + prose(9) for _ in range(20)), "\n".join(prose(9) + " ..." for _ in range(20)),
             prose(60) + " 1 2 3" * 9, " ".join(f"{w} # % {w}" for w in prose(80).split()), prose(80) + " same" * 40, "é à ü " * 30 + prose(90),
             "\n".join([prose(12)] * 3 + [prose(12) for _ in range(5)]), "\n" * 500 + prose(70), "long" * 9 + " " + "wordswordswords " * 60,
             "  x y " * 40 + prose(100)]
    more = spark.createDataFrame([(100 + i, t, "en", "s", 1, 5, "v", "r") for i, t in enumerate(texts)], odd_docs.schema)
    return odd_docs.unionByName(more).withColumn("kept", F.lit(7)).withColumn("_text", F.lit("clash")).withColumn("n_words", F.lit(0))


def test_rules_against_brute_force(rule_docs):
    got = sorted(map(tuple, rule_cascade.judged(rule_docs).collect()), key=repr)
    want = sorted(((r.doc_id, *brute_rules(r.text or "")) for r in rule_docs.collect()), key=repr)
    assert got == want and {True, False} == {r[-1] for r in got}


def test_rules_keep_whole_rows(rule_docs, no_docs):
    got = sorted(map(tuple, rule_cascade.keep_good(rule_docs).collect()), key=repr)
    assert got == sorted((tuple(r) for r in rule_docs.collect() if brute_rules(r.text or "")[-1]), key=repr)
    assert rule_cascade.keep_good(no_docs).collect() == [] and rule_cascade.judged(no_docs).collect() == []


def test_order_of_rules():
    """Rejections per cost, given what the rules before reject."""
    rules = [rule_cascade.Rule(name, lambda d: False) for name in "abcd"]
    # a rejects 60 for 10; b rejects 50 for 2, c the same ones for 1; d rejects nothing
    patterns = [(0b0001, 60, [600, 120, 60, 60]), (0b0110, 50, [500, 100, 50, 50]), (0, 100, [1000, 200, 100, 100])]
    assert [r.name for r in rule_cascade.ordered(rules, patterns)] == ["c", "a", "d", "b"]
    assert [r.name for r in rule_cascade.ordered(rules, [])] == ["a", "b", "c", "d"]


def test_short_circuit(rule_docs, spark):
    """A rule is asked about nothing that a rule before it, or a base rule, has rejected; the verdict doesn't depend on the order."""
    asked = spark.sparkContext.accumulator(0)

    def counted(d):
        asked.add(1)
        return rule_cascade._symbols(d)
    always, never = rule_cascade.Rule("always", lambda d: True), rule_cascade.Rule("symbols", counted)
    texts = rule_docs.select("text").toArrow().column(0).combine_chunks()
    assert not rule_cascade._judged(texts, [always, never])["kept"].any() and asked.value == 0
    one, other = (rule_cascade._judged(texts, rules)["kept"].tolist() for rules in (rule_cascade.RULES, rule_cascade.RULES[::-1]))
    assert one == other


def test_profile_of_rules(rule_docs):
    rows = rule_cascade.profile(rule_docs).collect()
    passing = [t for t in rule_docs.collect() if not brute_rules(t.text or "")[5]]
    assert sum(r.docs for r in rows) == len(passing) and all(len(r.nanos) == len(rule_cascade.RULES) for r in rows)
    assert sum(r.docs for r in rows if r.pattern == 0) == sum(brute_rules(t.text or "")[6] for t in passing)


def test_labelled_good_documents_pass_the_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = rule_cascade.judged(docs).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where(
        "n_words >= 50").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r.quality: r.share for r in found.collect()}
    assert share[1] > 0.99 and share[0] < 0.02


def brute_variants(rows, least=spelling.LEAST_COUNT):
    counts = Counter()
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    out = {}
    for w in n:
        others = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 5 * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {(w, o[0], root(w), *o[1:]) for w, o in out.items()}


@pytest.fixture(scope="module")
def spelt(spark):
    """Words around a few roots, by all kinds of edits, runs of equal letters, ties, chains, other alphabets and very long words."""
    rng = random.Random(5)
    letters = "abé×ÿ"
    words = {"aaaaaa", "aaaaaaa", "aaaaaaaa", "bbbbbb", "x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499, "ÀÉÎÕÜß", "àéîõüß"}
    for _ in range(40):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 8)))
        words |= {w, w[:3] + rng.choice(letters) + w[3:], w[:2] + w[3:], w[:-1] + rng.choice(letters), rng.choice(letters) + w}
    texts = [(i, " ".join([w] * rng.choice([1, 5, 5, 7, 25, 25, 130, 700]) + [w.upper()])) for i, w in enumerate(sorted(words))]
    texts += [(7, None), (None, "Aaaaaa-aaaaaa"), (None, None), (8, ""), (9, "one_two3three"), (9, "one_two3three")]
    return [(i, t) for i, t in texts]


def test_variants_against_brute_force(spark, spelt):
    docs = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in spelt], "doc_id long, text string, n long, word string, id long")
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    want = brute_variants(spelt)
    assert len(got) == len(want) and set(got) == want
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a form of a form


def test_numbers_do_not_depend_on_ranges(spark, spelt):
    """Nodes of words over many ranges equal those of one range, and equal numbers mean equal prefixes."""
    words = spelling.vocabulary(spark.createDataFrame(spelt, "doc_id long, text string"))
    longest = 3001
    tables = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        tables.append({r.word: (r.id, r.nodes) for r in spelling.numbered(words, longest).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tables[0] == tables[1]
    seen = {}
    for w, (_, nodes) in tables[0].items():
        for i, node in enumerate(nodes):
            assert hash(w[:i]) == seen.setdefault(node, hash(w[:i]))
    assert len(set(seen.values())) == len(seen)


def test_variants_of_nothing(spark, no_docs):
    assert spelling.variants(no_docs).collect() == []
    few = spark.createDataFrame([(1, "seldom seldom"), (2, None)], "doc_id long, text string")
    assert spelling.variants(few).collect() == []
