"""Operators on documents against brute force, and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import bpe, chosen_path, compact_windows, crf, curriculum, piecewise, toxicity
from tidewatch.llm import components as components_module
from tidewatch.llm.components import components
from tidewatch.llm.segments import maximal_segments
from tidewatch.llm.words import distinct, hash_words, shingles

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_groups(rows, width, percent):
    """Least id reachable over links between ids; rows that share an id are one."""
    root = {i: i for i, _ in rows if i is not None}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    sets = [(i, shingle_set(t, width)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


def test_words_of_batches(prose):
    texts = ["A bC\tde", "", None, " x\x0by ", prose(500_000), "é É"]
    hashes, starts, first = hash_words(pa.array(texts))
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    seen = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    values, begin = distinct(*shingles(hashes, first, 3))
    assert np.diff(begin).tolist() == [len(shingle_set(t, 3)) for t in texts]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(spark, odd_docs, width, percent):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute_groups(rows, width, percent)
    got = chosen_path.near_groups(odd_docs, width, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingle_set(t, width)) for _, t in rows)


def test_near_groups_of_a_large_group(spark, prose, monkeypatch):
    """A group beyond a node is branched, and beyond a cluster's limit meets in nodes of trees."""
    base = prose(200).split()
    rows = [(i, " ".join(w if (j * 31 + i) % 401 else f"w{i}" for j, w in enumerate(base))) for i in range(700)]
    rows += [(1000 + i, prose(60)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows, 3, 85)
    for limit in (4096, 300):
        monkeypatch.setattr(chosen_path, "BLOCKED", limit)
        assert {r.doc_id: r.component_id for r in chosen_path.near_groups(docs, 3, 85).collect()} == want


def changed(text, rng, places):
    """text with other words at so many places that no shingle of five words holds two of them."""
    words_ = text.split()
    for at in rng.sample(range(0, len(words_) // 6), places):
        words_[6 * at + 2] = f"x{rng.randrange(10**9)}"
    return " ".join(words_)


def test_near_groups_of_a_star(spark, prose, monkeypatch):
    """Copies whose only link is their base are linked to it, also in a cluster beyond the limit."""
    rng, base = random.Random(3), prose(400)
    rows = [(1, base)] + [(i, changed(base, rng, 10)) for i in range(2, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows, 3, 85)
    assert set(want.values()) == {1}
    for name, value in (("NODE", 16), ("BLOCK", 8), ("BLOCKED", 64)):
        monkeypatch.setattr(chosen_path, name, value)
    assert {r.doc_id: r.component_id for r in chosen_path.near_groups(docs, 3, 85).collect()} == want


def test_near_groups_where_trees_part_pairs(spark, prose, monkeypatch):
    """Pairs at the threshold are found where the trees' nodes are split often, or the trees are few, for the recall."""
    rng, shared = random.Random(4), prose(200)
    rows = []
    for i in range(150):
        own = f"{shared} {prose(130)}"
        rows += [(2 * i, own), (2 * i + 1, changed(own, rng, 8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows, 3, 85)
    assert len(set(want.values())) == 150
    monkeypatch.setattr(chosen_path, "NODE", 4)
    monkeypatch.setattr(chosen_path, "TREES", 1)
    assert {r.doc_id: r.component_id for r in chosen_path.near_groups(docs, 3, 85).collect()} == want


def test_keep_one_keeps_columns(odd_docs, no_docs):
    kept = chosen_path.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 9 not in ids and ids.count(None) == 2
    assert chosen_path.keep_one(no_docs).count() == 0
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("_dropped", "row", "kept", "component_id")})
    assert sorted(map(str, chosen_path.keep_one(clash).select(*odd_docs.columns).collect())) == sorted(map(str, kept.collect()))


@pytest.mark.parametrize("few", [0, 500_000])
def test_components(spark, monkeypatch, few):
    """By star contractions and in one task."""
    monkeypatch.setattr(components_module, "FEW_EDGES", few)
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6), (7, None), (3, 1), (9, 8), (8, 4)], "a long, b long")
    assert sorted(tuple(r) for r in components(edges).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (8, 4), (9, 4)]
    assert components(edges.limit(0)).count() == 0
    chain = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components(chain).collect()} == {0}
    rng = random.Random(2)
    pairs = [(rng.randrange(-2000, 2000), rng.randrange(-2000, 2000)) for _ in range(1500)]
    least = {}
    for _ in range(60):  # slow and plain
        for a, b in pairs:
            least[a] = least[b] = min(least.get(a, a), least.get(b, b))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {i: c for i, c in least.items() if i in linked}


def test_passages(odd_docs, no_docs, spark):
    rows = {r.doc_id: r for r in compact_windows.repeated(odd_docs).collect()}
    assert set(rows) == set(range(1, 16))
    assert {i for i, r in rows.items() if r.class_id == 1} == {1, 2, 9, 14}
    assert rows[15].class_id == 3 and rows[1].n_links == 0 and rows[11].n_links == 0
    assert [tuple(s) for s in rows[14].spans] == [(40, 159)] and rows[9].repeated_words == 120
    assert compact_windows.repeated(no_docs).count() == 0
    cut = compact_windows.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns
    left = {r.doc_id: r for r in cut.collect()}
    assert 9 not in left and len(words(left[14].text)) == 80 and left[14].n_chars == len(left[14].text)
    same = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(left[i].text == same[i] for i in (1, 3, 4, 5, 6, 7, 11, 12, 13))


def test_passages_need_two_hash_functions():
    """At the threshold of 0.8, at most 0.2 % of the passages agree on too few of the hash functions."""
    n, agree = compact_windows.HASHES, compact_windows.AGREE
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(agree)) < 0.002


def test_every_exact_passage_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    found = {r.doc_id: r for r in compact_windows.repeated(docs).collect()}
    where = {}
    for i in sorted(texts):
        for at in range(len(texts[i]) - 50):
            where.setdefault(tuple(texts[i][at : at + 51]), []).append((i, at))
    for places in where.values():
        first = places[0][0]
        for i, at in places:
            if i != first:
                assert found[i].class_id == found[first].class_id
                assert any(s["first"] <= at and at + 50 <= s["last"] for s in found[i].spans)


@pytest.mark.parametrize("line_words", [20, 30, 40, 46])
def test_passages_around_a_common_line(spark, prose, line_words):
    """100 pairs of documents that share a passage, part of which is a line that 300 others have as well, also twice."""
    line, rows = prose(line_words), []
    for i in range(300):
        rows.append((1000 + i, f"{prose(80)} {line} {prose(80)}" + (f" {line} {prose(30)}" if i % 3 == 0 else "")))
    for i in range(100):
        extra = max(52, line_words + 10) - line_words
        before, after = prose(extra // 2), prose(extra - extra // 2)
        first = f"{line} {prose(60)} " if i % 4 == 0 else ""
        rows += [(2000 + 2 * i, f"{first}{prose(50)} {before} {line} {after} {prose(50)}"), (2001 + 2 * i, f"{prose(70)} {before} {line} {after} {prose(30)}")]
    found = {r.doc_id: r for r in compact_windows.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    passage = max(52, line_words + 10)
    caught = [i for i in range(100) if found[2001 + 2 * i].class_id == 2000 + 2 * i
              and any(s["first"] <= 70 and s["last"] >= 69 + passage for s in found[2001 + 2 * i].spans)]
    assert len(caught) == 100
    assert all(found[1000 + i].n_links == 0 for i in range(300))


def test_near_copies_in_a_crowd(spark, prose):
    """100 pairs of documents share two lines of 27 words, one word of which is another one in the copy; 15 earlier documents or more have
    either line alone."""
    lines, rng = [prose(27).split() for _ in range(20)], random.Random(6)
    rows = [(i, f"{prose(40)} {' '.join(lines[i % 20])} {prose(40)}") for i in range(300)]
    for i, (a, b) in enumerate(rng.sample([(a, b) for a in range(20) for b in range(a)], 100)):
        passage = lines[a] + lines[b]
        altered = [w if k != 8 + i % 38 else "altered" for k, w in enumerate(passage)]
        rows += [(1000 + 2 * i + copy, f"{prose(50)} {' '.join(p)} {prose(50)}") for copy, p in enumerate((passage, altered))]
    found = {r.doc_id: r for r in compact_windows.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = [i for i in range(100) if found[1001 + 2 * i].class_id == 1000 + 2 * i
              and any(s["first"] <= 50 and s["last"] >= 103 for s in found[1001 + 2 * i].spans)]
    assert len(caught) >= 99  # a pair agrees on too few hash functions with 0.2 %
    assert all(found[i].n_links == 0 for i in range(300))


def test_rarest_places_of_runs():
    """Every run that lacks few enough places, be they the rarest or the most common ones, shares a chosen place with the other document."""
    rng, lengths = np.random.default_rng(9), compact_windows._lengths(20, 80)
    for _ in range(200):
        there = np.flatnonzero(rng.random(120) < 0.97)
        n, free = rng.integers(2, 5, len(there)), rng.random(len(there)) >= rng.choice([0, 0.3, 0.8])
        chosen = compact_windows._rarest(rng.integers(0, 9, len(there)), there, n, np.zeros(len(there), np.int64), free, lengths)
        assert not (chosen & ~free).any()
        for length, misses in lengths:
            for a in range(120 - length + 1):
                inside = np.flatnonzero((there >= a) & (there < a + length))
                lacked = length - len(inside)
                # the other document may lack the chosen ones first
                assert lacked > misses or chosen[inside].sum() > misses - lacked or chosen[inside].sum() == free[inside].sum()


def test_passages_have_a_run_that_lacks_few():
    """Of the places of any passage at the threshold some run of _lengths lacks no more than it may, wherever the missing ones are."""
    rng = np.random.default_rng(10)
    for span, percent in ((46, 80), (46, 70), (20, 90), (16, 50)):
        lengths, miss = compact_windows._lengths(span, percent), 2 * percent / (100 - percent)
        for size in range(span, 4 * span):
            lost = int(size / (miss + 1) + 1e-9)
            for at in {0, size // 2, size // 2 - lost // 2, span - lost // 2, *rng.integers(0, size, 6).tolist()}:
                there = np.ones(size, dtype=bool)
                there[max(0, min(at, size - lost)) :][:lost] = False
                for passage in (there, rng.permutation(there)):
                    gone = np.append(0, np.cumsum(~passage))
                    assert any((gone[n:] - gone[:-n] <= m).any() for n, m in lengths if n <= size)


def test_turns_of_documents(spark, monkeypatch):
    """Shared places know how many documents come before theirs, also where a shingle's places come in pieces."""
    monkeypatch.setattr(compact_windows, "PIECE", 16)
    rng = random.Random(3)
    rows = sorted({(rng.choice([1, 1, 1, rng.randrange(2, 60)]), rng.randrange(40), rng.randrange(3) << compact_windows._REGION | rng.randrange(90)) for _ in range(500)})
    holders, want = {}, Counter()
    for shingle, i, _ in rows:
        holders.setdefault(shingle, set()).add(i)
    regions = set()
    for shingle, i, place in rows:
        region = shingle, i, place >> compact_windows._REGION
        if len(holders[shingle]) > 1:
            want[shingle, i, place, len([j for j in holders[shingle] if j < i]), region not in regions] += 1
        regions.add(region)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        for size in ("7", before):
            spark.conf.set(batch, size)
            got = compact_windows._shared_places(spark.createDataFrame(rows, "shingle long, id long, place long")).collect()
            assert Counter((r.shingle, r.id, r.place, r.turn, r.first) for r in got) == want
            assert all(r.n == min(16, sum(s == r.shingle for s, _, _ in rows)) for r in got)
    finally:
        spark.conf.set(batch, before)


def test_dense_stretches_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        there = rng.random(40) < rng.choice([0.5, 0.8, 0.9])
        span, miss = int(rng.integers(1, 20)), float(rng.choice([1.5, 4, 8]))
        good = [(i, j) for i in range(40) for j in range(i + span - 1, 40) if there[i] and there[j]
                and there[i : j + 1].sum() - miss * (~there[i : j + 1]).sum() >= 0]
        want = [(i, j) for i, j in good if not any((a, b) != (i, j) and a <= i and j <= b for a, b in good)]
        assert compact_windows._dense(there, span, miss) == want


def test_altered_passages_against_brute_force(spark, prose):
    """Passages of 60 words of which every 25th or so is another word, each in two documents or in four."""
    rng, rows, pairs = random.Random(4), [], 0
    for i in range(60):
        passage = prose(60).split()
        for copy in range(4 if i % 3 == 0 else 2):
            own = [w if not copy or rng.random() > 0.02 else "altered" + w for w in passage]
            rows.append((10 * i + copy, f"{prose(rng.randint(0, 60))} {' '.join(own)} {prose(rng.randint(0, 60))}"))
    texts = {i: words(t) for i, t in rows}
    found = {r.doc_id: r for r in compact_windows.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = 0
    for i, t in texts.items():
        sets = {j: [frozenset(zip(*(u[a + k : a + 50 - 4 + k] for k in range(5)), strict=True)) for a in range(len(u) - 49)] for j, u in texts.items()
                if j // 10 == i // 10 and j < i}
        own = [frozenset(zip(*(t[a + k : a + 50 - 4 + k] for k in range(5)), strict=True)) for a in range(len(t) - 49)]
        if any(len(x & y) >= 0.8 * len(x | y) for x in own for u in sets.values() for y in u):
            pairs += 1
            missed += found[i].n_links == 0
        else:
            assert found[i].n_links == 0 or not sets
    assert pairs >= 60 and missed <= 0.02 * pairs


def test_texts_that_share_an_id(spark, prose):
    """A copied text, an unlike text, a shorter one, a null and an empty one under one id; columns named like the operator's."""
    a, b, c = prose(80), prose(60), prose(120)
    rows = [(1, a), (2, a), (2, "keep me please"), (2, None), (2, ""), (2, f"{b} {c}"), (3, b), (4, f"{prose(20)} {b}"), (4, "short"), (None, a), (5, a), (5, a)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x", "y", "z", 1) for i, t in rows],
                                 "doc_id long, text string, n_chars long, _id string, _spans string, marks string, id int")
    cut = compact_windows.without_repeats(docs)
    assert cut.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in cut.collect())
    assert got == Counter([(1, a), (2, "keep me please"), (2, None), (2, ""), (2, f"{b} {c}"), (4, rows[7][1].rsplit(" ", 60)[0]), (4, "short"), (None, a)])
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())


def test_windows_are_those_of_brute_force(spark, prose):
    text = prose(300)
    rows = compact_windows.windows(spark.createDataFrame([(1, text)], "id long, text string"), 40).collect()
    for k in range(compact_windows.HASHES):
        low, high, functions = compact_windows._unpacked(np.array([r.at for r in rows]))
        own = sorted(zip(low[functions == k].tolist(), high[functions == k].tolist(), strict=True))
        covered = {}
        for low, high in own:
            assert high - low + 1 >= 40
        hashes, _, first = hash_words(pa.array([text]))
        values = compact_windows.mix(shingles(hashes, first, 5)[0], 31 + k)
        for i in range(len(values) - 39):
            covered[int(i + values[i : i + 40].argmin())] = None
        assert len(own) == len(covered)


def test_segments_against_quadratic():
    rng = np.random.default_rng(3)
    for _ in range(50):
        values = rng.choice([2.0, -1.0, 0.5, -3.0], 40)
        hits = np.flatnonzero(values != -1.0)
        got = maximal_segments(hits, values[hits], -1.0)
        total = np.concatenate(([0], np.cumsum(values)))
        best = max((total[b] - total[a] for a in range(41) for b in range(a + 1, 41)), default=0)
        assert max((s for _, _, s in got), default=0) == pytest.approx(max(best, 0))
        for first, last, score in got:
            assert score == pytest.approx(values[first : last + 1].sum())
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))


def test_all_maximal_segments_against_recursion():
    """The best segment, then the best ones left and right of it, and so on, are the maximal ones."""
    rng = np.random.default_rng(6)

    def plain(values, begin):
        total = np.concatenate(([0], np.cumsum(values)))
        best = max(((total[b] - total[a], a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        _, a, b = best
        return [*plain(values[:a], begin), (begin + a, begin + b - 1), *plain(values[b:], begin + b)]
    for _ in range(60):
        values = np.where(rng.random(45) < 0.5, -0.7, rng.normal(0.4, 1.5, 45))
        hits = np.flatnonzero(values != -0.7)
        assert [(a, b) for a, b, _ in maximal_segments(hits, values[hits], -0.7)] == plain(values, 0)


def test_bpe_equals_tiktoken(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    assert bpe.read_ranks(spark, path) == ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hard = ["a  b \n c", " lead", "trail ", "it's 12'll", "aaaa" * 700, " x  y", "中文 text😀", "x\x1c y", "<|endoftext|>"]
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"), True)
    out = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("x")), ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(out) == docs.count()
    for r in out:
        assert list(r.ids) == own.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(no_docs, ranks, public_tokenizers.PATTERN).count() == 0
    digests = bpe.round_trip(docs.withColumns({"_text": F.lit("clash"), "n_tokens": F.lit(0)}), ranks, public_tokenizers.PATTERN)
    want = sorted(str((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                       hashlib.sha256((r.text or "").encode()).hexdigest()))
                  for r in docs.collect() for ids in [own.encode_ordinary(r.text or "")])
    assert sorted(str(tuple(r)) for r in digests.collect()) == want
    assert bpe.round_trip(no_docs, ranks, public_tokenizers.PATTERN).count() == 0


def test_fingerprints(odd_docs, no_docs):
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = piecewise.beside_next(odd_docs).collect()
    want = []
    for at, (i, text) in enumerate(rows):
        after, n = rows[(at + 1) % len(rows)][1], len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        want.append((str(i), n, hashlib.sha256(edited.encode()).hexdigest(), piecewise.fingerprint(text.encode()),
                     piecewise.fingerprint(edited.encode()), piecewise.fingerprint(after.encode())))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(want)
    assert piecewise.beside_next(no_docs).count() == 0
    assert piecewise.fingerprint(b"") == "3::"


def test_fingerprints_against_scalar_arithmetic(prose):
    """Rolling hash, pieces and signatures byte by byte with Python's whole numbers, and the greatest id beside rows without one."""
    mask = 2**64 - 1

    def scramble(x, seed):
        x = (x + 0x9E3779B97F4A7C15 * (2 * seed + 1)) & mask
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)
    of_byte, turns = [scramble(b, 61) for b in range(256)], [scramble(k, 67) | 1 for k in range(piecewise.WINDOW)]

    def signature(data, size):
        pieces, total = [], 0
        for i in range(len(data)):
            rolled = sum(of_byte[data[i - back]] * turns[back] for back in range(min(i + 1, piecewise.WINDOW))) & mask
            value = scramble(rolled, 3) >> 16
            total = (total + scramble(value, 9)) & mask
            if value % size == 0:
                pieces.append(total)
                total, ended = 0, True
            else:
                ended = False
        if data and not ended:
            pieces.append(total)
        if len(pieces) > piecewise.CHARACTERS:
            pieces = [*pieces[: piecewise.CHARACTERS - 1], sum(pieces[piecewise.CHARACTERS - 1 :]) & mask]
        return "".join(chr(piecewise._LETTERS[scramble(p, 5) >> 58]) if isinstance(piecewise._LETTERS[0], (int, np.integer))
                       else piecewise._LETTERS[scramble(p, 5) >> 58].decode() for p in pieces)

    def plain(data):
        size = piecewise.SMALLEST
        while size * piecewise.CHARACTERS < len(data):
            size *= 2
        while size > piecewise.SMALLEST and len(signature(data, size)) < piecewise.CHARACTERS // 2:
            size //= 2
        return f"{size}:{signature(data, size)}:{signature(data, 2 * size)}"
    for text in ("", "a", "aaaa" * 200, prose(40), prose(500), "é中" * 90, prose(3) * 50):
        assert piecewise.fingerprint(text.encode()) == plain(text.encode())


def test_the_greatest_id_is_no_null(spark, prose):
    last = (1 << 63) - 1
    rows = [(last, prose(9)), (None, prose(8)), (1, prose(7)), (None, None)]
    got = piecewise.beside_next(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key long")).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)


def test_fingerprint_likeness(spark, prose):
    text = prose(800)
    pair = [(piecewise.fingerprint(text.encode()), piecewise.fingerprint(t.encode()))
            for t in (text, text[:3000] + " inserted here " + text[3000:], prose(800))]
    rows = spark.createDataFrame(pair, "a string, b string").select(piecewise.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert rows[0].x == 1 and 0.8 < rows[1].x <= 1 and rows[2].x < 0.4


def test_fingerprint_does_not_depend_on_blocks(monkeypatch, prose):
    text = prose(2000).encode()
    whole = piecewise.fingerprint(text)
    monkeypatch.setattr(piecewise, "BLOCK", 999)
    assert piecewise.fingerprint(text) == whole


def test_curriculum(spark, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = curriculum.plan(docs).collect()
        assert len(rows) == docs.count()
        by_source = {}
        for r in rows:
            taken = sum(c["words"] for c in r.copies)
            assert taken <= 3 * r["size"] and all(0 <= c["position"] <= 1 for c in r.copies)
            total = by_source.setdefault(r.source_key, [0, 0, r.target, r.source_size])
            total[0] += taken
            total[1] += r["size"]
        names = sorted(by_source)
        for at, name in enumerate(names):
            taken, size, target, source_size = by_source[name]
            assert size == source_size and abs(taken - target) <= 0.5 and target <= 3 * size + 1e-6
            if target < 3 * size - 1e-6:  # free sources share by weight
                assert all(by_source[o][2] * (at % 3 + 1) == pytest.approx(target * (names.index(o) % 3 + 1)) or
                           by_source[o][2] == pytest.approx(3 * by_source[o][1]) for o in names)
        assert sum(s[2] for s in by_source.values()) == pytest.approx(sum(s[1] for s in by_source.values()))
        assert sorted(map(str, curriculum.plan(docs).collect())) == sorted(map(str, rows))
    assert curriculum.plan(no_docs).count() == 0
    mixed = curriculum.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("_id", "_copies", "_copy", "row", "c", "copies", "position")})
    assert Counter(map(str, curriculum.mixed(clash).select(*odd_docs.columns).collect())) == Counter(map(str, mixed.collect()))
    two = odd_docs.where("doc_id in (1, 3)").withColumn("source", F.lit("s"))
    alone = curriculum.mixed(two.unionByName(two.withColumn("doc_id", F.lit(None).cast("long"))))  # rows without an id are not lost
    assert {r.doc_id for r in alone.collect()} == {1, 3, None}
    at = [r.position for r in curriculum.in_order(curriculum.plan(odd_docs)).collect()]
    assert at == sorted(at)


def test_demand_is_inverted(spark):
    """A source that fades out has half of its words due before half of the time."""
    docs = spark.createDataFrame([(i, "word", s) for i in range(200) for s in ("a", "b", "c")], "doc_id long, text string, source string")
    docs = docs.withColumn("doc_id", F.col("doc_id") * 3 + F.ascii("source"))
    rows = [c["position"] for r in curriculum.plan(docs).where("source_key = '0a'").collect() for c in r.copies]
    assert sum(p < 0.5 for p in rows) / len(rows) == pytest.approx(0.625, abs=0.02)


def held_out_accuracy(found, labels, name):
    rows = found.join(labels.withColumnRenamed("doc_id", "i"), F.col("i") == F.col("doc_id")).where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == r[name] for r in rows) / len(rows)


def test_quality(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = crf.train(docs, labels)
    assert held_out_accuracy(crf.quality(docs, labels), labels, "quality") > 0.97
    odd = {r.doc_id: r.score for r in crf.scores(odd_docs, model).collect()}
    assert odd[4] == odd[5] == model.prior and odd[1] == odd[9] and len(odd) == 16
    assert crf.scores(no_docs, model).count() == 0
    assert crf.keep_good(odd_docs, labels).columns == odd_docs.columns
    blank = crf.quality(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in blank} == {0.5}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    unary, follow = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    first = np.array([0, 4, 4, 5, 9])
    marginal, both, log_sum = crf.forward_backward(unary, follow, first)
    want, pairs, total = np.zeros((9, 2)), np.zeros((2, 2)), 0.0
    for lo, hi in ((0, 4), (4, 5), (5, 9)):
        n = hi - lo
        weights = {}
        for code in range(2**n):
            s = [code >> i & 1 for i in range(n)]
            weights[tuple(s)] = np.exp(sum(unary[lo + i, s[i]] for i in range(n)) + sum(follow[a, b] for a, b in zip(s, s[1:], strict=False)))
        z = sum(weights.values())
        total += np.log(z)
        for s, w in weights.items():
            for i in range(n):
                want[lo + i, s[i]] += w / z
            for a, b in zip(s, s[1:], strict=False):
                pairs[a, b] += w / z
    assert np.allclose(marginal, want) and np.allclose(both, pairs) and log_sum == pytest.approx(total)


def test_toxicity_fit_counts_every_segment(spark, prose, monkeypatch):
    """The fit sees as many significant passages of a long text as scoring does."""
    own = [prose(60) for _ in range(200)]
    rows = [(i, t if i % 2 else f"{t} {'vile ' * 5}" * 100) for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    fit = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, y: seen.append(x) or fit(x, y))
    toxicity.train(docs, labels)
    assert seen[0][:, 1].max() == pytest.approx(np.log1p(100))


def test_toxicity(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    assert held_out_accuracy(toxicity.toxicity(docs, labels), labels, "toxic") > 0.96
    model = toxicity.train(docs, labels)
    mean = spark.createDataFrame([(1, "you stupid moron, you worthless scum")], "doc_id long, text string")
    found = toxicity.score(odd_docs.unionByName(mean.withColumn("doc_id", F.lit(77).cast("long")), True), model).collect()
    scores = {r.doc_id: r for r in found}
    assert scores[77].score > 0.5 and [(s["first"], s["last"]) for s in scores[77].segments] == [(1, 5)]
    assert scores[4].score == scores[5].score < 0.5 and scores[1].score == scores[9].score and len(found) == odd_docs.count() + 1
    assert toxicity.score(no_docs, model).count() == 0
    blank = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in blank} == {0.5}


def test_mixing_moves_whole_texts_once(spark, monkeypatch):
    """In partitions of about 100 rows the mix has the order of the plan, and texts pass through one exchange."""
    rng = random.Random(3)
    rows = [(7 * i - 300, "w " * rng.randint(0, 40) if i % 50 else None, rng.choice(["a", "b", "b", "c", None])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(curriculum, "PART_ROWS", 100)
    mixed = curriculum.mixed(docs)
    taken = F.filter("copies", lambda c: 2 * c["words"] >= F.col("size"))
    want = [r.id for r in curriculum.in_order(curriculum.plan(docs).withColumn("copies", taken)).collect()]
    assert mixed.rdd.getNumPartitions() == 8 and [r.doc_id for r in mixed.collect()] == want
    plan = mixed.select("*")._jdf.queryExecution().executedPlan().toString()  # not run yet
    assert re.findall(r"\bExchange (\w+\([a-z_]+)", plan) == ["shufflepartitionidpassthrough(direct_shuffle_partition_id", "hashpartitioning(key"]


def test_shared_halves_against_brute_force(spark, monkeypatch):
    """Halves of one document, of several, and of so many rows that they come in pieces; those met in a task need no exchange."""
    monkeypatch.setattr(compact_windows, "PIECE", 64)
    rng, batches = np.random.default_rng(2), []
    for _ in range(4):
        half = np.where(rng.random(400) < 0.5, 1, rng.integers(2, 900, 400))
        batches.append((half, rng.integers(0, 300, 400), rng.integers(0, 1 << 40, 400)))
    told = pa.Table.from_batches([compact_windows._told(*b) for b in batches])
    holders, rows = {}, [r for b in batches for r in zip(*(c.tolist() for c in b), strict=True)]
    for half, i, _ in rows:
        holders.setdefault(half, set()).add(i)
    got = compact_windows._of_two(spark.createDataFrame(told.to_pandas(), "half long, id long, starts long, known boolean")).collect()
    assert Counter(map(tuple, got)) == Counter((i, at) for half, i, at in rows if len(holders[half]) > 1)
    assert sum(half == 1 and not known for half, known in zip(told["half"].to_pylist(), told["known"].to_pylist(), strict=True)) == 4


def test_labels_meet_vertices_not_shingles(spark):
    """A set has one row of prefix shingles to be joined with its label, however many they are."""
    sets = spark.createDataFrame([(v, [v * 100 + k for k in range(100)] + [7]) for v in range(1, 6)], "vertex long, set array<long>")
    prefixes = chosen_path._prefixes(sets, 80)
    assert prefixes.count() == 5 and {len(r.tokens) for r in prefixes.collect()} == {21}
    apart = chosen_path._apart(prefixes, spark.createDataFrame([(1, 1), (2, 1)], "vertex long, label long"))
    held = {r.vertex: set(r.tokens) for r in prefixes.collect()}
    labels = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    want = {(t, v) for v, ts in held.items() for t in ts if len({labels[u] for u in held if t in held[u]}) > 1}
    assert {(r.token, r.vertex) for r in apart.collect()} == want


def test_first_rows_of_groups_as_they_pass(spark):
    """Groups of one row to many, also cut by the ends of Arrow batches; nothing is held in a window."""
    rng = random.Random(5)
    rows = [(key, 3 if key == 9 else 0, rng.randrange(3) if key == 9 else 0, rng.randrange(-20, 20), rng.randrange(1 << 40))
            for key in range(60) for _ in range(rng.choice([1, 2, 3, 5, 40]))]
    groups = {}
    for r in rows:
        groups.setdefault(r[:3], []).append(r[3:])
    want = Counter()
    for (key, salts, salt), held in groups.items():
        crowd = len(held) > 2 or salts > 0
        want.update((key, salts, salt, i, at, *min(held), crowd) for i, at in held if crowd or i != min(held)[0])
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        for size in ("3", before):
            spark.conf.set(batch, size)
            headed = compact_windows._headed(spark.createDataFrame(rows, "key long, salts int, salt int, id long, at long"))
            assert Counter(map(tuple, headed.collect())) == want
    finally:
        spark.conf.set(batch, before)
    assert "Window" not in headed._jdf.queryExecution().executedPlan().toString()


def test_parts_of_texts_are_moved_once(spark, prose):
    """Candidates take their parts of both texts along one exchange; Arrow batches may end between the sides."""
    texts = {i: prose(200).split() for i in range(6)}
    for i in range(1, 6):
        texts[i][20 * i : 20 * i + 80] = texts[0][10 * i : 10 * i + 80]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    rows = [(i, 0, 190, 0, 0, 190) for i in range(1, 6)] + [(3, 50, 130, 0, 10, 100)]
    candidates = spark.createDataFrame(rows, "id long, lo int, hi int, rep long, rlo int, rhi int")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        spark.conf.set(batch, "3")
        found = compact_windows._verified(candidates, docs, 46, 80)
        assert Counter(map(tuple, found.collect())) == Counter(
            [(i, 20 * i, 20 * i + 79, 0, 10 * i, 10 * i + 79) for i in range(1, 6)] + [(3, 60, 134, 0, 30, 104)])
    finally:
        spark.conf.set(batch, before)
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString()  # not run yet
    assert "Exchange hashpartitioning(candidate" in plan and plan.count("Exchange hashpartitioning(") <= 3


def test_spans_of_long_slopes():
    """Equal and falling values, of which a search passes one after another, are done as by looking at each."""
    rng = np.random.default_rng(8)
    for values in (np.full(900, 7), np.arange(900)[::-1], np.append(np.arange(900), [0, 3, 1]), rng.integers(0, 9, 900)):
        ranked, begin = values.astype(np.uint64), np.array([0, 300, 300, len(values)])
        left, right = compact_windows._spans(np.arange(len(values)), ranked, begin)
        for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            low, high = (0, 299) if i < 300 else (300, len(values) - 1)
            assert a == max((j + 1 for j in range(low, i) if values[j] <= values[i]), default=low)
            assert b == min((j - 1 for j in range(i + 1, high + 1) if values[j] < values[i]), default=high)


def test_encoder_remembers_no_more_than_asked(spark, prose, monkeypatch):
    """The pipeline's workers remember less than an encoder that is alone, and the ids do not depend on it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b" c": 257}
    short, long = (bpe.TextEncoder(ranks, bpe.SPACED_PATTERN, n) for n in (20, 5000))
    texts = [prose(100) + ", and." for _ in range(5)]
    assert [short(t) for t in texts] == [long(t) for t in texts]
    for table in (short.token.__self__, short.after_space.__self__):
        assert len(table) <= 20 and len(table.older) <= 20
    asked = {}
    monkeypatch.setattr(bpe, "encode", lambda docs, ranks, pattern, **options: asked.update(options) or docs)
    corpus_pipeline.encoding(spark, spark.range(1), "")
    assert asked["remembered"] <= 100_000 < bpe.REMEMBERED


def test_runs_of_a_crowd_against_brute_force(spark, prose):
    """Every run of 50 words that several documents have, also in windows of all of them, is linked with the first document that has it."""
    rng, pool = random.Random(11), [prose(rng_words).split() for rng_words in (50, 52, 60, 75, 90)]
    texts = {}
    for i in range(60):
        parts = [prose(rng.randint(5, 40)).split()]
        for passage in rng.sample(pool, rng.randint(0, 3)):
            begin = rng.randint(0, len(passage) - 40)
            parts += [passage[begin:] if rng.random() < 0.5 else passage, prose(rng.randint(1, 9)).split()]
        texts[i] = [w for part in parts for w in part]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    crowded = compact_windows.windows(docs).select("id", "at")
    links = {}
    for r in compact_windows._exact(crowded, docs, 46).collect():
        assert texts[r.id][r.first : r.last + 1] == texts[r.rep][r.rep_first : r.rep_last + 1]
        links.setdefault((r.id, r.rep), []).append((r.first, r.last))
    where = {}
    for i, t in texts.items():
        for at in range(len(t) - 49):
            where.setdefault(tuple(t[at : at + 50]), []).append((i, at))
    shared = [(i, at, places[0][0]) for places in where.values() for i, at in places if i != places[0][0]]
    assert len(shared) > 500
    assert all(any(a <= at and at + 49 <= b for a, b in links[i, rep]) for i, at, rep in shared)
