"""The pipeline stage by stage against brute force."""

from __future__ import annotations

import base64
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from test_documents import brute_groups, words
from tidewatch.llm import crf, curriculum
from tidewatch.session import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stored(stage(spark, docs, SF), f"test-{name}")
    return [*out, docs]


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "mixing", "encoding"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_stage_drops_what_scores_low(spark, stages):
    scores = crf.quality(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in scores.collect() if r.predicted}


def test_near_stage_keeps_the_first_of_each_group(stages):
    groups = brute_groups([(r.doc_id, r.text) for r in stages[1].collect()], 5, 80)
    assert {r.doc_id for r in stages[2].collect()} == set(groups.values())


def test_substring_stage_leaves_no_repeats_and_clean_texts_alone(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    count = Counter()
    for text in before.values():
        w = words(text)
        count.update({tuple(w[i : i + 51]) for i in range(len(w) - 50)})
    left = Counter()
    for i, text in before.items():
        w = words(text)
        if all(count[tuple(w[at : at + 51])] == 1 for at in range(len(w) - 50)):
            continue
        kept = words(after[i].text) if i in after else []
        left.update({tuple(kept[at : at + 51]) for at in range(len(kept) - 50)})
    assert all(n == 1 for n in left.values())
    assert all(r.n_chars == len(r.text) for r in after.values())
    unchanged = sum(after[i].text == t for i, t in before.items() if i in after)
    assert unchanged >= 0.8 * len(before)


def test_mixing_stage_follows_the_plan(stages):
    plan = {r.id: sum(2 * c["words"] >= r["size"] for c in r.copies) for r in curriculum.plan(stages[3]).collect()}
    got = Counter(r.doc_id for r in stages[4].collect())
    assert got == {i: n for i, n in plan.items() if n}


def test_encoding_stage_equals_tiktoken(stages):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(list(r.ids) == own.encode_ordinary(r.text) for r in rows)
