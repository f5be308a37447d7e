"""The plan comes from the linear program: its share of the pieces, its bound, and what it leaves."""

import random

import numpy as np
import pytest

from strophe.llm import common, packing

RNG = random.Random(5)
HISTOGRAMS = {
    "every length": {s: RNG.randrange(1, 2000) for s in range(1, 2049)},
    "about a half": {s: RNG.randrange(1, 50) for s in range(900, 1100)},
    "over a half": {s: 5 for s in range(1100, 2048)},
    "long and short": {s: RNG.randrange(1, 9) for s in [*range(1200, 1900), *range(1, 40)]},
    "needs pivots": {s: RNG.randrange(1, 50) for s in range(500, 900, 5)},
}


def share_programmed(counts):
    left = np.zeros(packing.LENGTH + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    pieces = left[:-1].sum()
    _, programs = packing.programmed(left, packing.LENGTH)
    return 1 - left.sum() / pieces, programs


def checked(counts):
    plan, used = packing.plan(counts), {}
    for pattern, times in plan:
        assert sum(s * k for s, k in pattern) <= packing.LENGTH
        for s, k in pattern:
            used[s] = used.get(s, 0) + k * times
    assert used == counts
    return sum(times for _, times in plan)


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_plan_is_near_the_bound(name):
    counts = HISTOGRAMS[name]
    share, programs = share_programmed(counts)
    assert share >= 0.9
    assert all(p.objective <= p.bound * (1 + packing.GAP) + 1e-6 for p in programs)
    assert checked(counts) <= programs[0].bound * (1 + packing.GAP) + 10


def test_plan_of_the_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents", "doc_id", "text")
    found = packing.pieces(docs, packing.tokenizer_path()).groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in found}
    share, programs = share_programmed(counts)
    assert share >= 0.9 and programs[0].objective <= programs[0].bound * (1 + packing.GAP)
    assert checked(counts) == -(-sum(s * n for s, n in counts.items()) // packing.LENGTH)


def test_merge_ranks_equal_the_files_pairs():
    from strophe.llm.bpe import WordBpe

    assert WordBpe(packing.tokenizer_path()).consistent()
