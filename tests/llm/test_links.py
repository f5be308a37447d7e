import random
from collections import Counter
from itertools import combinations

import pytest

from strophe.llm import ngram_join
from tests.llm.test_queries import SF, Q, shingles


def brute_links(docs, k=4, p=85):
    sets, out = [(d, shingles(t, k)) for d, t in docs], Counter()
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= p * len(x | y):
            out[a] += 1
            out[b] += 1
    return {d: out[d] for d, _ in sets}


def similar_texts():
    """Forty different texts one or two words away from a common one, some of them copied, and unlike ones."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(120), 1 + i % 2):
            words[at] = f"x{i}"
        texts += [" ".join(words)] * (1 + i % 3)
    return list(enumerate([*texts, " ".join(f"u{i}" for i in range(60)), "short", None, ""]))


def test_links_of_a_group_of_similar_texts(spark):
    docs = similar_texts()
    found = ngram_join.with_links(spark.createDataFrame(docs, "doc_id long, text string"), 4, (85, 100)).collect()
    want = brute_links(docs)
    assert {r.doc_id: r.n_links for r in found} == want
    assert max(want.values()) == 48


@pytest.mark.parametrize("where", ["fixture", "generated"])
def test_links_of_the_query(spark, sf, where):
    sf_dir = sf if where == "fixture" else SF
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: r.n_links for r in Q["op7_ngram_jaccard_join"](spark, sf_dir).collect()} == brute_links(docs)
