"""Reply trees against brute force: branches, ties, orphans, cycles, repeated ids, long chains."""

import random
from collections import defaultdict

import pytest

from strophe.llm import chat_format

SCHEMA = "tree long, id long, parent long, score long, role string, text string"


def brute(messages, top):
    """{tree: [turns of each chosen path]}, best first within each root."""
    out = defaultdict(list)
    trees = defaultdict(lambda: defaultdict(list))
    for tree, i, parent, score, role, text in messages:
        trees[tree][i].append((role or "", text or "", score or 0, parent))
    for tree, by_id in trees.items():
        nodes, above = {}, {}
        for i, rows in by_id.items():
            rows.sort(key=lambda r: r[:3])
            for n, r in enumerate(rows, 1):
                nodes[i, n] = r
                above[i, n] = (i, n - 1) if n > 1 else (r[3], len(by_id[r[3]])) if r[3] in by_id else None
        leaves = set(nodes) - set(above.values())
        branches = defaultdict(list)
        for leaf in leaves:
            path, at = [], leaf
            while at is not None and at not in path:
                path.append(at)
                at = above[at]
            if at is None:
                branches[path[-1]].append((-sum(nodes[x][2] for x in path), -len(path), leaf, path[::-1]))
        for found in branches.values():
            for _, _, leaf, path in sorted(found)[:top]:
                out[tree].append((leaf[0], [nodes[x][:2] for x in path]))
    return {t: sorted(v) for t, v in out.items()}


def formatted(spark, messages, top):
    out = defaultdict(list)
    for r in chat_format.format_trees(spark.createDataFrame(messages, SCHEMA), top).collect():
        turns = chat_format.parse(r.formatted)
        told = [chat_format.unescape(r.formatted[s.start : s.stop]) for s in r.loss]
        assert told == [t for role, t in turns if role == "assistant"]
        out[r.tree].append((r.leaf, turns))
    return {t: sorted(v) for t, v in out.items()}


def random_messages(seed):
    rng, rows = random.Random(seed), []
    for tree in range(12):
        n = rng.randrange(1, 25)
        for i in range(n):
            parent = None if i == 0 or rng.random() < 0.08 else rng.randrange(i) if rng.random() < 0.9 else rng.choice([900, i, (i + 1) % n])
            rows.append((tree, i, parent, rng.randrange(3), rng.choice(["user", "assistant"]), f"<|im_end|>{rng.randrange(99)}"))
            if rng.random() < 0.08:  # the same id again
                rows.append((tree, i, parent, rng.randrange(3), "assistant", f"again {rng.randrange(99)}"))
    rows += [(None, 1, None, None, None, None), (None, 2, 1, 5, "assistant", "of no tree")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, top", [(1, 1), (2, 3)])
def test_random_trees(spark, seed, top):
    rows = random_messages(seed)
    assert formatted(spark, rows, top) == brute(rows, top)


def test_repeated_rows_hang_one_below_the_other(spark):
    rows = [(1, 1, None, 0, "user", "q"), (1, 1, None, 0, "user", "q"), (1, 2, 1, 0, "assistant", "a")]
    assert formatted(spark, rows, 5) == {1: [(2, [("user", "q"), ("user", "q"), ("assistant", "a")])]}


def test_long_chain_and_cycle(spark):
    rows = [(1, i, i - 1 if i else None, 1, "user" if i % 2 else "assistant", f"m{i}") for i in range(2500)]
    rows += [(2, 1, 3, 1, "user", "a"), (2, 2, 1, 1, "user", "b"), (2, 3, 2, 1, "user", "c"), (2, 4, 3, 1, "user", "below")]
    got = formatted(spark, rows, 1)
    assert set(got) == {1} and [t for _, t in got[1][0][1]] == [f"m{i}" for i in range(2500)]


def test_very_long_text(spark):
    text = "<|im_end|> long " * 200_000
    assert formatted(spark, [(1, 1, None, 0, "assistant", text)], 1) == {1: [(1, [("assistant", text)])]}
