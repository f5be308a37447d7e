import random

import pytest

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id string, text string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def documents():
    """Copies, near copies, shared lines, benchmark passages, toxic words, nulls, empty, blank and very long texts."""
    rng, texts = random.Random(7), []
    base = words(rng, 120)
    near = base.copy()
    near[60] = "changed"
    texts += [" ".join(base)] * 6 + [" ".join(near)] + [" ".join(near[:40] + ["Other"] + near[41:])]
    texts += [None, "", " \t\n", "one", "ONE", "two words", "Two Words", " ".join(words(rng, 30_000, 5000))]
    passage = BENCHMARK[0][1].split()
    texts += [" ".join(words(rng, 20) + passage[:20] + words(rng, 20)), " ".join(words(rng, 900) + passage[:14])]
    texts += [" ".join(words(rng, 40)) + "\nthis line stands on many sites\n" + " ".join(words(rng, 30)) for _ in range(12)]
    for i in range(160):
        texts.append(" ".join(words(rng, 40) + (["vile", "scum"] if i % 4 == 0 else [])))
    return [(i, t, "en", f"site{i % 9}" if i % 11 else None, None if t is None else len(t)) for i, t in enumerate(texts)]


BENCHMARK = [("b1", " ".join(f"bench{i}" for i in range(30))), ("b2", "bench short item"), ("b3", None), ("b4", "")]


@pytest.fixture(scope="session")
def tables():
    docs = documents()
    labels = [(i, 1, int("scum" in t)) for i, t, *_ in docs if t and i % 5]
    pages = [(1, "u", "<nav>menu</nav><article><p>Fish &amp; chips,  are\ngood to eat, says the cook.</p><p>Second one.</p></article><footer>foot</footer>"), (2, "v", None), (3, None, "")]
    talks = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|> b"), (2, 0, "user", None), (2, 1, "assistant", None)]
    return {"documents": docs, "labels": labels, "benchmark": BENCHMARK, "pages": pages, "conversations": talks}


def write(spark, where, tables):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables.get(name, []), schema).write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.fixture(scope="session")
def sf(spark, tables, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("full"), tables)


@pytest.fixture(scope="session")
def empty_sf(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})
