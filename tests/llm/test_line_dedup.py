from collections import defaultdict

import pytest

import corpus_pipeline
from strophe.llm import line_dedup

SHORT = ["Les.", "And ornd.", "版权所有", "a b c"]


@pytest.fixture(scope="module")
def docs(spark):
    """Lines of one to three words and of a script without spaces on six sites, a lone short line, blanks."""
    rows = [(i, "\n".join([f"body of text number {i}", SHORT[i % 4], "", f" {SHORT[(i + 1) % 4]}\t", SHORT[(i + 2) % 4], "own" if i == 3 else ""]), f"s{i % 6}") for i in range(24)]
    rows += [(24, "Les.", None), (25, None, "s0"), (26, "", "s1"), (27, " ", "s2")]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def brute_force(rows):
    sites, seen, out = defaultdict(set), set(), {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            sites[line.strip()].add(r.source)
    for r in sorted(rows):
        kept = []
        for line in (r.text or "").split("\n"):
            key = line.strip()
            if not key or len(sites[key]) < line_dedup.MIN_SITES or key not in seen:
                kept.append(line)
            seen.add(key)
        out[r.doc_id] = None if r.text is None else "\n".join(kept)
    return out


def test_lines_of_any_length_go(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    got = {r.doc_id: r.clean for r in line_dedup.dedup(docs).collect()}
    assert got == brute_force(rows)
    assert all(sum((t or "").split("\n").count(s) for t in got.values()) <= 1 for s in SHORT)


def test_stage_drops_a_document_of_short_lines(spark, docs):
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert set(range(28)) - set(kept) == {24}
    assert sum("Les." in (t or "") for t in kept.values()) == 1
