"""Results do not depend on how scans are split, nor on the names of further columns."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strophe.llm import decontaminate, line_dedup, media, ngram_join
from tests.llm.test_line_dedup import brute_force
from tests.llm.test_queries import brute_components


@contextmanager
def more_cores(spark, make):
    """What ``make`` returns, to be read with scans that are split otherwise than while it was made."""
    before = {"spark.sql.files.openCostInBytes": "1", "spark.sql.leafNodeDefaultParallelism": "2"}
    after = {"spark.sql.files.openCostInBytes": "1", "spark.sql.leafNodeDefaultParallelism": "64"}
    for k, v in before.items():
        spark.conf.set(k, v)
    try:
        out = make()
        for k, v in after.items():
            spark.conf.set(k, v)
        yield out
    finally:
        for k in after:
            spark.conf.unset(k)


@pytest.fixture(scope="module")
def docs(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("split") / "documents")
    spark.read.parquet(f"{sf}/documents.parquet").repartition(5, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def test_the_scan_is_split_otherwise(spark, docs):
    ids = docs.select("doc_id", F.monotonically_increasing_id().alias("at"))
    with more_cores(spark, lambda: ids.collect()) as before:
        assert before != docs.select("doc_id", F.monotonically_increasing_id().alias("at")).collect()


def test_line_dedup(spark, docs):
    rows = docs.select("doc_id", "text", "source").collect()
    with more_cores(spark, lambda: line_dedup.dedup(docs)) as out:
        assert {r.doc_id: r.clean for r in out.collect()} == brute_force(rows)


def test_near_duplicates(spark, docs, tables):
    want = {d for d, _, c in brute_components([(d[0], d[1]) for d in tables["documents"]], 5, 80) if d == c}
    with more_cores(spark, lambda: ngram_join.dedup(docs)) as out:
        assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_media(spark, docs, tables):
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    with more_cores(spark, lambda: media.digests(docs)) as out:
        got = {r.doc_id: tuple(r[n] for n in names) for r in out.collect()}
    assert got == {d[0]: media.brute(d[1]) for d in tables["documents"]}


def test_rows_that_repeat(spark):
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (1, "other words of the same id", "s"), (2, "a b c d e f g", "t"), (None, "", "s"), (None, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r.doc_id, r.text) for r in ngram_join.dedup(docs).collect() if r.doc_id)
    assert kept == [(1, "a b c d e f g"), (1, "other words of the same id")]
    assert ngram_join.dedup(docs).filter("doc_id IS NULL").count() == 2
    assert media.digests(docs).count() == 6
    assert line_dedup.dedup(docs).count() == 6
    found = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.with_links(docs).collect()}
    assert (1, 3, 1, 2) in found and (2, 3, 1, 2) in found


def test_columns_of_clashing_names(spark):
    names = ["n_lines", "n_removed", "clean", "row", "rid", "_rid", "w", "hits", "_score", "_t", "_p", "key", "sig", "site", "gone", "n", "_row", "dotted.name"]
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 13), (2, "four five six", "en", "t", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    bench = spark.createDataFrame([("b", "four five six")], "item_id string, text string")
    want = sorted(tuple(r) for r in docs.collect())
    assert sorted(tuple(r) for r in ngram_join.dedup(docs).collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()) == want
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.columns == docs.columns
    assert [r.text for r in cut.orderBy("doc_id").collect()] == ["one two three", ""]
    assert cut.collect()[0]["hits"] == "own hits"
    assert [tuple(r) for r in decontaminate.remove_documents(docs, bench).collect()] == want[:1]
    assert line_dedup.dedup(docs).count() == 2


@pytest.mark.parametrize("max_broadcast", [decontaminate.MAX_BROADCAST, 0])
def test_both_ways_of_decontamination(spark, sf, tables, max_broadcast):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {tuple(r) for r in decontaminate.report(docs, bench, max_broadcast=max_broadcast).collect()}
    assert got == {tuple(r) for r in decontaminate.report(docs, bench).collect()}
    assert sum(r[5] for r in got) == 1
    text = "Keep bench0, bench1 bench2; bench short item! tail"
    one = spark.createDataFrame([(1, text), (2, "Bench short item"), (3, None)], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(one, bench, max_broadcast=max_broadcast).collect()}
    assert cut == {1: "Keep bench0, bench1 bench2! tail", 2: "", 3: None}
