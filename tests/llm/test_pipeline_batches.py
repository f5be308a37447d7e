"""The pipeline's stages send texts to Python in small batches and leave the session as it was."""

import pytest

import corpus_pipeline as pipeline

SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch"
OPERATORS = {"toxicity": (pipeline.toxicity, "keep_clean"), "near_dedup": (pipeline.ngram_join, "dedup"), "packing": (pipeline.packing, "pack_documents")}


@pytest.mark.parametrize("name", OPERATORS)
def test_batches_of_a_stage(spark, monkeypatch, name):
    seen, before = [], spark.conf.get(SIZE)
    module, operator = OPERATORS[name]
    own = getattr(module, operator)

    def watched(docs, *args):
        seen.append(int(spark.conf.get(SIZE)))
        return own(docs, *args)

    monkeypatch.setattr(module, operator, watched)
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert dict(pipeline.STAGES)[name](spark, docs, sf_dir).columns
    assert seen and max(seen) <= 1000 and spark.conf.get(SIZE) == before
