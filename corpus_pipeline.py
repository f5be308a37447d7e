"""Corpus pipeline over ``documents``: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result to the shared folder and rereads it, so a lost executor costs one stage.

* toxicity: documents predicted toxic go; all others stay as they are.
* line_dedup: repeated cross-site lines go from the texts (``n_chars`` follows); documents that consisted of nothing
  else go, too, as their lines stay elsewhere; documents that had no words before stay.
* near_dedup: of each component of near duplicates (five-word shingles, similarity 0.8) the lowest doc_id stays.
* decontamination: documents of which a twentieth or more lies in benchmark windows go.
* packing: the pieces of all remaining documents with their places in sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import common, decontaminate, line_dedup, ngram_join, packing, toxicity

#: Rows of a batch sent to Python. Texts are long and one executor runs all stages: what a large batch took stays in the
#: pools of its JVM for the stages after.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_batches(stage: Stage) -> Stage:
    """What a stage runs before it returns, in small batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.session_conf(spark, BATCH):
            return stage(spark, docs, sf_dir)

    return run_stage


@in_batches
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = F.col("n_removed") > 0
    kept = line_dedup.cut(docs).filter(~F.coalesce(changed & (F.trim("clean") == ""), F.lit(False)))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


@in_batches
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"))


@in_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The label model, the components and the packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        with common.scratch(spark) as made:  # a stage's tables go when its result is there, and so does the stage before
            with common.session_conf(spark, BATCH):
                out = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(out._strophe_path)
        common.discard(docs)
        docs = out
    return docs
