"""The label model beside gold labels: held-out figures, and what its parts do."""

import numpy as np
import pytest

from strophe.llm import common, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return common.table(spark, SF, "documents", "doc_id", "text"), common.table(spark, SF, "labels", "doc_id", "toxic")


def test_held_out_figures(spark, tables):
    docs, labels = tables
    rows = toxicity.query(spark, SF).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) >= 0.95
    assert hit / sum(r.toxic for r in rows) >= 0.9


def test_votes_count_every_row_that_is_not_held_out(spark, tables):
    docs, _ = tables
    model = toxicity.Model(lexicon={"idiot": 0, "scum": 1})
    votes = toxicity.votes_of_all(docs, model, "text", "doc_id").collect()
    rows = docs.filter(~toxicity.held_out(docs["doc_id"])).collect()
    assert sum(r.n for r in votes) == len(rows)
    both = sum(1 for r in rows if {"idiot", "scum"} <= set(toxicity._WORD.findall((r.text or "").lower())))
    assert sum(r.n for r in votes if {0, 1} <= set(r.votes)) == both


def test_a_row_counts_by_its_label_or_by_its_votes(spark, tables):
    docs, labels = tables
    known = toxicity.known_labels(labels)
    train = toxicity.training_rows(docs, known)
    others = toxicity.votes_of_all(docs, toxicity.Model(lexicon={"idiot": 0}), "text", "doc_id", known).collect()
    assert train.count() > 1000
    assert sum(r.n for r in others) + train.count() == docs.filter(~toxicity.held_out(docs["doc_id"])).count()


def test_rates_are_found_without_a_rows_own_label(spark):
    """Votes drawn from known rates, a tenth of the rows labelled: the rates and the posterior come out."""
    rng = np.random.default_rng(3)
    n, on, off = 20_000, np.array([0.6, 0.5, 0.4, 0.3]), np.array([0.01, 0.02, 0.05, 0.2])
    y = rng.random(n) < 0.1
    fired = rng.random((n, 4)) < np.where(y[:, None], on, off)
    votes = spark.createDataFrame([([int(v) for v in np.flatnonzero(f)], 1) for f in fired[2000:]], "votes array<int>, n long").groupBy("votes").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    rates = toxicity.label_model(fired[:2000], y[:2000].astype(float), 1.0 - y[:2000], votes)
    assert np.allclose(rates.on, on, atol=0.05) and np.allclose(rates.off, off, atol=0.02) and abs(rates.prior - 0.1) < 0.02
    assert np.allclose(rates.share, 1)
    assert ((rates.posterior(fired) > 0.5) == y).mean() > 0.94


def test_copies_of_a_voter_share_their_evidence():
    rng = np.random.default_rng(4)
    y = (rng.random(4000) < 0.2).astype(float)
    one = rng.random(4000) < np.where(y > 0, 0.6, 0.05)
    fired = np.stack([one, one, one, rng.random(4000) < np.where(y > 0, 0.4, 0.05)], 1)
    start = toxicity._rates(y @ fired, (1 - y) @ fired, y.sum(), (1 - y).sum(), np.ones(4))
    assert toxicity.shared_evidence(fired, y, 1 - y, start) == pytest.approx([1 / 3, 1 / 3, 1 / 3, 1], rel=0.01)
