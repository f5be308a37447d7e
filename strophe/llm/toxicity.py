"""Toxicity by weak supervision.

Voters are mined from labelled training rows: words that are commoner in toxic documents by a likelihood ratio test
whose bar rises with the number of words tried (the ``MAX_VOTERS`` of the highest statistic), their common beginnings
as patterns, and patterns of the text as a whole. A generative label model has for each voter the rates at which it
fires on either class. The labels start it and anchor it: in each step of EM the rates are estimated from the training
rows by their labels and from all other rows of the corpus that are not held out by the posterior of their votes. Pairs
of voters that fire together more than their class explains (correlation over ``CORRELATED`` within the classes) share
their evidence out. The posteriors of the training rows' votes, in which no row's own label stands, train a linear
classifier (logistic regression) over the voters, which scores every text.

Voters are tested, and the classifier is fitted, on at most ``MAX_LABELLED`` labelled rows, chosen by a hash of doc_id
when there are more; the bound makes the label table broadcastable and the vote matrix fit the driver. The label model's
rates are summed over all rows (equal votes are one row with a count) and only a row for each voter comes to the driver.
Scoring is one pass over all texts without a shuffle.

Defined results: null and empty texts cast no votes and get the classifier's base score; documents without a label are
scored like all others; several labels of one document count as toxic if any is; without labels of both classes every
score is the smoothed share of toxic labels (0 but for a billionth without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import discard, only, stored, table

#: Labelled rows used for fitting, at most.
MAX_LABELLED = 40_000
#: Lexicon voters, at most.
MAX_VOTERS = 400
#: Toxic training rows that must hold a word before it is tried.
MIN_SUPPORT = 3
THRESHOLD = 0.3
PREFIX = 5
#: Correlation within the classes from which voters share their evidence, and EM's steps and end.
CORRELATED = 0.5
STEPS, STILL = 6, 1e-3

_WORD = re.compile(r"[^\W\d_]+")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
#: Voters over the whole text, after the lexicon voters; those after them are made of the others, so only the classifier
#: has them.
PATTERNS = ("shouting", "repetition")
DERIVED = ("any lexicon word", "several lexicon words", "many lexicon words", "no lexicon word")


@dataclass
class Model:
    """Voters with their weights; ``bias`` alone scores a text without votes."""

    bias: float = -6.0
    lexicon: dict[str, int] = field(default_factory=dict)
    prefixes: dict[str, int] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)

    def votes(self, text: str | None) -> list[int]:
        """Indices of the voters that fire; DERIVED come last."""
        text = text or ""
        words = _WORD.findall(text.lower())
        distinct = set(words)
        lex = self.lexicon
        hits = [lex[w] for w in distinct & lex.keys()]
        out = list(hits)
        if self.prefixes:
            out += {self.prefixes[w[:PREFIX]] for w in distinct if len(w) > PREFIX and w[:PREFIX] in self.prefixes}
        base = len(lex) + len(self.prefixes)
        count = sum(1 for w in words if w in lex) if hits else 0
        flags = (2 * sum(map(len, _CAPITALS.findall(text))) > len(text), len(words) > 20 and 4 * len(distinct) < len(words), len(hits) > 0, len(hits) > 1, count > 3, not hits)
        return out + [base + i for i, f in enumerate(flags) if f]

    @property
    def voters(self) -> int:
        return len(self.lexicon) + len(self.prefixes) + len(PATTERNS)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[i] for i in self.votes(text)) if self.weights else self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``n`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def held_out(doc: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(4)) == 2


def known_labels(labels: DataFrame, doc: str = "doc_id", max_rows: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxic) of at most about ``max_rows`` labelled documents that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col(doc).isNotNull()).filter(~held_out(F.col(doc)))
    known = known.groupBy(F.col(doc).alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > max_rows:
        share = int(max_rows / n * (1 << 20))
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    return known


def training_rows(docs: DataFrame, known: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(text, toxic) of the documents in ``known_labels``, which are few enough to be broadcast."""
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")


def _g2(a: Column, b: Column, pos: int, neg: int) -> Column:
    """Likelihood ratio statistic of a word in a of pos and b of neg rows."""

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    share = (a + b) / F.lit(float(pos + neg))
    return 2 * (term(a, share * pos) + term(b, share * neg) + term(F.lit(pos) - a, (1 - share) * pos) + term(F.lit(neg) - b, (1 - share) * neg))


def mine(train: DataFrame, pos: int, neg: int) -> list[str]:
    """Words that speak for toxicity: counted over the training rows in Spark, tested on the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for part in _slices(batches, 200):
            sets = [sorted(set(_WORD.findall((t or "").lower()))) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.string())), part.column("toxic")], ["words", "toxic"])

    counts = (
        train.mapInArrow(words, "words array<string>, toxic int")
        .select(F.explode("words").alias("word"), "toxic")
        .groupBy("word")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .filter(F.col("a") >= MIN_SUPPORT)
    )
    counts = stored(counts, "word-counts")
    bar = 2 * math.log(max(counts.count(), 2))
    a, b = F.col("a"), F.col("b")
    speaks = counts.withColumn("g", _g2(a, b, pos, neg)).filter((a * neg > b * pos) & (F.col("g") >= bar))
    found = [r["word"] for r in speaks.orderBy(F.desc("g"), "word").limit(MAX_VOTERS).collect()]
    discard(counts)
    return found


def vote_rows(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct votes of the training rows (a row of flags each), with how many toxic and how many other rows cast them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for part in _slices(batches, 1000):
            votes = [sorted(model.votes(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.int32())), part.column("toxic")], ["votes", "toxic"])

    cast = train.mapInArrow(run, "votes array<int>, toxic int").groupBy("votes").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    rows = cast.orderBy("votes").collect()  # at most MAX_LABELLED
    fired = np.zeros((len(rows), model.voters + len(DERIVED)), bool)
    for i, r in enumerate(rows):
        fired[i, r["votes"]] = True
    return fired, np.array([r["a"] for r in rows], float), np.array([r["b"] for r in rows], float)


@dataclass
class LabelModel:
    """Rates of the voters on toxic and other rows, the share of toxic rows, and each voter's share of its evidence."""

    on: np.ndarray
    off: np.ndarray
    prior: float
    share: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Probability of the toxic class from a matrix of votes."""
        x = fired.astype(np.float32)
        yes, no = self.share * np.log(self.on / self.off), self.share * np.log((1 - self.on) / (1 - self.off))
        z = math.log(self.prior / (1 - self.prior)) + x @ yes + (1 - x) @ no
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rates(fired_on: np.ndarray, fired_off: np.ndarray, p: float, q: float, share: np.ndarray) -> LabelModel:
    """Smoothed rates from how often voters fired on p toxic and q other rows."""
    mean = (fired_on + fired_off) / (p + q)
    on, off = ((f + 0.5 * mean) / (n + 0.5) for f, n in ((fired_on, p), (fired_off, q)))
    return LabelModel(np.clip(on, 1e-5, 1 - 1e-5), np.clip(off, 1e-5, 1 - 1e-5), min(max(p / (p + q), 1e-4), 1 - 1e-4), share)


def shared_evidence(fired: np.ndarray, a: np.ndarray, b: np.ndarray, start: LabelModel) -> np.ndarray:
    """One over the sum of a voter's correlations within the classes, its own included; ``a`` toxic and ``b`` other rows
    cast the votes of each row of ``fired``."""
    together = np.zeros((fired.shape[1], fired.shape[1]))
    for rates, n in ((start.on, a), (start.off, b)):
        rest = fired - rates
        together += (rest * n[:, None]).T @ rest
    scale = np.sqrt(np.diag(together)) + 1e-6
    rho = np.abs(together / scale / scale[:, None])
    return 1 / np.clip(np.where(rho > CORRELATED, rho, 0).sum(0), 1, None)


def votes_of_all(docs: DataFrame, model: Model, text: str, doc: str, known: DataFrame | None = None) -> DataFrame:
    """(votes, n) of all rows that are not held out and not in ``known_labels``: equal votes are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for part in _slices(batches, 1000):
            seen = Counter(tuple(sorted(v for v in model.votes(t) if v < model.voters)) for t in part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    rows = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    if known is not None:
        rows = rows.join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti")
    return stored(rows.select("text").mapInArrow(run, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")), "votes")


def _expected(votes: DataFrame, rates: LabelModel, m: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """How often each voter fired on toxic and on other rows by the posteriors, and how many rows these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        on, off = np.zeros(m + 1), np.zeros(m + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                fired = np.zeros((part.num_rows, m + 1), bool)
                fired[:, m] = True  # counts the rows
                for i, v in enumerate(part.column("votes").to_pylist()):
                    fired[i, v] = True
                n = part.column("n").to_numpy(zero_copy_only=False)
                post = rates.posterior(fired[:, :m])
                on += (post * n) @ fired
                off += ((1 - post) * n) @ fired
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m + 1), pa.int32()), pa.array(on), pa.array(off)], ["voter", "on", "off"])

    sums = votes.mapInArrow(run, "voter int, on double, off double").groupBy("voter").agg(F.sum("on").alias("on"), F.sum("off").alias("off")).collect()
    out = np.zeros((2, m + 1))
    for r in sums:
        out[:, r["voter"]] = r["on"], r["off"]
    return out[0, :m], out[1, :m], out[0, m], out[1, m]


def label_model(fired: np.ndarray, a: np.ndarray, b: np.ndarray, votes: DataFrame) -> LabelModel:
    """EM over the labelled rows (votes ``fired`` of ``a`` toxic and ``b`` other rows) and all others (``votes_of_all``)."""
    m = fired.shape[1]
    known = (a @ fired, b @ fired, a.sum(), b.sum())
    rates = _rates(*known, np.ones(m))
    rates.share = shared_evidence(fired, a, b, rates)
    for _ in range(STEPS):
        new = _rates(*(k + e for k, e in zip(known, _expected(votes, rates, m), strict=True)), rates.share)
        still = max(np.abs(new.on - rates.on).max(), np.abs(new.off - rates.off).max()) < STILL
        rates = new
        if still:
            break
    return rates


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, l2: float = 1.0, steps: int = 30) -> tuple[float, np.ndarray]:
    """Regularised logistic regression on soft labels ``y`` of rows that count ``n`` times, by Newton steps."""
    xb = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(xb.shape[1])
    penalty = np.full(len(w), l2)
    penalty[0] = 1e-3
    for _ in range(steps):
        z = np.clip(xb @ w, -30, 30)
        p = 1 / (1 + np.exp(-z))
        grad = xb.T @ (n * (p - y)) + penalty * w
        hess = (xb * (n * (p * (1 - p) + 1e-6))[:, None]).T @ xb + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", max_rows: int = MAX_LABELLED) -> Model:
    known = known_labels(labels, doc, max_rows)
    train = stored(training_rows(docs, known, text, doc), "toxic-train")
    seen = {r["toxic"]: r["n"] for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    train_ = train.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    pos, neg = seen.get(1, 0), seen.get(0, 0)
    if not pos or not neg:
        share = (pos + 0.5) / (pos + neg + 1) if pos + neg else 0.0
        return Model(bias=math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    lexicon = mine(train_, pos, neg)
    heads = Counter(w[:PREFIX] for w in lexicon if len(w) > PREFIX)
    prefixes = sorted(h for h, k in heads.items() if k > 2)
    model = Model(lexicon={w: i for i, w in enumerate(lexicon)}, prefixes={h: len(lexicon) + i for i, h in enumerate(prefixes)})
    fired, a, b = vote_rows(train_, model)
    votes = votes_of_all(docs, model, text, doc, known)
    rates = label_model(fired[:, : model.voters], a, b, votes)
    bias, weights = logistic(fired, rates.posterior(fired[:, : model.voters]), a + b)
    model.bias, model.weights = bias, weights.tolist()
    discard(train, votes)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each text."""
    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in docs.schema.fields if f.name != out], T.StructField(out, T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for part in _slices(batches, 1000):
            scores = pa.array([model.score(t) for t in part.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [scores], [*names, out])

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, unchanged."""
    name = "_score"
    while name in docs.columns:
        name = f"_{name}"
    return score(docs, fit(docs, labels, text), text, name).filter(F.col(name) < THRESHOLD).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
