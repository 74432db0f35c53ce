"""Operator 3: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts are unlabelled, not clean.
Two numpy models in a row, both with the class prior in their risk:

1. evidence per hashed word form and word beginning: the log odds that a text with
   it is toxic, prior * P(form | toxic) against the unlabelled share, shrunk to the
   prior for rare forms;
2. a logistic model of a text's three strongest words, their mean and its length,
   trained with the non-negative estimator: the risk of positives at label 1 plus
   max(0, risk of unlabelled at label 0 - prior * risk of positives at label 0).

Evidence for training rows comes from the folds they are not in. The fit looks at a
bounded sample (``max_positive``, ``max_unlabelled`` texts, the smallest by hash of
their id); scoring looks at every whole text. Without any positive text every score
is 0. Null and empty texts are scored as texts without words.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.llm.common import Bounded, parts, read

WORD = re.compile(r"[^\W_]+")
SLOTS = 1 << 18
BEGINNING = 5
LOWEST = -20.0


def forms(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def slot(word: str) -> tuple[int, int]:
    """Slots of a word and of its beginning."""
    return zlib.crc32(b"w" + word.encode()) % SLOTS, zlib.crc32(b"p" + word[:BEGINNING].encode()) % SLOTS


@dataclass
class Classifier:
    evidence: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(((features - self.mean) / self.scale) @ self.weights)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(strongest: list[float], words: int) -> list[float]:
    """Model inputs from the strongest evidence of a text, descending."""
    top = [max(x, LOWEST) for x in strongest[:3]]
    top += [LOWEST] * (3 - len(top))
    return [*top, sum(top) / 3, float(np.log1p(words)), 1.0]


def share(texts: list[np.ndarray]) -> np.ndarray:
    """Number of texts with each slot."""
    n = np.zeros(SLOTS)
    for t in texts:
        n[np.unique(t)] += 1
    return n


def evidence(positive: list, unlabelled: list, prior: float, shrink: float = 4.0) -> np.ndarray:
    toxic = prior * share(positive) / max(1, len(positive))
    every = np.maximum(share(unlabelled) / max(1, len(unlabelled)), toxic)
    k = shrink / max(1, len(unlabelled))
    return np.log((toxic + k * prior) / (every - toxic + k * (1 - prior)))


def described(texts: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    rows = []
    for t in texts:
        e = weights[t].max(axis=1) if len(t) else np.empty(0)
        rows.append(features(sorted(e[np.argsort(e)[-3:]].tolist(), reverse=True), len(t)))
    return np.array(rows).reshape(-1, 6)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, folds: int = 3, steps: int = 1000,
        rate: float = 0.05, decay: float = 1e-4) -> Classifier:
    """Each text: its (word slot, beginning slot) pairs, one row per distinct word."""
    xs = []
    for group in (positive, unlabelled):
        out = np.zeros((len(group), 6))
        for f in range(folds):
            away = evidence(*([t for i, t in enumerate(g) if i % folds != f] for g in (positive, unlabelled)), prior)
            out[f::folds] = described(group[f::folds], away)
        xs.append(out)
    mean, scale = xs[1].mean(0), xs[1].std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    p, u = ((x - mean) / scale for x in xs)
    w, m, v = np.zeros(6), np.zeros(6), np.zeros(6)
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        slope = sigmoid(zu) @ u / len(u) - prior * (sigmoid(zp) @ p) / len(p)
        g = decay * w - prior * (sigmoid(-zp) @ p) / len(p) + (slope if rest > 0 else 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Classifier(evidence(positive, unlabelled, prior), mean, scale, w)


def sample(docs: DataFrame, ids: DataFrame) -> list[np.ndarray]:
    """Slots of one text of each id of a bounded table: the smallest by hash, if an id has several."""
    rows = docs.join(F.broadcast(ids), "id").select("id", F.xxhash64("text").alias("h"), "text")
    schema = rows.select("id", "h").schema.add("pairs", "binary")

    def extract(batches):
        for batch in parts(batches):
            pairs = [np.array([slot(w) for w in sorted(forms(t))], "<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(pairs, pa.binary())], schema.names)

    found = rows.mapInArrow(extract, schema).groupBy("id").agg(F.min_by("pairs", "h").alias("pairs")).collect()
    return [np.frombuffer(r.pairs, "<i4").reshape(-1, 2) for r in sorted(found, key=lambda r: str(r.id))]


def train(docs: DataFrame, labels: DataFrame, *, max_positive: int = 4000, max_unlabelled: int = 12000) -> Classifier | None:
    """Fit on docs (id, text) and labels (id, toxic); None without positive texts.

    The prior is the share of toxic rows among the labels.
    """
    labels = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = labels.agg(F.count("*").alias("n"), F.sum(F.expr("int(toxic = 1)")).alias("toxic")).first()
    if not known.toxic:
        return None
    # An id may stand for many rows: one text of each counts.
    rank = F.xxhash64("id", F.lit("sample"))
    positive = labels.where("toxic = 1").orderBy(rank, "id").limit(max_positive).select("id")
    unlabelled = docs.where("id is not null").select("id").distinct().orderBy(rank, "id").limit(max_unlabelled)
    p, u = sample(docs, positive), sample(docs, unlabelled)
    if not p or not u:
        return None
    return fit(p, u, min(max(known.toxic / known.n, 1e-3), 0.9))


def score(docs: DataFrame, model: Classifier | None, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; a text is read whole and word by word."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    names = [c for c in docs.columns if c != out]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers, whatever the input
    at = names.index(text_col)

    def run(batches):
        m, memo = shared.value, Bounded(400_000)
        weights = m.evidence
        for batch in parts(batches, at):
            memo.trim()
            rows = []
            for text in batch.column(at).to_pylist():
                words = forms(text)
                for w in (w for w in words if w not in memo):
                    a, b = slot(w)
                    memo[w] = max(weights[a], weights[b])
                e = list(map(memo.__getitem__, words))
                rows.append(features(sorted(e, reverse=True)[:3], len(e)))
            scores = m.score(np.array(rows).reshape(-1, 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, out])

    fields = docs.select(*names).schema.add(out, "double")
    return docs.select(*names).mapInArrow(run, fields)


def learned(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """The production model: rows of two of three folds by crc32 of the id's text."""
    labels = labels.select(F.col("doc_id").alias("id"), "toxic").where(~held_out("id"))
    return train(docs.select(F.col("doc_id").alias("id"), "text"), labels)


def held_out(col: str):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


THRESHOLD = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the folds that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learned(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
