"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of a bias and the weights of its
distinct words, each told by itself and by its first four and five letters (which stand for inflected
forms); the document's is their noisy-or, 1 - prod(1 - s). Only document labels are needed:
the gradient of the document likelihood tells each sentence its share. Weights are not negative, so a
word can only be evidence for toxicity; small ones are dropped and the rest fitted again, which leaves
a short exact word list and no hash collisions. The same sentence scores then locate what offends.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Known, fold, labelled_sample, slices

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class MilModel:
    bias: float
    weights: dict[str, float]


def _features(word: str) -> tuple[str, ...]:
    return (word, f"^{word[:4]}", f"^{word[:5]}") if len(word) > 5 else (word,)


def word_weights(weights: dict[str, float], limit: int = 1_000_000) -> Known:
    """Weight of each word, from those of its features."""
    return Known(lambda word: sum(weights.get(f, 0.0) for f in _features(word)), limit)


def gradients(words: np.ndarray, starts: np.ndarray, bag: np.ndarray, y: np.ndarray, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
    """Mean noisy-or log-likelihood of document labels, and its gradients by word weights and bias."""
    lengths = np.diff(np.concatenate([starts, [len(words)]]))
    full = lengths > 0
    z = np.full(len(starts), bias)
    z[full] += np.add.reduceat(weights[words], starts[full]) if full.any() else 0
    s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    quiet = np.bincount(bag, np.log1p(-np.minimum(s, 1 - 1e-12)), len(y))
    none = np.exp(quiet)  # no sentence offends
    share = np.where(y == 1, none / np.maximum(1 - none, 1e-12), -1.0)
    g = s * share[bag]
    told = np.where(y == 1, np.log(np.maximum(1 - none, 1e-12)), quiet).mean()
    return float(told), np.bincount(words, np.repeat(g, lengths), len(weights)) / len(y), float(g.sum() / len(y))


def _fit(words: np.ndarray, starts: np.ndarray, bag: np.ndarray, y: np.ndarray, weights: np.ndarray, bias: float, steps: int, rate: float, penalty: float):
    """Gradient ascent on the noisy-or likelihood. words: of all sentences; starts: each sentence's first."""
    moments = [np.zeros(len(weights)), np.zeros(len(weights)), 0.0, 0.0]
    for step in range(1, steps + 1):
        _, grad, grad_bias = gradients(words, starts, bag, y, weights, bias)
        grad = grad - penalty
        m = moments
        m[0] += 0.1 * (grad - m[0])
        m[1] += 0.01 * (grad**2 - m[1])
        m[2] += 0.1 * (grad_bias - m[2])
        m[3] += 0.01 * (grad_bias**2 - m[3])
        weights = np.maximum(0, weights + rate * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7))
        bias += rate * m[2] / (1 - 0.9**step) / (np.sqrt(m[3] / (1 - 0.99**step)) + 1e-7)
    return weights, bias


def train(texts: list[str], y: np.ndarray, min_docs: int = 5, vocabulary: int = 60_000, keep: float = 1.0) -> MilModel:
    """Fit to texts and their labels. Words of fewer than ``min_docs`` texts and beyond the ``vocabulary``
    most frequent are left out; weights below ``keep`` are dropped before the final fit."""
    if not len(texts) or y.min() == y.max():
        return MilModel(-12.0 if not len(texts) or y.min() == 0 else 12.0, {})
    found = Counter()
    sentences = [[_WORD.findall(s) for s in _SENTENCE.findall(t.lower())] for t in texts]
    for doc in sentences:
        found.update({f for w in {w for s in doc for w in s} for f in _features(w)})
    names = [w for w, n in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:vocabulary] if n >= min_docs]

    def packed(names: list[str]):
        index = {w: i for i, w in enumerate(names)}
        words, starts, bag = [], [], []
        for d, doc in enumerate(sentences):
            for s in doc:
                starts.append(len(words))
                bag.append(d)
                words.extend(index[f] for w in dict.fromkeys(s) for f in _features(w) if f in index)
        return np.array(words, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(bag, dtype=np.int64)

    weights, bias = _fit(*packed(names), y, np.full(len(names), 0.1), -7.0, 120, 0.15, 2e-5)
    strong = [i for i in np.argsort(-weights, kind="stable").tolist() if weights[i] >= keep]
    names = [names[i] for i in strong]
    weights, bias = _fit(*packed(names), y, weights[strong], bias, 150, 0.1, 2e-5)
    return MilModel(float(bias), {w: float(x) for w, x in zip(names, weights) if x > 0})


def sentence_scores(text: str, bias: float, weights: Known) -> list[tuple[int, int, float]]:
    """(start, end, score) of every sentence."""
    weight = weights.__getitem__
    return [(*m.span(), 1 / (1 + math.exp(-min(40.0, bias + sum(map(weight, set(_WORD.findall(m.group().lower())))))))) for m in _SENTENCE.finditer(text)]


def scored(text: str, bias: float, weights: Known) -> tuple[float, str]:
    """Document score and offending sentences (score 0.5 or more) as start:end, comma-joined."""
    if not any(map(weights.__getitem__, _WORD.findall(text.lower()))):
        # No word has a weight: every sentence has the bias alone.
        quiet = 1 / (1 + math.exp(-bias))
        at = "" if quiet < 0.5 else ",".join(f"{m.start()}:{m.end()}" for m in _SENTENCE.finditer(text))
        return -math.expm1(len(_SENTENCE.findall(text)) * math.log1p(-min(quiet, 1 - 1e-12))), at
    scores = sentence_scores(text, bias, weights)
    none = sum(math.log1p(-min(s, 1 - 1e-12)) for _, _, s in scores)
    return -math.expm1(none), ",".join(f"{a}:{b}" for a, b, s in scores if s >= 0.5)


def score(docs: DataFrame, model: MilModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and offending (start:end of sentences, code points, comma-joined) of every row.

    A null or empty text has no sentence and scores 0. Null and repeated ids keep their rows; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = word_weights(model.weights)
        for batch in slices(batches):
            got = [scored(t or "", model.bias, weights) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array([g[0] for g in got], pa.float64()), "offending": pa.array([g[1] for g in got], pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, offending string")


def learnt(docs: DataFrame, labels: DataFrame, sample_rows: int = 5000, sample_chars: int = 20_000) -> MilModel:
    """A model from a bounded sample: at most ``sample_rows`` labelled documents of at most
    ``sample_chars`` characters outside the held-out fold."""
    rows = labelled_sample(docs, labels, "toxic", sample_rows, sample_chars).select("text", "label").collect()
    return train([r[0] for r in rows], np.array([int(r[1] != 0) for r in rows]))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learnt(docs, labels)).select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
