"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another. The model of a category sees the
features of the text and the probabilities of the categories before it. For
training these are out-of-fold: the rows of a fold get theirs from models that were
fitted without that fold, so a later model learns how far an earlier one can be
trusted on new text.

Features are the words of a text and their first letters, so that a stem counts in
whatever form it comes. Those that tell the labels apart best are chosen first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterledger.llm.texts import chunks

#: Labelled rows that are used at most: those with the smallest hash of their id.
LABELLED_ROWS = 8_000
FEATURES = 3_000
#: Least chi-square of a feature with the label; by chance one in ten thousand has it.
LEAST_CHI_SQUARE = 15.0
FOLDS = 5
PREFIXES = (4, 5, 6)

# English words of two kinds of insult, from which the first two categories are marked on
# rows that are labelled toxic. Fixed values.
PERSON_WORDS = ("idiot", "moron", "stupid", "clown", "loser", "fool", "dumb")
WORTH_WORDS = ("worthless", "trash", "scum", "pathetic", "disgusting", "garbage", "filth")
CATEGORIES = ("person", "worth", "toxic")

_WORD = re.compile(r"\w+")


def features_of(text: str) -> set[str]:
    """Distinct lower-cased words, and their beginnings marked with a hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in PREFIXES if len(w) >= n}


class Linear(NamedTuple):
    """Weights of the chosen features, of the earlier probabilities, and the constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float


class Rows:
    """Sparse rows: the positions of the features that each has."""

    def __init__(self, rows: list[np.ndarray]):
        self.count = len(rows)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.at = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.at], minlength=self.count)


def logistic(rows: Rows, earlier: np.ndarray, labels: np.ndarray, used: np.ndarray, size: int, steps: int = 200, penalty: float = 1e-6) -> Linear:
    """Penalised logistic regression on the used rows, by scaled gradient steps.

    Rare labels weigh more: by the root of their odds, at most tenfold.
    """
    positive = max(float((used * labels).sum()), 1.0)
    used = used * np.where(labels > 0, min(10.0, max(1.0, used.sum() / positive - 1) ** 0.5), 1.0)
    weights, before, constant = np.zeros(size), np.zeros(earlier.shape[1]), -1.0
    sums, sums_before, sum_constant = np.full(size, 1e-8), np.full(len(before), 1e-8), 1e-8
    number = max(int(used.sum()), 1)
    for _ in range(steps):
        off = used * (probability(rows.dot(weights) + earlier @ before + constant) - labels)
        grad = np.bincount(rows.at, weights=off[rows.row], minlength=size) / number + penalty * weights
        grad_before = earlier.T @ off / number + penalty * before
        grad_constant = off.sum() / number
        sums += grad**2
        sums_before += grad_before**2
        sum_constant += grad_constant**2
        weights -= 0.5 * grad / np.sqrt(sums)
        before -= 0.5 * grad_before / np.sqrt(sums_before)
        constant -= 0.5 * grad_constant / np.sqrt(sum_constant)
    return Linear(weights, before, float(constant))


def probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


class ChainModel:
    """Chosen features and one linear model for each category, in order."""

    def __init__(self, names: list[str], models: list[Linear]):
        self.names, self.models = names, models
        self.place = {name: i for i, name in enumerate(names)}

    def rows(self, texts: list[str]) -> Rows:
        """Positions of the chosen features of each text."""
        place = self.place
        out = []
        for text in texts:
            found = set()
            for word in set(_WORD.findall(text.lower())):
                for name in (word, *(word[:n] + "-" for n in PREFIXES if len(word) >= n)):
                    if name in place:
                        found.add(place[name])
            out.append(np.fromiter(sorted(found), np.int64, len(found)))
        return Rows(out)

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities (texts, categories); each category sees those before it."""
        rows = self.rows(texts)
        out = np.zeros((rows.count, len(self.models)))
        for j, model in enumerate(self.models):
            out[:, j] = probability(rows.dot(model.weights) + out[:, :j] @ model.earlier + model.constant)
        return out


def category_labels(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Labels of the categories: the first two are a labelled row that has such a word."""
    words = [set(_WORD.findall(t.lower())) for t in texts]
    marked = [np.array([bool(w & set(kind)) for w in words], bool) & (toxic > 0) for kind in (PERSON_WORDS, WORTH_WORDS)]
    return np.column_stack([*marked, toxic > 0]).astype(float)


def chosen_features(texts: list[str], toxic: np.ndarray, count: int) -> list[str]:
    """Features that at least three labelled rows have, by their chi-square with the label, if it is large enough."""
    have, have_toxic = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        found = features_of(text)
        have.update(found)
        if label:
            have_toxic.update(found)
    total, positive = len(texts), float((toxic > 0).sum())
    share = positive / max(total, 1)

    def weight(name: str) -> float:
        n = have[name]
        expected = n * share
        return (have_toxic[name] - expected) ** 2 / max(expected * (1 - share), 1e-9) * (1 - n / (total + 1))

    weights = {n: w for n, k in have.items() if k >= 3 and (w := weight(n)) >= LEAST_CHI_SQUARE}
    return sorted(weights, key=lambda n: (-weights[n], n))[:count]


def fitted(ids: list[int], texts: list[str], toxic: np.ndarray, count: int = FEATURES, folds: int = FOLDS) -> ChainModel:
    """Fit the chain; ``ids`` deal the rows to the folds."""
    names = chosen_features(texts, toxic, count)
    model = ChainModel(names, [])
    rows = model.rows(texts)
    labels = category_labels(texts, toxic)
    fold = np.array([(i * 2654435761 >> 7) % folds for i in ids], np.int64)
    earlier = np.zeros((len(texts), 0))
    models = []
    everything = np.ones(len(texts))
    for j in range(labels.shape[1]):
        outside = np.zeros(len(texts))
        for k in range(folds):
            part = logistic(rows, earlier, labels[:, j], (fold != k).astype(float), len(names))
            score = rows.dot(part.weights) + earlier @ part.earlier + part.constant
            outside[fold == k] = probability(score)[fold == k]
        models.append(logistic(rows, earlier, labels[:, j], everything, len(names)))
        earlier = np.column_stack([earlier, outside])
    return ChainModel(names, models)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> tuple[list[int], list[str], np.ndarray]:
    """At most ``limit`` labelled rows with text, those with the smallest hash of their id."""
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = chosen.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").toArrow()
    found = found.sort_by("doc_id")
    return found["doc_id"].to_pylist(), found["text"].to_pylist(), found["toxic"].to_numpy().astype(float)


def scored(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per document: (doc_id, p_person, p_worth, p_toxic, toxic).

    The chain is fitted on the driver to at most ``limit`` labelled rows and applied to every
    whole text; null and empty texts have no features and get the constants' probabilities.
    Without labelled rows every probability is the same and nothing is toxic. Repeated rows
    are scored each; other columns are left out; an empty table gives an empty one.
    """
    model = fitted(*labelled_sample(docs, labels, limit))
    columns = [f"p_{name}" for name in CATEGORIES]
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = ChainModel(*sent.value)
        for batch, texts in chunks(batches, "_text"):
            found = chain.predict([texts.one(i).decode("utf-8") for i in range(len(texts))])
            arrays = [batch.column("doc_id"), *(pa.array(found[:, j]) for j in range(len(columns))), pa.array(found[:, -1] >= threshold)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns, "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in columns) + ", toxic boolean")
