"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with chance p = sigmoid(b + the weights of what its words show: each
word, and each word's first 3 to 6 letters), a document if any sentence is: 1 - product of (1 - p), the noisy-or.
Weights are fitted to document labels alone, by gradient steps on the likelihood of that noisy-or; the model then names
the sentences at fault. The fit uses at most ROWS labelled documents of each label (whole texts of at most
labelled.BYTES together), and of their features the FEATURES whose share of documents differs most between the labels, if
at least LEAST_DOCS of the sample have one and the difference is over LEAST_Z standard errors; it stops when the
likelihood hardly rises, after STEPS at most. Scoring reads whole texts, once, where they are.

Defined results: null and empty texts, and texts without letters, have no sentence and score 0. If the labels have one
class only (or none), every text scores the share of label 1 (or 0). Repeated rows get a row
each; only doc_id and text are read, whatever the other columns are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import documents, held_out, ship, text_or_empty
from pairloom.llm.labelled import labelled_sample

#: Labelled documents of each label that the model is fitted on.
ROWS = 2000
FEATURES = 4000
LEAST_DOCS = 5
LEAST_Z = 5.0
STEPS = 300
#: The fit stops when 10 steps raise the mean log-likelihood by less.
RISE = 2e-5
#: Different words that a process remembers the weight of.
MEMO = 500_000

_words = re.compile(r"[^\W\d_]+").findall
_sentence = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in range(3, 7) if len(word) >= k)]


def _select(bags: list[list[set[str]]], y: np.ndarray, most: int) -> dict[str, int]:
    """The features whose share of documents differs most between the labels, in standard errors of over LEAST_Z."""
    seen = (Counter(), Counter())
    for sentences, label in zip(bags, y, strict=True):
        seen[int(label)].update({f for w in set().union(*sentences) for f in word_features(w)} if sentences else ())
    n1 = float(y.sum())
    n0 = len(y) - n1
    scored = []
    for f in seen[0].keys() | seen[1].keys():
        a, b = seen[1][f], seen[0][f]
        if a + b < LEAST_DOCS:
            continue
        share = (a + b) / len(y)
        error = math.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) or 1.0
        if abs(z := (a / n1 - b / n0) / error) > LEAST_Z:
            scored.append((-abs(z), f))
    return {f: i for i, (_, f) in enumerate(sorted(scored)[:most])}


def fit(sample: list[tuple[str, int, float]], most: int = FEATURES, steps: int = STEPS) -> dict:
    """bias, weights by feature, and the share of label 1."""
    y = np.array([label for _, label, _ in sample], dtype=float)
    weight = np.array([w for _, _, w in sample])
    if not len(y) or y.min() == y.max():
        return {"bias": None, "weights": {}, "share": float(np.average(y, weights=weight)) if len(y) else 0.0}
    bags = [[set(w) for m in _sentence.finditer(text.lower()) if (w := _words(m[0]))] for text, _, _ in sample]
    index = _select(bags, y, most)
    plain = np.zeros(len(y))  # sentences without a feature
    at, feature, owner = [], [], []
    for doc, sentences in enumerate(bags):
        for words in sentences:
            own = {index[f] for w in words for f in word_features(w) if f in index}
            if own:
                at.extend([len(owner)] * len(own))
                feature.extend(own)
                owner.append(doc)
            else:
                plain[doc] += 1
    at, feature, owner = (np.array(x, dtype="int64") for x in (at, feature, owner))
    theta, m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    theta[-1] = -6.0
    likelihoods = []
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(at, theta[feature], len(owner))
        p, rest = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-theta[-1]))
        log_none = np.bincount(owner, -np.logaddexp(0, z), len(y)) - plain * math.log1p(math.exp(theta[-1]))
        none = np.exp(log_none)
        likelihoods.append(float(np.average(np.where(y == 1, np.log(np.maximum(1 - none, 1e-6)), log_none), weights=weight)))
        if step > 60 and likelihoods[-1] - likelihoods[-11] < RISE:
            break
        # The likelihood's slope in each sentence's log-odds; a label that nothing explains has a bounded pull.
        pull = np.where(y == 1, none / np.maximum(1 - none, 0.05), -1.0) * weight / weight.mean()
        by_sentence = pull[owner] * p
        grad = np.append(np.bincount(feature, by_sentence[at], len(index)), by_sentence.sum() + (pull * plain).sum() * rest)
        grad = grad / len(y) - 1e-5 * np.append(theta[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return {"bias": float(theta[-1]), "weights": {f: float(theta[i]) for f, i in index.items()}, "share": float(np.average(y, weights=weight))}


class Scorer:
    """Sentence and document chances of a fitted model."""

    def __init__(self, model: dict, memo: int = MEMO):
        self.bias, self.weights, self.share, self.limit = model["bias"], model["weights"], model["share"], memo
        self.memo: dict[str, tuple[str, ...]] = {}
        self.plain = 0.0 if self.bias is None else math.log1p(math.exp(self.bias))

    def _shown(self, word: str) -> tuple[str, ...]:
        if len(self.memo) > self.limit:
            self.memo.clear()
        own = self.memo[word] = tuple(f for f in word_features(word) if f in self.weights)
        return own

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, log-odds) of each sentence with words. Lower-casing may change the length of rare texts; then places are of the lower-cased text."""
        get = self.memo.get
        for m in _sentence.finditer(text.lower()):
            if words := _words(m[0]):
                shown: set[str] = set()
                for w in words:
                    own = get(w)
                    if own is None:
                        own = self._shown(w)
                    if own:
                        shown.update(own)
                yield m.start(), m.end(), self.bias + sum(self.weights[f] for f in sorted(shown)) if shown else self.bias

    def score(self, text: str) -> float:
        if self.bias is None:
            return self.share
        none = 0.0
        for _, _, z in self.sentences(text):
            none -= self.plain if z == self.bias else float(np.logaddexp(0, z))
        return min(1.0, max(0.0, -math.expm1(none)))

    def offending(self, text: str, least: float = 0.5) -> list[dict]:
        if self.bias is None:
            return []
        found = ((s, e, 1 / (1 + math.exp(-min(max(z, -500), 500)))) for s, e, z in self.sentences(text))
        return [{"start": s, "end": e, "chance": p} for s, e, p in found if p >= least]


def score(docs: DataFrame, model: dict, spans: bool = False) -> DataFrame:
    """doc_id, score and, if asked for, the offending sentences (start, end, chance) of each row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for rows in batches:
            out = pd.DataFrame({"doc_id": rows["doc_id"], "score": [scorer.score(t) for t in rows["text"]]})
            if spans:
                out["offending"] = [scorer.offending(t) for t in rows["text"]]
            yield out

    kind = dict(docs.dtypes)["doc_id"]
    more = ", offending array<struct<start: int, end: int, chance: double>>" if spans else ""
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, f"doc_id {kind}, score double{more}")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(labelled_sample(docs, labels, "toxic", ROWS)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
