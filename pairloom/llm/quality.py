"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built from labelled texts. A text, in pieces of PIECE bytes so that the dictionary counts
throughout, is compressed with each. The difference bad - good of the summed sizes, normalised by their sum and by the
text's length, says which the text is more like; with the mean size by length, which tells how far the difference can go
at all, it is turned into a chance of label 1 by a quadratic logistic curve. The curve is fitted on labelled texts that
the dictionaries have not seen. At most ROWS labelled documents of each label, with whole texts of at most
labelled.BYTES together, are used, two thirds of them (up to TRAIN_BYTES) for the dictionaries; scoring reads whole texts where they are.

Defined results: null and empty texts have differences and size 0 and get the curve's value there. If the labels have
one class only (or none), every text scores the share of label 1 (or 1: nothing speaks against it). Repeated rows get a
row each, very long texts count whole; only doc_id and text are read, whatever the other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import documents, held_out, ship, text_or_empty
from pairloom.llm.labelled import labelled_sample

ROWS = 4500
#: Bytes of whole texts, taken in the order of a hash, that one dictionary is built from: more don't make it better.
TRAIN_BYTES = 8 << 20
PIECE = 1000
DICTIONARY = 32768
LEVEL = 3
ACCEPT = 0.3


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def _dictionary(texts: list[bytes]) -> bytes:
    samples, left = [], TRAIN_BYTES
    for t in sorted(texts, key=lambda t: (xxhash.xxh64_intdigest(t), t)):
        if len(t) <= left:
            left -= len(t)
            samples += _pieces(t)
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text: the text itself is the dictionary
        return b"".join(samples)[-DICTIONARY:] or b"\0" * 8


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress
            for d in (good, bad)
        )

    def measures(self, text: bytes) -> tuple[float, float, float]:
        good = bad = 0
        for p in _pieces(text):
            good += len(self.good(p))
            bad += len(self.bad(p))
        n = len(text)
        return ((bad - good) / (bad + good), (bad - good) / n, (bad + good) / (2 * n)) if n else (0.0, 0.0, 0.0)


class Curve:
    """A logistic curve of the measures, their products and squares."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, beta: np.ndarray | None = None):
        self.mean, self.spread, self.beta = mean, spread, beta

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x.reshape(-1, 3) - self.mean) / self.spread, -4, 4)
        return np.stack([np.ones(len(z)), *z.T, *(z[:, i] * z[:, j] for i in range(3) for j in range(i, 3))], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Curve:
        """By Newton's method with a slight pull to 0."""
        u, w = self._terms(x), weight / weight.mean()
        self.beta = np.zeros(u.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(u @ self.beta, -40, 40)))
            h = (u * (w * p * (1 - p))[:, None]).T @ u + 0.1 * np.eye(u.shape[1])
            step = np.linalg.solve(h, u.T @ (w * (y - p)) - 0.1 * self.beta)
            self.beta = self.beta + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._terms(x) @ self.beta, -40, 40)))


def fit(sample: list[tuple[str, int, float]]) -> dict:
    labels = np.array([label for _, label, _ in sample], dtype=float)
    weight = np.array([w for _, _, w in sample])
    if not len(labels) or labels.min() == labels.max():
        return {"good": None, "share": float(labels.mean()) if len(labels) else 1.0}
    texts = [t.encode() for t, _, _ in sample]
    place, turn = {0.0: 0, 1.0: 0}, []  # every third text of each label is for the curve
    for k in labels:
        place[k] += 1
        turn.append(place[k] % 3 == 0)
    turn = np.array(turn)
    good, bad = (_dictionary([t for t, k, c in zip(texts, labels, turn, strict=True) if k == label and not c]) for label in (1, 0))
    if len(set(labels[turn])) < 2:
        turn[:] = True
    both = Compressors(good, bad)
    x = np.array([both.measures(t) for t, c in zip(texts, turn, strict=True) if c])
    curve = Curve(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)).fit(x, labels[turn], weight[turn])
    return {"good": good, "bad": bad, "curve": curve}


def _scores(model: dict, both: Compressors, texts) -> np.ndarray:
    return model["curve"](np.array([both.measures(t) for t in texts], dtype=float).reshape(-1, 3))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of each row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = Compressors(model["good"], model["bad"])
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": _scores(model, both, rows["text"])})

    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    if model["good"] is None:
        return rows.select("doc_id", F.lit(model["share"]).alias("score"))
    return rows.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def accept(docs: DataFrame, model: dict, least: float = ACCEPT) -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns, in one pass and without a shuffle."""
    ship(docs.sparkSession)
    if model["good"] is None:
        return docs if model["share"] >= least else docs.where(F.lit(False))

    @F.pandas_udf("boolean")
    def stays(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        both = Compressors(model["good"], model["bad"])
        for texts in parts:
            yield pd.Series(_scores(model, both, texts) >= least)

    return docs.where(stays(text_or_empty().cast("binary")))


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    return fit(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", ROWS))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, learned(spark, docs, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
