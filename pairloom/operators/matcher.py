"""Pluggable scorers: an injected callable for prompts, a lexical baseline, re-embedding."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import records as R

#: Seconds before a failed call is made once more.
PAUSE = 2.0


def answers(df: DataFrame, ask: Callable[[str], str], prompt: str = "prompt", pause: float = PAUSE) -> DataFrame:
    """df with column answer. A call that fails is made once more; if it fails again the answer is null."""

    def once_more(text: str) -> str | None:
        for last in (False, True):
            try:
                return ask(text)
            except Exception:  # noqa: BLE001  whatever the backend raises
                if not last:
                    time.sleep(pause)
        return None

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([once_more(t) for t in texts], dtype="object")

    return df.withColumn("answer", run(prompt))


def zero_shot(pairs: DataFrame, ask: Callable[[str], str], model: str = "") -> DataFrame:
    """pairs with prompt, answer and match."""
    asked = answers(pairs.withColumn("prompt", R.prompt(F.col("left"), F.col("right"), model)), ask)
    return asked.withColumn("match", R.yes_label(F.col("answer")))


def features(pairs: DataFrame) -> DataFrame:
    """pairs with features: Jaccard of words, share of shared words on either side, length ratio."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " ", -1))
    a, b = F.col("_a"), F.col("_b")
    both = F.size(F.array_intersect(a, b)).cast("double")
    ratio = F.least(F.length("left"), F.length("right")) / F.greatest(F.length("left"), F.length("right"), F.lit(1))
    x = F.array(both / F.size(F.array_union(a, b)), both / F.size(a), both / F.size(b), ratio.cast("double"))
    return pairs.withColumn("_a", words("left")).withColumn("_b", words("right")).withColumn("features", array_to_vector(x)).drop("_a", "_b")


#: What each kind of saved model scores with: the pair's own classifier, or the cosine of two records' encodings, or both.
KINDS = {"pairwise": ("pair",), "singleton": ("single",), "dual": ("pair", "single")}


def save(model: LogisticRegressionModel, path: str, kind: str, budget: int, f1: float, keep_lower: bool = False) -> bool:
    """Saves a model with its kind, budget and F1. keep_lower: a saved one of a budget up to this with a greater F1 stays. True: saved."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    spark = SparkSession.active()
    if keep_lower and (old := _settings(spark, path)) is not None and old["f1"] > f1 and old["budget"] <= budget:
        return False
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(kind, int(budget), float(f1))], "kind string, budget long, f1 double").coalesce(1).write.mode("overwrite").json(f"{path}/settings")
    return True


def _settings(spark: SparkSession, path: str) -> dict | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/settings")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("kind string, budget long, f1 double").json(f"{path}/settings").first().asDict()


def load(path: str) -> tuple[LogisticRegressionModel, dict]:
    """The saved model, and its settings with `scores`, what its kind scores with. An error names a path without a model."""
    found = _settings(SparkSession.active(), path)
    if found is None:
        raise FileNotFoundError(f"no saved model at {path}")
    return LogisticRegressionModel.load(f"{path}/model"), found | {"scores": KINDS[found["kind"]]}


def train(rows: DataFrame, steps: int = 50) -> LogisticRegressionModel:
    return LogisticRegression(maxIter=steps, regParam=0.01).fit(rows.select("features", F.col("label").cast("double").alias("label")))


def score(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """rows with prob, the chance of a match."""
    out = model.transform(rows.withColumn("_label", F.col("label")))
    return out.withColumn("prob", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "_label")


def re_embed(df: DataFrame, encode: Callable[[np.ndarray], np.ndarray], v: str = "v") -> DataFrame:
    """df with its vectors put through an encoder, a matrix at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                rows[v] = list(encode(np.stack(rows[v].to_numpy())))
            yield rows

    return df.mapInPandas(run, df.schema)
