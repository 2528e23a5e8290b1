"""Selection methods by name, ensembles of them, and grids of runs.

A name is a family with an optional metric: spec, gen, nn..., tv..., tt..., tm..., kcg..., aug; the metric is the last part
after "_", cs by default. Names joined by "-" are an ensemble.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators import selection
from pairloom.operators.pairs import mean_vector

GOALS = {"tv": "val", "tt": "test", "tm": "train"}


def parse(name: str) -> tuple[str, str]:
    """(family, metric) of one method; an unknown family is an error."""
    for family in ("spec", "gen", "nn", "tv", "tt", "tm", "kcg", "aug"):
        if name.startswith(family):
            metric = name.rsplit("_", 1)[-1]
            return family, "cs" if metric in (name, *GOALS) else metric
    raise ValueError(f"unknown method {name}")


def ensemble(name: str) -> list[str]:
    return name.split("-")


def run_tag(task: str, **settings) -> str:
    """task_key=value_..., with / as _."""
    return "_".join([task, *(f"{k}={v}" for k, v in settings.items())]).replace("/", "_")


def select(pairs: DataFrame, method: str | None, budget: int, seed: int = selection.SEED) -> DataFrame:
    """target, out_pos, donor, pair_idx for raw pairs (domain, pair_idx, split, l, r). None: the domains alone."""
    if method is None:
        return pairs.select(F.col("domain").alias("target")).distinct()
    family, metric = parse(method)
    if family == "aug":
        raise ValueError("aug makes new texts: augment.augmented takes labelled text pairs")
    raw = pairs.select("domain", "pair_idx", "split", "l", "r")
    split = lambda s: raw.where(F.col("split") == s).drop("split")
    unit = lambda df: df.select("domain", "pair_idx", V.unit_pair(F.col("l"), F.col("r")).alias("v"))
    train = split("train")
    if family == "spec":
        return selection.spec(train, budget, seed)
    if family == "gen":
        return selection.general(train, budget, seed)
    if family == "nn":
        return selection.nearest(unit(train), budget, seed)
    if family == "kcg":
        return selection.k_center(unit(train), budget, seed)
    goal = split(GOALS[family])
    dense = {"kde": selection.kde, "kde2d": selection.kde2d, "mmd": selection.mmd}
    if metric in dense:
        return dense[metric](train, goal, budget, seed)
    if metric == "cs":
        return selection.shift(unit(train), unit(goal).groupBy("domain").agg(mean_vector("v").alias("goal")), budget, seed)
    half = goal.withColumn("h", V.mean2(F.col("l"), F.col("r")))
    return selection.shift_singles(train, half.groupBy("domain").agg(mean_vector("h").alias("goal")), budget, seed)


def select_ensemble(pairs: DataFrame, name: str, budget: int, seed: int = selection.SEED) -> DataFrame:
    """The sets of all methods of an ensemble, with a column method."""
    sets = [select(pairs, m, budget, seed).withColumn("method", F.lit(m)) for m in ensemble(name)]
    return reduce(DataFrame.unionByName, sets)


def grid(seeds: Iterable[int], budgets: Iterable[int], methods: Iterable[str], run: Callable[[int, int, str], DataFrame]) -> DataFrame:
    """The rows of run(seed, budget, method) for all combinations, in one plan, with these three as columns."""
    parts = [
        run(s, b, m).withColumn("seed", F.lit(s)).withColumn("budget", F.lit(b)).withColumn("method", F.lit(m)) for s in seeds for b in budgets for m in methods
    ]
    return reduce(DataFrame.unionByName, parts)
