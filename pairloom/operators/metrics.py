"""Precision, recall, F1, thresholds, votes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.vectors import let

PAIRWISE = [i * 0.05 for i in range(20)]
COSINE = [i * 0.01 for i in range(101)]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 to counts tp, fp, fn; 0 where a denominator is."""
    out = counts.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(match: Column, label: Column) -> list[Column]:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return [one((match == 1) & (label == 1)).alias("tp"), one((match == 1) & (label == 0)).alias("fp"), one((match == 0) & (label == 1)).alias("fn")]


def sweep(scored: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """keys, threshold, f1: the first threshold with the best F1; 0.5 and 0 where no F1 is above 0.

    Scores are counted by the number of thresholds below them, so a row is read once, not once a threshold.
    """
    steps = F.array(*[F.lit(t) for t in thresholds])
    below = let(F.col("score"), lambda s: F.size(F.filter(steps, lambda t: s > t)))
    cells = scored.select(*keys, "label", below.alias("below")).groupBy(*keys, "below").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    grid = cells.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))))
    hit = F.col("below") > F.col("step")
    counts = grid.groupBy(*keys, "step").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
    )
    best = with_scores(counts).groupBy(*keys).agg(F.max(F.struct(F.col("f1"), (-F.col("step")).alias("less"))).alias("b"))
    t = F.element_at(steps, (1 - F.col("b.less")).cast("int"))
    return best.select(*keys, F.when(F.col("b.f1") > 0, t).otherwise(F.lit(0.5)).alias("threshold"), F.col("b.f1").alias("f1"))


def vote(probs: DataFrame, keys: list[str], weights: dict[str, float] | None = None, kind: str = "soft_vote") -> DataFrame:
    """keys, prob: the mean over methods, or the weighted one if weights are asked for, given and not all 0."""
    if kind not in ("soft_vote", "soft_vote_weighted", "weighted_soft_vote"):
        raise ValueError(f"unknown vote {kind}")
    if kind == "soft_vote" or not weights or sum(weights.values()) <= 0:
        return probs.groupBy(*keys).agg(F.avg("prob").alias("prob"))
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("method"))
    return probs.groupBy(*keys).agg((F.sum(F.col("prob") * w) / F.sum(w)).alias("prob"))


def spread(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("runs"))


def domain_weights(test: DataFrame) -> DataFrame:
    n = test.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def averages(f1: DataFrame, weights: DataFrame) -> DataFrame:
    """macro and weighted mean of a domain metric; a domain without a weight is an error."""
    both = f1.join(weights, "domain", "left").withColumn("weight", F.coalesce("weight", F.raise_error(F.concat(F.lit("no weight for "), F.col("domain").cast("string"))).cast("double")))
    return both.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("weight")) / F.sum("weight")).alias("weighted_f1"))


def best_so_far(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Adds best: the greatest value of this and all rows before in order, as when the model of a lower budget is kept."""
    below = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("best", F.max(value).over(below))


def losses(p: Column, cosine: Column, label: Column, alpha: float = 1.0) -> dict[str, Column]:
    """Aggregates: cross_entropy of chances p, cosine_loss (matches near 1, others not above 0), and what each kind of model
    is trained on: pairwise the first, late_fusion the second, dual the first plus alpha times the second."""
    own = F.greatest(F.when(label == 1, p).otherwise(1 - p), F.lit(1e-12))
    cross = F.avg(-F.log(own))
    near = F.coalesce(F.avg(F.when(label == 1, 1 - cosine)), F.lit(0.0))
    far = F.coalesce(F.avg(F.when(label == 0, F.greatest(cosine, F.lit(0.0)))), F.lit(0.0))
    return {"cross_entropy": cross, "cosine_loss": near + far, "pairwise": cross, "late_fusion": near + far, "dual": cross + alpha * (near + far)}


def first_best(rows: DataFrame, keys: list[str], value: str, order: str, keep: list[str]) -> DataFrame:
    """Per key the row with the greatest value above 0; of equal ones the first in order."""
    best = F.max_by(F.struct(*keep, value, order), F.struct(F.col(value), (-F.col(order)).alias("less")))
    return rows.where(F.col(value) > 0).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
