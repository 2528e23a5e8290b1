"""Kernel discrepancies and densities of a domain's pairs, in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators import kernels
from pairloom.operators.pairs import small

#: Rows of a domain that a task holds of either side.
ROWS = 4000


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """rows with _block, its number among _blocks of at most about `most` rows of a domain."""
    n = rows.groupBy("domain").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_blocks"))
    return rows.join(small(n), "domain").withColumn("_block", F.pmod(F.xxhash64("pair_idx", "kind"), F.col("_blocks")).cast("int"))


def _new(c: str) -> Column:
    """The column under its name, but not the same one as on the other side of a cogroup."""
    return F.col(c).alias(c)


def mmd_by_domain(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """domain, mmd: the squared discrepancy of a domain's vectors of kind train and val. rows: domain, pair_idx, kind, v.

    Each pair of blocks is a task's work and gives three sums; domains without one of the kinds are left out.
    """
    dealt = _dealt(rows, most)
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    one = dealt.select("domain", F.col("_block").alias("i"), others.alias("j"), "kind", "v")
    two = dealt.select(_new("domain"), others.alias("i"), F.col("_block").alias("j"), _new("kind"), _new("v"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not (len(a) and len(b)):
            return pd.DataFrame({"domain": [], "p": [], "q": [], "total": [], "n": []})
        side = lambda rows, k: np.stack(own.to_numpy()).astype(float) if len(own := rows.loc[rows["kind"] == k, "v"]) else None
        out = []
        for p, q in (("train", "train"), ("val", "val"), ("train", "val")):
            x, y = side(a, p), side(b, q)
            if x is not None and y is not None:
                out.append((a["domain"].iloc[0], p, q, kernels.rbf_sum(x, y, 1 / x.shape[1]), len(x) * len(y)))
        return pd.DataFrame(out, columns=["domain", "p", "q", "total", "n"])

    kind = dict(rows.dtypes)["domain"]
    schema = f"domain {kind}, p string, q string, total double, n long"
    parts = one.groupBy("domain", "i", "j").cogroup(two.groupBy("domain", "i", "j")).applyInPandas(sums, schema)
    mean = lambda p, q: F.sum(F.when((F.col("p") == p) & (F.col("q") == q), F.col("total"))) / F.sum(F.when((F.col("p") == p) & (F.col("q") == q), F.col("n")))
    value = mean("train", "train") + mean("val", "val") - 2 * mean("train", "val")
    return parts.groupBy("domain").agg(value.alias("mmd")).where("mmd IS NOT NULL")


def log_densities(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """domain, pair_idx, log_density of the train vectors under the val vectors' density, the mean over dimensions. A task
    has a block of a domain's train vectors and all its val vectors."""
    train, goal = (rows.where(F.col("kind") == k) for k in ("train", "val"))
    dealt = _dealt(train, most)
    copies = dealt.select("domain", "_blocks").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    spread = goal.join(small(copies), "domain").select(_new("domain"), "_block", _new("v"))

    def run(own: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not (len(own) and len(data)):
            return pd.DataFrame({"domain": [], "pair_idx": [], "log_density": []})
        value = kernels.log_density(np.stack(own["v"].to_numpy()).astype(float), np.stack(data["v"].to_numpy()).astype(float)).mean(axis=1)
        return pd.DataFrame({"domain": own["domain"], "pair_idx": own["pair_idx"], "log_density": value})

    kind = dict(rows.dtypes)["domain"]
    by = ("domain", "_block")
    return dealt.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(run, f"domain {kind}, pair_idx long, log_density double")


def silverman(x: Column, y: Column, n: Column) -> Column:
    """An aggregate: the bandwidth of a joint density in two dimensions; 1 below 5 points, 1e-3 at least. n: the count."""
    spread = lambda c: F.least(F.stddev_samp(c), (F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))) / 1.34)
    h = F.greatest(1.06 * (spread(x) + spread(y)) / 2 * F.pow(n, F.lit(-0.2)), F.lit(0.001))
    return F.when(n < 5, 1.0).otherwise(h)
