"""Training sets of an exact size per domain.

All methods share a frame. A domain with at least `budget` rows of its own gives a seeded sample of them. Another one
gives all its rows, then the best-ranked donors of other domains, then the whole again until the budget is full.
Rows: target, out_pos (0 to budget-1), donor, pair_idx.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators import kernels
from pairloom.operators.pairs import centroids, mean_vector, small

SEED = 22
#: Ranks are rounded so that the last bit of a sum can't reorder rows.
DIGITS = 9
#: Candidates of one target that a greedy task holds; more are picked from in rounds.
GREEDY = 200_000
#: Candidates of one target that a round brings to the driver.
POOL = 2000


def draw(seed: int, *cols: str) -> Column:
    """A seeded order of rows that any engine with md5 repeats."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def oversample(rows: DataFrame, budget: int, key: str = "target", pos: str = "pos") -> DataFrame:
    """Repeats each key's rows, in the order of pos (0 to m-1), until there are `budget`: column out_pos."""
    m = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_m"))
    full = rows.join(m, key).withColumn("_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(budget) / F.col("_m")) - 1)))
    return full.withColumn("out_pos", F.col("_rep") * F.col("_m") + F.col(pos)).where(F.col("out_pos") < budget).drop("_rep", "_m", pos)


def own_rows(train: DataFrame, budget: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows with target, donor, pair_idx, pos, n; the domains that need donors with their n)."""
    n = train.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    rows = train.select("domain", "pair_idx").join(small(n), "domain")
    by = lambda *o: F.row_number().over(Window.partitionBy("domain").orderBy(*o))
    # The rank itself is cut, so Spark cuts it before the shuffle too.
    rich = rows.where(F.col("n") >= budget).withColumn("rank", by(draw(seed, "domain", "pair_idx"), "pair_idx")).where(F.col("rank") <= budget)
    poor = rows.where(F.col("n") < budget).withColumn("rank", by("pair_idx")).where(F.col("rank") <= budget)
    own = rich.unionByName(poor).select(
        F.col("domain").alias("target"), F.col("domain").alias("donor"), "pair_idx", (F.col("rank") - 1).cast("long").alias("pos"), "n"
    )
    return own, n.where(F.col("n") < budget).withColumnRenamed("domain", "target")


def fill(own: DataFrame, need: DataFrame, scored: DataFrame, budget: int) -> DataFrame:
    """scored: target, donor, pair_idx, score (smaller is better). Ranks are cut before they are shuffled."""
    order = Window.partitionBy("target").orderBy(F.round("score", DIGITS), "donor", "pair_idx")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)
    donors = best.join(small(need), "target").where(F.col("rank") <= F.lit(budget) - F.col("n"))
    donors = donors.select("target", "donor", "pair_idx", (F.col("n") + F.col("rank") - 1).cast("long").alias("pos"))
    return oversample(own.drop("n").unionByName(donors), budget).select("target", "out_pos", "donor", "pair_idx")


def _against(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each target with the candidates of other domains; targets are a row per domain."""
    return candidates.join(small(targets), F.col("domain") != F.col("target"))


def spec(train: DataFrame, budget: int, seed: int = SEED) -> DataFrame:
    """A domain's own rows only."""
    own, _ = own_rows(train, budget, seed)
    return oversample(own.drop("n"), budget).select("target", "out_pos", "donor", "pair_idx")


def general(train: DataFrame, budget: int | None, seed: int = SEED) -> DataFrame:
    """A seeded sample of all domains' rows, the target's own included, for each target; budget None: the whole pool."""
    targets = train.select(F.col("domain").alias("target")).distinct()
    pool = train.select(F.col("domain").alias("donor"), "pair_idx").crossJoin(small(targets))
    order = Window.partitionBy("target").orderBy(draw(seed, "target", "donor", "pair_idx"), "donor", "pair_idx")
    ranked = pool.withColumn("rank", F.row_number().over(order))
    pos = (F.col("rank") - 1).cast("long")
    if budget is None or budget < 0:
        return ranked.select("target", pos.alias("out_pos"), "donor", "pair_idx")
    # The rank itself is cut, so Spark cuts it before the shuffle too.
    few = ranked.where(F.col("rank") <= budget).withColumn("pos", pos).drop("rank")
    return oversample(few, budget).select("target", "out_pos", "donor", "pair_idx")


def nearest(train: DataFrame, budget: int, seed: int = SEED) -> DataFrame:
    """Donors by the distance of their unit pair vector to the target's unit centroid. train: domain, pair_idx, v (unit)."""
    own, need = own_rows(train, budget, seed)
    targets = centroids(train).select(F.col("domain").alias("target"), "centroid").join(need.select("target"), "target", "left_semi")
    scored = _against(targets, train).select("target", F.col("domain").alias("donor"), "pair_idx", V.distance(F.col("v"), F.col("centroid")).alias("score"))
    return fill(own, need, scored, budget)


def gain(cand: Column, mean: Column, n: Column, goal: Column, added: int = 1) -> Column:
    """How much nearer, by cosine, the training mean comes to the goal when `cand` (a sum of `added` vectors) joins it."""
    moved = F.zip_with(mean, cand, lambda m, c: (m * n + c) / (n + added))
    return V.cosine(moved, goal) - V.cosine(mean, goal)


def shift(train: DataFrame, goals: DataFrame, budget: int, seed: int = SEED) -> DataFrame:
    """Donors by centroid gain on unit pairs. goals: domain, goal (the mean of validation, test or own training pairs)."""
    own, need = own_rows(train, budget, seed)
    state = train.groupBy("domain").agg(mean_vector("v").alias("mean"), F.count(F.lit(1)).alias("m"))
    targets = state.join(goals, "domain").withColumnRenamed("domain", "target").join(need.select("target"), "target", "left_semi")
    scored = _against(targets, train).select(
        "target", F.col("domain").alias("donor"), "pair_idx", (-gain(F.col("v"), F.col("mean"), F.col("m"), F.col("goal"))).alias("score")
    )
    return fill(own, need, scored, budget)


def shift_singles(train: DataFrame, goals: DataFrame, budget: int, seed: int = SEED) -> DataFrame:
    """Centroid gain on raw singletons: a donor adds its two records. train: domain, pair_idx, l, r."""
    own, need = own_rows(train, budget, seed)
    sums = train.withColumn("half", V.mean2(F.col("l"), F.col("r"))).groupBy("domain").agg(mean_vector("half").alias("mean"), (2 * F.count(F.lit(1))).alias("m"))
    targets = sums.join(goals, "domain").withColumnRenamed("domain", "target").join(need.select("target"), "target", "left_semi")
    both = V.plus(F.col("l"), F.col("r"))
    scored = _against(targets, train).select(
        "target", F.col("domain").alias("donor"), "pair_idx", (-gain(both, F.col("mean"), F.col("m"), F.col("goal"), 2)).alias("score")
    )
    return fill(own, need, scored, budget)


def _by_kernel(train: DataFrame, goal_pairs: DataFrame, budget: int, seed: int, kernel) -> DataFrame:
    """Donors by a NumPy score over raw pairs: each task has a target's pairs and a block of candidates."""
    own, need = own_rows(train, budget, seed)
    raw = F.concat("l", "r")
    own_raw = train.select(F.col("domain").alias("target"), F.lit("own").alias("kind"), "pair_idx", raw.alias("lr"))
    goal = goal_pairs.select(F.col("domain").alias("target"), F.lit("goal").alias("kind"), "pair_idx", raw.alias("lr"))
    context = own_raw.unionByName(goal).join(small(need.select("target")), "target", "left_semi")
    n = train.count()
    blocks = max(1, -(-n // 20_000))
    context = context.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    context = context.select("target", "kind", F.col("pair_idx").alias("place"), "lr", "block")
    cands = train.select(F.col("domain").alias("donor"), "pair_idx", raw.alias("lr"), F.pmod(F.xxhash64("domain", "pair_idx"), F.lit(blocks)).cast("int").alias("block"))
    cands = cands.join(small(need.select("target")), F.col("donor") != F.col("target"))
    scored = context.groupBy("target", "block").cogroup(cands.groupBy("target", "block")).applyInPandas(
        lambda a, b: kernels.score_block(a, b, kernel), "target int, donor int, pair_idx long, score double"
    )
    return fill(own, need, scored, budget)


def kde(train: DataFrame, goal_pairs: DataFrame, budget: int, seed: int = SEED) -> DataFrame:
    return _by_kernel(train, goal_pairs, budget, seed, kernels.kde_gain)


def kde2d(train: DataFrame, goal_pairs: DataFrame, budget: int, seed: int = SEED) -> DataFrame:
    return _by_kernel(train, goal_pairs, budget, seed, kernels.kde2d_density)


def mmd(train: DataFrame, goal_pairs: DataFrame, budget: int, seed: int = SEED) -> DataFrame:
    return _by_kernel(train, goal_pairs, budget, seed, kernels.mmd_gain)


def _in_rounds(train: DataFrame, need: DataFrame, budget: int, pool: int) -> DataFrame:
    """Farthest-first picks where candidates don't fit one task: target, donor, pair_idx, score. A round scans all
    candidates where they are and brings each target's `pool` farthest and the one after these. A distance to the
    nearest centre only falls with further picks, so picks among the pool are those among all candidates while they come
    before that one; the next round goes on from there. The driver and the tasks hold the targets' centers and picks."""
    spark = train.sparkSession
    train = train.select("domain", "pair_idx", "v").persist()
    left = {r["target"]: budget - r["n"] for r in need.collect()}
    own = train.join(small(need.select(F.col("target").alias("domain"))), "domain", "left_semi").toPandas()
    centers = {t: np.stack(g["v"].to_numpy()).astype(float) for t, g in own.groupby("domain")}
    picked: dict[int, list[tuple[int, int]]] = {t: [] for t in left}
    order = Window.partitionBy("target").orderBy(F.desc("far"), "donor", "pair_idx")
    schema = "target int, donor int, pair_idx long, far double, near double, v array<double>"
    while left:
        scan = kernels.farthest({t: centers[t] for t in left}, {t: set(picked[t]) for t in left}, pool + 1)
        top = train.mapInPandas(scan, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool + 1).toPandas()
        found = {t: g.sort_values("rank") for t, g in top.groupby("target")}
        for t in list(left):
            rows = found.get(t)
            if rows is None:
                del left[t]  # all candidates are picked
                continue
            picks = kernels.picks_before(rows, pool, left[t])
            chosen = rows.iloc[picks]
            picked[t] += zip(chosen["donor"].tolist(), chosen["pair_idx"].tolist(), strict=True)
            centers[t] = np.concatenate([centers[t], np.stack(chosen["v"].to_numpy()).astype(float)])
            left[t] -= len(picks)
            if not left[t]:
                del left[t]
    train.unpersist()
    rows = [(t, d, i, float(k)) for t, own_picks in picked.items() for k, (d, i) in enumerate(own_picks)]
    return spark.createDataFrame(rows, "target int, donor int, pair_idx long, score double")


def k_center(train: DataFrame, budget: int, seed: int = SEED, most: int = GREEDY, pool: int = POOL) -> DataFrame:
    """Farthest-first donors from the target's unit pairs. Above `most` candidates the same picks are made in rounds."""
    own, need = own_rows(train, budget, seed)
    if train.count() > most:
        return fill(own, need, _in_rounds(train, need, budget, pool), budget)
    targets = need.select("target", F.col("n").alias("own_n"))
    centers = train.select(F.col("domain").alias("target"), F.lit(-1).alias("donor"), "pair_idx", "v").join(small(targets), "target")
    cands = _against(targets, train).select("target", F.col("domain").alias("donor"), "pair_idx", "v", "own_n")
    pick = lambda rows: kernels.farthest_first(rows, budget)
    schema = "target int, donor int, pair_idx long, score double, v array<double>, own_n long"
    scored = cands.unionByName(centers.select(*cands.columns)).groupBy("target").applyInPandas(pick, schema).drop("v", "own_n")
    return fill(own, need, scored, budget)
