"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words; its documents get rates, the expected copies. Among all rates of at most CAP
that meet the token constraints sum of size_i rate_i = target, those nearest to 1 in relative entropy, each document
counting once, solve the convex dual
    min over l of  sum_i phi(size_i l_source(i)) - sum_s target_s l_s,   phi' = least(CAP, exp).
So rates are exponential tilts exp(l_s size_i), at most CAP: a source to be cut loses words in its long documents first,
one to be raised gains them there. Newton's iterations run on all sources at once; gradient and Hessian are sums over the
documents in each of them, distributed and added up in Spark (documents of one source and size have one term, counted).
A step that leaves the interval known to hold the solution halves it instead. Rates are then rounded into whole copies
by carrying the error in words from longer to shorter documents, within pieces of a source of a bounded number of documents.

Defined results: null and empty texts have size 0 and rate 1, take 0 words and get one copy. A null source is a source of its own, after all others. Rows that repeat a doc_id with the same source and
size share their copies. A document of any length is one unit. Empty tables give empty results. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import BROADCAST_BYTES, documents, materialize, ranked_ranges, ship, split_join, text_or_empty, unused

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3
#: Documents of a source that are rounded together.
PIECE = 2000
NEWTON_STEPS = 60
TOLERANCE = 1e-10


def words(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds weight: the given weights in turn, sources in the order of code points, null last."""
    keyed = sources.withColumn("_order", F.struct(F.isnull("source").alias("no"), "source"))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table, before = ranked_ranges(keyed, "_order", None, parts)
    if not before:
        return sources.withColumn("weight", F.lit(1.0))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("_part").orderBy("_order")) - 1 + offset[F.col("_part")]
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return table.withColumn("weight", F.get(turn, (place % len(weights)).cast("int"))).drop("_order", "_part")


def targets(sources: DataFrame, cap: float = CAP, total: float | None = None) -> DataFrame:
    """Adds target: total (by default all sizes) by weight, at most cap times source_size, the excess shared again by weight.

    The end of that sharing is target = least(cap * source_size, level * weight); the level is found from below in a
    finite number of steps, each a sum over the sources.
    """
    level, room = 0.0, F.col("source_size") * float(cap)
    while True:
        full = F.lit(level) * F.col("weight") >= room
        all_, held, weight = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, room)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not weight:
            break
        new = ((float(total if total is not None else all_ or 0)) - (held or 0.0)) / weight
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(room, F.lit(level) * F.col("weight")))


def _rate(cap: float, size: str = "size", l: str = "l") -> Column:
    return F.exp(F.least(F.col(l) * F.col(size), F.lit(math.log(cap))))


def newton(sources: DataFrame, sizes: DataFrame, cap: float = CAP, steps: int = NEWTON_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds l, the dual variable, and flat, a rate for all documents where the constraint leaves no other (else null).

    sources: source, source_size, target and more; sizes: source, size, n (documents of that size); give written tables.
    A step is l - gradient / Hessian; it ends when no source's gradient is above tolerance times its target (and 1e-8 words).
    """
    # A target of nothing, or of all that the cap allows, has its solution at an end of the line.
    flat = F.when(F.col("source_size") <= 0, 1.0).when(F.col("target") <= 0, 0.0)
    flat = flat.when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), float(cap))
    none = F.lit(None).cast("double")
    names = sources.columns
    table = sources.select("*", flat.cast("double").alias("flat"), F.lit(0.0).alias("l"), none.alias("lo"), none.alias("hi"))
    table = materialize(table.withColumn("done", F.col("flat").isNotNull()), "dual")
    few = sources.count() * 128 <= BROADCAST_BYTES
    inside = F.col("l") * F.col("size") < math.log(cap)
    for _ in range(steps):
        left = table.where(~F.col("done"))
        if left.isEmpty():
            break
        at = left.select(F.col("source").alias("_s"), "l")
        terms = sizes.where("size > 0").join(F.broadcast(at) if few else at, F.col("source").eqNullSafe(F.col("_s")))
        mass = F.col("n") * F.col("size") * _rate(cap)
        # Decimal sums don't depend on the order, so reruns agree to the last digit.
        exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
        sums = terms.groupBy("_s").agg(exact(mass).alias("_m"), exact(F.when(inside, mass * F.col("size"))).alias("_h"))
        moved = left.join(F.broadcast(sums) if few else sums, F.col("source").eqNullSafe(F.col("_s")))
        error = F.col("_m") - F.col("target")
        moved = moved.withColumn("lo", F.when(error < 0, F.col("l")).otherwise(F.col("lo")))
        moved = moved.withColumn("hi", F.when(error > 0, F.col("l")).otherwise(F.col("hi")))
        step = F.col("l") - error / F.col("_h")
        good = F.coalesce(step > F.col("lo"), F.lit(True)) & F.coalesce(step < F.col("hi"), F.lit(True)) & F.coalesce(F.col("_h") > 0, F.lit(False))
        far = F.when(F.col("l") != 0, F.col("l") * 2).otherwise(F.when(error < 0, 1e-6).otherwise(-1e-6))
        new = F.when(good, step).otherwise(F.coalesce((F.col("lo") + F.col("hi")) / 2, far))
        moved = moved.withColumn("done", F.abs(error) <= tolerance * F.col("target") + 1e-8)
        moved = moved.withColumn("l", F.when(F.col("done"), F.col("l")).otherwise(new))
        table = materialize(table.where("done").unionByName(moved.select(*table.columns)), "dual")
    return table.select(*names, "l", "flat")


def _round_pieces(batches: Iterator[pd.DataFrame], cap: int) -> Iterator[pd.DataFrame]:
    """Copies for rows sorted by piece and falling size; what a document takes too much or too little goes on to the next."""
    piece, error = None, 0.0
    for rows in batches:
        out = np.zeros(len(rows), dtype="int32")
        for i, (key, size, n, rate) in enumerate(zip(rows["_piece"], rows["size"], rows["_n"], rows["rate"], strict=True)):
            if key != piece:
                piece, error = key, 0.0
            mass = size * n
            if mass == 0:
                out[i] = min(cap, round(rate))
                continue
            want = rate * mass + error
            out[i] = min(cap, max(0, int(np.floor(want / mass + 0.5))))
            error = want - out[i] * mass
        yield rows.drop(columns=["_piece"]).assign(copies=out)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, piece: int = PIECE) -> DataFrame:
    """A row per row of docs: doc_id, source, size, source_size, target, rate, copies."""
    spark = docs.sparkSession
    ship(spark)
    sized = docs.select("doc_id", "source", words().alias("size"))
    units = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    bins = units.groupBy("source", "size").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("units"))
    bins = materialize(bins, "size_bins")
    sums = bins.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("units").alias("_docs"))
    goals = materialize(targets(source_weights(sums, weights), cap), "targets")
    table = newton(goals, bins.select("source", "size", "n"), cap)
    own = materialize(table.select("source", "source_size", "target", "l", "flat", "_docs"), "duals")
    if own.count() * 128 <= BROADCAST_BYTES:
        joined = units.join(F.broadcast(own.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    else:
        joined = split_join(units, own, "source", "_docs", "doc_id")
    joined = joined.withColumn(
        "rate", F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce("flat", _rate(cap)))
    ).drop("l", "flat")
    keyed = joined.withColumn(
        "_piece", F.xxhash64("source", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_docs") / F.lit(float(piece)))))
    ).drop("_docs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = keyed.repartition(parts, "_piece").sortWithinPartitions("_piece", F.desc("size"), "doc_id")
    kinds = dict(keyed.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keyed.columns if c != "_piece") + ", copies int"
    rounded = order.mapInPandas(lambda it: _round_pieces(it, cap), schema)
    return rounded.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_copy", "_n")


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as its copies say; rows with none go."""
    plan = mix(docs, **how).select("doc_id", "source", "size", "copies").where("copies > 0").distinct()
    size = unused(docs, "_size")
    sized = docs.withColumn(size, words())
    names = {c: unused(sized, f"_plan_{c}") for c in plan.columns}
    plan = plan.withColumnsRenamed(names)
    same = F.lit(True)
    for mine, theirs in (("doc_id", "doc_id"), ("source", "source"), (size, "size")):
        same = same & F.col(mine).eqNullSafe(F.col(names[theirs]))
    again = unused(sized, "_copy")
    times = F.explode(F.sequence(F.lit(1), F.col(names["copies"])))
    return sized.join(plan, same).withColumn(again, times).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "rate", "copies")
