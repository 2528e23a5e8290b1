"""Training sets with texts from selected keys, pooled validation sets, and encoded, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.pairs import small


def budgeted(selected: DataFrame, pairs: DataFrame, domains: list | None = None) -> DataFrame:
    """domain, split, pos, left, right, label: the selected donors' texts as a target's training rows, its own validation and test rows as they are.

    selected: target, out_pos, donor, pair_idx; pairs: domain, pair_idx, split, left, right, label. domains: these targets only.
    """
    if domains is not None:
        selected, kept = selected.where(F.col("target").isin(domains)), pairs.where(F.col("domain").isin(domains))
    else:
        kept = pairs
    keys = selected.select("target", "out_pos", F.col("donor").alias("_donor"), F.col("pair_idx").alias("_pair"))
    texts = pairs.where("split = 'train'").select("domain", "pair_idx", "left", "right", "label")
    train = keys.join(texts, (F.col("domain") == F.col("_donor")) & (F.col("pair_idx") == F.col("_pair")))
    shown = ["left", "right", "label"]
    train = train.select(F.col("target").alias("domain"), F.lit("train").alias("split"), F.col("out_pos").cast("long").alias("pos"), *shown)
    rest = kept.where("split <> 'train'").select("domain", "split", F.col("pair_idx").cast("long").alias("pos"), *shown)
    return train.unionByName(rest)


def pooled_validation(val: DataFrame, least: int = 100) -> DataFrame:
    """target and all columns of val: a domain's own validation rows, or all domains' where it has fewer than `least`.

    Domains without any row are not known here; give their names as rows of val with null keys to have them pooled.
    """
    n = val.groupBy("domain").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("domain", "target")
    own = val.join(n.where(F.col("_n") >= least), F.col("domain") == F.col("target"))
    pooled = val.crossJoin(small(n.where(F.col("_n") < least)))
    return own.unionByName(pooled).select("target", *val.columns)


def encode_pair(left: Column, right: Column, max_len: int, first: list[int], between: list[int], last: list[int]) -> Column:
    """The ids of a pair for a model: special ids around two id arrays, which are cut to fit into max_len.

    The longer one is cut first; if both are over half of the room, each gets half, the longer one (of equal ones the
    right one) the odd place.
    """
    room = max(0, max_len - len(first) - len(between) - len(last))
    n, m = F.size(left), F.size(right)
    fits = n + m <= room
    short = F.least(n, m, F.lit(room // 2))
    keep_left = F.when(fits, n).when(n <= m, short).otherwise(F.lit(room) - short)
    keep_right = F.when(fits, m).when(n <= m, F.lit(room) - short).otherwise(short)
    ids = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    cut = lambda a, k: F.slice(a.cast("array<int>"), 1, k)
    return F.concat(ids(first), cut(left, keep_left), ids(between), cut(right, keep_right), ids(last))


def encode_single(text: Column, max_len: int, first: list[int], last: list[int]) -> Column:
    """The ids of one record, cut at its end."""
    ids = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    return F.concat(ids(first), F.slice(text.cast("array<int>"), 1, max(0, max_len - len(first) - len(last))), ids(last))


def pad_batch(rows: DataFrame, batch: str, cols: list[str], by: list[str] | None = None, pad: int = 0) -> DataFrame:
    """rows with each id array of cols padded to the longest of its batch; `by`: the arrays that count for that length (all by default)."""
    longest = F.max(F.greatest(*[F.size(c) for c in by or cols], F.lit(0)))
    size = rows.groupBy(F.col(batch).alias("_batch")).agg(longest.alias("_size"))
    both = rows.join(size, F.col(batch).eqNullSafe(F.col("_batch")))
    padded = {c: F.concat(c, F.array_repeat(F.lit(pad), F.greatest(F.col("_size") - F.size(c), F.lit(0)))) for c in cols}
    return both.withColumns(padded).select(*rows.columns)
