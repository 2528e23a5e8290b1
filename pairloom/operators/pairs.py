"""Records, pairs and vectors by domain."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import vectors as V

#: Rows and bytes of a side that may be broadcast.
SMALL = 100_000
SMALL_BYTES = 32 << 20


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row."""
    own = [F.size(c) * 8 if kind.startswith("array") else F.octet_length(c) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    return F.lit(16) + sum((F.coalesce(x, F.lit(0)).cast("long") for x in own), F.lit(0))


def small(df: DataFrame, rows: int = SMALL, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """df, computed once and kept, with a broadcast hint if its counted rows and bytes allow it."""
    kept = df.persist()
    n, size = kept.agg(F.count(F.lit(1)), F.sum(_bytes(kept))).first()
    return F.broadcast(kept) if n <= rows and (size or 0) <= most_bytes else kept


def numbered(df: DataFrame, domain: str, *order: str) -> DataFrame:
    """Adds idx, the place in the domain from 0. Done once, at ingest: place is identity from then on."""
    place = F.row_number().over(Window.partitionBy(domain).orderBy(*order)) - 1
    return df.withColumn("idx", place.cast("long"))


def vector_pairs(singles: DataFrame) -> DataFrame:
    """domain, pair_idx, l, r from singles (domain, idx, v): neighbours 2i and 2i+1; an unpaired last one is left out."""
    side = lambda k: F.first(F.when(F.col("idx") % 2 == k, F.col("v")), ignorenulls=True)
    both = singles.groupBy("domain", F.expr("idx div 2").alias("pair_idx")).agg(side(0).alias("l"), side(1).alias("r"))
    return both.where("l IS NOT NULL AND r IS NOT NULL")


def split_of(pair_idx: str = "pair_idx") -> Column:
    k = F.pmod(F.col(pair_idx), F.lit(5))
    return F.when(k <= 2, "train").when(k == 3, "val").otherwise("test")


def mean_vector(v: str) -> Column:
    """An aggregate: the component-wise mean, summed partially on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(v))))


def unpivot(pairs: DataFrame) -> DataFrame:
    """Two rows a pair: side 0 the left text, side 1 the right one."""
    return pairs.select("*", F.posexplode(F.array("left", "right")).alias("side", "text")).drop("left", "right")


def centroids(pairs: DataFrame, v: str = "v") -> DataFrame:
    """domain, centroid (unit, if not null), mean, n of each domain's vectors."""
    out = pairs.groupBy("domain").agg(mean_vector(v).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("centroid", F.when(V.norm(F.col("mean")) > 0, V.unit(F.col("mean"))).otherwise(F.col("mean")))
