"""What the operators share: a folder that every executor sees, written tables, text helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
#: A side of a join is broadcast only if its measured rows need no more than this.
BROADCAST_BYTES = 8 << 20
#: Bytes of a batch of rows on its way to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows of one key that a join leaves together.
SPLIT = 1_000_000

_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_own: dict[str, str] = {}
_shipped: set[str] = set()
_leaves: set[str] = set()


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, folder, True)
        _own[app] = f"file://{folder}"
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the application ends."""
    own = f"{shared_base(spark)}/{spark.sparkContext.applicationId}"
    if own not in _leaves:
        _leaves.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files behind a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, with a broadcast hint if counting its rows proves it small; else the join shuffles. Count a written table only."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def split_join(many: DataFrame, one: DataFrame, key: str, rows: str, by: str, limit: int | None = None) -> DataFrame:
    """many joined with one on key, where a key of `one` (one row each, with column `rows`: how often it is in many) can be
    very common: beyond `limit` rows its rows are dealt by the hash of `by` to as many copies as it takes. Null keys match.

    Give it a written table `one`. The keys to be split are total / limit at most.
    """
    limit = limit or SPLIT
    hot = one.where(F.col(rows) > limit).select(F.col(key).alias("_hot"), F.ceil(F.col(rows) / limit).cast("int").alias("_copies"))
    n = hot.count()
    if not n:
        return many.join(one.withColumnRenamed(key, "_one"), F.col(key).eqNullSafe(F.col("_one"))).drop("_one")
    hot = F.broadcast(hot) if n * 256 <= BROADCAST_BYTES else hot
    copies = F.coalesce("_copies", F.lit(1))
    dealt = many.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_copy", F.pmod(F.xxhash64(by), copies).cast("int")).drop("_hot", "_copies")
    each = one.withColumnRenamed(key, "_one").withColumn("_part", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col(rows), F.lit(1)) / limit).cast("int") - 1)))
    return dealt.join(each, F.col(key).eqNullSafe(F.col("_one")) & (F.col("_copy") == F.col("_part"))).drop("_one", "_copy", "_part")


def ship(spark: SparkSession) -> None:
    """Prepares the session for Python workers: batches are bounded in bytes, as texts have any length, and this package can be imported where PYTHONPATH doesn't have it already."""
    if spark.conf.get(_BATCH_SETTING) == "67108864b":  # Spark's default: nobody chose another bound
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="pairloom-ship-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/pairloom_ship.zip", "w") as z:
        for p in sorted((root / "pairloom").rglob("*.py")):
            z.write(p, str(p.relative_to(root)))
    spark.sparkContext.addPyFile(f"{folder}/pairloom_ship.zip")


def slices(batches, rows: int = 1000):
    """Arrow batches in pieces of at most `rows`: what a task holds of ids and words stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def one_row_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of df with equal keys that with the longest text, then the smallest, then by a hash of all columns; summed up before the shuffle."""
    plain = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    order = F.struct(-F.length(text_or_empty()), text_or_empty(), F.xxhash64(*plain))
    best = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*df.columns).alias("_row"), order.alias("_order"))
    found = best.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_row", "_order").alias("_row"))
    return found.select("_row.*")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(col: str = "doc_id") -> Column:
    """The rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ranked_ranges(df: DataFrame, order: str, value: str | None, parts: int) -> tuple[DataFrame, dict[int, int]]:
    """df range-partitioned and sorted by order, written with its partition as column _part, and the sum of value (or the rows) of all partitions before each. The driver gets one number per partition."""
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    table = materialize(ranged, "ranged")
    sums = table.groupBy("_part").agg((F.sum(value) if value else F.count(F.lit(1))).cast("long").alias("n")).collect()
    before, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in sums):
        before[part] = total
        total += n
    return table, before


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
