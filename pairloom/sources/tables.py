"""Written intermediate tables: they cut the lineage, survive lost executors and are computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_leaves: set[str] = set()


def _base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = tempfile.mkdtemp(prefix="pairloom-tables-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the application's part of the shared folder, which goes when the application ends."""
    spark = df.sparkSession
    own = f"{_base(spark)}/{spark.sparkContext.applicationId}-tables"
    if own not in _leaves:
        _leaves.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        folder = path.getFileSystem(spark._jsc.hadoopConfiguration())
        folder.mkdirs(path)
        folder.deleteOnExit(path)
    at = f"{own}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
