"""Exact dedup against a persistent digest index. DataFrame functions only.

Texts are equal when they are the same after deleting ASCII white space; null is an empty text. The index is a Parquet
table bucketed and sorted by the SHA-256 of that text. New documents are grouped by digest, groups that the index has
are found by a sort-merge anti-join, and the others are appended.

Defined results: of equal texts in one batch the row with most code points stays, then the smallest doc_id (null last);
a text that an earlier batch brought stays with that batch's document. Rows that repeat a doc_id with an equal text are
one document given several times: each gets a row, one of them is kept. An empty table gives an empty result. Only
doc_id and text are read, so further columns don't matter.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import SPACE, bounded_broadcast, documents, materialize, one_row_each, shared_path, split_join, text_or_empty, unused

#: Least buckets of an index; digests a bucket should hold; how much an index is expected to grow; files a bucket before it is written anew.
BUCKETS = 32
BUCKET_ROWS = 4_000_000
GROWTH = 8
FILES = 16


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, f"{SPACE}+", "").cast("binary"), 256))


class DigestIndex:
    """The stored index: digest, keep_id, n_points; bucketed and sorted by digest in a folder of path.

    The number of buckets is chosen when the first rows come, for GROWTH times as many of them, unless it is given; it
    stands in the folder's name, so a later session that opens the same path has it. When the appends have left more than
    FILES files a bucket, the index is written anew, one file a bucket, in a folder of the next generation. The newest
    generation that was written whole counts.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path, self.wanted, self.id_type = spark, path, buckets, id_type
        self.table: str | None = None
        stored = self._folders()
        if stored:
            self._open(*max(stored))

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _folders(self) -> list[tuple[int, int]]:
        """(generation, buckets) of what was written whole."""
        files, path = self._fs()
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        found = [re.fullmatch(r"generation-(\d+)-buckets-(\d+)", n) for n in names]
        return [(int(m[1]), int(m[2])) for m in found if m]

    def _open(self, generation: int, buckets: int, new: str = "") -> None:
        self.generation, self.buckets = generation, buckets
        self.folder = f"{self.path}/generation-{generation}-buckets-{buckets}{new}"
        self.table = "digest_index_" + hashlib.md5(self.folder.encode()).hexdigest()[:16]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {self.id_type}, n_points INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.folder}'"
        )

    def expect(self, rows: int) -> None:
        """Chooses the buckets of a new index for its first rows."""
        if self.table is None:
            self._open(0, self.wanted or max(BUCKETS, 1 << max(0, (GROWTH * rows // BUCKET_ROWS).bit_length())))

    def read(self) -> DataFrame:
        self.expect(0)
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """One file a bucket at most: the rows are dealt out by their buckets."""
        self.expect(0)
        self._insert(rows)
        if len(self.read().inputFiles()) > FILES * self.buckets:
            self.compact()

    def _insert(self, rows: DataFrame) -> None:
        # By the bucket's own number: dealt by digest, each of more partitions than buckets would write a file in every bucket.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        rows.select("digest", "keep_id", "n_points").repartitionById(self.buckets, bucket).write.insertInto(self.table)

    def compact(self) -> None:
        """Writes the index anew under a name that doesn't count yet, renames it, and takes the old one away."""
        old, generation = self.folder, self.generation + 1
        # As plain files: of a table with buckets Spark takes the dealing out below to be done, then reads it file by file.
        rows = self.spark.read.schema(self.read().schema).parquet(old)
        self.close()
        files, _ = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        made = f"{self.path}/generation-{generation}-buckets-{self.buckets}"
        files.delete(path(made + "-new"), True)  # of an attempt that failed
        self._open(generation, self.buckets, "-new")
        self._insert(rows)
        self.close()
        files.rename(path(made + "-new"), path(made))
        self._open(generation, self.buckets)
        files.delete(path(old), True)

    def close(self) -> None:
        """Takes the table out of the session's catalog; the files stay."""
        if self.table is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            self.table = None


def _groups(per_doc: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.isnull("doc_id").alias("no_id"), "doc_id"))
    return (
        per_doc.groupBy("digest")
        .agg(best.alias("best"), F.sum("copies").alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("n_points"), "group_size")
    )


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """A row per row of docs: doc_id, digest, keep_id, group_size (rows of docs with that text), kept. The index has the new texts then.

    Giving the same documents again changes nothing: the document that the index names is kept again.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", F.length(text).alias("n_points"), digest_of(text).alias("digest"))
    # By digest and id first: a text that a third of all rows share isn't one task's work.
    per_doc = materialize(
        rows.groupBy("digest", "doc_id").agg(F.max("n_points").alias("n_points"), F.count(F.lit(1)).alias("copies")), "digests"
    )
    groups = materialize(_groups(per_doc), "digest_groups")
    index.expect(groups.count())
    fresh = groups.join(index.read().select("digest").hint("merge"), "digest", "left_anti")
    index.append(materialize(fresh, "digests_new"))
    resolved = materialize(
        groups.select("digest", "group_size").join(index.read().select("digest", "keep_id").hint("merge"), "digest"),
        "digest_keeps",
    )
    return (
        split_join(per_doc.select("digest", "doc_id", "copies"), resolved, "digest", "group_size", "doc_id")
        .select("doc_id", "digest", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
        .drop("copy")
    )


def new_index(docs: DataFrame, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    spark = docs.sparkSession
    return DigestIndex(spark, path or shared_path(spark, "digest_index"), buckets, dict(docs.dtypes)["doc_id"])


def keep_first(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat a doc_id and an equal text the longest, then the smallest text."""
    own = index or new_index(docs)
    found = deduplicate(docs, own)
    if index is None:
        own.close()
    gone = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")), "digests_gone")
    named = materialize(found.where("kept").select("doc_id", "digest"), "digests_kept")
    # A document given several times is in both: it loses its further rows only.
    again = materialize(
        gone.join(named, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest")), "left_semi").distinct(), "digests_again"
    )
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, digest_of(text_or_empty()))
    names = {c: unused(keyed, c) for c in ("_id", "_digest")}
    gone, again = (x.select(*[F.col(c).alias(names[c]) for c in names]) for x in (gone, again))
    same = F.col("doc_id").eqNullSafe(F.col(names["_id"])) & (F.col(key) == F.col(names["_digest"]))
    if again.isEmpty():
        return keyed.join(bounded_broadcast(gone, 64), same, "left_anti").drop(key)
    id_type = F.col(names["_id"])
    only_gone = gone.join(
        again.select(id_type.alias("_a"), F.col(names["_digest"]).alias("_b")),
        id_type.eqNullSafe(F.col("_a")) & (F.col(names["_digest"]) == F.col("_b")),
        "left_anti",
    )
    single = keyed.join(only_gone, same, "left_anti")
    rest = single.join(again, same, "left_anti")
    return rest.unionByName(one_row_each(single.join(again, same, "left_semi"), ["doc_id", key])).drop(key)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = new_index(docs)
    found = deduplicate(docs, index)
    index.close()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
"""
