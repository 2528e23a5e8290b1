"""Writing the token ids of documents into coded files and reading them back.

Documents are range-partitioned and sorted by doc_id (null last); each partition becomes one file, written under another
name and renamed, so a task that runs again leaves the same file. The driver gets one row a file: its ids. From
these the first id's number of each file follows. Python makes ids and files; the JVM codes the blocks (TokenCodec.java),
with the same bytes as token_codec.

Defined results: null and empty texts are the end id alone. Rows that repeat a doc_id stay next to each other, the order
among them by text. A text of any length is one document, and its ids may be any unsigned 32-bit numbers. An empty table
gives no file and an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import contextlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import jvm_codec, store
from pairloom.llm.common import documents, materialize, shared_path, ship, slices, text_or_empty
from pairloom.llm.token_codec import BLOCK, MAGIC, counted, docs_part, documents_of, footer, framed, groups_of, read_footer, split_group, stored_counts
from pairloom.llm.tokenize import default_tokenizer, encoder

END_ID = 2
#: Bytes of ids that a batch of rows holds when files are read.
BATCH = 8 << 20
#: Blocks that the JVM codes at once: a million ids.
PIECE = 256
#: Bytes of the memo of words; what has one does no coding, and so has room for more.
MEMO = 256 << 20


def _groups(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """What the JVM codes: places in a base, in pieces; `stored` is the base as a file has it, with a group's first piece. At last the documents."""
    enc, end = encoder(path, MEMO), np.array([end_id], "<u4").tobytes()
    batches = slices(batches)
    first = next(batches, None)
    if first is None:
        return

    def docs() -> Iterator[tuple[object, bytes]]:
        batch = first
        while batch is not None:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                yield doc, ids + end
            batch = next(batches, None)

    def row(places=b"", ids=b"", counts=b"", stored=None, docs=None, n_docs=0, n_tokens=0) -> pa.RecordBatch:
        binary = [pa.array([x], pa.binary()) for x in (places, ids, counts, stored, docs)]
        return pa.RecordBatch.from_arrays([*binary, pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=_PIECES)

    names, sizes = [], []
    for data in groups_of(docs(), names, sizes):
        stored, ids, counts, places = counted(np.frombuffer(data, "<u4"))
        stored, kind = framed(len(ids), stored, zlib.crc32(stored)), "<u2" if len(ids) <= 1 << 16 else "<u4"
        ids, counts = ids.astype("<u4").tobytes(), counts.astype("<u4").tobytes()
        for at in range(0, len(places), PIECE * BLOCK):
            own = places[at : at + PIECE * BLOCK].astype(kind)
            yield row(own.tobytes(), ids, counts, None if at else stored, n_tokens=len(own))
    yield row(docs=docs_part(names, sizes, first.schema.field("doc_id").type), n_docs=len(names))


_PIECES = ["places", "ids", "counts", "stored", "docs", "n_docs", "n_tokens"]


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    rows = (r for b in batches for r in zip(*[b.column(c) for c in ("blocks", "stored", "docs", "n_docs", "n_tokens")], strict=True))
    first = next(rows, None)
    if first is None:
        return
    counts = {"n_docs": 0, "n_tokens": 0}

    def chunks() -> Iterator[bytes]:
        yield MAGIC
        at, places = len(MAGIC), []
        for r in itertools.chain([first], rows):
            blocks, stored, docs, n_docs, n_tokens = (x.as_py() for x in r)
            counts["n_docs"] += n_docs
            counts["n_tokens"] += n_tokens
            if docs is not None:
                yield footer(docs, places)
                return
            if stored is not None:
                places.append((at, 0, 0))
            offset, ids, n = places[-1]
            places[-1] = offset, ids + n_tokens, n + -(-n_tokens // BLOCK)
            for x in (stored or b"", blocks):
                at += len(x)
                yield x
        raise ValueError("the documents are missing")

    uri = f"{folder}/part-{part:08d}.tok"
    size = store.write_file(uri, chunks())
    yield pa.RecordBatch.from_pydict({"part": [part], "path": [uri], **{k: [v] for k, v in counts.items()}, "n_bytes": [size]})


@contextlib.contextmanager
def _other_workers(spark: SparkSession) -> Iterator[None]:
    """Functions made meanwhile run in Python workers of their own: the others keep their memos, and no more workers get one."""
    env = spark.sparkContext.environment
    env["PAIRLOOM_WORKERS"] = "files"
    try:
        yield
    finally:
        del env["PAIRLOOM_WORKERS"]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The files' table: part, path, n_docs, n_tokens, n_bytes, start (ids in all files before)."""
    spark = docs.sparkSession
    ship(spark)
    jvm_codec.register(spark)
    path = tokenizer or default_tokenizer()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    order = [F.asc_nulls_last("doc_id"), F.col("text")]
    ranged = rows.repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
    pieces = ranged.mapInArrow(lambda it: _groups(it, path, end_id), "places binary, ids binary, counts binary, stored binary, docs binary, n_docs long, n_tokens long")
    coded = pieces.select(jvm_codec.encoded("places", "ids", "counts").alias("blocks"), "stored", "docs", "n_docs", "n_tokens")
    schema = "part long, path string, n_docs long, n_tokens long, n_bytes long"
    with _other_workers(spark):
        files = coded.mapInArrow(lambda it: _write(it, folder), schema)
    files = materialize(files, "token_files")
    before, at = {}, 0
    for part, n in sorted((r[0], r[1]) for r in files.select("part", "n_tokens").collect()):
        before[part] = at
        at += n
    if not before:
        return files.withColumn("start", F.lit(0).cast("long"))
    starts = spark.createDataFrame(list(before.items()), "part long, start long")
    return files.join(F.broadcast(starts), "part")  # one row a file, as collected


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the JVM decodes: a file's documents and start, then its blocks in pieces, with the ids and counts of their base."""

    def row(blocks=b"", ids=b"", counts=b"", docs=None, start=0) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in (blocks, ids, counts, docs)], pa.array([start], pa.int64())], names=["blocks", "base", "counts", "docs", "start"])

    for b in batches:
        for uri, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
            with store.Reader(uri) as reader:
                docs, groups = read_footer(reader)
                yield row(docs=docs, start=start)
                for offset, size, n in groups:
                    stored, pieces = split_group(reader.read(offset, size), n, PIECE)
                    ids, counts = (x.astype("<u4").tobytes() for x in stored_counts(stored))
                    for piece in pieces:
                        yield row(piece, ids, counts)


def _read(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows = (tuple(x.as_py() for x in r) for b in batches for r in zip(b.column("ids"), b.column("docs"), b.column("start"), strict=True))
    for _, docs, start in rows:  # a file's first row; documents_of takes those of its ids
        names, starts, sizes, ids, held = [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(names, id_type), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"],
            )

        for name, own in documents_of(docs, (r[0] for r in rows)):
            names.append(name)
            starts.append(start)
            sizes.append(len(own) // 4)
            ids.append(own)
            start += len(own) // 4
            held += len(own)
            if held >= BATCH:
                yield batch()
                names, starts, sizes, ids, held = [], [], [], [], 0
        yield batch()


def read_tokens(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids of each document in the files; each file is a task's work."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(id_type))
    n = max(1, files.count())
    jvm_codec.register(files.sparkSession)
    blocks = files.select("part", "path", "start").repartitionByRange(n, "part").mapInArrow(_blocks, "blocks binary, base binary, counts binary, docs binary, start long")
    decoded = blocks.select(jvm_codec.decoded("blocks", "base", "counts").alias("ids"), "docs", "start")
    with _other_workers(files.sparkSession):
        return decoded.mapInArrow(lambda it: _read(it, kind), f"doc_id {id_type}, start long, n_tokens long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    files = write_tokens(docs, shared_path(spark, "tokens"))
    back = read_tokens(files, dict(docs.dtypes)["doc_id"])
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
