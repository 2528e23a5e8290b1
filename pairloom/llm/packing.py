"""Bounded-space online packing of documents into token windows.

Each partition keeps a fixed number of open windows. A document's ids and its end id are cut into whole windows and a
rest; the rest goes into the open window where it fits best. If it fits in none and no further window may be opened,
the fullest is topped up with the head of that rest and emitted, and the tail goes on. What is open at a partition's
end is merged: the open windows of up to MERGE partitions are packed again in one task, in rounds, until one group is
left; its last windows are filled one after the other and the final remainder becomes windows whose lengths are powers
of two, which need no padding. No document is moved between tasks but those leftovers, at most `windows` a partition.

Defined results: null and empty texts are the end id alone. Rows that repeat a doc_id are packed each. An empty table
gives an empty result. Very long texts become as many windows as they need, in time and memory that grow with their
length only. Only doc_id and text are read. Window numbers depend on how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import documents, shared_path, ship, slices, text_or_empty
from pairloom.llm.tokenize import default_tokenizer, encoder

SIZE = 2048
WINDOWS = 16
END_ID = 1
#: Partitions (or groups of them) whose leftovers one task merges.
MERGE = 64
#: Tokens of closed windows that a task holds before it hands them on.
HELD = 1 << 20

_PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, part long"


class Packer:
    """Places pieces (doc, start, ids, doc_tokens); emits (doc, start, ids, doc_tokens, window, offset, open) for whole windows."""

    def __init__(self, windows: int, size: int, first: int):
        self.windows, self.size, self.next = windows, size, first
        self.open: list[list] = []  # [tokens in it, its pieces]
        self.out: list[tuple] = []
        self.held = 0  # tokens in out

    def _emit(self, pieces: list[tuple], is_open: bool = False) -> None:
        at = 0
        for doc, start, ids, doc_tokens in pieces:
            self.out.append((doc, start, ids, doc_tokens, self.next, at, is_open))
            at += len(ids) // 4
        self.held += at
        self.next += 1

    def add(self, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        """A piece; ids as bytes. Whole windows are cut from it in one walk, however long it is."""
        size, whole = self.size, len(ids) // (4 * self.size)
        for k in range(whole):
            self._emit([(doc, start + k * size, ids[4 * k * size : 4 * (k + 1) * size], doc_tokens)])
        start, ids = start + whole * size, ids[4 * whole * size :]
        while ids:
            n = len(ids) // 4
            best = max((w for w in self.open if w[0] + n <= size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.windows:
                self.open.append(best := [0, []])
            if best is not None:
                best[0] += n
                best[1].append((doc, start, ids, doc_tokens))
                if best[0] == size:
                    self._emit(best[1])
                    self.open = [w for w in self.open if w is not best]
                return
            full = max(self.open, key=lambda w: w[0])
            gap = size - full[0]
            self._emit([*full[1], (doc, start, ids[: 4 * gap], doc_tokens)])
            self.open = [w for w in self.open if w is not full]
            start, ids = start + gap, ids[4 * gap :]

    def leave_open(self) -> None:
        for _, pieces in self.open:
            self._emit(pieces, True)
        self.open = []

    def close(self) -> None:
        """Fills the open windows one after the other; the remainder becomes windows of falling powers of two."""
        rest = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, start, ids, doc_tokens = rest.pop(0)
                n = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], doc_tokens))
                if n < len(ids) // 4:
                    rest.insert(0, (doc, start + n, ids[4 * n :], doc_tokens))
                room -= n
            self._emit(window)

    def take(self, id_type: pa.DataType, part: int) -> pa.RecordBatch:
        rows, self.out, self.held = self.out, [], 0
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays(
            [
                pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array([len(x) // 4 for x in cols[2]], pa.int64()),
                pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()),
                pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.bool_()), pa.array([part] * len(rows), pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open", "part"],
        )


def _first(level: int, part: int) -> int:
    """Window numbers: 24 bits of partition and 28 of count below the level."""
    return ((level << 24) | part) << 28


def _pack_texts(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, windows: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    enc, packer, end = encoder(path), Packer(windows, size, _first(0, part)), np.array([end_id], "<u4").tobytes()
    kind = pa.int64()
    for b in slices(batches):
        kind = b.schema.field("doc_id").type
        for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
            packer.add(doc, 0, ids + end, len(ids) // 4 + 1)
            if packer.held >= HELD:
                yield packer.take(kind, part)
        yield packer.take(kind, part)
    packer.leave_open()
    yield packer.take(kind, part)


def _merge(batches: Iterator[pa.RecordBatch], level: int, size: int, windows: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and then longest piece first; each group's windows go on to be open in it."""
    packer, group, kind = None, None, pa.int64()

    def end() -> pa.RecordBatch:
        packer.close() if last else packer.leave_open()
        return packer.take(kind, group)

    for b in batches:
        kind = b.schema.field("doc_id").type
        cols = [b.column(c).to_pylist() for c in ("group", "doc_id", "start", "ids", "doc_tokens")]
        for g, doc, start, ids, doc_tokens in zip(*cols, strict=True):
            if g != group:
                if packer is not None:
                    yield end()
                packer, group = Packer(windows, size, _first(level, g)), g
            packer.add(doc, start, ids, doc_tokens)
    if packer is not None:
        yield end()


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, size: int = SIZE, windows: int = WINDOWS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, {_PIECE}"
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def written(df: DataFrame, name: str) -> DataFrame:
        at = shared_path(spark, name)
        df.write.partitionBy("open").option("compression", "zstd").parquet(at)
        return spark.read.schema(schema).parquet(at)

    level = 0
    table = written(rows.mapInArrow(lambda it: _pack_texts(it, path, end_id, size, windows), schema), "packed")
    done = [table.where(~F.col("open"))]
    while True:
        left = table.where("open")
        most = left.agg(F.max("part")).first()[0]
        if most is None:
            break
        level += 1
        last = most < MERGE
        grouped = left.withColumn("group", F.expr(f"part div {MERGE}"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = grouped.repartition(1 if last else parts, "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "start")
        merged = order.select("group", "doc_id", "start", "ids", "doc_tokens").mapInArrow(
            lambda it, level=level, last=last: _merge(it, level, size, windows, last), schema
        )
        table = written(merged, "packed")
        done.append(table.where(~F.col("open")))
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open", "part")


def pieces(docs: DataFrame) -> DataFrame:
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(documents(spark, sf_dir))
