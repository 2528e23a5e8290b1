"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits in a ring of 4 segments of 16. If two fingerprints differ in at most 3 bits, the pigeonring
principle gives a segment from which every chain of 1, 2, 3 and 4 consecutive segments differs in at most 3/4 bit a
segment: 0, 1, 2 and 3 bits. So the first segment is equal and, of the second, at least one half is: these 24 bits are
the key of an index, 8 keys a fingerprint. Pairs with a key in common are checked chain by chain before the full
Hamming distance. What a key's fingerprints link is returned as a spanning forest, never as all pairs; keys with very
many fingerprints are split into pairs of blocks, so that no task has an unbounded group.

Defined results: null text is empty; texts without words have fingerprint 0. A bit that exactly half of the shingles have
is 0. Very long texts are counted in pieces, whole. Rows that repeat a doc_id each get a row.
component_id is null only if all of a component's ids are null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import bounded_broadcast, documents, materialize, one_row_each, ship, slices, split_join, unused
from pairloom.llm.components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints of one key that a task compares at once; beyond it a key is split into blocks of half this size.
GROUP = 4096
#: Shingles whose bits are counted at once; texts of more bytes than TEXT are counted piece by piece.
_BITS = 1 << 14
TEXT = 1 << 20


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each bit is set in each run of hashes; bit 63 first. No run is empty."""
    bits = np.unpackbits(hashes.astype(">u8").view("uint8").reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype="int64")


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, in pieces of bounded size."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, dtype="int64")
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), _BITS):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _BITS], ends[i : i + _BITS], strict=True)]
        counts += _bit_counts(np.array(part, dtype="uint64"), np.zeros(1, dtype="int64"))[0]
    return int(np.packbits(2 * counts > len(starts)).view(">u8")[0])


def fingerprint_batch(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of many texts; short ones share the counting of bits."""
    out = np.zeros(len(texts), dtype="uint64")
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    begins: list[int] = []
    rows: list[int] = []

    def flush() -> None:
        if rows:
            starts = np.array(begins, dtype="int64")
            counts = _bit_counts(np.array(hashes, dtype="uint64"), starts)
            sizes = np.diff(np.append(starts, len(hashes)))
            out[rows] = np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8")[:, 0]
        hashes.clear(), begins.clear(), rows.clear()

    for row, text in enumerate(texts):
        if not text:
            continue
        if len(text) > TEXT:
            out[row] = fingerprint_of(text, shingle)
            continue
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype="int64", count=len(words)) + 1)
        k = min(shingle, len(words))
        starts = [0, *ends[: len(words) - k].tolist()]
        stops = (ends[k - 1 :] - 1).tolist()
        rows.append(row)
        begins.append(len(hashes))
        hashes.extend([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
        if len(hashes) >= _BITS:
            flush()
    flush()
    return out


def _fingerprint_arrow(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = b.column("text").to_pylist()
        prints = fingerprint_batch(texts, shingle).astype("int64", casting="unsafe")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(prints, pa.int64())], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed long), a row per row of docs."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda it: _fingerprint_arrow(it, shingle), f"doc_id {kind}, text_hash long, fp long")


def ring_keys(fps: DataFrame) -> DataFrame:
    """fp, key: 8 rows each. A key holds the chain's start (2 bits), the half (1 bit), the segment (16), the half's bits (8)."""
    segment = lambda i: F.shiftrightunsigned("fp", 48 - 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))
    keys = []
    for i in range(4):
        for half in (0, 1):
            near = F.shiftrightunsigned(segment(i + 1), 8) if half == 0 else segment(i + 1).bitwiseAND(F.lit(0xFF))
            keys.append(F.shiftleft(F.lit(2 * i + half).cast("long"), 24) + F.shiftleft(segment(i), 8) + near)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _pops(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype("int16")


def chain_pass(x: np.ndarray, start: int, distance: int = DISTANCE) -> np.ndarray:
    """Of XORed fingerprints, those whose chain from segment start stays within 3/4 bit a segment, ring-wise to the full distance."""
    ok = np.ones(len(x), dtype=bool)
    total = np.zeros(len(x), dtype="int16")
    for length in range(1, 5):
        seg = (x >> np.uint64(48 - 16 * ((start + length - 1) % 4))) & np.uint64(0xFFFF)
        total += _pops(seg)
        ok &= total <= (length * distance) // 4
        if not ok.any():
            break
    return ok


def _forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps: breadth first, each step against what is not reached yet."""
    left = np.unique(fps)
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = chain_pass(left ^ at, start)
            if hit.any():
                found = left[hit]
                left = left[~hit]
                front.extend(found)
                out.extend((int(at), int(f)) for f in found)
    return out


def _links_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key (and block pair): links of each run of equal keys."""
    kept_key, kept_fp = np.zeros(0, dtype="int64"), np.zeros(0, dtype="uint64")
    kept_pair = np.zeros(0, dtype="int64")

    def solve(key: np.ndarray, pair: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        begin, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
        size = end - begin
        a: list[int] = []
        b: list[int] = []
        two = begin[size == 2]
        for start in range(4):
            at = two[(key[two] >> 25) == start]
            ok = at[chain_pass(fp[at] ^ fp[at + 1], start)]
            a += fp[ok].tolist()
            b += fp[ok + 1].tolist()
        for s, e in zip(begin[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            for x, y in _forest(fp[s:e], int(key[s] >> 25)):
                a.append(x)
                b.append(y)
        cast = lambda v: pa.array(np.array(v, dtype="uint64").astype("int64", casting="unsafe"), pa.int64())
        return pa.RecordBatch.from_arrays([cast(a), cast(b)], names=["a", "b"])

    for batch in batches:
        key = np.concatenate((kept_key, batch.column("key").to_numpy(zero_copy_only=False)))
        pair = np.concatenate((kept_pair, batch.column("pair").to_numpy(zero_copy_only=False)))
        fp = np.concatenate((kept_fp, batch.column("fp").to_numpy(zero_copy_only=False).astype("uint64", casting="unsafe")))
        if not len(key):
            continue
        last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield solve(key[:cut], pair[:cut], fp[:cut])
        kept_key, kept_pair, kept_fp = key[cut:], pair[cut:], fp[cut:]
    if len(kept_key):
        yield solve(kept_key, kept_pair, kept_fp)


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """a, b: enough links among the distinct fingerprints fps (column fp) to connect all that lie within 3 bits, step by step."""
    spark = fps.sparkSession
    ship(spark)
    keys = ring_keys(fps)
    hot = materialize(keys.groupBy("key").count().where(F.col("count") > group), "hot_keys")
    hot = bounded_broadcast(hot.select("key", F.ceil(F.col("count") * 2 / group).cast("int").alias("blocks")), 32)
    dealt = keys.join(hot, "key", "left")
    # A member of a hot key goes to each pair of blocks that its own block is in.
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("own"))
    pairs = F.transform(others, lambda j: F.least(j, F.col("own")).cast("long") * F.col("blocks") + F.greatest(j, F.col("own")))
    dealt = dealt.withColumn("own", own).withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.select("key", "pair", "fp").repartition(parts, "key", "pair").sortWithinPartitions("key", "pair")
    return rows.mapInArrow(_links_arrow, "a long, b long")


def components(docs: DataFrame, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """doc_id, text_hash, fp, component_id for each row of docs."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "fps")
    labels = connected_components(links(distinct.select("fp"), group))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "n", "least_id", F.coalesce("label", "fp").alias("label"))
    named = materialize(named, "fp_labels")
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    table = materialize(named.join(least, "label").select("fp", "n", "component_id"), "fp_components")
    return split_join(prints, table, "fp", "n", "doc_id").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id. Of several rows with a component's smallest doc_id
    that with the longest text stays, then the smallest text. Rows without an id stay."""
    found = materialize(components(docs, **how), "near_components")
    hashed, names = unused(docs, "_hash"), {}
    keyed = docs.withColumn(hashed, F.xxhash64("text"))
    names = {c: unused(keyed, f"_{c}") for c in ("doc_id", "text_hash")}

    def marked(rows: DataFrame, name: str) -> DataFrame:
        return materialize(rows.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct(), name)

    same = (F.col("doc_id") == F.col(names["doc_id"])) & (F.col(hashed) == F.col(names["text_hash"]))
    gone = marked(found.where("doc_id <> component_id"), "near_copies")
    rest = keyed.join(bounded_broadcast(gone, 24), same, "left_anti")
    first = found.where("doc_id = component_id")
    twice = first.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    twice = marked(first.join(twice, F.col("doc_id") == F.col("_id"), "left_semi"), "near_same")
    if not twice.isEmpty():
        rest = rest.join(twice, same, "left_anti").unionByName(one_row_each(rest.join(twice, same, "left_semi"), ["doc_id"]))
    return rest.drop(hashed)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
