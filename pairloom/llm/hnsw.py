"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one point of the index; of its ids the K + 1 smallest are kept with it, as no other can be among K
nearest (so every row is indexed, and thousands of copies cost one point). Vectors of each length have an index of their
own. Points are dealt to shards by a hash of the vector: as many as there are shuffle partitions, but of at least LEAST
and at most SHARD points on average. A shard inserts its points one after the other in a shuffled order, each into the
levels up to its own (an M-th of a level's points reach the next): it descends greedily from the entry point, then keeps
the EF_BUILD nearest that it meets on each of its levels; M of them that lie in different directions become neighbours,
links go both ways and full lists are cut by the same rule. A shard is written as one file of flat arrays: vectors, ids,
and per level its points and their neighbours, padded. A query descends likewise, keeps EF candidates on level 0, and the
shards' results are merged. Should the graph give a query fewer than it needs, that shard is scanned for it.

All distances are sums of squared differences in double precision, of vectors scaled by one power of two, so that
neither an offset nor a very large or small scale costs accuracy; scaling back is exact.

Queries go in blocks to every shard of their length: the work grows with queries times shards (times the logarithm of a
shard's points), as the contract's query set demands. A task reads a shard's file once for all blocks that it has of it.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of different
lengths have no distance and don't find each other. Rows that repeat an id and vector are one row. Equal distances go to
the smaller id, also across shards, as far as the candidates hold them. A query gets min(K, candidates of its length)
rows. An empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm import store
from pairloom.llm.common import materialize, shared_path, ship

K = 10
SHARD = 32_768
LEAST = 4096
M = 16
EF_BUILD = 64
EF = 200
#: Queries of a block.
BLOCK = 512
LEVELS = 8
#: Links that a list takes beyond its bound before it is cut.
SLACK = 16


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v"), fine.alias("fine")).where("vec_id IS NOT NULL AND fine").drop("fine")


def points(rows: DataFrame, k: int = K) -> DataFrame:
    """v, ids: each different vector with its k + 1 smallest ids. Ranks are cut before the shuffle, so a very common vector is no large group."""
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # -0.0 is 0.0
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.select("vec_id", plain.alias("v")).dropDuplicates().withColumn("r", rank).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _squares(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.einsum("ij,ij->i", d, d)


class Level:
    """The points of a level, in the order of insertion, and their neighbours as places in the shard."""

    def __init__(self, members: np.ndarray, n: int, most: int):
        self.members, self.most = members, most
        self.place = np.full(n, -1, dtype="int32")
        self.place[members] = np.arange(len(members))
        self.near = np.full((len(members), most + SLACK), -1, dtype="int32")
        self.count = np.zeros(len(members), dtype="int32")

    def of(self, p: int) -> np.ndarray:
        at = self.place[p]
        return self.near[at, : self.count[at]]


class Graph:
    """Vectors (scaled, in double precision) and levels, 0 first; points are inserted, or come from a stored shard."""

    def __init__(self, x: np.ndarray, levels: list[Level], entry: int = -1):
        self.x, self.levels, self.entry = x, levels, entry
        self.stamp, self.met = 0, np.zeros(len(x), dtype="int64")

    def _descend(self, q: np.ndarray, down_to: int, top: int) -> tuple[float, int]:
        """The nearest point met by greedy steps on the levels from top to above down_to."""
        best = self.entry
        dist = float(_squares(self.x[best : best + 1], q)[0])
        for l in range(top, down_to, -1):
            while len(near := self.levels[l].of(best)):
                d = _squares(self.x[near], q)
                i = int(d.argmin())
                if d[i] >= dist:
                    break
                best, dist = int(near[i]), float(d[i])
        return dist, best

    def _nearest(self, q: np.ndarray, start: list[tuple[float, int]], l: int, ef: int) -> list[tuple[float, int]]:
        """The ef nearest that a best-first walk on level l meets, nearest first."""
        x, met, level = self.x, self.met, self.levels[l]
        place, near_of, count = level.place, level.near, level.count
        self.stamp += 1
        stamp = self.stamp
        met[[p for _, p in start]] = stamp
        todo, found = list(start), [(-d, -p) for d, p in start]
        heapq.heapify(todo), heapq.heapify(found)
        while todo:
            d, p = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            at = place[p]
            near = near_of[at, : count[at]]
            near = near[met[near] != stamp]
            if not len(near):
                continue
            met[near] = stamp
            ds = _squares(x[near], q)
            if len(found) >= ef:
                keep = ds < -found[0][0]
                near, ds = near[keep], ds[keep]
            for dn, pn in zip(ds.tolist(), near.tolist(), strict=True):
                if len(found) < ef:
                    heapq.heappush(found, (-dn, -pn))
                    heapq.heappush(todo, (dn, pn))
                elif dn < -found[0][0]:
                    heapq.heapreplace(found, (-dn, -pn))
                    heapq.heappush(todo, (dn, pn))
        return sorted((-d, -p) for d, p in found)

    def _diverse(self, q: np.ndarray, own: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
        """Up to m of the points `own` (nearest to q first): one is taken if it is nearer to q than to all taken ones; free places then go to the nearest left."""
        if len(own) <= m:
            return own
        y = self.x[own] - q
        between = dist[:, None] + dist[None, :] - 2 * (y @ y.T)
        closest = np.full(len(own), np.inf)
        taken, left = [], []
        for i, d in enumerate(dist.tolist()):
            if len(taken) < m and d < closest[i]:
                taken.append(i)
                np.minimum(closest, between[i], out=closest)
            else:
                left.append(i)
        return own[(taken + left)[:m]]

    def _link(self, level: Level, p: int, to: int) -> None:
        at = level.place[p]
        n = level.count[at]
        level.near[at, n] = to
        level.count[at] = n + 1
        if n + 1 == level.near.shape[1]:
            self._cut(level, p)

    def _cut(self, level: Level, p: int) -> None:
        own, q = level.of(p), self.x[p]
        dist = _squares(self.x[own], q)
        order = np.argsort(dist, kind="stable")
        kept = self._diverse(q, own[order], dist[order], level.most)
        at = level.place[p]
        level.near[at] = -1
        level.near[at, : len(kept)] = kept
        level.count[at] = len(kept)

    def insert(self, p: int, height: int, m: int, ef: int) -> int:
        """Puts point p into the levels up to its height; returns the new top level. The entry point is on the top level."""
        if self.entry < 0:
            self.entry = p
            return height
        q = self.x[p]
        top = max(l for l, level in enumerate(self.levels) if level.place[self.entry] >= 0)
        start = [self._descend(q, min(height, top), top)]
        for l in range(min(height, top), -1, -1):
            start = self._nearest(q, start, l, ef)
            own, dist = np.array([i for _, i in start]), np.array([d for d, _ in start])
            level = self.levels[l]
            for to in self._diverse(q, own, dist, m).tolist():
                self._link(level, p, to)
                self._link(level, to, p)
        if height > top:
            self.entry = p
        return max(height, top)

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest points found (and those as near as the last one) and their squared distances, nearest first; of all points, if there are no more."""
        top = len(self.levels) - 1
        found = self._nearest(q, [self._descend(q, 0, top)], 0, max(ef, k))
        at, dist = np.array([p for _, p in found]), np.array([d for d, _ in found])
        if len(found) < min(k, len(self.x)):  # what the walk can't reach
            dist = _squares(self.x, q)
            at = np.argsort(dist, kind="stable")
            dist = dist[at]
        last = dist[min(k, len(dist)) - 1]
        return at[dist <= last], dist[dist <= last]


def build(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 7) -> Graph:
    """The graph of the vectors, inserted in a shuffled order."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    height = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(m)).astype(int), LEVELS - 1)
    levels = [Level(order[height[order] >= l].astype("int32"), n, 2 * m if l == 0 else m) for l in range(int(height.max()) + 1)]
    graph = Graph(vectors, levels)
    for p in order.tolist():
        graph.insert(p, int(height[p]), m, ef)
    for level in levels:
        for p in level.members[level.count > level.most].tolist():
            graph._cut(level, p)
    return graph


_HEAD = struct.Struct("<Q")


def stored(graph: Graph, ids: list[list[int]]) -> Iterator[bytes]:
    """A shard's file: the length of a JSON header, the header, and flat arrays."""
    ends = np.cumsum([len(i) for i in ids], dtype="int64")
    arrays = [graph.x, ends, np.array([i for own in ids for i in own], dtype="int64")]
    for level in graph.levels:
        arrays += [level.members, level.near[:, : level.most]]
    head = json.dumps({"entry": graph.entry, "arrays": [[a.dtype.str, list(a.shape)] for a in arrays]}).encode()
    yield _HEAD.pack(len(head)) + head
    for a in arrays:
        yield np.ascontiguousarray(a).tobytes()


def load(uri: str) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph of a stored shard; where each point's ids end, and the ids."""
    with store.Reader(uri) as f:
        (n,) = _HEAD.unpack(f.read(0, _HEAD.size))
        head = json.loads(f.read(_HEAD.size, n))
        at, arrays = _HEAD.size + n, []
        for kind, shape in head["arrays"]:
            size = int(np.dtype(kind).itemsize * np.prod(shape))
            arrays.append(np.frombuffer(f.read(at, size), kind).reshape(shape))
            at += size
    x, ends, ids = arrays[:3]
    levels = []
    for members, near in zip(arrays[3::2], arrays[4::2], strict=True):
        level = Level.__new__(Level)
        level.members, level.near, level.most = members, near, near.shape[1]
        level.place = np.full(len(x), -1, dtype="int32")
        level.place[members] = np.arange(len(members))
        level.count = (near >= 0).sum(axis=1)
        levels.append(level)
    return Graph(x, levels, head["entry"]), ends, ids


def index(pts: DataFrame, shard: int = SHARD, least: int = LEAST, m: int = M, ef: int = EF_BUILD) -> DataFrame:
    """The index's table: dim, shard, shards (of that dim), scale (a power of two), path of the shard's file. Give it a written table."""
    spark = pts.sparkSession
    ship(spark)
    parts, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_path(spark, "hnsw")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    dims = pts.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), largest.alias("largest"))
    shards = F.greatest(F.ceil(F.col("n") / shard), F.least(F.lit(parts), F.ceil(F.col("n") / least)))
    dims = dims.select("dim", shards.cast("long").alias("shards"), F.floor(F.log2("largest")).cast("long").alias("scale"))
    dims = materialize(dims, "dims")
    # A task a shard: shards take long to build and are of like size.
    tasks = dims.agg(F.sum("shards")).first()[0] or 1
    dealt = pts.join(dims, F.size("v") == F.col("dim")).withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")))

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, part = int(key[0]), int(key[1])
        x = np.stack(rows["v"].to_numpy()).astype("float64")
        order = np.lexsort(x.T[::-1])  # whatever order the rows came in
        x = np.ldexp(np.ascontiguousarray(x[order]), -int(rows["scale"].iloc[0]))
        uri = f"{folder}/{dim}-{part}.hnsw"
        store.write_file(uri, stored(build(x, m, ef), [[int(i) for i in rows["ids"].iloc[o]] for o in order]))
        return pd.DataFrame({"dim": [dim], "shard": [part], "shards": [int(rows["shards"].iloc[0])], "scale": [int(rows["scale"].iloc[0])], "path": [uri]})

    dealt = dealt.repartitionByRange(tasks, "dim", "shard")
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(make, "dim int, shard long, shards long, scale long, path string"), "hnsw_shards")


def search(shards: DataFrame, queries: DataFrame, k: int = K, ef: int = EF, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, score: for each query (vec_id, v) and shard up to k rows that are not the query's own, nearest first in each shard."""
    spark = shards.sparkSession
    ship(spark)
    n = queries.count()
    blocks = queries.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // block)))))
    # Blocks are grouped by a hash, so each has about `block` queries.
    packed = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = packed.join(shards, "dim").select("path", "scale", "block", "queries")
    pairs = pairs.repartition(parts, "path", "block").sortWithinPartitions("path", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            for r in rows.itertuples():
                if r.path != held:
                    (graph, ends, ids), held = load(r.path), r.path
                out = []
                for q in r.queries:
                    v = np.ldexp(np.asarray(q["v"], dtype="float64"), -r.scale)
                    got, d = graph.search(v, k + 1, max(ef, k + 1))
                    far = np.ldexp(np.sqrt(d), r.scale).tolist()
                    near = sorted((s, i) for p, s in zip(got.tolist(), far, strict=True) for i in ids[ends[p - 1] if p else 0 : ends[p]].tolist() if i != q["vec_id"])
                    out += [(q["vec_id"], i, s) for s, i in near[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return pairs.mapInPandas(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each query; queries default to the ids divisible by 100."""
    rows = materialize(usable(vectors), "vectors")
    pts = materialize(points(rows, k), "points")
    asked = rows.where(F.col("vec_id") % 100 == 0) if queries is None else usable(queries)
    found = search(index(pts), asked.dropDuplicates(), k)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
