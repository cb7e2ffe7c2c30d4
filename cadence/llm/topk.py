"""Exact top-k by dual-tree search over cover trees.

Vectors are compared by cosine, which on unit vectors orders like distance. Data are dealt to shards around pivots, queries to
blocks around the same pivots, and each shard and block has a cover tree, whose nodes hold a centre and a covering radius. A pair of a query node and
a data node is skipped when even its nearest points, by the triangle inequality, are farther apart than the worst k-th distance that any query below the
query node has so far; leaves meet in one matrix product. Each block is first searched in a shard around its own pivot; the bounds found
there decide which other shards it has to meet at all, first by pivots, of which there are few whatever the size of the table, then by shards. A block of queries travels to the shards,
as there are fewer queries than data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadence.llm.session import cut, share

K, EVERY, SHARD, BLOCK, LEAF = 10, 20, 8192, 1024, 256
#: Most pivots, and the rows that they are picked from; every row is dealt to the nearest.
PIVOTS, SAMPLE = 1024, 8192
#: Scores are rounded to this many places, and ties in the rounded score go to the lower id.
PLACES = 9
_SLACK = 1e-7


@dataclass
class Node:
    """Rows start to end of a tree's vectors."""

    start: int
    end: int
    centre: np.ndarray
    radius: float
    children: list["Node"] = field(default_factory=list)

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Centres and radii of the children, or of a leaf itself."""
        some = self.children or [self]
        if not hasattr(self, "_reach"):
            self._reach = np.array([c.centre for c in some]), np.array([c.radius for c in some])
        return self._reach


def spread_points(x: np.ndarray, most: int, radius: float = 0.0, first: int = 0) -> tuple[list[int], np.ndarray]:
    """Points picked one after the other as the farthest from those before, until all are within radius; and which of them each row is nearest to."""
    near, owner, picked, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64), [], first
    while len(picked) < most and (len(picked) < 2 or near.max() > radius):
        d = np.sqrt(np.maximum(0, np.square(x - x[at]).sum(1)))
        owner[d < near] = len(picked)
        near = np.minimum(near, d)
        picked.append(at)
        at = int(np.argmax(near))
    return picked, owner


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[Node, np.ndarray]:
    """The tree and the order of rows that it is made for. Children of a node lie at least half its radius apart and cover all its points, so radii fall with depth."""
    order = np.arange(len(x))

    def build(start: int, end: int) -> Node:
        own = x[order[start:end]]
        centre = own[np.argmin(np.square(own - own.mean(0)).sum(1))]
        distance = np.sqrt(np.square(own - centre).sum(1))
        node = Node(start, end, centre, float(distance.max()))
        if end - start <= leaf or node.radius < 1e-9:
            return node
        picked, owner = spread_points(own, 16, node.radius / 2, int(np.argmax(distance)))
        by = np.argsort(owner, kind="stable")
        order[start:end] = order[start:end][by]
        sizes = np.bincount(owner, minlength=len(picked))
        ends = start + np.cumsum(sizes)
        node.children = [build(int(e - n), int(e)) for n, e in zip(sizes, ends) if n]
        return node

    return build(0, len(x)), order


class Best:
    """The k best (score, id) of each query so far, by rounded score and then id."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id, self.k = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), k

    def add(self, start: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all ids for the queries from start on; -inf for none."""
        least = self.score[start : start + len(score), -1]
        rows = np.flatnonzero(score.max(1) >= least - 10.0**-PLACES)
        if not len(rows):
            return
        some = np.round(score[rows], PLACES)
        bar = least[rows]
        if some.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(some, some.shape[1] - self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((some >= bar[:, None]) & (some > -np.inf))
        old = np.repeat(np.arange(len(rows)), self.k)
        r, s, i = np.concatenate([old, r]), np.concatenate([self.score[start + rows].ravel(), some[r, c]]), np.concatenate([self.id[start + rows].ravel(), ids[c]])
        order = np.lexsort((i, -s, r))
        r = r[order]
        place = np.arange(len(r)) - np.searchsorted(r, np.arange(len(rows)))[r]
        order = order[place < self.k]
        self.score[start + rows], self.id[start + rows] = s[order].reshape(-1, self.k), i[order].reshape(-1, self.k)

    def worst(self, start: int, end: int) -> float:
        """The greatest k-th distance of these queries, with room for what rounds to the same score."""
        s = self.score[start:end, -1].min()
        return np.inf if s == -np.inf else float(np.sqrt(max(0.0, 2 - 2 * s + 3 * 10.0**-PLACES))) + _SLACK


def search(q: Node, d: Node, qx: np.ndarray, qid: np.ndarray, dx: np.ndarray, did: np.ndarray, best: Best) -> int:
    """Brings best up to date with the queries of q against the data of d; returns how many leaf pairs were compared."""
    compared = 0
    stack = [(float(np.sqrt(np.square(q.centre - d.centre).sum())) - q.radius - d.radius, q, d)]
    while stack:
        gap, a, b = stack.pop()
        if gap > best.worst(a.start, a.end):
            continue
        if not a.children and not b.children:
            compared += 1
            score = qx[a.start : a.end] @ dx[b.start : b.end].T
            own = qid[a.start : a.end][:, None] == did[b.start : b.end][None, :]
            score[own] = -np.inf
            best.add(a.start, score, did[b.start : b.end])
            continue
        split_a = bool(a.children) and (not b.children or a.radius >= b.radius)
        split_b = bool(b.children) and not split_a
        (ca, ra), (cb, rb) = a.reach() if split_a else (a.centre[None], np.array([a.radius])), b.reach() if split_b else (b.centre[None], np.array([b.radius]))
        gaps = np.sqrt(np.square(ca[:, None] - cb[None]).sum(2)) - ra[:, None] - rb[None]
        pairs = [(float(gaps[i, j]), x, y) for i, x in enumerate(a.children if split_a else [a]) for j, y in enumerate(b.children if split_b else [b])]
        # the nearest pair is searched first, as it tightens the bounds most
        pairs.sort(key=lambda p: -p[0])
        stack += pairs
    return compared


def _unpacked(ids: bytes, vectors: bytes, width: int, leaf: int) -> tuple[np.ndarray, np.ndarray, Node, np.ndarray]:
    """Ids, vectors and tree of a shard or block, and the order that its rows were brought into."""
    ids, x = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, width)
    tree, order = cover_tree(x, leaf)
    return ids[order], np.ascontiguousarray(x[order]), tree, order


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_PACKED = "region int, part int, ids binary, vectors binary, centre array<double>, radius double, reach double"
#: Blocks that visit a shard in one task.
VISITS = 64
_FOUND = "vec_id long, neighbor_id long, score double"


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): the k other vectors of greatest cosine for each query, which is a vector whose id is divisible by `every`.

    Scores are rounded to PLACES places; equal ones rank by id. Fewer than k others give fewer rows. Rows with a null id or vector, with a null or
    non-finite element, of length zero or of another width than most rows are left out; among widths of equally many rows the least counts. Of rows that repeat an id the
    first by its elements counts; equal vectors of different ids are neighbours. Other columns are not read. A vector, however wide, must fit a worker.
    """
    spark = vectors.sparkSession
    clean = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    clean = clean.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < 1e300) and exists(v, x -> x <> 0)")
    sizes = clean.groupBy(F.size("v").alias("n")).agg(F.countDistinct("vec_id").alias("c")).orderBy(F.desc("c"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbor_id long, score double")
    width, count = sizes["n"], sizes["c"]
    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt(np.square(x).sum(1, keepdims=True))

    rows = clean.where(F.size("v") == width)
    sample = unit(np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, 8 * -(-count // shard))).collect()], float))
    picked, _ = spread_points(sample, min(pivots, -(-count // shard), len(sample)))
    centres = sample[picked]
    around = share(spark, centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = around()
        for batch in batches:
            x = unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            blob = pa.Array.from_buffers(pa.binary(8 * width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([pa.array(np.argmax(x @ near.T, 1).astype(np.int32)), batch.column("vec_id"), blob.cast(pa.binary())], names=["region", "vec_id", "v"])

    placed = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(place, "region int, vec_id long, v binary"))

    def pack(rows: pa.Table) -> pa.Table:
        """A shard or block as one row: ids and vectors by id, centre and radius, and how far its vectors are from the pivot."""
        rows = rows.sort_by("vec_id")
        region = rows["region"][0].as_py()
        x = np.frombuffer(b"".join(rows["v"].to_pylist()), np.float64).reshape(-1, width)
        centre = x[np.argmin(np.square(x - x.mean(0)).sum(1))]
        far = lambda c: float(np.sqrt(np.square(x - c).sum(1).max()))
        blobs = [pa.array([v.tobytes()], pa.binary()) for v in (rows["vec_id"].to_numpy(), x)]
        return pa.Table.from_arrays([pa.array([region], pa.int32()), pa.array([rows["part"][0].as_py()], pa.int32()), *blobs, pa.array([centre.tolist()]), pa.array([far(centre)]), pa.array([far(around()[region])])], names=["region", "part", "ids", "vectors", "centre", "radius", "reach"])

    def packed(rows: DataFrame, size: int) -> DataFrame:
        """The rows of each region in parts of about size, by a hash of their ids, each part as one row."""
        counts = rows.groupBy("region").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
        parts = rows.join(F.broadcast(counts), "region").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
        return cut(parts.groupBy("region", "part").applyInArrow(pack, _PACKED))

    shards = packed(placed, shard)
    blocks = packed(placed.where(F.col("vec_id") % every == 0), block)
    if blocks.isEmpty():
        return spark.createDataFrame([], "vec_id long, rank int, neighbor_id long, score double")

    # each block in one shard of its own region first
    homes = shards.groupBy("region").agg((F.max("part") + 1).alias("parts"))
    query = blocks.select("region", F.col("part").alias("block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "centre", "radius", "reach")))
    at_home = query.join(F.broadcast(homes), "region").withColumn("part", F.pmod("block", "parts")).drop("parts").join(shards.select("region", "part", "ids", "vectors"), ["region", "part"])
    kept = ["region", "block", "part", "q_centre", "q_radius", "q_reach"]
    begun_schema = pa.schema([("region", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("q_centre", pa.list_(pa.float64())), ("q_radius", pa.float64()), ("q_reach", pa.float64()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("scores", pa.binary()), ("found", pa.binary()), ("worst", pa.float64())])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            qid, qx, qt, _ = _unpacked(row["q_ids"], row["q_vectors"], width, LEAF // 4)
            did, dx, dt, _ = _unpacked(row["ids"], row["vectors"], width, LEAF)
            best = Best(len(qid), k)
            search(qt, dt, qx, qid, dx, did, best)
            out = {c: row[c] for c in kept} | {"q_ids": qid.tobytes(), "q_vectors": qx.tobytes(), "scores": best.score.tobytes(), "found": best.id.tobytes(), "worst": min(4.0, best.worst(0, len(qid)))}
            yield pa.RecordBatch.from_pylist([out], schema=begun_schema)

    begun = cut(at_home.mapInArrow(begin, "region int, block int, part int, q_centre array<double>, q_radius double, q_reach double, q_ids binary, q_vectors binary, scores binary, found binary, worst double"))

    # regions that can hold a neighbour of a region's queries: at most PIVOTS rows each
    data_reach = {r["region"]: r["reach"] for r in shards.groupBy("region").agg(F.max("reach").alias("reach")).collect()}
    query_reach = {r["region"]: (r["reach"], r["worst"]) for r in begun.groupBy("region").agg(F.max("q_reach").alias("reach"), F.max("worst").alias("worst")).collect()}
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    meet = [(a, b) for a, (reach, worst) in sorted(query_reach.items()) for b, other in sorted(data_reach.items()) if apart[a, b] - reach - other <= worst + _SLACK]
    regions = spark.createDataFrame(meet, "region int, to int")
    gap = F.sqrt(F.aggregate(F.zip_with("q_centre", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, z: s + z)) - F.col("q_radius") - F.col("radius")
    ends = shards.select(F.col("region").alias("to"), F.col("part").alias("to_part"), "centre", "radius")
    visits = begun.drop("q_ids", "q_vectors", "scores", "found").join(F.broadcast(regions), "region").join(ends, "to")
    visits = visits.where((gap <= F.col("worst") + _SLACK) & ((F.col("region") != F.col("to")) | (F.col("part") != F.col("to_part"))))
    visits = cut(visits.select("region", "block", "to", "to_part", gap.alias("gap")))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's own row comes first, then one for each block that visits it; what beats a query's bounds goes on."""
        data = None
        for row in _rows(batches):
            if row["ids"] is not None:
                data = _unpacked(row["ids"], row["vectors"], width, LEAF)
                continue
            did, dx, dt, _ = data
            qid, qx, qt, order = _unpacked(row["q_ids"], row["q_vectors"], width, LEAF // 4)
            best = Best(len(qid), k)
            best.score[:] = np.frombuffer(row["scores"], np.float64).reshape(-1, k)[order]
            best.id[:] = np.frombuffer(row["found"], np.int64).reshape(-1, k)[order]
            before = best.id.copy()
            search(qt, dt, qx, qid, dx, did, best)
            new = (best.score > -np.inf) & ~(best.id[:, :, None] == before[:, None, :]).any(2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, new.sum(1))), pa.array(best.id[new]), pa.array(best.score[new])], names=["vec_id", "neighbor_id", "score"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            qid, score, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["scores"], np.float64).reshape(-1, k), np.frombuffer(row["found"], np.int64).reshape(-1, k)
            keep = score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, keep.sum(1))), pa.array(ids[keep]), pa.array(score[keep])], names=["vec_id", "neighbor_id", "score"])

    # a shard that many blocks visit is sent to as many tasks as that takes
    at = ["to", "to_part", "salt"]
    tasks = visits.groupBy("to", "to_part").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("tasks"))
    blank = lambda *cs: [F.lit(None).cast("binary").alias(c) for c in cs]
    heads = shards.select(F.col("region").alias("to"), F.col("part").alias("to_part"), "ids", "vectors").join(tasks, ["to", "to_part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    heads = heads.select(*at, F.lit(-9.0).alias("gap"), "ids", "vectors", *blank("q_ids", "q_vectors", "scores", "found"))
    salt = F.pmod(F.xxhash64("region", "block"), F.col("tasks")).cast("int").alias("salt")
    guests = visits.join(tasks, ["to", "to_part"]).select("region", "block", "to", "to_part", salt, "gap").join(begun.select("region", "block", "q_ids", "q_vectors", "scores", "found"), ["region", "block"])
    guests = guests.select(*at, "gap", *blank("ids", "vectors"), "q_ids", "q_vectors", "scores", "found")
    rows = heads.unionByName(guests).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *at).sortWithinPartitions(*at, "gap")
    found = begun.select("q_ids", "scores", "found").mapInArrow(known, _FOUND).unionByName(rows.mapInArrow(across, _FOUND))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id")))
    return ranked.where(F.col("rank") <= k).select("vec_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "score")
