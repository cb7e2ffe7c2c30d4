"""Connected components and verified groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadence.llm.session import cut, drop


#: Most edges, of 16 bytes each, whose components the driver finds; those of more are found by rounds of joins.
DRIVER_EDGES = 500_000


def _components_of(edges: pa.Table) -> pa.Table:
    """(id, root) of a few edges (u, v), v the smaller end: roots sink along edges, and by jumps to roots of roots."""
    u, v = (edges[c].to_numpy() for c in ("u", "v"))
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for end in (root[a], root[b], a, b):
            np.minimum.at(root, end, low)
        root = root[root]
        if (root == before).all():
            return pa.table({"id": ids, "root": ids[root]})


def connected_components(edges: DataFrame, few: int = DRIVER_EDGES) -> DataFrame:
    """(id, root) for every id in edges (a, b); root is the smallest id that it is connected with.

    Alternates large-star and small-star steps, so rounds grow with the logarithm of the longest path; up to `few` edges are brought to the driver instead, with the
    same result. Self-loops and repeated edges are allowed; null ends are dropped; no edges give no rows.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    if e.count() <= few:
        found = edges.sparkSession.createDataFrame(_components_of(e.toArrow()), "id long, root long")
        drop(e)
        return found
    seen, last = None, e
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.withColumn("m", F.least("u", F.min("v").over(W.partitionBy("u"))))
        e = low.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.withColumn("m", F.min("v").over(W.partitionBy("u")))
        e = low.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, e = last, cut(e)
        drop(before)
        last = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now == seen or now[0] == 0 or now[0] == now[2] and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def verified_components(members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, root) of the groups that verified pairs within buckets connect; members has (bucket, id).

    verify takes distinct pairs (a, b), a < b, and returns those that hold. Each bucket's ids are first compared with its
    smallest id alone, which settles a bucket of true copies in as many comparisons as it has ids. Where a comparison
    fails, every pair of that bucket that the first comparisons did not connect is compared too, so the result is that of
    comparing all pairs in all buckets.
    """
    stars = members.withColumn("a", F.min("id").over(W.partitionBy("bucket"))).withColumnRenamed("id", "b").where("a < b")
    stars = cut(stars.groupBy("a", "b").agg(F.collect_set("bucket").alias("buckets")))
    first = cut(verify(stars.select("a", "b")).select("a", "b"))
    failed = stars.join(first, ["a", "b"], "left_anti")
    roots = connected_components(first)
    odd = cut(failed.select(F.explode("buckets").alias("bucket")).distinct())
    if odd.isEmpty():
        return roots
    ids = members.join(odd, "bucket", "left_semi").distinct().join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    ids = cut(ids)
    pairs = (
        ids.alias("x").join(ids.alias("y"), "bucket").where("x.id < y.id and x.root <> y.root")
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")
    )
    second = cut(verify(pairs).select("a", "b"))
    return roots if second.isEmpty() else connected_components(first.unionByName(second))
