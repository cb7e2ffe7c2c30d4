"""Near-duplicates by MinHash with tensored banding.

Two collections of M small groups of A minhashes each are computed. Every pair of a group of the first and a group of the second is the key of one table, so 2 * M * A minhashes give the M * M tables of 2 * A minhashes
each that independent bands would need 2 * A * M * M for. Documents that share a key are candidates; the Jaccard
similarity of their sets of word n-grams decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadence.llm.graph import verified_components
from cadence.llm.session import cut, with_ids
from cadence.llm.textkernel import Hasher, distinct_per_row, list_column, mix, ngrams, slices

SHINGLE, GROUPS, GROUP_SIZE, THRESHOLD = 3, 11, 2, 0.5


def signatures(docs: DataFrame, shingle: int = SHINGLE, groups: int = GROUPS, size: int = GROUP_SIZE, seed: int = 7) -> DataFrame:
    """(id, f1, f2, keys): a 128-bit fingerprint of the word sequence, and the keys of the groups * groups tables.

    Rows without an id or text are left out; those without words have equal fingerprints and no keys.
    """
    random = np.random.default_rng(seed)
    flip = random.integers(0, 1 << 63, 2 * groups * size, dtype=np.uint64)
    factor = random.integers(0, 1 << 63, 2 * groups * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids = batch.column("id")
            for lo, hi, data, offsets in slices(batch.column("text")):
                words = hasher.words(data, offsets)
                has = np.flatnonzero(np.diff(words.bounds) > 0)
                bare = np.flatnonzero(np.diff(words.bounds) == 0)
                if len(bare):
                    none = pa.array(np.zeros(len(bare), np.int64))
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(bare)), none, none, list_column(np.zeros(0, np.int64), np.zeros(len(bare) + 1, np.int64), pa.int64())], names=["id", "f1", "f2", "keys"])
                if not len(has):
                    continue
                h, bounds = ngrams(words, shingle)
                at = bounds[has]
                place = np.arange(len(words.hash)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
                print_ = [np.add.reduceat(mix(words.hash ^ mix(place.astype(np.uint64) + np.uint64(k))), words.bounds[has]) for k in (11, 1 << 40)]
                least = [np.minimum.reduceat((h ^ f) * m, at) for f, m in zip(flip, factor)]
                sides = []
                for side in range(2):
                    for g in range(groups):
                        key = np.full(len(has), side * groups + g + 1, np.uint64)
                        for m in least[(side * groups + g) * size : (side * groups + g + 1) * size]:
                            key = mix(key * np.uint64(0x9FB21C651E98DF25) + m)
                        sides.append(key)
                keys = np.stack([mix(sides[i] * np.uint64(3) + sides[groups + j]) for i in range(groups) for j in range(groups)], 1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(has)), *(pa.array(x.view(np.int64)) for x in print_), list_column(keys.ravel(), np.arange(len(has) + 1) * keys.shape[1], pa.int64())],
                    names=["id", "f1", "f2", "keys"],
                )

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text"))
    return texts.mapInArrow(run, "id long, f1 long, f2 long, keys array<long>")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, n, grams): the distinct n-gram hashes of each document that has an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                values, bounds = distinct_per_row(*ngrams(hasher.words(data, offsets), shingle))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(np.diff(bounds).astype(np.int32)), list_column(values.view(np.int64), bounds, pa.int64())], names=["id", "n", "grams"])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text"))
    return texts.mapInArrow(run, "id long, n int, grams array<long>").where("n > 0")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_id): each document that goes, and the one of its group, of the smallest id, that stays.

    A group is what pairs of Jaccard similarity of at least threshold connect; the similarity is that of the sets of word
    3-grams, a shorter text being one gram. Texts of equal words are always together, and so are texts without words. Rows with a null id or text
    belong to no group. Rows that repeat an id count as that one document, with all their texts. A text of any length is read whole, and must fit a worker. Other columns are not read.
    """
    signed = cut(signatures(docs))
    firsts = signed.withColumn("first", F.min("id").over(W.partitionBy("f1", "f2")))
    exact = cut(firsts.where("id <> first").select("id", "first").distinct())
    single = signed.groupBy("f1", "f2").agg(F.min_by("keys", "id").alias("keys"), F.min("id").alias("id"))
    members = single.select("id", F.explode("keys").alias("bucket"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        sets = cut(shingle_sets(with_ids(docs, ids, "doc_id")).select("id", "n", "grams"))
        x, y = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("grams").alias(f"g_{c}")) for c in "ab")
        shared = F.size(F.array_intersect("g_a", "g_b"))
        return pairs.join(x, "a").join(y, "b").where(shared >= threshold * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b").distinct()

    roots = cut(verified_components(members, verify))
    whole = exact.join(roots.withColumnRenamed("id", "first"), "first", "left").select(F.col("id").alias("doc_id"), F.coalesce("root", "first").alias("kept_id"))
    moved = roots.where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("kept_id"))
    return whole.unionByName(moved).where("doc_id <> kept_id").groupBy("doc_id").agg(F.min("kept_id").alias("kept_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, but for all documents of a group save that of the smallest id.

    Rows with a null id stay. Of rows that repeat both an id and all columns of docs, one stays.
    """
    gone = cut(near_duplicates(docs, threshold).select("doc_id"))
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = with_ids(docs, gone, "doc_id", "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = with_ids(kept, repeated, "doc_id").dropDuplicates(["doc_id", "text"])
    return with_ids(kept, repeated, "doc_id", "left_anti").unionByName(once).select(docs.columns)
