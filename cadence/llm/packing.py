"""Packing documents into training sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost, the sum of squared lengths of its pieces. Pieces are
taken longest first; each goes to the open sequence that has room in every respect and that the rule prefers.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.session import cut


class Capacity(NamedTuple):
    tokens: int = 4096
    documents: int = 32
    attention: int = 4096 * 4096 // 2
    #: Longer documents are cut into pieces of this many tokens.
    piece: int = 2048


#: Sequences that one task fills; pieces are dealt to tasks by hash, so every task sees the whole range of lengths.
SEQUENCES_PER_GROUP = 1024


def best_fit(sizes: np.ndarray, capacity: Capacity, rule: str = "norm") -> np.ndarray:
    """The sequence of each piece; sizes in the order in which they are placed.

    rule norm takes the sequence whose weighted residual after placing is the shortest vector; dot takes the one whose residual has the greatest
    weighted dot product with the piece. Both in shares of the capacities, each weighted with the pieces' mean
    share of it; ties go to the oldest sequence.
    """
    need = np.stack([sizes, np.ones(len(sizes), np.int64), sizes * sizes], 1).astype(np.int64)
    limit = np.array(capacity[:3], np.int64)
    weight = (need / limit).mean(0) if len(need) else np.ones(3)
    smallest = need.min(0) if len(need) else limit
    out = np.empty(len(sizes), np.int64)
    room = np.empty((0, 3), np.int64)  # of the open sequences
    name = np.empty(0, np.int64)
    made = 0
    for i, x in enumerate(need):
        fits = np.flatnonzero((room >= x).all(1))
        if len(fits):
            if rule == "norm":
                at = fits[np.argmin(np.square((room[fits] - x) / limit) @ weight)]
            else:
                at = fits[np.argmax((room[fits] / limit) @ (weight * x / limit))]
            room[at] -= x
            out[i] = name[at]
            if (room[at] < smallest).any():
                room, name = np.delete(room, at, 0), np.delete(name, at)
        else:
            out[i] = made
            if ((limit - x) >= smallest).all():
                room, name = np.vstack([room, limit - x]), np.append(name, made)
            made += 1
    return out


def pack(docs: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", tokens: Column | None = None, sequences: int = SEQUENCES_PER_GROUP) -> DataFrame:
    """A row for each sequence: group, sequence, doc_ids, starts, lengths, n_tokens, n_docs, attention_cost.

    The piece doc_ids[i] holds lengths[i] tokens from token starts[i] on. tokens is the number of tokens of a row, words between white
    space unless given. Every token of every row is in exactly one piece; rows without tokens are in none. A null id stays null in
    doc_ids. Rows that repeat an id are packed each. Other columns are not read.
    """
    if capacity.piece > min(capacity.tokens, math.isqrt(capacity.attention)) or min(capacity) < 1:
        raise ValueError("a piece must fit into an empty sequence")
    n = F.coalesce(tokens if tokens is not None else F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")).where("n > 0")
    pieces = pieces.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity.piece).cast("long"))).alias("start"), "n")
    pieces = cut(pieces.select("doc_id", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity.piece)).alias("size")))
    total = pieces.agg(F.greatest(F.sum("size") / capacity.tokens, F.count("*") / capacity.documents, F.sum(F.col("size").cast("double") * F.col("size")) / capacity.attention)).first()[0] or 0
    groups = max(1, math.ceil(total / sequences))

    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy(zero_copy_only=False)
        known = table["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        keys = table["doc_id"].fill_null(-1).to_numpy()
        start, size = table["start"].to_numpy(), table["size"].to_numpy()
        order = np.lexsort((start, keys, ~known, -size))
        start, size, keys, known = start[order], size[order], keys[order], known[order]
        del ids
        where = best_fit(size, capacity, rule)
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(where.max() + 2 if len(where) else 1))
        cuts = pa.array(bounds.astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order], mask=m)) for x, m in ((keys, ~known[order]), (start, None), (size, None))]
        count = len(bounds) - 1
        sums = lambda x: pa.array(np.add.reduceat(x[order], bounds[:-1]) if count else np.zeros(0, np.int64))
        return pa.table(
            {
                "group": pa.array(np.full(count, table["group"][0].as_py(), np.int64)), "sequence": pa.array(np.arange(count)), "doc_ids": lists[0], "starts": lists[1], "lengths": lists[2],
                "n_tokens": sums(size), "n_docs": pa.array(np.diff(bounds)), "attention_cost": sums(size * size),
            }
        )

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, "group long, sequence long, doc_ids array<long>, starts array<long>, lengths array<long>, n_tokens long, n_docs long, attention_cost long")
