"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of test items.

Every passage of every document is a query. Impacts are divided by the score that an item has for its own text, so one
threshold, a share of that score, serves all items; retrieval is of all items above it, not of the best few.

A passage is two consecutive runs of words, each as long as the longest item, so an item's copy lies whole in one of a
document's overlapping passages. The index has its items in aligned blocks and keeps every term's greatest impact in each.
Retrieval prunes twice without loss. The pivot: common terms together can't lift an item to the threshold, so rare ones must
supply what it lacks; only blocks with postings of a passage's rare terms are looked at. The block maxima: those of the rare
terms, as shares of what the items lack, are summed for each passage and block, for all passages of a slice at once, and a block that can't
reach the threshold is skipped. In the others the items are scored, by lists in order of their maxima, and given up as soon
as the lists to come can't lift them to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.session import cut, share, with_ids
from cadence.llm.textkernel import Hasher, buffers, mix, slices

K1, B, BLOCK, THRESHOLD, OVERLAP = 1.2, 0.75, 4, 0.5, 0.6
#: Items of one broadcast index; a larger benchmark is searched in as many passes over the documents as it has such parts.
ITEMS_PER_INDEX = 100_000


@dataclass
class Index:
    """Some items. blocks[b] has for each term its greatest impact in block b and its postings there, item to impact.

    rare_block and rare_max at rare_bounds[t]:rare_bounds[t + 1] are the blocks of a rare term t, with its maxima as
    shares of what the items lack; words are the pairs of words of questions and answers.
    """

    ids: np.ndarray
    words: list[tuple[np.ndarray, np.ndarray]]
    terms: np.ndarray
    blocks: list[dict[int, tuple[float, dict[int, float]]]]
    rare_bounds: np.ndarray
    rare_block: np.ndarray
    rare_max: np.ndarray
    longest: int
    threshold: float


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence or line is the answer, what is before it the question; a single sentence is cut in its middle."""
    ends = [m.end() for m in re.finditer(r"[.?!]\s+|\n+", text.strip())]
    if ends:
        return text.strip()[: ends[-1]], text.strip()[ends[-1] :]
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


def bigrams(h: np.ndarray) -> np.ndarray:
    """Hashes of word pairs; of the word itself where there is one only."""
    return h if len(h) < 2 else mix(h[:-1] * np.uint64(3) + h[1:])


def _hashes(texts: list[str]) -> list[np.ndarray]:
    words = Hasher().words(*buffers(pa.array(texts, pa.string())))
    return [words.hash[a:b] for a, b in zip(words.bounds, words.bounds[1:])]


def document_frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Terms, the items that have each, items with words, words."""
    each = [h for h in _hashes(texts) if len(h)]
    terms, df = np.unique(np.concatenate([np.unique(h) for h in each] or [np.zeros(0, np.uint64)]), return_counts=True)
    return terms, df, len(each), sum(map(len, each))


def build_index(ids: list[int | None], texts: list[str], terms: np.ndarray, df: np.ndarray, n: int, total: int, threshold: float) -> Index:
    """The index of some items under statistics of all. Items without words are left out."""
    hashes = _hashes(texts)
    use = [i for i, h in enumerate(hashes) if len(h)]
    hashes = [hashes[i] for i in use]
    sides = [question_and_answer(texts[i]) for i in use]
    words = [(bigrams(q), bigrams(a)) for q, a in zip(_hashes([q for q, _ in sides]), _hashes([a for _, a in sides]))]
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    t, item, impact = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, h in enumerate(hashes):
        term, tf = np.unique(h, return_counts=True)
        at = np.searchsorted(terms, term)
        w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) * n / total))
        t.append(at)
        item.append(np.full(len(at), i))
        impact.append(w / w.sum())
    t, item, impact = map(np.concatenate, (t, item, impact))
    order = np.lexsort((item, t))
    t, item, impact = t[order], item[order], impact[order]
    rare = df <= max(2, 0.05 * n)
    common = np.bincount(item[~rare[t]], impact[~rare[t]], len(hashes))
    # an item that common terms alone lift to the threshold counts as reached by any of its rare terms
    need = np.maximum(threshold - common, 1e-3)
    some = np.flatnonzero(rare[t])
    scaled = impact[some] / need[item[some]]
    if (common >= threshold).any():
        every = np.flatnonzero((common >= threshold)[item])
        some, scaled = np.concatenate([some, every]), np.concatenate([scaled, np.ones(len(every))])
    key, at = np.unique(t[some] * (len(hashes) // BLOCK + 1) + item[some] // BLOCK, return_inverse=True)
    top = np.zeros(len(key))
    np.maximum.at(top, at, scaled)
    rt, rb = key // (len(hashes) // BLOCK + 1), key % (len(hashes) // BLOCK + 1)
    blocks: list[dict] = [{} for _ in range(len(hashes) // BLOCK + 1)]
    for x, i, w in zip(t.tolist(), item.tolist(), impact.tolist()):
        most, postings = blocks[i // BLOCK].get(x, (0.0, {}))
        blocks[i // BLOCK][x] = (max(most, w), postings | {i: w})
    longest = max(map(len, hashes), default=1)
    return Index(np.array([ids[i] for i in use], np.int64), words, terms, blocks, np.searchsorted(rt, np.arange(len(terms) + 1)), rb, top, longest, threshold)


def score_block(index: Index, block: int, terms: list[int]) -> list[tuple[int, float]]:
    """(item, score) of the block's items that the distinct terms score at least the threshold."""
    least, here = index.threshold - 1e-12, index.blocks[block]
    lists = sorted((here[t] for t in terms if t in here), key=lambda x: -x[0])
    rest = sum(x[0] for x in lists)
    scores: dict[int, float] = {}
    for most, postings in lists:
        if rest >= least:  # a new item can still get there
            for i, w in postings.items():
                scores[i] = scores.get(i, 0.0) + w
        else:
            for i in [i for i, s in scores.items() if s + rest < least]:
                del scores[i]
            if not scores:
                return []
            for i in scores:
                scores[i] += postings.get(i, 0.0)
        rest -= most
    return [(i, s) for i, s in scores.items() if s >= least]


def _search(index: Index, batches: Iterator[pa.RecordBatch], overlap: float) -> Iterator[pa.RecordBatch]:
    hasher, run = Hasher(), index.longest
    maybe = np.zeros(1 << 20, bool)
    maybe[index.terms >> np.uint64(44)] = True
    blocks = int(index.rare_block.max()) + 1 if len(index.rare_block) else 1
    counts = np.diff(index.rare_bounds)
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            words = hasher.words(data, offsets)
            n = np.diff(words.bounds)
            some = np.flatnonzero(maybe[words.hash >> np.uint64(44)])
            if not len(some) or not len(index.ids):
                continue
            at = np.minimum(np.searchsorted(index.terms, words.hash[some]), len(index.terms) - 1)
            ok = index.terms[at] == words.hash[some]
            some, at = some[ok], at[ok]
            row = np.searchsorted(words.bounds, some, "right") - 1
            first = np.concatenate([[0], np.cumsum(n // run + 2)])  # one run stays empty between rows
            cell = first[row] + (some - words.bounds[row]) // run
            # the block maxima of each distinct (run, rare term)
            live = counts[at] > 0
            key = np.unique(cell[live] * len(index.terms) + at[live])
            c, t = key // len(index.terms), key % len(index.terms)
            k = counts[t]
            pick = np.repeat(index.rare_bounds[t], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            where, inverse = np.unique(np.repeat(c, k) * blocks + index.rare_block[pick], return_inverse=True)
            sums = np.bincount(inverse, index.rare_max[pick], len(where))
            # a passage is a run and the next; the block may occur in either alone
            there = np.minimum(np.searchsorted(where, where + blocks), len(where) - 1)
            both = sums + np.where(where[there] == where + blocks, sums[there], 0)
            alone = np.isin(where - blocks, where, invert=True) & (sums >= 1 - 1e-9)
            passages = np.unique(np.concatenate([where[both >= 1 - 1e-9], where[alone & (where // blocks > first[np.searchsorted(first, where // blocks, "right") - 1])] - blocks]))
            order = np.argsort(cell, kind="stable")
            cell, at = cell[order], at[order]
            found: dict[tuple[int, int], list[float]] = {}
            now, terms = -1, []
            for passage in passages.tolist():
                p, block = divmod(passage, blocks)
                if p != now:
                    a, b = np.searchsorted(cell, [p, p + 2])
                    now, terms, have = p, np.unique(at[a:b]).tolist(), None
                for item, score in score_block(index, block, terms):
                    if have is None:
                        r = int(np.searchsorted(first, p, "right")) - 1
                        begin = words.bounds[r] + (p - first[r]) * run
                        have = words.hash[begin : min(begin + 2 * run, words.bounds[r + 1])]
                        have = np.concatenate([bigrams(have), have])
                    q, s = (float(np.isin(x, have).mean()) if len(x) else 1.0 for x in index.words[item])
                    if min(q, s) >= overlap:
                        best = found.setdefault((r, item), [0.0, 0.0, 0.0])
                        best[:] = max(best, [score, q, s])
            if found:
                ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array([r for r, _ in found])), pa.array(index.ids[[i for _, i in found]]), *(pa.array([x[k] for x in found.values()]) for k in range(3))],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )


def contaminated(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, part: int = ITEMS_PER_INDEX) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document that holds a test item.

    score is the best passage's BM25 score as a share of the item's own; the overlaps are the shares of the question's and the answer's word pairs in
    that passage, both at least overlap. Null or blank texts, and rows with a null id on either side, match nothing. Items of equal
    text are each reported, and of passages that score alike the one of greater overlaps. A text of any length is read whole, and must fit a worker. Rows that repeat an id are one document. An empty benchmark gives
    no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    items = bench.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    parts = max(1, -(-items.count() // part))
    take = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items for k in range(parts)]
    terms, df, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
    for x in take:
        new, count, m, w = document_frequencies(x.toArrow()["text"].to_pylist())
        terms, at = np.unique(np.concatenate([terms, new]), return_inverse=True)
        df, n, total = np.bincount(at, np.concatenate([df, count]), len(terms)).astype(np.int64), n + m, total + w
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    out = None
    for x in take:
        rows = x.toArrow()
        index = share(spark, build_index(rows["item_id"].to_pylist(), rows["text"].to_pylist(), terms, df, n, total, threshold))
        found = texts.mapInArrow(lambda batches, index=index: _search(index(), batches, overlap), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose id contaminated() doesn't report; rows with a null id stay."""
    gone = cut(contaminated(docs, bench).select("doc_id").distinct())
    return with_ids(docs, gone, "doc_id", "left_anti").select(docs.columns)
