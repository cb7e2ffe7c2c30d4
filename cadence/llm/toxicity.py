"""Toxicity by a classifier chain of linear models.

The chain predicts CATEGORIES in turn. Each is a logistic regression on the presence of words that a screening test
picked, on that of their first PREFIXES bytes, as stems take many endings, on four measures of form, and on the probabilities of the categories before it. In training those are
out-of-fold predictions, so a later model sees them as good as they will be on new documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.session import share
from cadence.llm.textkernel import Hasher, Words, distinct_per_row, mix, slices

CATEGORIES = ("low_quality", "toxic", "severe")
#: Most labelled documents that the models are fitted on: those whose hashed ids are lowest.
SAMPLE = 8_000
PREFIXES = (4, 5, 6)
FOLDS, MIN_POSITIVES, MOST_WORDS, LEAST_Z, LEAST_DOCUMENTS, RIDGE, THRESHOLD = 5, 5, 200, 4.5, 3, 1.0, 0.5


@dataclass
class Link:
    """One model: hashes of its words, sorted, and weights of these, of the measures and of earlier probabilities."""

    words: np.ndarray
    word_weights: np.ndarray
    weights: np.ndarray
    bias: float

    def predict(self, hits: np.ndarray, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """hits: for each distinct (row, word) the word's hash."""
        z = dense @ self.weights + self.bias
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hits), len(self.words) - 1)
            found = self.words[at] == hits
            z = z + np.bincount(rows[found], self.word_weights[at[found]], len(dense))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate([x.words for x in self.links])) if self.links else np.zeros(0, np.uint64)

    def predict(self, hits: np.ndarray, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Probabilities, a column for each category."""
        for link in self.links:
            dense = np.column_stack([dense, link.predict(hits, rows, dense)])
        return dense[:, dense.shape[1] - len(self.links) :]


def terms(words: Words, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, rows) of the words, then of the prefixes of each length that longer words have."""
    rows = words.rows()
    yield words.hash, rows
    total = hasher.sums(words.data)
    for n in PREFIXES:
        longer = words.end - words.start > n
        start = words.start[longer]
        yield mix(hasher.spans(total, start, start + n) + np.uint64(n)), rows[longer]


def measures(words: Words) -> np.ndarray:
    """Per row: length, share of bytes in words and in neither words nor white space, mean length of a word."""
    n = np.diff(words.bounds)
    size = np.maximum(1, np.diff(words.offsets))
    total = np.concatenate([[0], np.cumsum(words.end - words.start)])[words.bounds]
    blank = np.concatenate([[0], np.cumsum(words.data <= 32)])[words.offsets]
    inside, white = np.diff(total), np.diff(blank)
    return np.column_stack([np.log1p(n) / 10, inside / size, (size - inside - white) / size, inside / np.maximum(1, n) / 10])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and, last, the bias, by Newton steps, each halved until it lowers the loss; the bias is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def loss(w: np.ndarray) -> float:
        s = x @ w
        return float((np.logaddexp(0, s) - y * s).sum() + 0.5 * (shrink * w * w).sum())

    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        down = x.T @ (y - p) - shrink * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), down)
        size = 1.0
        while (then := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        if then > now:
            break
        w, now = w + size * step, then
        if down @ step < 1e-8:  # twice what is still to be won
            break
    return w


def fit_link(vocabulary: np.ndarray, codes: np.ndarray, rows: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Link:
    """codes, rows: the distinct words of each document, as places in the sorted vocabulary. With too few positives or negatives, a constant.

    Words are picked by how sure it is that they are of one class; among equals those of lower hashes.
    """
    n, pos = len(y), float(y.sum())
    if min(pos, n - pos) < MIN_POSITIVES:
        p = (pos + 0.5) / (n + 1)
        return Link(np.zeros(0, np.uint64), np.zeros(0), np.zeros(dense.shape[1]), float(np.log(p / (1 - p))))
    df = np.bincount(codes, minlength=len(vocabulary))
    hit = np.bincount(codes[y[rows] > 0], minlength=len(vocabulary))
    p = df / n
    z = (hit / pos - (df - hit) / (n - pos)) / np.sqrt(np.maximum(1e-12, p * (1 - p) * (1 / pos + 1 / (n - pos))))
    z[df < LEAST_DOCUMENTS] = 0
    best = np.flatnonzero(np.abs(z) >= LEAST_Z)
    best = np.sort(best[np.lexsort((vocabulary[best], -np.abs(z[best])))[:MOST_WORDS]])
    x = np.zeros((n, len(best)))
    place = np.full(len(vocabulary), -1, np.int32)
    place[best] = np.arange(len(best))
    found = np.flatnonzero(place[codes] >= 0)
    x[rows[found], place[codes[found]]] = 1
    w = logistic(np.column_stack([x, dense]), y)
    return Link(vocabulary[best], w[: len(best)], w[len(best) : -1], float(w[-1]))


def fit_chain(vocabulary: np.ndarray, codes: np.ndarray, rows: np.ndarray, dense: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> Chain:
    """labels: a column of 0 or 1 for each category; folds: the fold of each document."""
    chain = Chain()
    if not len(labels):
        return chain
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        out = np.zeros(len(y))
        for f in np.unique(folds):
            test = folds == f
            if test.all():
                out[:] = (y.sum() + 0.5) / (len(y) + 1)
                break
            place = (np.cumsum(~test) - 1).astype(np.int32)
            used = ~test[rows]
            link = fit_link(vocabulary, codes[used], place[rows[used]], dense[~test], y[~test])
            there = (np.cumsum(test) - 1).astype(np.int32)
            out[test] = link.predict(vocabulary[codes[~used]], there[rows[~used]], dense[test])
        chain.links.append(fit_link(vocabulary, codes, rows, dense, y))
        dense = np.column_stack([dense, out])
    return chain


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            words = hasher.words(data, offsets)
            each = list(terms(words, hasher))
            h, rows = np.concatenate([x for x, _ in each]), np.concatenate([x for _, x in each])
            order = np.argsort(rows, kind="stable")
            h, bounds = distinct_per_row(h[order], np.searchsorted(rows[order], np.arange(hi - lo + 1)))
            dense = measures(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    pa.array([x.tobytes() for x in dense], pa.binary()),
                    *(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", *CATEGORIES)),
                ],
                names=["words", "dense", "doc_id", *CATEGORIES],
            )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain, fitted on at most sample labelled documents that docs has with a text.

    A label row with a null id, quality or toxic is left out; of several rows for one id the highest toxic and the lowest
    quality hold. Severe means toxic and of low quality. A repeated document counts once.
    """
    quality, toxic = F.col("quality") == 0, F.col("toxic") == 1
    present = docs.where("text is not null").select("doc_id")
    known = (
        labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .select("doc_id", quality.cast("int").alias("low_quality"), toxic.cast("int").alias("toxic"), (quality & toxic).cast("int").alias("severe"))
        .join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select("doc_id", F.lower("text").alias("text")).where("text is not null").join(F.broadcast(known), "doc_id")
    table = texts.mapInArrow(_training_rows, "words binary, dense binary, doc_id long, low_quality int, toxic int, severe int").toArrow()
    ids = table["doc_id"].to_numpy()
    order = np.sort(np.unique(ids, return_index=True)[1]) if len(ids) else np.zeros(0, int)
    order = order[np.argsort(ids[order], kind="stable")]
    y = np.column_stack([table[c].to_numpy()[order] for c in CATEGORIES]) if len(order) else np.zeros((0, len(CATEGORIES)))
    dense = np.array([np.frombuffer(table["dense"][i].as_py(), float) for i in order.tolist()])
    held = table["words"].take(pa.array(order)).combine_chunks() if len(order) else pa.array([], pa.binary())
    del table
    ends = np.frombuffer(held.buffers()[1], np.int32)[: len(held) + 1].astype(np.int64) // 8 if len(held) else np.zeros(1, np.int64)
    hashes = np.frombuffer(held.buffers()[2], np.uint64)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(order), dtype=np.int32), np.diff(ends))
    # no model takes a word of fewer than LEAST_DOCUMENTS, so the driver keeps the others alone, as their places among these
    ranked = np.sort(hashes)
    often = ranked[LEAST_DOCUMENTS - 1 :] == ranked[: len(ranked) - LEAST_DOCUMENTS + 1] if len(ranked) >= LEAST_DOCUMENTS else np.zeros(0, bool)
    vocabulary = np.unique(ranked[: len(often)][often])
    del ranked, often
    codes, keep = np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
    for lo in range(0, len(hashes) if len(vocabulary) else 0, 1 << 20):
        some = hashes[lo : lo + (1 << 20)]
        at = np.minimum(np.searchsorted(vocabulary, some), len(vocabulary) - 1)
        codes[lo : lo + len(some)], keep[lo : lo + len(some)] = at, vocabulary[at] == some
    del hashes, held
    codes, rows = codes[keep], rows[keep]
    folds = (ids[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    return fit_chain(vocabulary, codes, rows, dense, y, folds)


class Scorer:
    """A chain at work in one task."""

    def __init__(self, chain: Chain, threshold: float) -> None:
        self.chain, self.threshold, self.hasher, self.vocabulary = chain, threshold, Hasher(), chain.vocabulary()
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.vocabulary >> np.uint64(48)] = True

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each row, and whether it is rejected."""
        words = self.hasher.words(data, offsets)
        n = len(offsets) - 1
        if not self.chain.links:
            return np.full((n, len(CATEGORIES)), np.nan), np.zeros(n, bool)
        keys = [np.zeros(0, np.int64)]
        for h, rows in terms(words, self.hasher) if len(self.vocabulary) else ():
            some = np.flatnonzero(self.maybe[h >> np.uint64(48)])
            at = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
            found = self.vocabulary[at] == h[some]
            keys.append(rows[some[found]] * len(self.vocabulary) + at[found])
        key = np.unique(np.concatenate(keys))
        size = max(1, len(self.vocabulary))
        p = self.chain.predict(self.vocabulary[key % size], key // size, measures(words))
        return p, (p[:, CATEGORIES.index("toxic")] >= self.threshold) & (np.diff(words.bounds) > 0)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_<category> of each category, rejected: one row for each row of docs.

    A null or blank text has the probabilities that the models give to a document without words, and is never rejected.
    Without any labelled document the probabilities are null and nothing is rejected. Rows with a null or repeated id are
    scored like any other, a text of any length whole, so that it must fit a worker; a probability of just the threshold rejects. Other columns of docs are not read.
    """
    spec = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", rejected boolean"
    known = share(docs.sparkSession, chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(known(), threshold)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                p, bad = scorer(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(x, from_pandas=True) for x in p.T), pa.array(bad)], names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, spec)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that the chain doesn't reject.

    Each row is judged by its own text, so no join or shuffle is needed; null and blank texts stay.
    """
    known = share(docs.sparkSession, train(docs, labels))
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(known(), threshold)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("lowered")):
                bad = scorer(data, offsets)[1]
                yield batch.select(names).slice(lo, hi - lo).filter(pa.array(~bad))

    renamed = docs.toDF(*names)
    kept = renamed.withColumn("lowered", F.lower(names[docs.columns.index("text")])).mapInArrow(run, renamed.schema)
    return kept.toDF(*docs.columns)
