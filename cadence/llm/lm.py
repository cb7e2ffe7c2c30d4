"""Language-model scores by deleted interpolation.

The model predicts each word of a text from the two before. Maximum-likelihood estimates of word 3-, 2- and 1-grams and a uniform one are mixed; the
weights depend on the bucket of how often the two words before occur, a bucket for each power of two. They are learned by expectation-maximisation on the events of
held-out documents, under counts of the others. A text is scored under counts of all documents, from which the one event that is predicted is deleted, so a text
that occurs once doesn't predict itself.

All events are shuffled once, packed, to the part of their middle word, where every count that they need is at hand but that of single words; words of many events are spread over
several parts, to which counts of their contexts go along. Parts give sums for blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.session import cut, share
from cadence.llm.textkernel import Hasher, mix, slices

HELD_OUT, ROUNDS, BUCKETS = 50, 12, 24
#: Most words that are told apart as 1-grams: the most frequent. All others together are one class, within which they are equally likely; in longer n-grams they are told apart by 31 bits.
VOCABULARY = 1 << 20
#: Events of a part, about; words of more than half of it are spread.
PART = 1_000_000
#: Held-out events are told apart by their estimates in half powers of two, so that there are at most BUCKETS * 64**3 kinds, whatever the corpus.
STEP, LEVELS = 2, 64
_FLUSH, _ROWS, _BLOCK, _RARE = 1 << 20, 1 << 15, 12, np.uint32(1 << 31)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed planes of their bytes."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(arrays[0]).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, sizes = int.from_bytes(blob[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(blob[8:], n * sum(sizes), codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    ends = n * np.cumsum(sizes)
    return [np.ascontiguousarray(raw[e - n * s : e].reshape(s, n).T).view(k).ravel() for e, s, k in zip(ends, sizes, kinds)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word in train and held-out rows, merged within the task up to some millions; word 0 stands for the beginning of a text that has words."""

    def merged(parts: list) -> list:
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(key, np.bincount(at, np.concatenate([c for _, c in parts]), len(key)).astype(np.int64))]

    def rows(parts: list) -> Iterator[pa.RecordBatch]:
        for key, counts in merged(parts):
            word, held = (key >> np.uint64(1)).view(np.int64), key & np.uint64(1) == 1
            for i in range(0, len(key), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(word[s]), pa.array(np.where(held[s], 0, counts[s])), pa.array(np.where(held[s], counts[s], 0))], names=["word", "train", "held"])

    hasher, parts, size = Hasher(), [], 0
    for batch in batches:
        held = batch.column("held").to_numpy(zero_copy_only=False).astype(np.uint64)
        for lo, hi, data, offsets in slices(batch.column("text")):
            words = hasher.words(data, offsets)
            n = np.diff(words.bounds)
            own = held[lo:hi]
            key, counts = np.unique(np.concatenate([_named(words.hash) << np.uint64(1) | np.repeat(own, n), own[n > 0]]), return_counts=True)
            parts.append((key, counts))
            size += len(key)
            if size > 1 << 21:
                parts = merged(parts)
                size = len(parts[0][0])
                if size > 1 << 20:
                    yield from rows(parts)
                    parts, size = [], 0
    if parts:
        yield from rows(parts)


def _named(h: np.ndarray) -> np.ndarray:
    """Words by 63 bits, none of them 0."""
    return np.maximum(h >> np.uint64(1), np.uint64(1))


class Model:
    """The words that are told apart, by falling count, and the totals; number 0 is the beginning of a text."""

    def __init__(self, words: np.ndarray, every: np.ndarray, train: np.ndarray, starts: int, rare: tuple[int, int, int], part: int) -> None:
        order = np.lexsort((words, -every))
        self.every, self.train = (np.concatenate([[0], x[order]]) for x in (every, train))
        by = np.argsort(words[order])
        self.sorted, self.number = words[order][by], (by + 1).astype(np.uint32)
        self.types, self.rare, self.rare_train = rare
        self.n, self.n_train = int(self.every.sum()) + self.rare, int(self.train.sum()) + self.rare_train
        self.parts = max(1, -(-self.n // part))
        middle = self.every.copy()
        middle[0] = starts
        self.salts = np.maximum(1, -(-2 * middle // part)).astype(np.int64)
        self.uniform = 1 / (len(words) + self.types + 1)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        h = _named(h)
        if not len(self.sorted):
            return _RARE | (h >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.number[at], _RARE | (h >> np.uint64(32)).astype(np.uint32))

    def spread(self, v: np.ndarray) -> np.ndarray:
        """Over how many parts the events of middle words are spread."""
        return np.where(v < _RARE, self.salts[np.minimum(v, len(self.salts) - 1)], 1)

    def part(self, v: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (mix(v.astype(np.uint64) << np.uint64(20) | salt.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)

    def single(self, w: np.ndarray, deleted: bool) -> np.ndarray:
        """Estimates of 1-grams: with an event deleted from all counts, or of train counts."""
        known = w < _RARE
        at = np.where(known, w, 0)
        if deleted:
            return np.where(known, self.every[at] - 1, (self.rare - 1) / max(1, self.types)) / max(1, self.n - 1)
        return np.where(known, self.train[at], self.rare_train / max(1, self.types)) / max(1, self.n_train)


def _ratio(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(d > 0, n / np.maximum(1, d), 0.0)


def _bucket(d: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(d + 1.0))).astype(np.int64)


def learn_weights(kinds: np.ndarray, counts: np.ndarray, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """(bucket, 4): weights of the uniform, 1-, 2- and 3-gram estimates, from kinds of held-out events and how often they occur. A bucket without any has equal ones."""
    bucket = kinds >> 18
    level = np.stack([kinds >> s & 63 for s in (0, 6, 12)], 1)
    p = np.column_stack([np.full(len(kinds), uniform), np.where(level > 0, 2.0 ** (-(level - 1) / STEP), 0.0)])
    weights = np.full((BUCKETS, 4), 0.25)
    for _ in range(rounds):
        share_of = weights[bucket] * p
        share_of *= (counts / share_of.sum(1))[:, None]
        got = np.stack([np.bincount(bucket, share_of[:, k], BUCKETS) for k in range(4)], 1)
        some = got.sum(1) > 0
        weights[some] = got[some] / got[some].sum(1, keepdims=True)
    return weights


def _events(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, kind, base, blob): packed events of each part (0), contexts of middle words that are spread (1), and, by the block of rows, what rows there are (2)."""
    hasher = Hasher()
    base, held_rows, pieces, size, roster = None, None, [], 0, []

    def flush() -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        if pieces:
            v, u, w, row = (np.concatenate([p[k] for p in pieces]) for k in range(4))
            spread = model.spread(v)
            part = model.part(v, np.where(spread > 1, mix(w.astype(np.uint64)).astype(np.int64) & 0x7FFFFFFF, 0) % spread)
            order = np.argsort(part << 32 | v.astype(np.int64))
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for s in np.split(order, cuts):
                out.append((int(part[s[0]]), 0, base, _packed(np.diff(v[s], prepend=np.uint32(0)), u[s], w[s], row[s])))
            hot = np.flatnonzero(spread > 1)
            if len(hot):
                pair, at, n = np.unique(v[hot].astype(np.uint64) << np.uint64(32) | u[hot], return_inverse=True, return_counts=True)
                train = np.bincount(at, row[hot] < _ROWS, len(pair)).astype(np.int64)
                copies = model.spread((pair >> np.uint64(32)).astype(np.uint32))
                each = np.repeat(np.arange(len(pair)), copies)
                salt = np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
                part = model.part((pair >> np.uint64(32)).astype(np.uint32)[each], salt)
                order = np.argsort(part, kind="stable")
                for s in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    e = each[s]
                    out.append((int(part[s[0]]), 1, base, _packed(pair[e], n[e].astype(np.uint32), train[e].astype(np.uint32))))
        if roster:
            row, ids, has, n = (np.concatenate([p[k] for p in roster]) for k in range(4))
            for s in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row >> _BLOCK)) + 1):
                block = int(row[s[0]] >> _BLOCK)
                out.append((block % model.parts, 2, block, _packed((row[s] & (1 << _BLOCK) - 1).astype(np.uint16), ids[s], has[s], n[s])))
        pieces.clear()
        roster.clear()
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["part", "kind", "base", "blob"])

    for batch in batches:
        rows, held = batch.column("row").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        ids = batch.column("doc_id")
        has, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        for lo, hi, data, offsets in slices(batch.column("text")):
            if base is not None and (rows[hi - 1] - base >= _ROWS or rows[lo] < base or size > _FLUSH):
                yield from flush()
                base, size = None, 0
            for s in range(lo, hi, _ROWS):  # rows of a slice without words may be many
                t = min(hi, s + _ROWS)
                if base is not None and rows[t - 1] - base >= _ROWS:
                    yield from flush()
                    base = None
                base = int(rows[s]) if base is None else base
                words = hasher.words(data[offsets[s - lo] : offsets[t - lo]], offsets[s - lo : t - lo + 1] - offsets[s - lo])
                n = np.diff(words.bounds)
                roster.append((rows[s:t], ids[s:t], has[s:t], n.astype(np.uint32)))
                if not len(words.hash):
                    continue
                w = model.numbers(words.hash)
                place = np.arange(len(w)) - np.repeat(words.bounds[:-1], n)
                v, u = np.zeros_like(w), np.zeros_like(w)
                v[1:], u[2:] = w[:-1], w[:-2]
                v[place < 1] = u[place < 2] = 0
                local = (rows[s:t] - base).astype(np.uint16) | np.where(held[s:t], _ROWS, 0).astype(np.uint16)
                pieces.append((v, u, w, np.repeat(local, n)))
                size += len(w)
    yield from flush()


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of equal keys, and the run of each place."""
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(first), np.cumsum(first) - 1


def _counts(key: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """How often the key of each place occurs; order, if given, brings equal keys together."""
    order = np.argsort(key) if order is None else order
    start, run = _runs(key[order])
    out = np.empty(len(key), np.int64)
    out[order] = np.diff(np.append(start, len(key)))[run]
    return out


def _occurring(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each key among sorted known ones, -1 for others."""
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, at, -1)


class Events:
    """The events of a part: words u, v before w, the row, whether it is held out; and counts of (v, u) of middle words that are spread."""

    def __init__(self, table: pa.Table, model: Model) -> None:
        parts, self.pairs = [], []
        for kind, at, blob in zip(table["kind"].to_pylist(), table["base"].to_pylist(), table["blob"].to_pylist()):
            if kind == 0:
                dv, u, w, row = _unpacked(blob, "<u4", "<u4", "<u4", "<u2")
                parts.append((np.cumsum(dv, dtype=np.uint32).astype(np.uint64) << np.uint64(32) | u, w, (row & np.uint16(_ROWS - 1)).astype(np.int64) + at, row >= _ROWS))
            elif kind == 1:
                self.pairs.append(_unpacked(blob, "<u8", "<u4", "<u4"))
        self.empty = not parts
        if not self.empty:
            self.context, self.w, self.row, self.held = (np.concatenate([p[k] for p in parts]) for k in range(4))
            del parts
            self.hot = np.flatnonzero(model.spread(self.v()) > 1)

    def v(self) -> np.ndarray:
        return (self.context >> np.uint64(32)).astype(np.uint32)

    def gram2(self) -> np.ndarray:
        return self.context & np.uint64(0xFFFFFFFF00000000) | self.w

    def gram3(self) -> np.ndarray:
        return mix(self.context * np.uint64(0x9E3779B97F4A7C15) ^ mix(self.w.astype(np.uint64)))

    def of_spread(self, train: bool) -> tuple[np.ndarray, np.ndarray]:
        """d3 and d2 of the events whose middle words are spread."""
        pair, n = (np.concatenate([p[k] for p in self.pairs]) for k in (0, 1 + train))
        pair, at = np.unique(pair, return_inverse=True)
        n = np.bincount(at, n, len(pair)).astype(np.int64)
        found = np.searchsorted(pair, self.context[self.hot])
        start, run = _runs(pair >> np.uint64(32))
        return n[found], np.add.reduceat(n, start)[run[found]]


def held_kinds(events: Events, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of held-out events and how often they occur: bucket and levels of the three estimates under train counts.

    Train events are only counted where a held-out one asks for them.
    """
    at = np.flatnonzero(events.held)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = []
    # a 3-gram is looked for where its context is asked for, so of most events only the first keys are made
    some = np.flatnonzero(~events.held)
    for key in (events.v().astype(np.uint64), events.context, events.gram3()):
        asked = np.unique(key[at])
        found = _occurring(asked, key[some])
        some = some[found >= 0]
        got.append(np.bincount(found[found >= 0], minlength=len(asked))[np.searchsorted(asked, key[at])])
    key = events.gram2()
    asked = np.unique(key[at])
    found = _occurring(asked, key[~events.held])
    n2 = np.bincount(found[found >= 0], minlength=len(asked))[np.searchsorted(asked, key[at])]
    d2, d3, n3 = got
    if len(events.hot):
        place = np.full(len(events.w), -1)
        place[at] = np.arange(len(at))
        own = place[events.hot]
        h3, h2 = events.of_spread(True)
        d3[own[own >= 0]], d2[own[own >= 0]] = h3[own >= 0], h2[own >= 0]
    p = [model.single(events.w[at], False), _ratio(n2, d2), _ratio(n3, d3)]
    level = [np.where(x > 0, 1 + np.minimum(LEVELS - 2, np.round(-np.log2(np.maximum(x, 1e-300)) * STEP)), 0).astype(np.int64) for x in p]
    return np.unique(_bucket(d3) << 18 | level[2] << 12 | level[1] << 6 | level[0], return_counts=True)


def log2_probabilities(events: Events, model: Model, weights: np.ndarray) -> np.ndarray:
    """Of each event, deleted from the counts of all rows."""
    order = np.argsort(events.context)
    d3, d2 = _counts(events.context, order), _counts(events.v(), order)
    if len(events.hot):
        d3[events.hot], d2[events.hot] = events.of_spread(False)
    w = weights[_bucket(d3 - 1)]
    p = w[:, 0] * model.uniform + w[:, 1] * model.single(events.w, True)
    p += w[:, 2] * _ratio(_counts(events.gram2()) - 1, d2 - 1)
    p += w[:, 3] * _ratio(_counts(events.gram3()) - 1, d3 - 1)
    return np.log2(p)


def fit_words(texts: DataFrame, vocabulary: int = VOCABULARY, part: int = PART) -> Model:
    """Counts of all words; the driver gets the most frequent ones, and totals of the others."""
    counts = cut(texts.select("text", "held").mapInArrow(_word_counts, "word long, train long, held long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("train").alias("every") + F.sum("held")).toDF("word", "train", "every"))
    level = F.floor(F.log2("every") * 8)
    got, least = 0, None
    for r in counts.where("word <> 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        got += r["count"]
        if got > vocabulary:
            break
        least = r["level"]
    frequent = level >= least if least is not None else F.lit(False)
    known = counts.where((F.col("word") != 0) & frequent).toArrow()
    rare = counts.where((F.col("word") != 0) & ~frequent).agg(F.count("*"), F.sum("every"), F.sum("train")).first()
    starts = counts.where("word = 0").agg(F.sum("every")).first()[0] or 0
    columns = [known[c].to_numpy() for c in ("word", "every", "train")]
    return Model(columns[0].astype(np.uint64), columns[1], columns[2], starts, tuple(x or 0 for x in rare), part)


def score(docs: DataFrame, held_out: int = HELD_OUT, rounds: int = ROUNDS, vocabulary: int = VOCABULARY, part: int = PART) -> DataFrame:
    """(doc_id, n_words, log2_prob): one row for each row of docs; log2_prob is the mean of its words.

    One row in held_out, by the hash of its id, is held out. A text that is null, empty or without words has n_words 0 and a null log2_prob. Null and repeated ids are scored like any
    other row, and equal texts alike; a row whose text occurs elsewhere is likelier for it. One text must fit a worker. Other columns are not read.
    """
    spark = docs.sparkSession
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0).cast("int")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), held.alias("held"))
    model = share(spark, fit_words(texts, vocabulary, part))
    packed = texts.mapInArrow(lambda batches: _events(model(), batches), "part int, kind int, base long, blob binary").repartition("part")

    def kinds(table: pa.Table) -> pa.Table:
        events = Events(table, model())
        kind, n = (np.zeros(0, np.int64),) * 2 if events.empty else held_kinds(events, model())
        return pa.table({"kind": kind, "n": n})

    def learn(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        return pa.table({"weights": [learn_weights(kind, table["n"].to_numpy(), model().uniform, rounds).ravel().tolist()]})

    # the kinds of events are few whatever the corpus, so one task learns of them
    known = packed.groupBy("part").applyInArrow(kinds, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n"))
    weights = known.groupBy(F.lit(0).alias("one")).applyInArrow(learn, "weights array<double>").agg(F.first("weights").alias("weights"))

    def sums(table: pa.Table) -> pa.Table:
        """(block, blob): sums for the rows of each block, and the rows that there are."""
        rows = [(at, 1, blob) for kind, at, blob in zip(table["kind"].to_pylist(), table["base"].to_pylist(), table["blob"].to_pylist()) if kind == 2]
        events = Events(table, model())
        if not events.empty:
            w = table["weights"][0].as_py()
            p = log2_probabilities(events, model(), np.array(w).reshape(BUCKETS, 4) if w else np.full((BUCKETS, 4), 0.25))
            row, at = np.unique(events.row, return_inverse=True)
            total = np.bincount(at, p, len(row)).astype(np.float32)
            for s in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row >> _BLOCK)) + 1):
                rows.append((int(row[s[0]] >> _BLOCK), 0, _packed((row[s] & (1 << _BLOCK) - 1).astype(np.uint16), total[s])))
        columns = list(zip(*rows)) if rows else [()] * 3
        return pa.table({"block": pa.array(columns[0], pa.int64()), "kind": pa.array(columns[1], pa.int32()), "blob": pa.array(columns[2], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        total, out = np.zeros(1 << _BLOCK), []
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()):
            if kind:
                out.append(_unpacked(blob, "<u2", "<i8", "?", "<u4"))
            else:
                at, s = _unpacked(blob, "<u2", "<f4")
                total[at] += s
        at, ids, has, n = (np.concatenate([x[k] for x in out]) for k in range(4))
        mean = total[at] / np.maximum(1, n)
        return pa.table({"doc_id": pa.array(ids, mask=~has), "n_words": n.astype(np.int64), "log2_prob": pa.array(mean, mask=n == 0)})

    # a scalar: the weights go along with each row, and the shuffle that they were learned from is read again
    scored = packed.withColumn("weights", weights.scalar()).groupBy("part").applyInArrow(sums, "block long, kind int, blob binary")
    return scored.groupBy("block").applyInArrow(finish, "doc_id long, n_words long, log2_prob double")
