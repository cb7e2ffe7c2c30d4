"""Exact substring deduplication by suffix automata of reference shards.

A span of at least `least` words that occurs earlier, in an earlier document by doc_id or earlier in its own, is removed. All
documents are the reference, so it is sharded: of each window of `least` words the word 5-gram of the smallest hash is the
anchor, the same in every place where the window occurs, and a shard is what surrounds the places of one anchor. Places with equal surroundings are one kind,
of which all but the first are settled by that; of an anchor with several kinds the first places are streamed in order through the suffix automaton of
those before. The matching statistics give the maximal spans, and what is new is added to the automaton. A window's places all lie in one shard, so the result
is exact. An anchor of more than `hot` kinds, whose automaton could outgrow a task, is made longer: the windows around a place are parted by where the anchor lies in them,
and all words that those of a part share are its anchor. At last a part has one window, and the anchor is all of it, so that there is one kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadence.llm.session import cut, drop, with_ids
from cadence.llm.textkernel import Hasher, Words, mix, slices

LEAST, GRAM, HOT = 50, 5, 2000
#: Into how many parts the windows of a place of too common an anchor are parted.
PARTS = 4
#: Most places of anchors, and documents with spans, that are broadcast.
BROADCAST_PLACES, BROADCAST_DOCS = 200_000, 100_000
_PLACES = "doc_id long, pos int, lo int, hi int, anchor long, kind long, start int, size int"


def anchors(words: Words, least: int = LEAST) -> np.ndarray:
    """(positions of words, hashes) of the anchors of all windows."""
    h, n = words.hash, len(words.hash)
    size = np.diff(words.bounds)
    left = np.repeat(size, size) - (np.arange(n) - np.repeat(words.bounds[:-1], size))
    wide = least - GRAM + 1
    if n < least or not (left >= least).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        g = g * np.uint64(0x9FB21C651E98DF25) + h[k : n - GRAM + 1 + k]
    g = mix(g)
    # the high bits decide, then the place: the leftmost of equal grams
    m = (g & ~np.uint64(0xFFFFFF)) | (np.arange(len(g), dtype=np.uint64) & np.uint64(0xFFFFFF))
    span = 1
    while 2 * span <= wide:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    m = np.minimum(m[: len(m) - (wide - span)], m[wide - span :])
    start = np.flatnonzero(left[: len(m)] >= least)
    low = (m[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    at = np.unique(start + ((low - start) & 0xFFFFFF))
    return at, g[at]


class Automaton:
    """Suffix automaton of sequences of integers, grown by one sequence at a time."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last, self.cuts = [-1], [0], 0, 0

    def _extend(self, c: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = copy
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
        self.last = cur

    def add(self, sequence: list[int]) -> None:
        self.cuts -= 1
        self._extend(self.cuts)  # a separator that no text holds
        for c in sequence:
            self._extend(c)

    def spans(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans, merged, of `least` or more elements that the automaton has, from the matching statistics."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        out: list[tuple[int, int]] = []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state, n = nxt[state][c], n + 1
            if n >= least:
                if out and out[-1][1] >= i + 1 - n:
                    out[-1] = (min(out[-1][0], i + 1 - n), i + 1)
                else:
                    out.append((i + 1 - n, i + 1))
        return out


class _Spans:
    """Hashes of spans of words."""

    def __init__(self, hasher: Hasher, words: Words) -> None:
        hasher.grow(len(words.hash) + 1)
        self.hasher, self.total = hasher, np.zeros(len(words.hash) + 1, np.uint64)
        np.cumsum(mix(words.hash + np.uint64(23)) * hasher.up[: len(words.hash)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.hasher.spans(self.total, start, end)


def _around(words: Words, row: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, some): the words of all windows of the row in which the word `at` is the lo-th to hi-th, hi left out; some: whether there are any."""
    start = np.maximum(words.bounds[row], at - hi + 1)
    last = np.minimum(words.bounds[row + 1] - least, at - lo)
    return start, last + least, last >= start


def _rows_of(ids: pa.Array, row: np.ndarray, words: Words, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, spans: _Spans, least: int) -> pa.RecordBatch:
    start, end, some = _around(words, row, at, lo, hi, least)
    start, end, row, at, lo, hi, anchor = (x[some] for x in (start, end, row, at, lo, hi, anchor))
    first = words.bounds[row]
    ints = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), ints(at - first), ints(lo), ints(hi), pa.array(anchor.view(np.int64)), pa.array(spans(start, end).view(np.int64)), ints(start - first), ints(end - start)], names=["doc_id", "pos", "lo", "hi", "anchor", "kind", "start", "size"])


def _places(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, pos, lo, hi, anchor, kind, start, size): each place of an anchor, at word pos, and what surrounds it: size words from start on, whose hash is kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                words = hasher.words(data, offsets)
                at, h = anchors(words, least)
                row = np.searchsorted(words.bounds, at, "right") - 1
                every = np.zeros(len(at), np.int64)
                yield _rows_of(batch.column("doc_id").slice(lo, hi - lo), row, words, at, every, every + least - GRAM + 1, h, _Spans(hasher, words), least)

    return _texts(docs).mapInArrow(run, _PLACES)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))


def _at_places(docs: DataFrame, found: DataFrame, spec: str, rows) -> DataFrame:
    """What rows(ids, row, words, at, lo, hi, anchor, hasher) makes of the places that found has for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                words = hasher.words(data, offsets)
                places = batch.column("places").slice(lo, hi - lo)
                flat = places.flatten()
                row = np.repeat(np.arange(hi - lo), pc.list_value_length(places).to_numpy(zero_copy_only=False))
                at = flat.field("pos").to_numpy() + words.bounds[row]
                # a row that repeats an id with another text has not all the places
                ok = at < words.bounds[row + 1]
                yield from rows(batch.column("doc_id").slice(lo, hi - lo), row[ok], words, at[ok], *(flat.field(c).to_numpy()[ok] for c in ("lo", "hi", "anchor")), hasher)

    few = (found.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES
    # of more places at least the ids, if these are few enough, keep other documents from being shuffled
    texts = _texts(docs).join(F.broadcast(found), "doc_id") if few else with_ids(_texts(docs), found.select("doc_id"), "doc_id").join(found, "doc_id")
    return texts.select("doc_id", "text", "places").mapInArrow(run, spec)


def _surroundings(docs: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(anchor, doc_id, start, words): the words around each place."""

    def rows(ids: pa.Array, row, words: Words, at, lo, hi, anchor, hasher: Hasher) -> Iterator[pa.RecordBatch]:
        a, b, some = _around(words, row, at, lo, hi, least)
        a, b, row, anchor = a[some], b[some], row[some], anchor[some]
        names = (words.hash >> np.uint64(33)).astype(np.int32)
        for s in range(0, len(a), 20_000):
            t = min(len(a), s + 20_000)
            size = b[s:t] - a[s:t]
            ends = np.cumsum(size)
            raw = names[np.repeat(a[s:t] - (ends - size), size) + np.arange(ends[-1])].tobytes()
            cuts = (np.concatenate([[0], ends]) * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[s:t]), ids.take(pa.array(row[s:t])), pa.array((a[s:t] - words.bounds[row[s:t]]).astype(np.int32)), pa.array([raw[i:j] for i, j in zip(cuts, cuts[1:])], pa.binary())],
                names=["anchor", "doc_id", "start", "words"],
            )

    return _at_places(docs, found, "anchor long, doc_id long, start int, words binary", rows)


def _longer(docs: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Places as _places() has them with longer anchors, PARTS or fewer for each place."""

    def rows(ids: pa.Array, row, words: Words, at, lo, hi, anchor, hasher: Hasher) -> Iterator[pa.RecordBatch]:
        spans = _Spans(hasher, words)
        step = -(-(hi - lo) // PARTS)
        for k in range(PARTS):
            a, b = lo + k * step, np.minimum(hi, lo + (k + 1) * step)
            some = (a < b) & _around(words, row, at, a, np.maximum(b, a + 1), least)[2]
            x, y, w = a[some], b[some], at[some]
            # what all windows of the part share
            longer = mix(spans(w - x, w - y + 1 + least) ^ mix(anchor[some].view(np.uint64) + x.astype(np.uint64)))
            yield _rows_of(ids, row[some], words, w, x, y, longer, spans, least)

    return _at_places(docs, found, _PLACES, rows)


class Shard:
    """The places of one anchor, streamed by document."""

    def __init__(self, least: int) -> None:
        self.least, self.seen, self.automaton, self.waiting = least, set(), None, None

    def document(self, regions: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        """Spans of a document that earlier documents have, or it itself at an earlier word; regions are (start, words), by start."""
        least, out = self.least, []
        new = []
        for start, raw in regions:
            if raw in self.seen:
                if len(raw) >= 4 * least:
                    out.append((start, start + len(raw) // 4))
                continue
            sequence = memoryview(raw).cast("i").tolist()
            if self.waiting is not None and self.automaton is None:
                self.automaton = Automaton()
                for first in self.waiting:
                    self.automaton.add(memoryview(first).cast("i").tolist())
            spans = self.automaton.spans(sequence, least) if self.automaton else []
            out += [(start + s, start + e) for s, e in spans]
            if spans != [(0, len(sequence))]:
                new.append((raw, sequence))
        if len(regions) > 1:  # regions may overlap, so windows are told apart by where they are
            first: dict[bytes, int] = {}
            for start, raw in regions:
                for k in range(len(raw) // 4 - least + 1):
                    if first.setdefault(raw[4 * k : 4 * (k + least)], start + k) < start + k:
                        out.append((start + k, start + k + least))
        self.seen.update(raw for _, raw in regions)
        if self.automaton:
            for _, sequence in new:
                self.automaton.add(sequence)
        elif new:
            self.waiting = [raw for raw, _ in new]
        return out


def _stream(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows come by anchor, and within it by doc_id and start. The spans (doc_id, s, e)."""
    anchor = doc = shard = None
    regions: list[tuple[int, bytes]] = []

    def spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "s", "e"])

    for batch in batches:
        rows: list[tuple[int, int, int]] = []
        for a, d, start, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "start", "words"))):
            if a != anchor or d != doc:
                if shard:
                    rows += [(doc, s, e) for s, e in shard.document(regions)]
                if a != anchor:
                    shard = Shard(least)
                anchor, doc, regions = a, d, []
            regions.append((start, raw))
        if rows:
            yield spans(rows)
    if shard and (rows := [(doc, s, e) for s, e in shard.document(regions)]):
        yield spans(rows)


def repeated_spans(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word): the maximal spans to remove; end_word is the word after.

    Words are numbered from 0 within a document; case and punctuation don't count. Spans that touch or overlap are one. Null, empty and short texts,
    and rows with a null id, have none; a text of any length is read whole, and must fit a worker. Rows that repeat an id with the same text count once; with other texts, they share
    their words' numbers. Of equal places the one of the lower doc_id and word is first. Other columns are not read.
    """
    places, spans, stale = _places(docs, least), [], []
    base = F.lit(1 << 31)
    while True:
        places = cut(places.distinct())
        drop(*stale)
        # a document and word as one number, as the least of structs would have to be sorted for
        place = F.col("doc_id").cast("decimal(20,0)") * base + F.col("pos")
        kinds = cut(places.groupBy("anchor", "kind", "lo", "hi").agg(F.count("*").alias("n"), F.min(place).alias("first")))
        again = kinds.where("n > 1").select("anchor", "kind", "first")
        later = places.withColumn("place", place).join(again, ["anchor", "kind"]).where("place <> first")
        spans.append(cut(later.groupBy("doc_id", F.col("start").alias("s")).agg(F.max(F.col("start") + F.col("size")).alias("e"))))
        several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
        pos = F.pmod("first", base.cast("decimal(20,0)"))
        firsts = kinds.join(several, "anchor").select(((F.col("first") - pos) / base).cast("long").alias("doc_id"), pos.cast("int").alias("pos"), "lo", "hi", "anchor", ((F.col("kinds") > hot) & (F.col("hi") - F.col("lo") > 1)).alias("hot"))
        firsts = cut(firsts)
        of = lambda rows: cut(rows.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "lo", "hi", "anchor")).alias("places")))
        cold = of(firsts.where("not hot"))
        around = _surroundings(docs, cold, least).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
        spans.append(cut(around.mapInArrow(lambda batches: _stream(batches, least), "doc_id long, s int, e int")))
        more = of(firsts.where("hot"))
        drop(cold, kinds, firsts)
        drop(places)
        if more.isEmpty():
            break
        places, stale = _longer(docs, more, least), [more]
    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    every = every.groupBy("doc_id", "s").agg(F.max("e").alias("e"))
    before = W.partitionBy("doc_id").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("doc_id").orderBy("s", "e").rowsBetween(W.unboundedPreceding, 0)
    every = every.withColumn("new", F.when(F.col("s") <= F.max("e").over(before), 0).otherwise(1)).withColumn("run", F.sum("new").over(upto))
    return every.groupBy("doc_id", "run").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).drop("run")


def drop_repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with those spans cut out of the texts, from each first word to the word after the span; every row stays.

    n_chars, where docs has it, is the new length of a text that lost spans.
    """
    gone = cut(repeated_spans(docs, least).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("gone")))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, key = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    renamed = docs.toDF(*names)
    joined = with_ids(renamed, gone.withColumnRenamed("doc_id", key), key, "left", BROADCAST_DOCS).select(*names, "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out = batch.column(text).to_pylist()
            lost = batch.column("gone").to_pylist()
            for lo, hi, data, offsets in slices(batch.column(text)):
                if not any(lost[lo:hi]):
                    continue
                words = hasher.words(data, offsets)
                for r in range(lo, hi):
                    if lost[r]:
                        b, raw, at, kept = words.bounds[r - lo], data[offsets[r - lo] : offsets[r - lo + 1]].tobytes(), 0, []
                        n = words.bounds[r - lo + 1] - b
                        for s, e in sorted((x["start_word"], min(x["end_word"], n)) for x in lost[r]):
                            if s < e:
                                kept.append(raw[at : words.start[b + s] - offsets[r - lo]])
                                at = words.start[b + e] - offsets[r - lo] if e < n else len(raw)
                        out[r] = b"".join([*kept, raw[at:]]).decode()
            arrays = [pa.array(out, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([bool(x) for x in lost])], names=[*names, "cut"])

    spec = renamed.withColumn("cut", F.lit(True)).schema
    out = joined.mapInArrow(run, spec)
    if "n_chars" in docs.columns:
        size = names[docs.columns.index("n_chars")]
        out = out.withColumn(size, F.when(F.col("cut"), F.length(text).cast("long")).otherwise(F.col(size)))
    return out.select(names).toDF(*docs.columns)
