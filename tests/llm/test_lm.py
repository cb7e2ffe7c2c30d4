import math
from collections import Counter

import numpy as np
import pytest

from cadence.llm import lm

from .samples import odd_rows, prose, table, words


def events(text):
    ws = [None, None, *words(text)]
    return [tuple(ws[i - 2 : i + 1]) for i in range(2, len(ws))]


def counted(texts):
    every = [e for t in texts for e in events(t)]
    return [Counter(e[2] for e in every), len(every), Counter(e[1:] for e in every), Counter(e[1] for e in every), Counter(every), Counter(e[:2] for e in every)]


def brute(rows, held, vocabulary, rounds=lm.ROUNDS):
    """Mean log-probabilities by plain dictionaries."""
    every, train = counted(t for _, t in rows), counted(t for (_, t), h in zip(rows, held) if not h)
    kept = {w for w, n in every[0].items() if math.floor(math.log2(n) * 8) >= vocabulary}
    rare = [w for w in every[0] if w not in kept]
    uniform = 1 / (len(every[0]) + 1)
    bucket = lambda d: min(lm.BUCKETS - 1, math.ceil(math.log2(d + 1)))

    def estimates(tables, e, less):
        n1, n, n2, d2, n3, d3 = tables
        one = (n1[e[2]] - less) / (n - less) if e[2] in kept else (sum(n1[w] for w in rare) - less) / len(rare) / (n - less)
        ratio = lambda a, b: (a - less) / (b - less) if b > less else 0.0
        return bucket(d3[e[:2]] - less), [one, ratio(n2[e[1:]], d2[e[1]]), ratio(n3[e], d3[e[:2]])]

    weights = np.full((lm.BUCKETS, 4), 0.25)
    asked = [estimates(train, e, 0) for (_, t), h in zip(rows, held) if h for e in events(t)]
    rounded = lambda x: 2.0 ** -(min(lm.LEVELS - 2, round(-math.log2(x) * lm.STEP)) / lm.STEP) if x > 0 else 0.0
    asked = [(b, np.array([uniform, *map(rounded, p)])) for b, p in asked]
    for _ in range(rounds):
        got = np.zeros_like(weights)
        for b, p in asked:
            got[b] += weights[b] * p / (weights[b] @ p)
        some = got.sum(1) > 0
        weights[some] = got[some] / got[some].sum(1, keepdims=True)
    out = []
    for _, t in rows:
        p = [math.log2(weights[b] @ np.array([uniform, *x])) for b, x in (estimates(every, e, 1) for e in events(t))]
        out.append((len(p), sum(p) / len(p) if p else None))
    return out


@pytest.mark.parametrize(("part", "vocabulary"), [(1_000_000, 1 << 20), (60, 1 << 20), (200, 12)])
def test_against_brute_force(spark, part, vocabulary):
    rows = [(i, " ".join(prose(i % 30, 12 + i % 9, 60))) for i in range(40)] + [(41, "É ß"), (42, None), (43, ""), (44, "ka " * 40)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in lm.score(docs, 4, vocabulary=vocabulary, part=part).collect()}
    held = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 4) = 0 as h").collect()}
    counts = Counter(w for _, t in rows for w in words(t))
    levels = sorted({math.floor(math.log2(n) * 8) for n in counts.values()}, reverse=True)
    least = max([x for x in levels if sum(math.floor(math.log2(n) * 8) >= x for n in counts.values()) <= vocabulary], key=lambda x: -x)
    for (i, _), (n, p) in zip(rows, brute(rows, [held[i] for i, _ in rows], least)):
        assert got[i]["n_words"] == n
        assert got[i]["log2_prob"] == (None if p is None else pytest.approx(p, rel=1e-5, abs=1e-5)), i


def test_a_text_that_occurs_twice_is_likelier(spark):
    rows = [(i, " ".join(prose(i if i < 50 else i - 50, 60))) for i in range(80)]
    got = {r["doc_id"]: r["log2_prob"] for r in lm.score(table(spark, rows), 5).collect()}
    twice = [got[i] for i in (*range(30), *range(50, 80))]
    assert min(twice) > max(got[i] for i in range(30, 50))


def test_a_text_of_known_words_in_random_order_is_less_likely(spark):
    base = [prose(k, 80) for k in range(12)]
    shuffled = sorted(base[0])
    rows = [(i, " ".join(base[i % 12])) for i in range(48)] + [(100, " ".join(shuffled))]
    got = {r["doc_id"]: r["log2_prob"] for r in lm.score(table(spark, rows), 5).collect()}
    assert max(v for k, v in got.items() if k == 100) < min(v for k, v in got.items() if k < 100)


def test_packing():
    a, b = np.arange(1000, dtype=np.uint32) * 77, np.arange(1000, dtype=np.int64) - 5
    x, y = lm._unpacked(lm._packed(a, b), "<u4", "<i8")
    assert (x == a).all() and (y == b).all()
    assert [len(x) for x in lm._unpacked(lm._packed(a[:0], b[:0]), "<u4", "<i8")] == [0, 0]


def test_odd_rows(spark):
    rows = odd_rows()
    got = lm.score(table(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 2
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["log2_prob"]))
    assert by[1] == by[2] == by[3] == by[4] == [(0, None)] and by[7][0][0] == 60_000
    assert by[8][0] == by[8][1] and by[10] == by[11]
    assert lm.score(table(spark, [])).count() == 0
    assert [tuple(r) for r in lm.score(table(spark, [(1, None), (None, "")])).orderBy("doc_id").collect()] == [(None, 0, None), (1, 0, None)]
