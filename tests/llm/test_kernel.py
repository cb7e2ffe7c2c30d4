import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm.graph import connected_components, verified_components
from cadence.llm.textkernel import Hasher, distinct_per_row, ngrams, slices

from .samples import groups, words

TEXT = st.text(alphabet="ab Z9é漢.\n", max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 40))
def test_words_are_those_of_the_regular_expression(texts, size):
    """Equal words have equal hashes and unequal ones unequal hashes, however rows are sliced."""
    got, seen = [], {}
    for lo, hi, data, offsets in slices(pa.array([None if t is None else t.lower() for t in texts], pa.string()), size):
        w = Hasher().words(data, offsets)
        assert len(w.bounds) == hi - lo + 1
        got += [w.hash[a:b].tolist() for a, b in zip(w.bounds, w.bounds[1:])]
    want = [words(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for g, x in zip(sum(got, []), sum(want, [])):
        assert seen.setdefault(x, g) == g
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(1, 4))
def test_ngrams(texts, n):
    _, _, data, offsets = next(iter(slices(pa.array([t.lower() for t in texts]), 1 << 20)))
    h, bounds = ngrams(Hasher().words(data, offsets), n)
    seen = {}
    for t, a, b in zip(texts, bounds, bounds[1:]):
        w = words(t)
        want = [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
        assert len(want) == b - a
        for x, g in zip(want, h[a:b].tolist()):
            assert seen.setdefault(x, g) == g
    assert len(set(seen.values())) == len(seen)
    v, at = distinct_per_row(h, bounds)
    assert [sorted(set(h[a:b])) for a, b in zip(bounds, bounds[1:])] == [list(v[a:b]) for a, b in zip(at, at[1:])]


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("few", [0, 500_000])
def test_connected_components(spark, seed, few):
    r = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), few).collect()
    known = groups([e for e in edges if None not in e and e[0] != e[1]])
    assert {x["id"]: x["root"] for x in got if x["id"] != x["root"]} == known
    assert len(got) == len({x["id"] for x in got})
    assert connected_components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_verified_components_equal_all_pairs(spark):
    """The first of a bucket matches few of its members, so the second comparison is needed."""
    r = np.random.default_rng(3)
    rows = [(int(b), int(i)) for b in range(12) for i in r.choice(60, 9, replace=False)]
    holds = lambda a, b: (a * 7 + b * 7) % 5 == 0
    got = verified_components(spark.createDataFrame(rows, "bucket long, id long"), lambda p: p.where("(a * 7 + b * 7) % 5 = 0"))
    pairs = {(a, b) for x, a in rows for y, b in rows if x == y and a < b and holds(a, b)}
    assert {x["id"]: x["root"] for x in got.collect() if x["id"] != x["root"]} == groups(pairs)
