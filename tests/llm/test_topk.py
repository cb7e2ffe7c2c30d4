import numpy as np
import pytest

from cadence.llm import topk


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int, score double")


def brute(rows, k, every=1):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = np.round(x @ x.T, topk.PLACES)
    out = set()
    for a in np.flatnonzero(ids % every == 0):
        order = [b for b in np.lexsort((ids, -s[a])) if b != a][:k]
        out |= {(int(ids[a]), r + 1, int(ids[b]), float(s[a, b])) for r, b in enumerate(order)}
    return out


@pytest.mark.parametrize(("shard", "block", "every"), [(40, 7, 1), (40, 1000, 20), (5000, 1000, 3)])
def test_against_brute_force(spark, shard, block, every):
    r = np.random.default_rng(2)
    centres = r.standard_normal((6, 8))
    rows = [(int(i), (centres[i % 6] + 0.2 * r.standard_normal(8)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000 + i, [2 * x for x in rows[0][1]]) for i in range(15)]
    got = {tuple(x) for x in topk.top_k(frame(spark, rows), 5, every, shard, block).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in brute(rows, 5, every)}


def test_a_shard_that_many_blocks_visit(spark, monkeypatch):
    monkeypatch.setattr(topk, "VISITS", 3)
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(6).tolist()) for i in range(400)] + [(400 + i, [1.0, *[0.0] * 5]) for i in range(200)]
    got = {tuple(x) for x in topk.top_k(frame(spark, rows), 4, 1, 100, 11, 3).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in brute(rows, 4)}


def test_tree_covers_and_prunes():
    r = np.random.default_rng(0)
    x = np.concatenate([c + 0.01 * r.standard_normal((200, 4)) for c in r.standard_normal((8, 4)) * 3])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    tree, order = topk.cover_tree(x, 16)
    x = x[order]
    stack, leaves = [tree], 0
    while stack:
        n = stack.pop()
        assert np.sqrt(np.square(x[n.start : n.end] - n.centre).sum(1)).max() <= n.radius + 1e-12
        assert not n.children or [n.start, *(c.end for c in n.children)] == [*(c.start for c in n.children), n.end]
        stack += n.children
        leaves += not n.children
    best = topk.Best(len(x), 3)
    assert sorted(order) == list(range(len(x)))
    assert topk.search(tree, tree, x, np.arange(len(x)), x, np.arange(len(x)), best) < leaves**2 / 3


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (10, [1e-30, 0.0])]
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, rows), 2, 1).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 10, 1.0), (2, 1, 1, 1.0), (2, 2, 10, 1.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (10, 1, 1, 1.0), (10, 2, 2, 1.0)]
    assert topk.top_k(frame(spark, [])).count() == 0 and topk.top_k(frame(spark, [(1, [1.0])])).count() == 0 and topk.top_k(frame(spark, [(20, [1.0])])).count() == 0
