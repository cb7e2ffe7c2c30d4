import numpy as np
import pytest

from cadence.llm import packing

from .samples import odd_rows, prose, table

SMALL = packing.Capacity(tokens=64, documents=5, attention=64 * 64 // 2, piece=32)


def brute(sizes, c, rule):
    """The same greedy choice over all sequences ever opened, in plain Python."""
    need = [(s, 1, s * s) for s in sizes]
    limit = c[:3]
    weight = [np.mean([n[k] / limit[k] for n in need]) for k in range(3)]
    rooms, out = [], []
    for n in need:
        best = None
        for b, room in enumerate(rooms):
            if all(room[k] >= n[k] for k in range(3)):
                if rule == "norm":
                    value = -sum(((room[k] - n[k]) / limit[k]) ** 2 * weight[k] for k in range(3))
                else:
                    value = sum(room[k] / limit[k] * weight[k] * n[k] / limit[k] for k in range(3))
                if best is None or value > best[0] + 1e-12:
                    best = (value, b)
        if best is None:
            rooms.append(list(limit))
            best = (0, len(rooms) - 1)
        rooms[best[1]] = [rooms[best[1]][k] - n[k] for k in range(3)]
        out.append(best[1])
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_against_brute_force(rule):
    for seed in range(6):
        sizes = np.sort(np.random.default_rng(seed).integers(1, 33, 150))[::-1]
        assert packing.best_fit(sizes, SMALL, rule).tolist() == brute(sizes.tolist(), SMALL, rule)
    assert packing.best_fit(np.zeros(0, int), SMALL).tolist() == []


@pytest.mark.parametrize("sequences", [3, 1000])
def test_every_token_once_and_no_capacity_exceeded(spark, sequences):
    rows = [(i, " ".join(prose(i, 1 + i * 7 % 90))) for i in range(120)] + [(5, "a repeated id"), (None, "no id here"), (None, "nor here now")]
    got = packing.pack(table(spark, rows), SMALL, sequences=sequences).collect()
    seen = {}
    for r in got:
        assert r["n_tokens"] == sum(r["lengths"]) <= SMALL.tokens and r["n_docs"] == len(r["doc_ids"]) <= SMALL.documents
        assert r["attention_cost"] == sum(n * n for n in r["lengths"]) <= SMALL.attention and len(r["doc_ids"]) == len(r["starts"])
        for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            seen.setdefault(d, []).extend(range(s, s + n))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).extend(range(len(t.split())))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({(r["group"], r["sequence"]) for r in got}) == len(got)


def test_odd_rows(spark):
    rows = odd_rows()
    got = packing.pack(table(spark, rows)).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) for _, t in rows)
    assert packing.pack(table(spark, [])).count() == 0 and packing.pack(table(spark, [(1, None), (2, "")])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table(spark, []), packing.Capacity(piece=4096))
