import random

import numpy as np
import pytest

from cadence.llm import decontam

from .samples import odd_rows, prose, table, words


def bench(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "item_id long, text string, score int, best double")


def items(n):
    out = []
    for k in range(n):
        w = prose(900 + k, 12 + k % 30)
        cut = len(w) * 2 // 3
        out.append((k, " ".join(w[:cut]).capitalize() + "? " + " ".join(w[cut:]).capitalize() + "."))
    return out


def found(docs, b, **k):
    return {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(docs, b, **k).collect()}


def brute(rows, test, threshold=decontam.THRESHOLD):
    """All items over all passages, by the formula, without an index."""
    tokens = [words(t) for _, t in test]
    n, avg = len(tokens), sum(map(len, tokens)) / len(tokens)
    df = {}
    for t in tokens:
        for w in set(t):
            df[w] = df.get(w, 0) + 1

    def impacts(t):
        return {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in set(t)}

    pairs = lambda t: set(zip(t, t[1:])) if len(t) > 1 else {(w,) for w in t}
    run, out = max(map(len, tokens)), set()
    sides = [[words(x) for x in decontam.question_and_answer(t.lower())] for _, t in test]
    for i, text in rows:
        w = words(text) if i is not None else []
        for p in range(-run, len(w), run):
            have = w[max(0, p) : p + 2 * run]
            grams = pairs(have) | {(x,) for x in have}
            for (item, _), t, qa in zip(test, tokens, sides):
                m = impacts(t)
                if sum(v for x, v in m.items() if x in set(have)) >= threshold * sum(m.values()) - 1e-9:
                    if all(len(pairs(s) & grams) >= decontam.OVERLAP * len(pairs(s)) - 1e-9 for s in qa if s):
                        out.add((i, item))
    return out


@pytest.mark.parametrize("part", [100_000, 7])
def test_against_brute_force(spark, part):
    r, test = random.Random(4), items(40)
    rows = []
    for i in range(60):
        w = prose(i, r.randrange(20, 400))
        if i % 3 == 0:  # some whole, some with words changed, some in part
            t = words(test[i % 40][1])
            t = [x if r.random() >= (0, 0.05, 0.3)[i // 3 % 3] else "zz" for x in t][: len(t) * 3 // 4 if i % 9 == 6 else None]
            at = r.randrange(len(w))
            w[at:at] = t
        rows.append((i, " ".join(w)))
    got = set(found(table(spark, rows), bench(spark, test), part=part))
    assert got == brute(rows, test) and len(got) >= 8


def test_scores_do_not_depend_on_pruning():
    test = items(60)
    terms, df, n, total = decontam.document_frequencies([t for _, t in test])
    index = decontam.build_index([i for i, _ in test], [t for _, t in test], terms, df, n, total, 0.2)
    r = np.random.default_rng(0)
    for _ in range(50):
        asked = sorted(r.choice(len(terms), 60, replace=False).tolist())
        for block, lists in enumerate(index.blocks):
            plain = {}
            for t in asked:
                for i, w in lists.get(t, (0, {}))[1].items():
                    plain[i] = plain.get(i, 0) + w
            got = dict(decontam.score_block(index, block, asked))
            assert got == pytest.approx({i: s for i, s in plain.items() if s >= 0.2 - 1e-12})


def test_odd_rows_and_stage(spark):
    test = [*items(5), (7, items(5)[0][1]), (8, None), (None, "an item without an id"), (9, ""), (10, "!!!"), (11, "single"), (12, "The same. Row.")]
    leak = items(5)[0][1]
    rows = odd_rows() + [(20, leak), (21, leak.upper()), (22, "x " * 50_000 + leak), (None, leak), (20, leak)]
    docs = table(spark, rows)
    got = found(docs, bench(spark, test))
    assert {k for k in got if k[0] > 19} == {(d, i) for d in (20, 21, 22) for i in (0, 7)}
    kept = decontam.drop_contaminated(docs, bench(spark, items(5)))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in odd_rows()}
    assert kept.count() == len(odd_rows()) + 1


def test_empty_tables(spark):
    assert found(table(spark, []), bench(spark, items(3))) == {}
    assert found(table(spark, odd_rows()), bench(spark, [])) == {}
