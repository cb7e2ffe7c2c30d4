import random

import numpy as np

from cadence.llm import toxicity

from .samples import odd_rows, prose, table

BAD = ["vilest", "grudge", "scabby"]


def corpus(n, seed=0):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        text = prose(seed * 10_000 + i, 60)
        if toxic:
            for _ in range(4):
                text.insert(r.randrange(60), r.choice(BAD) + r.choice(["", "ing", "ness"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 != 0), int(toxic)))
    return rows, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_stages(spark):
    rows, labels = corpus(600)
    chain = toxicity.train(table(spark, rows), labels_of(spark, labels))
    fresh, truth = corpus(240, seed=7)
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, fresh), chain).collect()}
    hits = [got[i]["rejected"] == bool(t) for i, _, t in truth]
    assert np.mean(hits) > 0.97 and len(got) == len(fresh)
    assert all(0 <= got[0][f"p_{c}"] <= 1 for c in toxicity.CATEGORIES)
    kept = toxicity.drop_toxic(table(spark, fresh), labels_of(spark, [])).count()
    assert kept == len(fresh)


def test_later_links_see_out_of_fold_predictions():
    r = np.random.default_rng(0)
    n = 400
    rows = np.arange(n).repeat(1)
    hashes = r.integers(1, 5, n).astype(np.uint64)
    y = np.stack([(hashes > 2).astype(int), (hashes > 2).astype(int)], 1)
    vocabulary, codes = np.unique(hashes, return_inverse=True)
    chain = toxicity.fit_chain(vocabulary, codes, rows, np.zeros((n, 0)), y, np.arange(n) % 5)
    assert len(chain.links) == 2 and len(chain.links[0].weights) == 0 and len(chain.links[1].weights) == 1 and chain.links[1].weights[0] > 0
    p = chain.predict(hashes, rows, np.zeros((n, 0)))
    assert p.shape == (n, 2) and ((p[:, 1] > 0.5) == y[:, 1]).mean() > 0.9


def test_the_sample_is_bounded(spark):
    rows, labels = corpus(60)
    assert len(toxicity.train(table(spark, rows), labels_of(spark, labels), sample=20).links) == 3


def test_odd_rows(spark):
    rows, labels = corpus(200)
    odd = odd_rows() + [(50_000, "vilest grudge scabby " + rows[1][1]), (50_001, None)]
    train = labels_of(spark, labels + labels + [(None, 1, 1), (3, None, 1), (4, 1, None), (99_999, 1, 1)])
    docs = table(spark, rows + odd)
    out = toxicity.score(docs, toxicity.train(docs, train)).collect()
    assert len(out) == docs.count()
    assert not any(r["rejected"] for r in out if r["doc_id"] is None) and [r["rejected"] for r in out if r["doc_id"] == 50_000] == [True]
    kept = toxicity.drop_toxic(docs, train)
    assert kept.columns == docs.columns and 50_000 not in {r["doc_id"] for r in kept.collect()} and kept.where("doc_id is null").count() == 2


def test_empty_tables(spark):
    rows, labels = corpus(40)
    empty = table(spark, [])
    assert toxicity.score(empty, toxicity.train(empty, labels_of(spark, labels))).count() == 0
    out = toxicity.score(table(spark, rows), toxicity.train(table(spark, rows), labels_of(spark, []))).collect()
    assert all(r["p_toxic"] is None and not r["rejected"] for r in out)


def test_labels_without_documents_do_not_fill_the_sample(spark):
    rows, labels = corpus(60)
    absent = [(10_000 + i, 1, 0) for i in range(3000)]
    assert len(toxicity.train(table(spark, rows), labels_of(spark, labels + absent), sample=60).links) == 3


def by_hand(text):
    """Words, their beginnings, and measures of a text, with strings."""
    raw = (text or "").lower().encode()
    found, word = [], b""
    for c in raw + b" ":
        if 48 <= c < 58 or 97 <= c < 123 or 65 <= c < 91 or c > 127:
            word += bytes([c])
        elif word:
            found.append(word)
            word = b""
    terms = {(0, w) for w in found} | {(n, w[:n]) for n in (4, 5, 6) for w in found if len(w) > n}
    inside, white, size = sum(map(len, found)), sum(c <= 32 for c in raw), max(1, len(raw))
    return terms, [np.log(1 + len(found)) / 10, inside / size, (size - inside - white) / size, inside / max(1, len(found)) / 10]


def fitted(terms, dense, y):
    """A linear model of the terms that a screening test picks and of dense columns, by plain gradient steps on the curvature."""
    n, pos = len(y), sum(y)
    df = {}
    for t, label in zip(terms, y):
        for w in t:
            a, b = df.get(w, (0, 0))
            df[w] = (a + 1, b + label)

    def z(w):
        d, hit = df[w]
        p = d / n
        return (hit / pos - (d - hit) / (n - pos)) / np.sqrt(max(1e-12, p * (1 - p) * (1 / pos + 1 / (n - pos))))

    picked = sorted(w for w in df if df[w][0] >= 3 and abs(z(w)) >= 4.5)
    assert len(picked) <= toxicity.MOST_WORDS
    x = np.array([[*(float(w in t) for w in picked), *d, 1.0] for t, d in zip(terms, dense)])
    ridge = np.array([1.0] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.lstsq(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (np.array(y) - p) - ridge * w, rcond=None)[0]
        w += step * min(1, 1 / max(1e-12, np.abs(step).max()))
    return lambda t, d: 1 / (1 + np.exp(-np.dot([*(float(v in t) for v in picked), *d, 1.0], w)))


def test_the_chain_against_one_made_by_hand(spark):
    rows, labels = corpus(320)
    texts = dict(rows)
    made = {i: by_hand(t) for i, t in rows}
    fold = {i: ((i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40) % 5 for i in texts}
    y = {i: (int(q == 0), t, int(q == 0 and t)) for i, q, t in labels}
    ids = sorted(texts)
    dense, models = {i: list(made[i][1]) for i in ids}, []
    for k in range(3):
        fit = lambda some: fitted([made[i][0] for i in some], [dense[i] for i in some], [y[i][k] for i in some])
        models.append(fit(ids))
        held = {f: fit([i for i in ids if fold[i] != f]) for f in range(5)}
        out = {i: held[fold[i]](made[i][0], dense[i]) for i in ids}
        for i in ids:
            dense[i] = [*dense[i], out[i]]
    fresh, _ = corpus(60, seed=3)
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, fresh), toxicity.train(table(spark, rows), labels_of(spark, labels))).collect()}
    for i, text in fresh:
        terms, d = by_hand(text)
        want = []
        for m in models:
            want.append(m(terms, [*d, *want]))
        assert [got[i][f"p_{c}"] for c in toxicity.CATEGORIES] == [float(p) if abs(p - got[i][f"p_{c}"]) > 1e-4 else got[i][f"p_{c}"] for p, c in zip(want, toxicity.CATEGORIES)], i
        assert got[i]["rejected"] == (want[1] >= toxicity.THRESHOLD)


def test_a_probability_at_the_threshold_is_rejected(spark):
    chain = toxicity.Chain([toxicity.Link(np.zeros(0, np.uint64), np.zeros(0), np.zeros(4 + k), 0.0) for k in range(3)])
    got = toxicity.score(table(spark, [(1, "a word"), (2, "a word"), (3, "...")]), chain).orderBy("doc_id").collect()
    assert [(r["p_toxic"], r["rejected"]) for r in got] == [(0.5, True), (0.5, True), (0.5, False)]
