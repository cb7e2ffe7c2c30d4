from cadence.llm import minhash

from .samples import groups, odd_rows, prose, swapped, table, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows, threshold=minhash.THRESHOLD):
    sets = {i: shingles(t) or {"no words"} for i, t in rows if i is not None and t is not None}
    ids = sorted(sets)
    return groups((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))


def test_recall_and_precision_against_brute_force(spark):
    rows, n = [], 0
    for base in range(25):
        text = prose(base, 120)
        rows.append((n, " ".join(text)))
        n += 1
        for copy in range(base % 6):
            rows.append((n, " ".join(swapped(n, text, 0.03 * copy))))
            n += 1
    rows += [(n + k, " ".join(prose(1000 + k, 40))) for k in range(60)]
    want = brute(rows)
    got = {r["doc_id"]: r["kept_id"] for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert len(want) > 30
    assert sum(got.get(i) == k for i, k in want.items()) >= 0.9 * len(want)
    assert set(got) <= set(want)


def test_a_group_of_many_copies(spark):
    text = prose(5, 80)
    rows = [(i, " ".join(text if i % 2 else swapped(i, text, 0.02))) for i in range(300)] + [(1000, " ".join(prose(6, 80)))]
    got = {r["doc_id"]: r["kept_id"] for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute(rows) and len(got) == 299


def test_odd_rows(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    got = {r["doc_id"]: r["kept_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {3: 2, 4: 2, 6: 5, 11: 10} == brute(rows)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 7, 8, 9, 10] and ids.count(None) == 2


def test_empty_table(spark):
    docs = table(spark, [])
    assert minhash.near_duplicates(docs).count() == 0
    assert minhash.drop_near_duplicates(docs).count() == 0


def test_recall_close_to_the_threshold(spark):
    rows = []
    for i in range(200):
        text = prose(3000 + i, 120)
        copy = [f"new{i}x{k}" if k % 9 == 4 and k < 9 * (12 + i % 2) else w for k, w in enumerate(text)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    want = brute(rows)
    got = {r["doc_id"]: r["kept_id"] for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert len(want) > 150
    assert sum(got.get(i) == k for i, k in want.items()) >= 0.9 * len(want), sum(got.get(i) == k for i, k in want.items()) / len(want)
