import pytest

from cadence.llm import substrings

from .samples import odd_rows, prose, swapped, table, words

LEAST = 12


def brute(rows, least=LEAST):
    seen, out = set(), {}
    for i, text in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        w, spans = words(text), []
        for k in range(len(w) - least + 1):
            window = tuple(w[k : k + least])
            if window in seen:
                if spans and spans[-1][1] >= k:
                    spans[-1][1] = k + least
                else:
                    spans.append([k, k + least])
            seen.add(window)
        if spans:
            out[i] = [tuple(s) for s in spans]
    return out


def found(docs, least=LEAST, **k):
    out = {}
    for r in substrings.repeated_spans(docs, least, **k).collect():
        out.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    return {i: sorted(s) for i, s in out.items()}


def corpus():
    shared = [prose(700 + k, 12 + 3 * k) for k in range(6)]
    rows = []
    for i in range(70):
        w = prose(i, 40)
        if i % 2:
            w[i % 40 : i % 40] = shared[i % 6]
        if i % 10 == 3:
            w += w[:25] + shared[0] + shared[0]
        if i % 7 == 0 and i:
            w = swapped(i, words(rows[i // 2][1]), 0.03)
        rows.append((i, " ".join(w)))
    return rows + [(80, "again and " * 40), (81, "again and again " * 3 + "again and " * 20), (82, "one " * 30)]


@pytest.mark.parametrize(("least", "hot"), [(12, 2000), (12, 3), (12, 0), (5, 0), (6, 1), (9, 0), (30, 2)])
def test_against_brute_force(spark, least, hot):
    rows = corpus()
    want = brute(rows, least)
    assert found(table(spark, rows), least, hot=hot) == want and (len(want) > 25 or least > 12 and want)


def test_kept_text(spark):
    rows = [(1, "A start. " + " ".join(prose(5, 20)) + " end!"), (2, "Other: " + " ".join(prose(5, 20)).upper() + " ... and é more."), (3, None)]
    out = substrings.drop_repeated_spans(table(spark, rows), LEAST)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.columns == table(spark, rows).columns
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("Other: and é more.", 18), 3: (None, None)}


def test_odd_rows(spark):
    rows = odd_rows()
    assert found(table(spark, rows)) == brute(rows)
    assert substrings.drop_repeated_spans(table(spark, rows), LEAST).count() == len(rows)
    assert found(table(spark, [])) == {} and substrings.drop_repeated_spans(table(spark, []), LEAST).count() == 0
