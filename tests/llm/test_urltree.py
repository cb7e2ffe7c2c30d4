import duckdb

from cadence.llm import urltree


def tables(spark, pages, labels):
    return (
        spark.createDataFrame([(*p, "x", 1, "y") for p in pages], "page_id long, url string, html string, n int, template string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def sample():
    pages, labels = [], []
    for i in range(400):
        kind = ("news", "spam", "blog", "spam")[i % 4] if i % 3 else "news"
        path = f"/{kind}/{i}/page" if i % 5 else f"/{kind}/{i}"
        pages.append((i, f"https://{'a.example' if i % 2 else 'B.example'}{path}?q={i}#f"))
        if i % 2 or i % 3:
            labels.append((i, int(kind != "spam"), 0))
    return pages, labels


def odd():
    return [(None, None), (900, None), (901, ""), (902, "no host"), (903, "http://"), (904, "http://c.example"), (905, "http://c.example/"), (905, "http://c.example/"), (906, "http://c.example//x///y/z/1/2/3/4?"), (907, "ftp://u@d.example:80/a")]


def test_against_sql_and_by_hand(spark):
    pages, labels = sample()
    pages, labels = pages + odd(), labels + [(None, 0, 0), (3, None, None), (5, 0, None), (5, 1, 1), (904, None, 1)]
    p, lab = tables(spark, pages, labels)
    out = urltree.url_templates(p, lab)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.execute("create table labels (doc_id bigint, quality int, toxic int)")
    c.executemany("insert into pages values (?, ?, null)", pages)
    c.executemany("insert into labels values (?, ?, ?)", labels)
    cols = ", ".join(out.columns)
    want = sorted(((*r[:5], None if r[5] is None else float(r[5]), r[6]) for r in c.execute(f"select {cols} from ({urltree.oracle_sql()})").fetchall()), key=repr)
    assert got == want
    spam = [r for r in got if r[2] and r[2].startswith("/spam/*")]
    assert spam and all(r[6] for r in spam if r[4] >= 3)
    assert not any(r[6] for r in got if r[2] and r[2].startswith("/news"))
    assert {r[1] for r in got if r[0] in (900, 901, 902, 903)} == {None}


def test_empty_tables(spark):
    pages, labels = sample()
    assert urltree.url_templates(*tables(spark, [], labels)).count() == 0
    p, lab = tables(spark, pages, [])
    out = urltree.url_templates(p, lab).collect()
    assert len(out) == len(pages) and not any(r["rejected"] for r in out) and not any("spam" in r["template"] for r in out)


def test_rare_sections_and_deep_paths(spark):
    pages = [(i, f"http://hot.example/s{i % 100}/{i}") for i in range(2000)]  # 100 sections of 1 %
    pages += [(3000 + i, f"http://deep.example/a/b/c/d/e/f/{'bad' if i % 2 else 'good'}/{i}") for i in range(60)]
    labels = [(i, int(i % 100 != 7), 0) for i in range(2000)] + [(3000 + i, int(i % 2 == 0), 0) for i in range(60)]
    got = {r["page_id"]: (r["template"], r["rejected"]) for r in urltree.url_templates(*tables(spark, pages, labels)).collect()}
    assert got[7] == ("/s7/*", True) and got[8][1] is False
    assert got[3001] == ("/a/b/c/d/e/f/bad/*", True) and got[3000] == ("/a/b/c/d/e/f/good/*", False)


def test_branches_that_are_alike_are_merged(spark):
    # four bad sections and two half bad ones among good ones; sections of equal shares lie by name, and ties at the threshold are rejected
    kinds = ["bad1", "bad2", "bad3", "bad4", "half1", "half2", *(f"good{k}" for k in range(12))]
    pages = [(i, f"http://x.example/{kinds[i % 18]}/{i}") for i in range(1800)]
    labels = [(i, int(kinds[i % 18][0] == "g" or kinds[i % 18][0] == "h" and i // 18 % 2), 0) for i in range(1800)]
    got = {r["page_id"]: (r["template"], r["n_pages"], r["rejected"]) for r in urltree.url_templates(*tables(spark, pages, labels)).collect()}
    assert {got[i] for i in range(1800) if kinds[i % 18].startswith("bad")} == {("/{bad1|bad4|4}/*", 400, True)}
    assert {got[i][:2] for i in range(1800) if kinds[i % 18].startswith("half")} == {("/{half1|half2|2}/*", 200)}
    assert not any(got[i][2] for i in range(1800) if kinds[i % 18].startswith("good"))


def test_a_share_at_the_threshold_is_rejected(spark):
    pages = [(i, f"http://t.example/only/{i}") for i in range(8)]
    labels = [(i, i % 2, 0) for i in range(8)]
    got = {r["page_id"]: (r["bad_share"], r["rejected"]) for r in urltree.url_templates(*tables(spark, pages, labels)).collect()}
    assert set(got.values()) == {(0.5, True)}
