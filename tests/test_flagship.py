"""The flagship queries against a reader of documents that is written apart from the package: what a document's lines hold is read by other means."""

import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cadence.plans import api, cli
from cadence.tables import ACRONYM, AMBIGUOUS, INITIALISM, SEED_LEXICON, SLANG, SYMBOL

SMALL = "/root/testdata/sf0.001"
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
BIG = [(10**15, "quadrillion"), (10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")]


def spell(n):
    for size, name in BIG:
        if n >= size:
            return [*spell(n // size), name, *(spell(n % size) if n % size else [])]
    return [ONES[n]] if n < 20 else [TENS[n // 10], *([ONES[n % 10]] if n % 10 else [])]


def word_count(raw):
    """(count, sure, told to be hopeless) of one word."""
    low = raw.lower()
    forms = [re.sub(r"(.)\1\1+", r"\1", low), re.sub(r"(.)\1\1+", r"\1\1", low)]
    bare = ["".join(c for c in unicodedata.normalize("NFKD", f) if not unicodedata.combining(c)) for f in forms]
    for f in [*forms, *bare, *(re.sub("[^a-z]", "", x) for x in forms + bare)]:
        if not f:
            continue
        if f in SLANG:
            return SLANG[f], True
        if f in AMBIGUOUS:
            return 0, False
        for t in (INITIALISM, SEED_LEXICON, ACRONYM):
            if f in t:
                return t[f], True
    spelled = [low] if 1 < len(raw) < 7 and raw.isupper() else [f for f in [*forms, *bare, *(re.sub("[^a-z]", "", x) for x in forms + bare)] if 1 < len(f) < 7 and not re.search("[aeiouy]", f)]
    return (sum(3 if c == "w" else 1 for c in spelled[0]), True) if spelled else (0, False)


def said(words):
    got = [(SEED_LEXICON[w], True) if w in SEED_LEXICON else word_count(w) for w in words]
    return sum(n for n, _ in got), all(s for _, s in got)


def digits(text):
    """A run of digits: a year if four that look like one; beyond 18 digit by digit."""
    text = text.lstrip("0") or "0" if len(text) != 4 else text
    n = int(text)
    if len(text) == 4 and 1000 <= n <= 2099:
        high, low = divmod(n, 100)
        if n % 1000 == 0 or 2000 < n < 2010:
            return spell(n)
        return spell(high) + (["hundred"] if not low else ["oh", ONES[low]] if low < 10 else spell(low))
    return [ONES[int(c)] for c in text] if len(text) > 18 else spell(n)


PIECE = re.compile(r"(?P<word>[^\W\d_]+)|(?P<number>\d+)|(?P<mark>\S)")
#: What needs more than pieces: links, addresses, names, joined or pointed numbers, faces, numerals.
HARD = re.compile(r"\d[\d.,:/-]*\d[.]|\d\.\d|\w\.\w|[@#]\w|\w['-]\w|[xX]+D+|[:;=]|\d[a-zA-Z%]|[-$€£¥−]\d|\d+-\d|\b[IVXLCDM]{2,}\b|[oO]\.[oO]|-_-|\^|w/|b/c|\(\d")


def read(line):
    """(total, how many pieces are unsure), or None for what this reader leaves alone."""
    if HARD.search(line):
        return None
    total = unsure = 0
    for m in PIECE.finditer(line):
        if m["word"]:
            n, sure = word_count(m["word"])
        elif m["number"]:
            n, sure = said(digits(m["number"]))
        else:
            n, sure = said(SYMBOL.get(m["mark"], []))
        total, unsure = total + n, unsure + (not sure)
    return total, unsure


@pytest.fixture(scope="module")
def lines(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {(r["doc_id"], k): t for r in rows for k, t in enumerate(r["text"].split("\n"))}


def test_totals_of_all_lines(spark, lines):
    got = {r["line_id"]: (r["total"], r["n_uncertain"]) for r in __spark_entry__.queries()["document_totals"](spark, SMALL).collect()}
    assert len(got) == len(lines)
    want = {f"{d}-{k}": read(t) for (d, k), t in lines.items()}
    held = {k: v for k, v in want.items() if v is not None}
    assert len(held) > 0.95 * len(lines)
    assert {k: got[k] for k in held} == held


def test_haiku_lines_are_the_sure_ones_of_five_or_seven(spark, lines):
    got = {(r["doc_id"], r["line_no"]): r["syllable_count"] for r in __spark_entry__.queries()["haiku_lines"](spark, SMALL).collect()}
    want = {k: r[0] for k, t in lines.items() if (r := read(t)) is not None and not r[1] and r[0] in (5, 7)}
    assert {k: v for k, v in got.items() if read(lines[k]) is not None} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_read_once(spark):
    df = spark.createDataFrame([(0, "a cat"), (1, "5 cats")], "line_id long, text string")
    for out in (api.analyze(df), api.count_keys(df), api.trace(df)):
        p = plan_of(out)
        assert Counter(x for x in re.findall(r"\b(?:ArrowEvalPython|MapInArrow|BatchEvalPython)\b", p.split("Initial Plan")[-1])) == {"MapInArrow": 1}, p
        assert not re.search(r"Filter.*regexp_extract_all", p)


def test_explanations(spark, capsys):
    df = spark.createDataFrame([(0, "five cats in the house"), (1, "omg blarghhhh today"), (2, "lol")], "line_id long, text string")
    unsure = lambda words: words.select("word", F.array(*map(F.lit, [0.5, 0.3, 0.1, 0.05, 0.05, 0.0, 0.0, 0.0])).alias("p"))
    rows = api.explain(df, scorer=unsure).orderBy("line_id").collect()
    assert [(r["routing"], r["det"], r["haiku"]) for r in rows] == [("det", 5, 5), ("det+oov", 5, None), ("hard", 0, None)]
    assert [(a["word"], a["count"], round(a["p"], 2), round(a["margin"], 2), a["accepted_from"]) for a in rows[1]["answers"]] == [("blargh", 1, 0.5, 0.2, 0.5)]
    assert [(s["fuzziness"], s["count"]) for s in rows[1]["sweep"]] == [(0.0, None), (0.25, None), (0.5, 6), (0.75, 6), (1.0, 6)]
    assert cli.main(["--explain", "-"], spark, ["nine cats\n", "  \n", "lol\n"]) == 0
    out = capsys.readouterr().out
    assert "[OK    ] total=2" in out and "routing: hard" in out and out.count("haiku: no") == 2
    assert cli.main(["-"], spark, ["nine\n", "cats\n"]) == 0 and "total=2" in capsys.readouterr().out
    assert cli.texts_of([], [], False) == list(cli.SAMPLES)
