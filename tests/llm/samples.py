"""Small tables for the tests of the operators."""

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("id", "bucket", "key", "n", "pos", "row", "value", "group", "count", "a", "b", "line", "root", "gone", "words", "lowered", "label", "t")


def words(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    sounds = "ka lo mi ter on da re shu vel or ant ti que ba".split()
    out = []
    for _ in range(n):
        k = int(vocabulary * r.random() ** 2)
        w = "".join(sounds[(k // 14**i) % 14] for i in range(1 + (k > 13) + (k > 195)))
        out.append(w)
    return out


def swapped(seed, text, share):
    r = random.Random(seed)
    return [w if r.random() > share else "zz" + str(r.randrange(10**6)) for w in text]


def table(spark, rows):
    """rows of (doc_id, text), as documents with columns beside whose names clash with those that operators use."""
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))


def odd_rows():
    """Nulls, empty and blank texts, marks alone, one word, a very long text, repeated rows."""
    long = " ".join(prose(1, 60_000))
    return [
        (None, "a row without an id but with a text of several words"), (None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "!!! ... ???"), (5, "word"), (6, "word"),
        (7, long), (8, "the same row twice with words enough"), (8, "the same row twice with words enough"), (9, "é ß ñ 漢字 😀 über"), (10, "tie tie tie tie"), (11, "Tie, tie; TIE. tie!"),
    ]


def groups(pairs):
    """{id: smallest id that the pairs connect it with}, for ids of which it isn't the smallest."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in list(parent) if find(x) != x}
