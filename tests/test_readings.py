import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadence.functions import numbers as N
from cadence.functions import speak
from cadence.functions import text as T

READ = {
    "5": "five", "$19.99": "nineteen dollars and ninety nine cents", "3.14": "three point one four", "1999": "nineteen ninety nine", "1,234": "one thousand two hundred thirty four", "nope": "",
    "£1": "one pound", "€20": "twenty euros", "£5.99": "five pounds and ninety nine pence", "£0.01": "zero pounds and one penny", "£1.2B": "one point two billion pounds", "€3M": "three million euros",
    "¥500": "five hundred yen", "¥1.5": "one point five yen", "-£2.50": "negative two pounds and fifty pence", "$1.2B": "one point two billion dollars", "20k": "twenty k", "4K": "four k", "21st": "twenty first",
    "1999,": "one thousand nine hundred ninety nine", "2007": "two thousand seven", "1905": "nineteen oh five", "1900": "nineteen hundred", "2000": "two thousand", "$.5": "zero dollars and fifty cents", "7%": "seven percent",
    "20th": "twenttieth", "": "",
}


def test_expand_in_python_and_in_columns(spark):
    assert {k: " ".join(speak.expand(k)) for k in READ} == READ
    df = spark.createDataFrame([(k,) for k in READ], "t string")
    assert {r["t"]: r["w"] for r in df.select("t", N.expand(F.col("t")).alias("w")).collect()} == READ


@pytest.mark.parametrize("digits", ["0", "100", "1234", "1000000", "999999999999999999", "1" + "0" * 18, "1" + "0" * 30, "007"])
def test_cardinal(spark, digits):
    got = spark.range(1).select(N.cardinal_digits(F.lit(digits)).alias("w")).first()["w"]
    assert got == " ".join(speak.cardinal(digits))
    if len(digits) == 31:
        assert got.split() == ["one"] + ["zero"] * 30


def test_columns_and_python_agree_on_ranges(spark):
    df = spark.range(0, 2300).select("id", N.cardinal(F.col("id")).alias("c"), N.ordinal(F.col("id")).alias("o"), N.year(F.col("id")).alias("y"))
    for r in df.collect():
        words = speak.cardinal(str(r["id"]))
        assert (r["c"], r["o"], r["y"]) == (" ".join(words), " ".join(speak.to_ordinal(words)), " ".join(speak.year(r["id"])))
    assert spark.range(1).select(N.cardinal(F.lit(-5)).alias("w"), N.cardinal(F.lit(None).cast("long")).alias("n")).first() == ("negative five", None)


def test_dates_times_fractions(spark):
    i = F.lit
    row = spark.range(1).select(
        N.date(i(5), i(17), i(2026)).alias("a"), N.date(i(13), i(1), i(2000)).alias("b"), N.clock(i(10), i(45), i("p")).alias("c"), N.clock(i(9), i(0)).alias("d"), N.clock(i(24), i(0)).alias("e"),
        N.fraction(i(3), i(4)).alias("f"), N.fraction(i(1), i(2)).alias("g"), N.fraction(i(2), i(3)).alias("h"), N.fraction(i(3), i(2)).alias("k"), N.fraction(i(1), i(21)).alias("l"), N.ratio(i(3), i(2)).alias("m"),
        N.roman_value(i("MCMXCIV")).alias("r"), N.roman_value(i("IIX")).alias("s"),
    ).first()
    assert tuple(row) == (
        "may seventeenth twenty twenty six", None, "ten forty five p m", "nine o clock", None, "three quarters", "one half", "two thirds", "three halves", "one first", "three two", 1994, None,
    )
    assert speak.date(2, 31, 68) == "february thirty first twenty sixty eight".split() and speak.date(1, 1, 69)[-2:] == ["sixty", "nine"]


def test_text_functions(spark):
    i = F.lit
    row = spark.range(1).select(
        T.collapse_elongation(i("noooooo")).alias("a"), T.collapse_elongation(i("cooool")).alias("b"), T.collapse_elongation(i("hi")).alias("c"), T.az_key(i("It's")).alias("d"), F.slice(T.encode_ids(i("Ab-c")), 1, 5).alias("e"),
        F.size(T.encode_ids(i("日本"))).alias("f"), T.split_handle(i("fooBar_baz42")).alias("g"), F.array_join(T.read_host(i("https://www.example.com/x?y")), " ").alias("h"), F.array_join(T.read_email(i("a.b@x.io")), " ").alias("k"),
        T.emoji_names(i("❤️😂")).alias("l"), T.strip_marks(i("café Ñandú")).alias("m"), T.fold_apostrophes(i("I’m")).alias("n"), T.nfkc(i("ﬁ 𝓱𝓮")).alias("o"), T.strip_marks_any(i("ệ")).alias("p"), T.expand_fractions(i("1½")).alias("q"), T.letters_count(i("www")).alias("r"),
    ).first()
    assert tuple(row) == (
        ["no", "noo"], ["col", "cool"], ["hi"], "its", [1, 2, 3, 0, 0], 24, ["foo", "bar", "baz", "forty", "two"], "w w w dot example dot com", "a dot b at x dot i o",
        "red heart, tears of joy", "cafe Nandu", "I'm", "fi he", "e", "1 one half ", 9,
    )


@pytest.mark.parametrize(
    ("raw", "url", "full"),
    [
        ("ebay.com", True, False), ("https://x.y", True, True), ("www.x", True, False), ("e.g", False, False), ("foo.co.uk", True, False), ("a.bc/x", True, True), ("a.bc/", True, False), ("end.no", True, False), ("a.com?q=1", True, True), ("plain", False, False),
    ],
)
def test_urls(spark, raw, url, full):
    from cadence.operators import scan

    assert (scan.is_url(raw), scan.is_full_url(raw)) == (url, full)
    assert tuple(spark.range(1).select(T.is_url(F.lit(raw)).alias("u"), T.is_full_url(F.lit(raw)).alias("f")).first()) == (url, full)


@pytest.mark.parametrize("word", ["hello", "hhFDWkdAxDjkbJfXdOwv", "aBcDeFg", "strngths", "x" * 16, "a1B2c3D", "McDonald", ""])
def test_junk(spark, word):
    from cadence.operators import scan

    assert spark.range(1).select(T.looks_junk(F.lit(word)).alias("j")).first()["j"] == scan.looks_junk(word)


def test_texts_are_changed_some_at_a_time(spark):
    texts = ["ệ", None, "a", "ﬁ"] * 300
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.strip_marks_any(F.col("t")).alias("m"), T.nfkc(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("e", "ệ"), (None, None), ("a", "a"), ("fi", "fi")] * 300
    held = []
    assert T._each(pa.array(texts), lambda t: held.append(t) or t).to_pylist() == texts and len(held) == 600
