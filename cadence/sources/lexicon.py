"""Pronunciation sources as DataFrames, their reconciliation into one lexicon, and its files."""

from __future__ import annotations

import lzma

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.numbers import let
from cadence.functions.text import az_key
from cadence.schemas import LEXICON

MAX_COUNT = 8
IPA_VOWELS = "aeiouyøœɐɑɒɔɘəɚɛɜɝɞɤɨɪɵɯɶʉʊʌʏæ"
SYLLABIC = "̩"
_MARKS = "ˈˌːˑ ̯̩͡‿/[]()|"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of text files; numbers rise in file order."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def parse_cmudict(lines: DataFrame) -> DataFrame:
    """(word, primary, counts) from lines `word[(k)] PHONE ...`: a syllable for each phone that ends in a digit.

    primary is that of the first line that is no variant, else the least.
    """
    rows = lines.select("line_no", F.trim(F.regexp_replace("value", " #.*$", "")).alias("value")).where("value <> ''")
    head = F.substring_index("value", " ", 1)
    word = F.regexp_extract(head, r"^(.+?)\(\d+\)$", 1)
    n = F.size(F.filter(F.slice(F.split("value", " "), 2, 10_000), lambda p: p.rlike("[0-9]$")))
    rows = rows.select("line_no", F.when(word != "", word).otherwise(head).alias("word"), (word != "").alias("variant"), n.alias("n"))
    own = F.min(F.when(~F.col("variant"), F.struct("line_no", "n")))["n"]
    return rows.groupBy("word").agg(F.coalesce(own, F.min("n")).alias("primary"), F.array_sort(F.collect_set("n")).alias("counts"))


def ipa_runs(ipa: Column) -> Column:
    """Maximal runs of phones with a vowel or a syllabic mark."""
    phones = F.transform(F.split(F.trim(ipa), r"\s+"), lambda p: p.rlike(f"[{IPA_VOWELS}{SYLLABIC}]"))
    # bound once: named within the filter it would be made anew for each phone
    return let(phones, lambda vowel: F.size(F.filter(F.sequence(F.lit(0), F.size(vowel) - 1), lambda k: F.get(vowel, k) & ~F.coalesce(F.get(vowel, k - 1), F.lit(False)))))


def parse_wikipron(lines: DataFrame) -> DataFrame:
    """(word, counts) from lines `word<tab>phones`; lines without either part or without a syllable are left out."""
    value = F.trim(F.col("value"))
    rows = lines.where(value.contains("\t")).select(F.lower(F.substring_index(value, "\t", 1)).alias("word"), F.trim(F.regexp_replace(value, "^[^\t]*\t", "")).alias("ipa"))
    rows = rows.where("word <> '' and ipa <> ''").withColumn("n", ipa_runs(F.col("ipa"))).where("n >= 1")
    return rows.groupBy("word").agg(F.array_sort(F.collect_set("n")).alias("counts"))


def _ints(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != ""), lambda x: x.cast("int"))


def parse_kaikki(lines: DataFrame) -> DataFrame:
    """(word, ipa, hyph) from lines `word<tab>counts<tab>counts`; of lines that repeat a word the last holds."""
    parts = F.split("value", "\t")
    rows = lines.select("line_no", F.get(parts, 0).alias("word"), _ints(F.get(parts, 1)).alias("ipa"), _ints(F.get(parts, 2)).alias("hyph"))
    return rows.groupBy("word").agg(F.max_by(F.struct("ipa", "hyph"), "line_no").alias("last")).select("word", "last.*")


def ipa_groups(ipa: Column) -> Column:
    """Groups between dots, of 1 to 12; null without a dot."""
    bare = F.translate(ipa, _MARKS, "")
    n = F.size(F.filter(F.split(bare, r"\."), lambda g: g != ""))
    return F.when(bare.contains(".") & n.between(1, 12), n)


KAIKKI_JSON = "lang_code string, word string, sounds array<struct<ipa:string>>, hyphenations array<struct<parts:array<string>>>, hyphenation array<string>, _corrupt_record string"


def read_kaikki_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw entries of JSON lines; broken lines have only _corrupt_record."""
    return spark.read.schema(KAIKKI_JSON).option("mode", "PERMISSIVE").json(path)


def extract_kaikki(entries: DataFrame) -> DataFrame:
    """(word, ipa, hyph): sorted counts of English entries that have any, united by word."""
    word = F.lower(F.trim("word"))
    from_parts = F.transform("hyphenations", lambda h: F.size(F.filter(h["parts"], lambda p: p != "")))
    plain = F.transform("hyphenation", lambda h: F.size(F.filter(F.array(h), lambda p: p != "")))
    hyph = F.when(F.size("hyphenations") > 0, from_parts).otherwise(plain)
    rows = entries.where("lang_code = 'en'").select(word.alias("word"), F.transform("sounds", lambda s: ipa_groups(s["ipa"])).alias("ipa"), hyph.alias("hyph")).where("word <> ''")
    clean = lambda c: F.filter(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<int>"))))), lambda n: n.between(1, 12))
    out = rows.groupBy("word").agg(F.array_sort(clean(F.col("ipa"))).alias("ipa"), F.array_sort(clean(F.col("hyph"))).alias("hyph"))
    return out.where("size(ipa) > 0 or size(hyph) > 0")


def write_kaikki(rows: DataFrame, path: str) -> None:
    """Tab-separated, sorted by word."""
    rows.orderBy("word").select("word", F.array_join("ipa", ",").alias("ipa"), F.array_join("hyph", ",").alias("hyph")).write.csv(path, sep="\t", emptyValue="")


def reconcile(cmu: DataFrame, wiki: DataFrame, kaikki: DataFrame) -> DataFrame:
    """The lexicon: three sources by their letters alone, joined in full.

    The primary count is that of the first source that has the word, in the order given with kaikki before wiki; valid counts are those of the
    first and third, or else of the second; several valid ones, or two sources that differ, make a word ambiguous.
    """
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    keyed = lambda df: df.withColumn("word", az_key(F.col("word"))).where("word <> ''").groupBy("word")
    c = keyed(cmu).agg(F.min("primary").alias("c_primary"), union("counts").alias("c"))
    w = keyed(wiki).agg(union("counts").alias("w"))
    k = keyed(kaikki.where("size(hyph) > 0")).agg(union("hyph").alias("k"))
    rows = c.join(w, "word", "full_outer").join(k, "word", "full_outer")
    valid = F.coalesce(F.array_sort(F.array_union("c", "k")), "c", "k", "w")
    ambiguous = F.coalesce(F.size("c") > 1, F.lit(False)) | F.coalesce(F.size("k") > 1, F.lit(False)) | F.coalesce(F.col("c") != F.col("k"), F.lit(False))
    source = F.when(F.col("c").isNotNull(), "cmu").when(F.col("k").isNotNull(), "kaikki").otherwise("wikipron")
    return rows.select("word", F.coalesce("c_primary", F.array_min("k"), F.array_min("w")).alias("primary"), valid.alias("valid"), ambiguous.alias("ambiguous"), source.alias("source"))


def in_range(lexicon: DataFrame) -> DataFrame:
    return lexicon.where(F.col("primary").between(1, MAX_COUNT))


def soft_labels(valid: Column) -> Column:
    """Equal shares of the valid counts from 1 to 8, 0 elsewhere."""
    some = F.filter(valid, lambda c: c.between(1, MAX_COUNT))
    return F.transform(F.sequence(F.lit(1), F.lit(MAX_COUNT)), lambda c: F.when(F.array_contains(some, c), F.lit(1.0) / F.size(some)).otherwise(F.lit(0.0)))


SUFFIXES = "iness ation ments ment ness iest ies ied ing edly ed es er est ly al ic s y".split()


def stem(word: Column) -> Column:
    """The word without the first of SUFFIXES, in their order, that leaves three letters or more."""
    out = word
    for s in reversed(SUFFIXES):
        out = F.when(word.endswith(s) & (F.length(word) >= len(s) + 3), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


def first_by(rows: DataFrame, order: Column, *ns: int) -> list[Column]:
    """For each n whether a row is among the first n by order, a struct whose first field is a hash h; exact, without sorting the rows.

    The hashes' first 16 bits are counted, at most 65,536 of them, and only rows of the one value in which an n-th row lies are brought to the driver.
    """
    top = F.shiftright(order["h"], 48)
    counts = rows.groupBy(top.alias("top")).count().orderBy("top").collect()
    out = []
    for n in ns:
        seen, first = 0, F.lit(n > 0)
        for r in counts:
            if seen + r["count"] <= n:
                seen += r["count"]
                continue
            first = top < r["top"]
            if n > seen:
                last = rows.where(top == r["top"]).select(order.alias("o")).orderBy("o").limit(n - seen).collect()[-1]["o"]
                first = order <= F.struct(*(F.lit(v).alias(k) for k, v in last.asDict().items()))
            break
        out.append(first)
    return out


def split(lexicon: DataFrame, how: str = "random", seed: int = 0, validation: float = 0.05, test: float = 0.05) -> DataFrame:
    """lexicon, of distinct words, with part: train, val or test, of as many words as the shares of all words, rounded down.

    random goes by a seeded hash of the word, hard by that of its stem, so that stems are dealt whole but for those at a part's end; source_oov tests on
    the words of wikipron alone; all trains on everything.
    """
    if how not in ("random", "hard", "source_oov", "all"):
        raise ValueError(f"unknown split {how!r}")
    if how == "all":
        return lexicon.withColumn("part", F.lit("train"))
    by = stem(F.col("word")) if how == "hard" else F.col("word")
    order = F.struct(F.xxhash64(by, F.lit(seed)).alias("h"), by.alias("by"), F.col("word").alias("word"))
    # read by each of the steps: made once, on the executors' disks if need be
    lexicon = lexicon.persist()
    n = lexicon.count()
    n_test, n_val = int(n * test), int(n * validation)
    if how == "source_oov":
        ours = F.coalesce(F.col("source") == "wikipron", F.lit(False))
        [val] = first_by(lexicon.where(~ours), order, n_val)
        return lexicon.withColumn("part", F.when(ours, "test").when(val, "val").otherwise("train"))
    test_rows, others = first_by(lexicon, order, n_test, n_test + n_val)
    return lexicon.withColumn("part", F.when(test_rows, "test").when(others, "val").otherwise("train"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon of lines `word<tab>count`, or, by its name, of Parquet.

    An .xz file, which Hadoop has no codec for, is unpacked by the driver: these hold some hundred thousand words.
    """
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".xz"):
        with lzma.open(path, "rt", encoding="utf-8") as file:
            rows = [(w, int(n)) for w, _, n in (line.rstrip("\n").partition("\t") for line in file) if n]
        if not rows:
            raise ValueError(f"{path} holds no words")
        lexicon = spark.createDataFrame(rows, "word string, primary int")
    else:
        lexicon = spark.read.schema("word string, primary int").csv(path, sep="\t")
    out = lexicon.select("word", "primary", F.array("primary").alias("valid"), F.lit(False).alias("ambiguous"), F.lit("ship").alias("source"))
    return out.select(*(F.col(f.name).cast(f.dataType) for f in LEXICON))


def load_lexicon(spark: SparkSession, path: str, cmudict: str | None = None) -> DataFrame:
    """The lexicon file, or where it is missing, empty or broken, the words of a CMUdict file with all counts that these have."""
    try:
        found = read_lexicon(spark, path)
        if not found.isEmpty():
            return found
        broken: Exception = ValueError(f"{path} holds no words")
    except (OSError, EOFError, lzma.LZMAError, ValueError, PySparkException) as e:
        broken = e
    if cmudict is None:
        raise broken
    rows = parse_cmudict(text_lines(spark, cmudict))
    out = rows.select("word", "primary", F.col("counts").alias("valid"), (F.size("counts") > 1).alias("ambiguous"), F.lit("cmu").alias("source"))
    return out.select(*(F.col(f.name).cast(f.dataType) for f in LEXICON))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """word and primary, sorted: as .xz one file by the driver, else Parquet."""
    rows = lexicon.select("word", "primary").orderBy("word")
    if not path.endswith(".xz"):
        rows.write.parquet(path)
        return
    with lzma.open(path, "wt", encoding="utf-8", preset=9 | lzma.PRESET_EXTREME) as file:
        for r in rows.toLocalIterator():
            file.write(f"{r['word']}\t{r['primary']}\n")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, event: str | None = None) -> DataFrame:
    rows = spark.read.json(path)
    return rows if event is None else rows.where(F.col("event") == event)
