"""Token counts by tiers of tables: one look-up join, then aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType

from cadence.functions import text as T
from cadence.operators.tokens import plain_note
from cadence.tables import ACRONYM, AMBIGUOUS, INITIALISM, SEED_LEXICON, SLANG

#: Most bytes of a lexicon that is broadcast to the tokens; a larger one is joined as Spark chooses.
BROADCAST_BYTES = 64 << 20


def is_small(lexicon: DataFrame) -> bool:
    """Whether the lexicon, measured whole, may be broadcast: its letters and, for each word, what a hash table takes beside them."""
    return (lexicon.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0) <= BROADCAST_BYTES


def seed_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SEED_LEXICON.items()), "word string, primary int")


def tier_table(lexicon: DataFrame) -> DataFrame:
    """(word, n, source, lexicon_n): what each known word resolves to, tables first to last; n is null for an ambiguous one.

    lexicon_n is the lexicon's count alone, which words of readings take first.
    """
    spark = lexicon.sparkSession
    rows = [(w, n, "slang", 1) for w, n in SLANG.items()] + [(w, n, "initialism", 2) for w, n in INITIALISM.items()] + [(w, None, "abstain", 2) for w in AMBIGUOUS] + [(w, n, "acronym", 4) for w, n in ACRONYM.items()]
    curated = spark.createDataFrame(rows, "word string, n int, source string, tier int")
    words = lexicon.select("word", F.col("primary").cast("int").alias("n"), F.lit("cmudict").alias("source"), F.lit(3).alias("tier"))
    first = F.min_by(F.struct("n", "source"), "tier").alias("first")
    return curated.unionByName(words).groupBy("word").agg(first, F.max(F.when(F.col("tier") == 3, F.col("n"))).alias("lexicon_n")).select("word", "first.n", "first.source", "lexicon_n")


def with_tiers(rows: DataFrame, tiers: DataFrame, broadcast: bool = True) -> DataFrame:
    """rows joined with tiers on word."""
    return rows.join(F.broadcast(tiers) if broadcast else tiers, "word", "left")


def spelled(word: Column) -> Column:
    """Short and without a vowel, so read letter by letter."""
    return word.rlike(r"^\p{L}{2,6}$") & ~word.rlike("[aeiouy]")


def count_tokens(tokens: DataFrame, tiers: DataFrame, keys: list[str], broadcast: bool = True) -> DataFrame:
    """(keys, pos, raw, n, source, confidence, note): a row for each token; keys and pos identify it.

    Of a word's candidates the first that any tier knows counts; then letters of short capitals, then of a vowelless candidate. Words
    of a reading go to the lexicon first, and missing ones add nothing but make the token an abstention.
    """
    reading = F.col("words").isNotNull()
    items = F.when(F.col("silent"), F.array()).when(reading, F.col("words")).otherwise(F.col("candidates")).cast("array<string>")
    rows = tokens.select(*keys, "pos", "raw", "kind", "silent", "approx", "note", reading.alias("reading"), F.posexplode_outer(items).alias("k", "word"))
    rows = with_tiers(rows, tiers, broadcast)
    letters = F.when(spelled(F.col("word")), T.letters_count(F.col("word")))
    # what a word of a reading adds; null if nothing knows it
    part = F.when(F.col("reading"), F.coalesce("lexicon_n", F.when(F.col("source").isNotNull(), F.col("n")).otherwise(letters)))
    rows = rows.withColumn("part", part)
    known = F.col("source").isNotNull() & ~F.col("reading")
    missing = F.col("reading") & F.col("part").isNull() & F.col("word").isNotNull()
    once = [F.first(c).alias(c) for c in ("raw", "kind", "silent", "approx", "note", "reading")]
    grouped = rows.groupBy(*keys, "pos").agg(
        *once,
        F.min(F.when(known, F.struct("k", "n", "source"))).alias("hit"),
        F.min(F.when(~F.col("reading") & letters.isNotNull(), F.struct(F.col("k"), letters.alias("n"), F.col("word")))).alias("spelled"),
        F.count(F.when(~F.col("reading"), F.col("word"))).alias("n_candidates"),
        F.sum("part").cast("int").alias("parts"),
        F.array_sort(F.collect_list(F.when(missing, F.struct("k", "word")))).alias("missing"),
    )
    bare = F.regexp_replace("raw", "^['’-]+|['’-]+$", "")
    capitals = (F.col("n_candidates") > 0) & bare.rlike(r"^\p{Lu}{2,6}$")
    dashed = lambda w: F.array_join(F.split(w, "(?!^)(?=.)"), "-")
    hit, spell = F.col("hit"), F.col("spelled")
    some = F.col("reading") & (F.size("missing") > 0)
    own = (
        F.when(hit.isNotNull() & hit["n"].isNull(), "ambiguous initialism").when(hit.isNotNull(), "")
        .when(capitals, dashed(F.lower(bare))).when(spell.isNotNull(), dashed(spell["word"])).otherwise("OOV")
    )
    n = F.when(F.col("silent"), 0).when(F.col("reading"), F.coalesce("parts", F.lit(0))).when(hit.isNotNull(), F.coalesce(hit["n"], F.lit(0))).when(capitals, T.letters_count(F.lower(bare))).otherwise(F.coalesce(spell["n"], F.lit(0)))
    source = (
        F.when(F.col("silent") | F.col("reading") & ~some, F.col("kind")).when(some, "abstain").when(hit.isNotNull(), hit["source"])
        .when(capitals | spell.isNotNull(), "letters").otherwise("abstain")
    )
    confidence = F.when(F.col("silent"), "exact").when(F.col("reading"), F.when(some | F.col("approx"), "approx").otherwise("exact")).when(source == "abstain", "none").otherwise("exact")
    lost = F.concat(F.col("note"), F.lit(" [OOV: "), F.array_join(F.transform("missing", lambda m: m["word"]), " "), F.lit("]"))
    note = F.when(F.col("silent") | F.col("reading") & ~some, F.col("note")).when(some, F.trim(lost)).when((F.col("note") != "") & (own != ""), F.concat_ws("; ", "note", own)).when(own != "", own).otherwise(F.col("note"))
    return grouped.select(*keys, "pos", "raw", n.cast("int").alias("n"), source.alias("source"), confidence.alias("confidence"), note.alias("note"))


def count_plain(words: DataFrame, tiers: DataFrame, broadcast: bool = True) -> DataFrame:
    """words, which has raw, a word or mark of a plain line, with n, source, confidence, note, route and oov_word.

    A plain word has one form, or two if it is drawn out, so it is looked up in its own row: nothing is exploded, grouped or shuffled. A null
    raw, of a line without words, counts nothing.
    """
    word, low = F.col("raw").rlike("^[A-Za-z]"), F.lower("raw")
    drawn = low.rlike(r"(.)\1\1")
    rows = words.withColumn("w0", F.when(word, F.when(drawn, F.regexp_replace(low, r"(.)\1{2,}", "$1")).otherwise(low)))
    rows = rows.withColumn("w1", F.when(word & drawn, F.regexp_replace(low, r"(.)\1{2,}", "$1$1")))
    for k in range(2):
        known = tiers.select(F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}"), F.col("source").alias(f"s{k}"))
        rows = rows.join(F.broadcast(known) if broadcast else known, f"w{k}", "left")
    hit = F.coalesce("s0", "s1")
    n = F.when(F.col("s0").isNotNull(), F.col("n0")).otherwise(F.col("n1"))
    form = F.when(F.col("raw").rlike("^[A-Z]{2,6}$"), low).when(spelled(F.col("w0")), F.col("w0")).when(spelled(F.col("w1")), F.col("w1"))
    rows = rows.withColumns({"hit": hit, "hit_n": n, "form": F.when(hit.isNull(), form)})
    hit, form = F.col("hit"), F.col("form")
    lost = word & hit.isNull() & form.isNull()
    route = F.when(hit == "abstain", "hard").when(lost, F.when(T.looks_junk(F.col("raw")), "hard").otherwise("oov")).otherwise("det")
    rows = rows.withColumns(
        {
            "n": F.when(hit.isNotNull(), F.coalesce("hit_n", F.lit(0))).when(form.isNotNull(), T.letters_count(form)).otherwise(0).cast("int"),
            "source": F.when(~word, "punct").when(hit.isNotNull(), hit).when(form.isNotNull(), "letters").otherwise("abstain"),
            "route": route,
        }
    )
    own = F.when(hit == "abstain", "ambiguous initialism").when(form.isNotNull(), F.array_join(F.split(form, "(?!^)(?=.)"), "-")).when(lost, "OOV")
    return rows.select(
        *words.columns, "n", F.when(F.col("raw").isNotNull(), F.col("source")).alias("source"), F.when(F.col("source") == "abstain", "none").otherwise("exact").alias("confidence"),
        F.concat_ws("; ", F.when(plain_note(F.col("raw")) != "", plain_note(F.col("raw"))), own).alias("note"), "route", F.when(F.col("route") == "oov", F.col("w0")).alias("oov_word"),
    )


def count_plain_kinds(words: DataFrame, tiers: DataFrame) -> DataFrame:
    """The same with tiers too large to broadcast: each distinct word is looked up once, and one join brings the answers back."""
    kinds = count_plain(words.where("raw is not null").select("raw").distinct(), tiers, False)
    found = words.where("raw is not null").join(kinds, "raw")
    empty = words.where("raw is null").select("*", *(F.lit({"n": 0, "confidence": "exact", "note": "", "route": "det"}.get(f.name)).cast(f.dataType).alias(f.name) for f in kinds.schema if f.name != "raw"))
    return found.unionByName(empty)


def deletions(word: Column) -> Column:
    """The word and what one deletion leaves of it or, of words of eight letters or more, two; the blocks of the spelling join."""

    def shorter(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    one = shorter(word)
    two = F.when(F.length(word) >= 8, F.flatten(F.transform(one, shorter))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


@F.pandas_udf(IntegerType())
def osa_distance(a, b):
    """Optimal string alignment distance, up to 3, of two columns."""
    import pandas as pd

    def distance(x: str, y: str) -> int:
        rows = [list(range(len(y) + 1))]
        for i, c in enumerate(x, 1):
            row = [i]
            for j, d in enumerate(y, 1):
                best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (c != d))
                if i > 1 < j and c == y[j - 2] and x[i - 2] == d:
                    best = min(best, rows[-2][j - 2] + 1)
                row.append(best)
            rows.append(row)
        return min(3, rows[-1][-1])

    return pd.Series([distance(x, y) for x, y in zip(a, b)], dtype="int32")


def correct(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, corrected, distance): the one nearest lexicon word of each distinct word of four letters or more; ties give none.

    Candidates share a deletion with the word, so the search is an equi-join; only they are measured. The first letter must stay, or trade places with the
    second.
    """
    fits = lambda c: F.col(c).rlike(r"^\p{L}+$")
    asked = words.select(F.lower("word").alias("word")).where(fits("word") & (F.length("word") >= 4)).distinct().withColumn("piece", F.explode(deletions(F.col("word"))))
    known = lexicon.where(fits("word")).select(F.col("word").alias("corrected")).distinct().withColumn("piece", F.explode(deletions(F.col("corrected"))))
    start = (F.substring("word", 1, 1) == F.substring("corrected", 1, 1)) | (F.substring("corrected", 1, 2) == F.reverse(F.substring("word", 1, 2)))
    pairs = asked.join(known, "piece").where("word <> corrected").select("word", "corrected").distinct().where(start)
    # a swap of neighbours is two plain edits, so with s swaps the distance is the plain one less s, and a pair farther than four plain edits is out
    most = F.when(F.length("word") >= 8, 2).otherwise(1)
    pairs = pairs.withColumn("plain", F.levenshtein("word", "corrected", 4)).where((F.col("plain") >= 0) & (F.col("plain") <= 2 * most))
    settled = F.col("plain") <= 1
    near = pairs.where(settled).select("word", "corrected", F.col("plain").alias("distance"))
    near = near.unionByName(pairs.where(~settled).select("word", "corrected", osa_distance("word", "corrected").alias("distance"))).where(F.col("distance") <= most)
    best = near.withColumn("least", F.min("distance").over(W.partitionBy("word"))).where("distance = least").groupBy("word").agg(F.count("*").alias("ties"), F.min("corrected").alias("corrected"), F.min("distance").alias("distance"))
    return best.where("ties = 1").select("word", "corrected", "distance")
