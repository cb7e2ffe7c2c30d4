"""The public transforms: counts, traces and haiku lines of a column of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import policy, resolve, tokens
from cadence.operators.scalar import line_sums, trace_text
from cadence.operators.scorer import Scorer
from cadence.tables import SEED_LEXICON

KEY = ["line_key"]
_SUMS = "total int, n_uncertain int, det int, oov_n int, hard boolean, oov array<string>"
_TRACE = ["pos", "raw", "n", "source", "confidence", "note"]


def _lexicon(spark: SparkSession, lexicon: DataFrame | None) -> DataFrame:
    return resolve.seed_lexicon(spark) if lexicon is None else lexicon


def _known(lexicon: DataFrame | None, words: DataFrame) -> dict[str, int]:
    """A small lexicon as what the scanner's workers look words up in."""
    return SEED_LEXICON if lexicon is None else {r["word"]: r["primary"] for r in words.select("word", "primary").toLocalIterator()}


def trace(lines: DataFrame, lexicon: DataFrame | None = None, key: str = "line_id", text: str = "text") -> DataFrame:
    """(key, pos, raw, n, source, confidence, note): how each token of each line was counted. key must identify lines.

    With a lexicon that is small enough to be sent along nothing is shuffled.
    """
    spark, words = lines.sparkSession, _lexicon(lines.sparkSession, lexicon)
    lines = lines.select(F.col(key).alias("line_key"), F.col(text).alias("text"))
    tiers = resolve.tier_table(words)
    if lexicon is not None and not resolve.is_small(words):
        scanned = tokens.explode_tokens(tokens.tokenize(lines, tokens.numerals_of(words)).drop("text"))
        return resolve.count_tokens(scanned, tiers, KEY, False).withColumnRenamed("line_key", key)
    plain, odd = tokens.branches(lines)
    direct = resolve.count_plain(tokens.exploded(plain, tokens.plain_tokens(F.col("text"))).where("raw is not null"), tiers).select("line_key", *_TRACE)
    known = spark.sparkContext.broadcast(_known(lexicon, words))
    scanned = tokens.in_batches(odd, "pos int, raw string, n int, source string, confidence string, note string", lambda t, memo: ((k, *x) for k, x in enumerate(trace_text(t, known.value, memo))))
    return direct.unionByName(scanned).withColumnRenamed("line_key", key)


def line_routes(lines: DataFrame, lexicon: DataFrame | None = None, key: str = "line_id", text: str = "text") -> DataFrame:
    """(line_key, total, n_uncertain, det, oov_n, hard, oov) of each line whose text isn't null; see scalar.line_sums().

    Words of plain lines are exploded once and looked up by joins within the row; one row of sums for each line is shuffled, texts are not. Other
    lines are summed in the batches that scan them, as long as the lexicon can be sent along; with a larger one each distinct word of plain lines is looked up
    once, and tokens of the others are joined too.
    """
    spark, words = lines.sparkSession, _lexicon(lines.sparkSession, lexicon)
    small = lexicon is None or resolve.is_small(words)
    tiers = resolve.tier_table(words)
    plain, odd = tokens.branches(lines.where(F.col(text).isNotNull()).select(F.col(key).alias("line_key"), F.col(text).alias("text")))
    exploded = tokens.exploded(plain, tokens.plain_words(F.col("text")))
    direct = policy.route_lines(resolve.count_plain(exploded, tiers) if small else resolve.count_plain_kinds(exploded, tiers), KEY)
    if small:
        known = spark.sparkContext.broadcast(_known(lexicon, words))
        return direct.unionByName(tokens.in_batches(odd, _SUMS, lambda t, memo: [line_sums(t, known.value, memo)]))
    scanned = tokens.scanned_tokens(odd, tokens.numerals_of(words)).drop("text")
    spoken = policy.classify(resolve.count_tokens(tokens.explode_tokens(scanned).where("not silent"), tiers, KEY, False)).select("line_key", "pos", "n", "source", "route", "oov_word")
    every = odd.select("line_key", F.lit(-1).alias("pos"), F.lit(0).alias("n"), F.lit("punct").alias("source"), F.lit("det").alias("route"), F.lit(None).cast("string").alias("oov_word"))
    return direct.unionByName(policy.route_lines(spoken.unionByName(every), KEY))


def analyze(lines: DataFrame, lexicon: DataFrame | None = None, key: str = "line_id", text: str = "text") -> DataFrame:
    """(key, total, confident, n_uncertain) of every line; one without tokens, or with a null text, has a sure total of 0. key must identify lines."""
    sums = line_routes(lines.withColumn(text, F.coalesce(text, F.lit(""))), lexicon, key, text)
    return sums.select(F.col("line_key").alias(key), "total", (F.col("n_uncertain") == 0).alias("confident"), "n_uncertain")


def count_keys(lines: DataFrame, lexicon: DataFrame | None = None, scorer: Scorer | None = None, fuzziness: float | tuple[float, ...] = 0.0, most: int | tuple[int, ...] | None = None, key: str = "line_id", text: str = "text") -> DataFrame:
    """(key, syllable_count) of the lines that have a sure count of up to `most`; key must identify lines.

    The scorer sees each unknown word once, and none of lines that are settled without it. An empty text has 0; a null one is left out. With a tuple of
    settings of fuzziness the rows are (key, fuzziness, syllable_count); with one of budgets they have most, too.
    """
    routed = line_routes(lines, lexicon, key, text)
    scores = scorer(policy.asked_words(routed, KEY, most)) if scorer is not None else None
    out = policy.totals(routed, scores, KEY, most, fuzziness)
    return out.withColumn("syllable_count", policy.within(F.col("syllable_count"), policy.budget(most))).where("syllable_count is not null").withColumnRenamed("line_key", key)


def count_lines(lines: DataFrame, lexicon: DataFrame | None = None, scorer: Scorer | None = None, fuzziness: float = 0.0, most: int | None = None, key: str = "line_id", text: str = "text") -> DataFrame:
    """lines with syllable_count: the sure count, or null; see count_keys(), which spares the join that brings the lines back."""
    return lines.join(count_keys(lines, lexicon, scorer, fuzziness, most, key, text), key, "left").select(*lines.columns, "syllable_count")


def haiku_keys(lines: DataFrame, **settings) -> DataFrame:
    """(key, syllable_count) of the lines that surely count 5 or 7."""
    return count_keys(lines, most=7, **settings).where(F.col("syllable_count").isin(5, 7))


def haiku_lines(lines: DataFrame, **settings) -> DataFrame:
    """lines with syllable_count 5 or 7 where the count is sure, else null."""
    return count_lines(lines, most=7, **settings).withColumn("syllable_count", policy.haiku(F.col("syllable_count")))


def fuzziness_sweep(lines: DataFrame, scorer: Scorer, steps: tuple[float, ...] = policy.STEPS, key: str = "line_id", **settings) -> DataFrame:
    """lines crossed with strictness settings, with the count at each; lines are read and words scored once for all settings."""
    counts = count_keys(lines, scorer=scorer, fuzziness=tuple(steps), key=key, **settings)
    each = lines.withColumn("fuzziness", F.explode(F.array(*map(F.lit, map(float, steps)))))
    return each.join(counts, [key, "fuzziness"], "left").select(*lines.columns, "syllable_count", "fuzziness")


def _quoted(c: Column | str) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def describe(lines: DataFrame, lexicon: DataFrame | None = None, key: str = "line_id", text: str = "text") -> DataFrame:
    """(key, description): the trace for people: the text, the verdict and a line for each token that isn't punctuation."""
    mark = F.when(F.col("confidence") == "exact", " ").when(F.col("confidence") == "approx", "~").otherwise("!")
    row = F.concat(F.lit("  "), mark, F.lit(" "), F.rpad(_quoted("raw"), 24, " "), F.lit(" "), F.lpad(F.col("n").cast("string"), 2, " "), F.lit("  "), F.rpad("source", 10, " "), F.when(F.col("note") != "", F.concat(F.lit(" "), "note")).otherwise(""))
    traced = trace(lines, lexicon, key, text)
    rows = traced.where("source <> 'punct'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))).alias("rows"))
    sums = analyze(lines, lexicon, key, text)
    verdict = F.concat(F.when(F.col("confident"), "[OK    ] total=").otherwise("[UNSURE] total="), "total", F.when(F.col("confident"), "").otherwise(F.concat(F.lit("  ("), "n_uncertain", F.lit(" uncertain)"))))
    return lines.select(key, text).join(sums, key).join(rows, key, "left").select(key, F.array_join(F.concat(F.array(_quoted(text), verdict), F.coalesce(F.transform("rows", lambda r: r["row"]), F.array().cast("array<string>"))), "\n").alias("description"))


def explain(lines: DataFrame, lexicon: DataFrame | None = None, scorer: Scorer | None = None, key: str = "line_id", text: str = "text", steps: tuple[float, ...] = policy.STEPS) -> DataFrame:
    """(key, description, routing, det, oov, answers, sweep, haiku): how each line goes through all layers; a null text has no row.

    routing is det, det+oov or hard; oov the words that the scorer is asked for; answers, for each of these in order, the word, its count, probability and margin over
    the second, and the least fuzziness that accepts it (null where the scorer has no answer); sweep the count at each setting (null: given up); haiku 5, 7 or null.
    """
    lines = lines.where(F.col(text).isNotNull())
    routed = line_routes(lines, lexicon, key, text)
    scores = scorer(policy.asked_words(routed, KEY, None)) if scorer is not None else None
    counts = policy.totals(routed, scores, KEY, None, tuple(steps))
    swept = counts.groupBy(*KEY).agg(F.collect_list(F.struct("fuzziness", F.col("syllable_count").alias("count"))).alias("got"))
    out = routed.join(swept, KEY, "left")
    at = lambda f: F.get(F.filter("got", lambda g: g["fuzziness"] == f), 0)["count"]
    sweep = F.array(*(F.struct(F.lit(float(f)).alias("fuzziness"), at(float(f)).alias("count")) for f in steps))
    answers = F.lit(None).cast("array<struct<word:string,count:int,p:double,margin:double,accepted_from:double>>")
    if scores is not None:
        p = F.col("p")
        top, second = F.array_max(p), F.get(F.sort_array(p, asc=False), 1)
        answer = scores.select("word", F.array_position(p, top).cast("int").alias("count"), top.alias("best"), (top - second).alias("margin"), policy.lowest_fuzziness(p).alias("accepted_from"))
        each = routed.where("not hard").select(*KEY, F.posexplode("oov").alias("k", "word")).join(answer, "word", "left")
        made = F.array_sort(F.collect_list(F.struct("k", F.struct("word", "count", F.col("best").alias("p"), "margin", "accepted_from").alias("answer"))))
        out = out.join(each.groupBy(*KEY).agg(F.transform(made, lambda x: x["answer"]).alias("answers")), KEY, "left")
        answers = F.col("answers")
    strict = at(float(steps[0]))
    out = out.select(F.col("line_key").alias(key), policy.routing_label(F.col("oov_n"), F.col("hard")).alias("routing"), "det", "oov", answers.alias("answers"), sweep.alias("sweep"), policy.haiku(strict).alias("haiku"))
    return describe(lines, lexicon, key, text).join(out, key)


def register(spark: SparkSession, lexicon: dict[str, int] | None = None) -> None:
    """SQL functions for single texts: syllable_count(text) and the table function syllable_trace(text).

    They resolve in Python with a lexicon that is sent along, for interactive use; whole tables go through count_lines and trace.
    """
    from pyspark.sql.functions import udf, udtf

    from cadence.operators.scalar import count_text

    words = dict(SEED_LEXICON if lexicon is None else lexicon)
    spark.udf.register("syllable_count", udf(lambda t: None if t is None else count_text(t, words), "int"))

    @udtf(returnType="pos int, raw string, n int, source string, confidence string, note string")
    class Trace:
        def eval(self, text: str):
            for k, row in enumerate(trace_text(text or "", words)):
                yield (k, *row)

    spark.udtf.register("syllable_trace", Trace)
