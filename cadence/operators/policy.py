"""What becomes of counted tokens: lines that count, that wait for the scorer, and that are given up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions import text as T

TOP, MARGIN = 0.85, 0.35
#: Strictness settings that are tried in turn.
STEPS = (0.0, 0.25, 0.5, 0.75, 1.0)


def classify(counted: DataFrame) -> DataFrame:
    """counted with route, one of det, oov and hard, and oov_word, what the scorer is asked for an oov token."""
    note, abstain = F.col("note"), F.col("source") == "abstain"
    tail = F.trim(F.element_at(F.split("note", ";"), -1))
    askable = ~note.contains("[OOV:") & ~note.contains("initialism") & ~note.contains("roman") & (tail == "OOV") & F.col("raw").rlike(r"\p{L}")
    route = (
        F.when(note.contains("spoken url"), F.when(abstain | T.is_full_url(F.col("raw")), "hard").otherwise("det"))
        .when(~abstain, "det").when(askable & ~T.looks_junk(F.col("raw")), "oov").otherwise("hard")
    )
    low = F.lower("raw")
    form = T.strip_marks(F.element_at(T.collapse_elongation(low), 1))
    return counted.withColumn("route", route).withColumn("oov_word", F.when(route == "oov", F.when(form == "", low).otherwise(form)))


def route_lines(classified: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, n_uncertain, det, oov_n, hard, oov), a row for each line; see scalar.line_sums().

    Partial sums leave one row for a line before the shuffle. Where nobody asks for the words Spark drops their column, so they don't travel.
    """
    oov = F.col("route") == "oov"
    sums = [
        F.sum("n").cast("int").alias("total"), F.count_if(F.col("source") == "abstain").cast("int").alias("n_uncertain"),
        F.sum(F.when(F.col("route") == "det", F.col("n")).otherwise(0)).cast("int").alias("det"), F.count_if(oov).cast("int").alias("oov_n"), F.max((F.col("route") == "hard").cast("int")).alias("hard"),
        F.array_sort(F.collect_list(F.when(oov, F.struct("pos", "oov_word")))).alias("oov"),
    ]
    out = classified.groupBy(*keys).agg(*sums)
    return out.select(*keys, "total", "n_uncertain", "det", "oov_n", (F.col("hard") == 1).alias("hard"), F.transform("oov", lambda x: x["oov_word"]).alias("oov"))


def routing_label(oov_n: Column, hard: Column) -> Column:
    return F.when(hard, "hard").when(oov_n > 0, "det+oov").otherwise("det")


def gate(p: Column, fuzziness: Column | float) -> Column:
    """The count that class probabilities accept, or null. A tie for the top goes to the higher class."""
    f = F.least(F.greatest(F.lit(fuzziness) if not isinstance(fuzziness, Column) else fuzziness, F.lit(0.0)), F.lit(1.0))
    top = F.array_max(p)
    at = F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0), lambda s, k: F.when(F.element_at(p, k) == top, k).otherwise(s))
    others = F.filter(p, lambda x, k: k != at - 1)
    second = F.coalesce(F.array_max(others), F.lit(0.0))
    return F.when((top >= (1 - f) * TOP) & (top - second >= (1 - f) * MARGIN), at).cast("int")


def lowest_fuzziness(p: Column, steps: tuple[float, ...] = STEPS) -> Column:
    """The least of some strictness settings that accepts."""
    return F.coalesce(*(F.when(gate(p, s).isNotNull(), F.lit(s)) for s in steps))


def within(total: Column, most: Column | int | None) -> Column:
    return total if most is None else F.when(total <= most, total)


def haiku(total: Column) -> Column:
    return F.when(total.isin(5, 7), total)


def budget(most: int | tuple[int, ...] | None) -> Column | int | None:
    """The budget of a row: with several, which are columns of their own by totals(), that of its column most."""
    return F.col("most") if isinstance(most, tuple) else most


def _asked(routed: DataFrame, keys: list[str], most: Column | int | None) -> tuple[DataFrame, DataFrame]:
    """Lines that nothing is to be asked for, and those that wait for the scorer; lines given up, or over the budget at one for each word, are in neither."""
    fits = ~F.col("hard") & (F.lit(True) if most is None else F.col("det") + F.col("oov_n") <= most)
    return routed.where(fits & (F.col("oov_n") == 0)), routed.where(fits & (F.col("oov_n") > 0))


def asked_words(routed: DataFrame, keys: list[str], most: int | tuple[int, ...] | None) -> DataFrame:
    """(word): the distinct words that the scorer is to be asked for. Of several budgets the largest asks for all."""
    return _asked(routed, keys, max(most) if isinstance(most, tuple) else most)[1].select(F.explode("oov").alias("word")).distinct()


def totals(routed: DataFrame, scores: DataFrame | None, keys: list[str], most: int | tuple[int, ...] | None, fuzziness: float | tuple[float, ...]) -> DataFrame:
    """(keys, syllable_count): the sum of a line, or null; with several settings of fuzziness (keys, fuzziness, syllable_count), from one scoring; with several budgets keys and most.

    scores has (word, p) of the words that asked_words() has; None stands for a scorer that isn't there.
    """
    many = isinstance(fuzziness, tuple)
    steps = fuzziness if many else (fuzziness,)
    each = F.array(*map(F.lit, map(float, steps)))
    if isinstance(most, tuple):
        routed, keys = routed.withColumn("most", F.explode(F.array(*map(F.lit, most)))), [*keys, "most"]
    most = budget(most)
    sure, asked = _asked(routed, keys, most)
    out = sure.select(*keys, F.explode(each).alias("fuzziness"), F.col("det").alias("syllable_count"))
    if scores is not None:
        said = scores.select("word", F.explode(F.array(*(F.struct(F.lit(float(f)).alias("fuzziness"), gate(F.col("p"), f).alias("said")) for f in steps))).alias("x")).select("word", "x.*")
        words = asked.select(*keys, "det", F.posexplode("oov").alias("at", "word")).select(*keys, "det", "at", "word", F.explode(each).alias("fuzziness"))
        got = words.join(said, ["word", "fuzziness"], "left")
        sums = got.groupBy(*keys, "fuzziness").agg((F.first("det") + F.sum("said")).cast("int").alias("syllable_count"), F.count_if(F.col("said").isNull()).alias("missed"))
        out = out.unionByName(sums.where("missed = 0").select(*keys, "fuzziness", within(F.col("syllable_count"), most).cast("int").alias("syllable_count")))
    return out if many else out.drop("fuzziness")
