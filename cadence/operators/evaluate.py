"""Measures of scored words: rows of y (the count), p (class probabilities), valid (counts) and ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicted(p: Column) -> Column:
    """The first class of the greatest probability."""
    return F.array_position(p, F.array_max(p)).cast("int")


def top_classes(p: Column, k: int = 3) -> Column:
    """The k most probable classes as (count, p), the lower class first among equals."""
    rows = F.transform(p, lambda x, i: F.struct((-x).alias("minus"), (i + 1).cast("int").alias("count")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(r["count"].alias("count"), (-r["minus"]).alias("p")))


def support(p: Column, share: float = 0.9) -> Column:
    """The fewest top classes that hold the share together."""
    rows = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("minus"), (i + 1).cast("int").alias("count"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("got"))
    step = lambda s, r: F.when(s["sum"] >= share, s).otherwise(F.struct((s["sum"] - r["minus"]).alias("sum"), F.concat(s["got"], F.array(r["count"])).alias("got")))
    return F.aggregate(rows, start, step)["got"]


def covers(p: Column, valid: Column, share: float = 0.9) -> Column:
    return F.size(F.array_except(valid, support(p, share))) == 0


def mass(p: Column, valid: Column) -> Column:
    return F.aggregate(F.filter(valid, lambda c: c.between(1, F.size(p))), F.lit(0.0), lambda s, c: s + F.element_at(p, c))


def metrics(rows: DataFrame) -> DataFrame:
    """One row: exact, within1, mae, lenient, amb_cover, amb_mass, amb_n; measures of no rows are null."""
    pred, y, amb = predicted(F.col("p")), F.col("y"), F.col("ambiguous")
    off = F.abs(pred - y)
    one = lambda c: F.avg(c.cast("double"))
    return rows.agg(
        one(off == 0).alias("exact"), one(off <= 1).alias("within1"), one(off).alias("mae"), one(F.array_contains("valid", pred)).alias("lenient"),
        one(F.when(amb, covers(F.col("p"), F.col("valid")))).alias("amb_cover"), F.avg(F.when(amb, mass(F.col("p"), F.col("valid")))).alias("amb_mass"), F.count_if(amb).alias("amb_n"),
        one(F.when(y >= 4, off == 0)).alias("tail"),
    )


def per_count(rows: DataFrame) -> DataFrame:
    """(y, n, exact) of each count that occurs, exact to three places."""
    hit = (predicted(F.col("p")) == F.col("y")).cast("double")
    return rows.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg(hit), 3).alias("exact"))


def ensemble(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p): class probabilities averaged over the rows of each key, one for each run."""
    each = runs.select(*keys, F.posexplode("p").alias("k", "x")).groupBy(*keys, "k").agg(F.avg("x").alias("x"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("all")).select(*keys, F.transform("all", lambda r: r["x"]).alias("p"))


def spread(results: DataFrame, measures: list[str]) -> DataFrame:
    """Mean and population deviation of measures over runs."""
    return results.agg(*(f(m).alias(f"{m}_{name}") for m in measures for name, f in (("mean", F.avg), ("std", F.stddev_pop))))


def best_run(results: DataFrame, by: str = "best_val", size: str | None = None) -> DataFrame:
    """The row of the greatest measure; among equals that of the fewest parameters, where size names their column."""
    return results.orderBy(F.desc_nulls_last(by), *([F.asc_nulls_last(size)] if size else [])).limit(1)


def by_size(results: DataFrame, size: str = "params") -> DataFrame:
    """Runs from the largest model to the smallest, those of unknown size last."""
    return results.orderBy(F.desc_nulls_last(size))


#: Presets of model capacity: embedding, widths, filters, recurrent size, head.
CAPACITY = {"medium": (32, (2, 3), 64, 96, 128), "s44k": (24, (2, 3), 32, 48, 64), "s22k": (16, (2, 3), 24, 32, 48), "s7k": (12, (2, 3), 16, 16, 32), "s4k": (10, (2, 3), 12, 12, 24), "s2k": (8, (2, 3), 8, 8, 16)}
CAPACITY["small"] = CAPACITY["s44k"]
#: Runs of a sweep: a capacity and a dropout each. The first is tried at two dropouts, the ladder's smaller steps at less and less.
RUNS = {
    "small_d10": ("small", 0.10), "small_d25": ("small", 0.25), "medium_d10": ("medium", 0.10), "medium_d25": ("medium", 0.25),
    "s44k": ("s44k", 0.10), "s22k": ("s22k", 0.10), "s7k": ("s7k", 0.05), "s4k": ("s4k", 0.05), "s2k": ("s2k", 0.0),
}


def check_run(tune: bool, split: str) -> None:
    """ValueError for a run that makes no sense: tuning picks the run of the best validation, and a split that trains on everything has none."""
    if tune and split == "all":
        raise ValueError("tuning needs validation words, which split 'all' does not leave; use 'random' or 'hard'")


def early_stop(epochs: DataFrame, run: str, epoch: str, value: str, patience: int) -> DataFrame:
    """epochs with best (the value so far), improved and stop: whether `patience` epochs passed without a better one."""
    from pyspark.sql import Window as W

    before = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    out = epochs.withColumn("improved", F.coalesce(F.col(value) > F.max(value).over(before), F.lit(True))).withColumn("best", F.max(value).over(upto))
    n = F.row_number().over(W.partitionBy(run).orderBy(epoch))
    out = out.withColumn("n", n).withColumn("last", F.max(F.when(F.col("improved"), F.col("n"))).over(upto))
    return out.withColumn("stop", F.col("n") - F.col("last") >= patience).drop("n", "last")
