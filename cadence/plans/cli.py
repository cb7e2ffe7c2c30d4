"""python -m cadence [--explain] [TEXT ...]: how texts are counted. - reads standard input: as one text, or with --explain as lines. Without texts some samples are shown."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession

from cadence.operators.scorer import npz_scorer, rule_scorer
from cadence.plans import api
from cadence.sources.lexicon import read_lexicon

SAMPLES = ("five cats in the house", "it cost $19.99 in 1999, idk", "soooo good 🔥 :)", "see https://www.example.com", "zyqof is my friend")


def texts_of(args: list[str], stdin: Iterable[str], lines: bool) -> list[str]:
    """The texts that are named; - alone stands for standard input, whose blank lines are left out where it is read as lines."""
    if args != ["-"]:
        return args or list(SAMPLES)
    return [line.rstrip("\r\n") for line in stdin if line.strip()] if lines else ["".join(stdin)]


def frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, text string")


def said(row: Row) -> str:
    """One line's row of api.explain() for people."""
    out = [row["description"], f"  routing: {row['routing']}, sure {row['det']}" + (f", asked: {', '.join(row['oov'])}" if row["oov"] and row["routing"] != "hard" else "")]
    for a in row["answers"] or []:
        if a["count"] is None:
            out.append(f"  {a['word']}: no answer")
        else:
            start = f"accepted from {a['accepted_from']:.2f}" if a["accepted_from"] is not None else "never accepted"
            out.append(f"  {a['word']}: {a['count']} (p {a['p']:.2f}, margin {a['margin']:.2f}), {start}")
    out.append("  sweep: " + "  ".join(f"{s['fuzziness']:.2f}:{'-' if s['count'] is None else s['count']}" for s in row["sweep"]))
    return "\n".join([*out, f"  haiku: {row['haiku'] or 'no'}"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin: Iterable[str] = sys.stdin) -> int:
    parser = argparse.ArgumentParser(prog="python -m cadence", description=__doc__)
    parser.add_argument("text", nargs="*")
    parser.add_argument("--explain", action="store_true", help="routing, answers of the scorer, sweep and verdict too")
    parser.add_argument("--lexicon", help="a file of words and counts")
    parser.add_argument("--weights", help="a file of network weights; without one --explain asks a rule")
    args = parser.parse_args(argv)
    own = spark is None
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        lines = frame(spark, texts_of(args.text, stdin, args.explain))
        lexicon = read_lexicon(spark, args.lexicon) if args.lexicon else None
        if args.explain:
            rows = api.explain(lines, lexicon, npz_scorer(args.weights) if args.weights else rule_scorer)
        else:
            rows = api.describe(lines, lexicon)
        for row in rows.orderBy("line_id").collect():
            print(said(row) if args.explain else row["description"], end="\n\n")
    finally:
        if own:
            spark.stop()
    return 0
