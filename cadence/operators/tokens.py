"""Texts to tokens. Plain lines are split by the JVM; only what needs the scanner goes to Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cadence import schemas
from cadence.functions import text as T
from cadence.operators.scan import scan
from cadence.tables import CONTRACTION

#: Bytes of texts that the scanner's workers turn into tokens at a time.
LETTERS = 1 << 17
#: What a plain line has none of: anything but letters, spaces and these marks, or a mark before a letter. In the rest nothing reads as a
#: number, link, name, face, symbol or numeral, but for ODD. Searches, as a pattern of whole lines would backtrack on long ones.
UNPLAIN = r"[^A-Za-z\s.,!?\"]|[.,!?\"][A-Za-z]"
ODD = r"(?:^|[^A-Za-z])(?:[xX]D+|[xX]+D+|[IVXLCDM]{2,})(?:[^A-Za-z]|$)|[xX]D+(?:[^A-Za-z]|$)"


def is_plain(text: Column) -> Column:
    return ~text.rlike(UNPLAIN) & ~text.rlike(ODD)


def plain_tokens(text: Column) -> Column:
    """The raw words and marks of a plain line."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|[.,!?\"]"), F.lit(0))


def plain_words(text: Column) -> Column:
    """The words of a plain line alone: its marks are silent."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))


def exploded(lines: DataFrame, raws: Column, text: str = "text") -> DataFrame:
    """(the other columns, pos, raw): a row for each element; a line without any has one row of nulls.

    Outer, as of an inner explode Spark infers a filter on the array's size, for which the array would be made once more.
    """
    return lines.select(*(c for c in lines.columns if c != text), F.posexplode_outer(raws).alias("pos", "raw"))


def _few(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of LETTERS bytes or so each: the tokens of one range are all that Python holds of a batch, however large."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LETTERS, "right")))
        yield lo, hi
        lo = hi


def scanned_tokens(lines: DataFrame, numerals: frozenset[str], text: str = "text") -> DataFrame:
    """Any lines with tokens, an array. numerals: words of the lexicon that look like Roman numerals."""
    kind = schemas.T.ArrayType(schemas.TOKEN)
    names, arrow = schemas.TOKEN.names, to_arrow_type(kind)
    schema = schemas.T.StructType([*lines.schema, schemas.T.StructField("tokens", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _few(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                made = [None if t is None else [dict(zip(names, x)) for x in scan(t, numerals.__contains__)] for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, arrow)], names=[*part.schema.names, "tokens"])

    return lines.mapInArrow(run, schema)


def numerals_of(lexicon: DataFrame) -> frozenset[str]:
    """Words of the lexicon that are spelled with the letters of numerals alone: a few, whatever its size."""
    rows = lexicon.where(F.col("word").rlike("^[ivxlcdm]{2,15}$") & F.upper("word").rlike("^M{0,4}(C[MD]|D?C{0,3})(X[CL]|L?X{0,3})(I[XV]|V?I{0,3})$")).select("word").distinct().collect()
    return frozenset(r["word"] for r in rows)


def in_batches(lines: DataFrame, spec: str, row: Callable[[str, dict], Iterable[tuple]], text: str = "text") -> DataFrame:
    """(line_key, the columns of spec): the rows that row() makes of each text, in the Arrow batches that bring the texts, once. Its second argument is a dict that a task keeps."""
    names = [f.name for f in _parsed(spec)]
    kind = lines.schema["line_key"].dataType
    schema = schemas.T.StructType([schemas.T.StructField("line_key", kind), *_parsed(spec)])
    types = [to_arrow_type(f.dataType) for f in _parsed(spec)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for lo, hi in _few(batch.column(text)):
                at: list[int] = []
                rows: list[tuple] = []
                for k, t in enumerate(batch.column(text)[lo:hi].to_pylist(), lo):
                    made = list(row(t, memo)) if t is not None else []
                    rows += made
                    at += [k] * len(made)
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([batch.column("line_key").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=["line_key", *names])

    return lines.select("line_key", text).mapInArrow(run, schema)


def _parsed(spec: str) -> list:
    return list(schemas.T.StructType.fromDDL(spec))


def branches(lines: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Plain lines, and the others.

    A guard inside one expression would not keep plain lines from Python, so they are a branch of their own.
    """
    plain = is_plain(F.col(text))
    return lines.where(plain), lines.where(~F.coalesce(plain, F.lit(False)))


def tokenize(lines: DataFrame, numerals: frozenset[str], text: str = "text") -> DataFrame:
    """lines with tokens, an array. A null text has null tokens, an empty one none."""
    plain, odd = branches(lines, text)
    token = lambda x: F.struct(
        x.alias("raw"), F.when(x.rlike("[A-Za-z]"), "word").otherwise("punct").alias("kind"), F.when(x.rlike("[A-Za-z]"), T.collapse_elongation(F.lower(x))).alias("candidates"),
        F.lit(None).cast("array<string>").alias("words"), (~x.rlike("[A-Za-z]")).alias("silent"), F.lit(False).alias("approx"), plain_note(x).alias("note"),
    )
    return plain.withColumn("tokens", F.transform(plain_tokens(F.col(text)), token)).unionByName(scanned_tokens(odd, numerals, text))


def plain_note(raw: Column) -> Column:
    """What was done to a plain word. As every lexicon keys contractions by letters alone, the form with an apostrophe is left to the scanner."""
    low = F.lower(raw)
    return F.when(low.rlike(r"(.)\1\1"), "elongation").when(low.isin(*sorted(CONTRACTION)), "contraction").otherwise("")


def explode_tokens(lines: DataFrame) -> DataFrame:
    """A row for each token, with its place pos from 0."""
    kept = [c for c in lines.columns if c != "tokens"]
    return lines.select(*kept, F.posexplode_outer("tokens").alias("pos", "token")).where("pos is not null").select(*kept, "pos", "token.*")
