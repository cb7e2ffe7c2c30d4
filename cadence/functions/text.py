"""Normalisation and lexical predicates as built-in expressions; one Arrow function where Spark has none."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cadence.functions import numbers
from cadence.tables import APOSTROPHES, EMOJI, EMOJI_CLASS, REGISTRY_LABELS, SPELLED_LABELS, TLDS, VULGAR



def _base(text: str) -> str:
    return "".join(filterfalse(unicodedata.combining, unicodedata.normalize("NFKD", text)))


#: Letters below U+0250 that decompose to a letter and marks, and that letter.
_MARKED = {chr(c): d for c in range(0xC0, 0x250) if len(d := _base(chr(c))) == 1 and d != chr(c)}


def fold_apostrophes(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))


def expand_fractions(text: Column) -> Column:
    for glyph, words in VULGAR.items():
        text = F.replace(text, F.lit(glyph), F.lit(f" {words} "))
    return text


#: Texts that a worker turns into Python strings at a time: beside these a batch stays in Arrow's form.
TEXTS = 256


def _each(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """change() of each text that isn't ASCII."""
    parts = (texts[lo : lo + TEXTS].to_pylist() for lo in range(0, len(texts), TEXTS))
    made = [pa.array([t if t is None or t.isascii() else change(t) for t in part], pa.string()) for part in parts]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """NFKC, which no built-in function gives; ASCII values of a batch are not touched."""
    return _each(texts, lambda t: unicodedata.normalize("NFKC", t))


@F.arrow_udf(StringType())
def strip_marks_any(texts: pa.Array) -> pa.Array:
    """NFKD without combining marks, for any script."""
    return _each(texts, _base)


def strip_marks(text: Column) -> Column:
    """The same for precomposed Latin letters alone, without leaving the JVM."""
    return F.translate(text, "".join(_MARKED), "".join(_MARKED.values()))


def is_emoji(text: Column) -> Column:
    """Whether every character is one that is never spoken."""
    return text.rlike(f"^[{EMOJI_CLASS}]+$")


def emoji_runs(text: Column) -> Column:
    """Maximal runs of emoji and of other text, in order, as (text, is_emoji)."""
    runs = F.regexp_extract_all(text, F.lit(f"[{EMOJI_CLASS}]+|[^{EMOJI_CLASS}]+"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(r.alias("text"), is_emoji(r).alias("is_emoji")))


def emoji_names(run: Column) -> Column:
    """Names of the glyphs of a run of emoji; joiners and selectors have none."""
    names = F.create_map(*(F.lit(x) for pair in EMOJI.items() for x in pair))
    glyphs = F.filter(F.split(run, ""), lambda g: (g != "") & ~g.rlike(r"^[\x{200D}\x{FE00}-\x{FE0F}]$"))
    said = F.array_join(F.transform(glyphs, lambda g: F.coalesce(F.try_element_at(names, g), F.lit("emoji"))), ", ")
    return F.when(said == "", "emoji").otherwise(said)


def collapse_elongation(word: Column) -> Column:
    """Runs of three or more of a character as one, then as two; one form if these are equal."""
    return F.array_distinct(F.array(F.regexp_replace(word, r"(.)\1{2,}", "$1"), F.regexp_replace(word, r"(.)\1{2,}", "$1$1")))


def az_key(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z]", "")


def encode_ids(word: Column, width: int = 24) -> Column:
    """Letters as 1 to 26, cut to and padded with 0 to the width; any word has a code."""
    letters = F.filter(F.split(F.substring(az_key(word), 1, width), ""), lambda c: c != "")
    ids = F.transform(letters, lambda c: F.ascii(c) - 96)
    return F.concat(ids, F.array_repeat(F.lit(0), F.lit(width) - F.size(ids)))


def split_handle(name: Column) -> Column:
    """Words of a camel-cased or underscored name, as an array."""
    pieces = F.regexp_extract_all(name, F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"), F.lit(0))
    return F.flatten(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), F.split(numbers.expand(p), " ")).otherwise(F.array(F.lower(p)))))


def host(link: Column) -> Column:
    """The host as readers of links see it: without scheme, path, query and closing marks."""
    bare = F.regexp_replace(link, "(?i)^https?://", "")
    return F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), r"[.,!?)\]}'\"]+$", "")


def is_url(body: Column) -> Column:
    labels = F.filter(F.split(F.lower(F.regexp_replace(F.regexp_extract(body, "^[^/?]*", 0), r"[.,!?)\]}'\"]+$", "")), r"\."), lambda x: x != "")
    top, second = F.try_element_at(labels, F.lit(-1)), F.try_element_at(labels, F.lit(-2))
    known = top.isin(*sorted(TLDS)) | (body.rlike("[/?]") & top.rlike(r"^\p{L}{2,}$")) | ((F.size(labels) >= 3) & (F.length(top) == 2) & second.isin(*sorted(REGISTRY_LABELS)))
    return body.rlike(r"(?i)^(https?://|www\.)") | ((F.size(labels) >= 2) & F.coalesce(known, F.lit(False)))


def is_full_url(raw: Column) -> Column:
    return raw.rlike("(?i)^https?://") | raw.contains("?") | raw.rlike("^[^/]*/.*[^/ ]")


def read_host(link: Column) -> Column:
    """Words of a link's host, as an array: labels with a dot between, www and some top levels spelled."""
    labels = F.filter(F.split(host(link), r"\."), lambda x: x != "")
    spelled = F.array(*(F.lit(x) for x in sorted({"www"} | SPELLED_LABELS)))
    said = lambda x: F.when(F.array_contains(spelled, F.lower(x)), F.filter(F.split(F.lower(x), ""), lambda c: c != "")).otherwise(split_handle(x))
    return F.flatten(F.transform(labels, lambda x, k: F.when(k > 0, F.concat(F.array(F.lit("dot")), said(x))).otherwise(said(x))))


def read_email(address: Column) -> Column:
    pieces = F.split(F.substring_index(address, "@", 1), r"\.")
    local = F.flatten(F.transform(pieces, lambda x, k: F.when(k > 0, F.concat(F.array(F.lit("dot")), split_handle(x))).otherwise(split_handle(x))))
    return F.concat(local, F.array(F.lit("at")), read_host(F.regexp_replace(address, "^[^@]*@", "")))


def looks_junk(word: Column) -> Column:
    """No plausible word: 16 letters or more, of erratic case, or long without a vowel."""
    case = F.translate(F.regexp_replace(F.regexp_replace(F.substring(word, 2, 10_000), r"\p{Lu}", "\u0001"), r"[^\u0001\W\d_]", "\u0002"), "\u0001\u0002", "Aa")
    flips = F.regexp_count(case, F.lit("A(?=a)|a(?=A)"))
    return (F.length(word) >= 16) | (flips >= 4) | ((F.length(word) >= 7) & ~F.lower(word).rlike("[aeiou]"))


def letters_count(word: Column) -> Column:
    """Count of a word spelled aloud: three for a w, one for any other letter."""
    return (F.length(word) + 2 * (F.length(word) - F.length(F.replace(word, F.lit("w"), F.lit(""))))).cast("int")
