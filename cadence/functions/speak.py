"""Readings of numeric tokens, hosts and handles as spoken words, in plain Python, for the scanner's workers.

The same readings of whole columns of numbers are in cadence.functions.numbers.
"""

from __future__ import annotations

import re

from cadence.tables import CURRENCIES, MAGNITUDES, MONTHS, SPELLED_LABELS

Words = list[str]
ENDINGS = frozenset("st nd rd th".split())
DIGITS = "zero one two three four five six seven eight nine".split()
UNITS = [*DIGITS, *"ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()]
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ("quadrillion", "trillion", "billion", "million", "thousand", "")
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def below_hundred(n: int) -> Words:
    """No word for nought."""
    if n < 20:
        return UNITS[n : n + 1] if n else []
    return [TENS[n // 10 - 2], *below_hundred(n % 10)]


#: Words of 0 to 999; none for nought.
HUNDREDS = [([UNITS[n // 100], "hundred"] if n > 99 else []) + below_hundred(n % 100) for n in range(1000)]


def cardinal(digits: str) -> Words:
    """A number of any length, by its digits; beyond quadrillions digit by digit."""
    digits = digits.lstrip("0") or "0"
    if len(digits) > 18:
        return [UNITS[int(d)] for d in digits]
    padded = digits.zfill(18)
    out: list[str] = []
    for scale, at in zip(SCALES, range(0, 18, 3)):
        group = HUNDREDS[int(padded[at : at + 3])]
        out += group + [scale] * bool(group and scale)
    return out or ["zero"]


def to_ordinal(words: list[str]) -> Words:
    """Only the last word changes. Words in -y get -tieth for it, as the readings that counts were set for have it."""
    last = words[-1]
    return [*words[:-1], IRREGULAR.get(last) or (last[:-1] + "tieth" if last[-1] == "y" else last + "th")]


def year(n: int) -> Words:
    century, rest = divmod(n, 100)
    if not 1000 <= n <= 2099 or n % 1000 == 0:
        return cardinal(str(n))
    if not rest:
        return [*cardinal(str(century)), "hundred"]
    if century == 20 and rest < 10:
        return ["two", "thousand", UNITS[rest]]
    return [*cardinal(str(century)), *(["oh", UNITS[rest]] if rest < 10 else below_hundred(rest))]


def plain(digits: str) -> Words:
    return cardinal(digits or "0")


def _numeric(text: str) -> bool:
    whole, _, part = text.replace(",", "").partition(".")
    return (whole + part).isdigit()


def expand(token: str) -> Words:
    """Words of one numeric token, none if it isn't one.

    A currency makes k, m, b and t multipliers; elsewhere they are letters. Four digits alone from 1000 to 2099 are a year.
    """
    rest = token.strip()
    minus = rest[:1] in ("-", "−")  # an empty token is no number below
    rest = rest[minus:]
    money = CURRENCIES.get(rest[:1])
    rest = rest[bool(money) :]
    percent = rest.endswith("%")
    rest = rest[: len(rest) - percent]
    letter = rest[-1:].lower()
    if letter in MAGNITUDES and _numeric(rest[:-1]):
        rest = rest[:-1]
    else:
        letter = ""
    commas = "," in rest
    ending = rest[-2:].lower()
    nth = ending in ENDINGS and rest[:-2].isdigit()
    rest = (rest[:-2] if nth else rest).replace(",", "")
    whole, _, fraction = rest.partition(".")
    if not (whole + fraction).isdigit():
        return []
    sign, tail = ["negative"] * minus, ["percent"] * percent
    if nth:
        return sign + to_ordinal(plain(whole)) + tail
    bare = not (fraction or money or percent or minus or commas or letter)
    if bare and len(whole) == 4 and whole[:2] in ("10", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20"):
        return year(int(whole))
    words = plain(whole)
    pointed = [*words, "point", *(UNITS[int(d)] for d in fraction)] if fraction else words
    if not money:
        return sign + pointed + [letter] * bool(letter) + tail
    one, many, *small = money.split()
    unit = one if whole.lstrip("0") == "1" else many
    if letter:
        return sign + pointed + [MAGNITUDES[letter], many] + tail
    if small and 1 <= len(fraction) <= 2:
        part = int(fraction.ljust(2, "0"))
        return sign + [*words, unit] + (["and", *cardinal(str(part)), small[part != 1]] if part else []) + tail
    return sign + [*pointed, unit] + tail


def date(month: int, day: int, the_year: int) -> Words:
    """None of a month or day that no calendar has; days are not checked against months."""
    if not (1 <= month <= 12 and 1 <= day <= 31):
        return []
    if the_year < 100:
        the_year += 2000 if the_year <= 68 else 1900
    return [MONTHS[month - 1], *to_ordinal(cardinal(str(day))), *year(the_year)]


def clock(hour: int, minute: int, half: str | None) -> Words:
    if hour > 23 or minute > 59:
        return []
    past = ["o", "clock"] if not minute else ["oh", UNITS[minute]] if minute < 10 else below_hundred(minute)
    return cardinal(str(hour)) + past + ([half.lower(), "m"] if half else [])


def fraction(top: int, bottom: int) -> Words:
    part = {2: "half", 4: "quarter"}.get(bottom) or to_ordinal(cardinal(str(bottom)))[-1]
    if top != 1:
        part = "halves" if part == "half" else part + "s"
    return [*cardinal(str(top)), part]


_PIECE = re.compile(r"(?P<digits>\d+)|[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def split_handle(name: str) -> Words:
    """Words of a camel-cased or underscored name; runs of digits are read, other scripts are dropped."""
    out: list[str] = []
    for m in _PIECE.finditer(name):
        piece = m.group()
        if m.group("digits"):
            out += expand(piece)
            continue
        out.append(piece.lower())
    return out


_SCHEME = re.compile(r"(?i)^https?://")


def host_of(link: str) -> str:
    """What comes before path and query, without closing marks."""
    return re.match("[^/?]*", link).group().rstrip("\"')]}!?,.")


def read_host(link: str) -> Words:
    """Labels with a dot between them; www and some top levels are spelled."""
    out: list[str] = []
    for k, label in enumerate(filter(None, host_of(_SCHEME.sub("", link)).split("."))):
        low = label.lower()
        out += ["dot"] * bool(k)
        out += list(low) if low == "www" or low in SPELLED_LABELS else split_handle(label)
    return out


def read_email(address: str) -> Words:
    local, _, host = address.partition("@")
    out: list[str] = []
    for k, piece in enumerate(local.split(".")):
        out += ["dot"] * bool(k) + split_handle(piece)
    return [*out, "at", *read_host(host)]


_ROMAN = dict(zip("MDCLXVI", (1000, 500, 100, 50, 10, 5, 1)))
ROMAN_SHAPE = re.compile("M{0,4}(?:C[MD]|D?C{0,3})(?:X[CL]|L?X{0,3})(?:I[XV]|V?I{0,3})")


def roman_value(numeral: str) -> int:
    values = [_ROMAN[c] for c in numeral]
    return sum(v if v >= max(values[k + 1 : k + 2], default=0) else -v for k, v in enumerate(values))
