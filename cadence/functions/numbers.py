"""Readings of columns of numbers as space-joined spoken words, in built-in expressions.

Values that an expression names more than once are bound by let(), so plans stay small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions import speak
from cadence.tables import CURRENCIES, MAGNITUDES, MONTHS


def _list(words: list[str]) -> Column:
    """A constant array, folded from one literal."""
    return F.split(F.lit("|".join(words)), r"\|")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, and written into the plan once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


_BELOW_THOUSAND = [" ".join(words) for words in speak.HUNDREDS]


def _hundred(n: Column) -> Column:
    """Words of 0 to 99, none for nought: one look-up in a constant array."""
    return F.get(_list(_BELOW_THOUSAND[:100]), n.cast("int"))


def _say(*parts: Column) -> Column:
    """Parts joined by spaces, without those that are null or empty."""
    return F.concat_ws(" ", *(F.when(p != "", p) for p in parts))


def cardinal_digits(digits: Column) -> Column:
    """Of a string of digits of any length; beyond quadrillions digit by digit."""
    return F.when(digits.isNotNull(), let(F.regexp_replace(digits, "^0+(?=.)", ""), _cardinal))


def _cardinal(digits: Column) -> Column:
    """The same without leading zeros: a look-up for each group of three digits that a number has."""

    def groups(padded: Column) -> Column:
        said = []
        for k, scale in enumerate(speak.SCALES):
            n = F.substring(padded, 3 * k + 1, 3).cast("int")
            words = F.get(_list(_BELOW_THOUSAND), n)
            said.append(F.when((F.length(digits) > 15 - 3 * k) & (n > 0), F.concat(words, F.lit(f" {scale}")) if scale else words))
        return F.concat_ws(" ", *said)

    each = F.array_join(F.transform(F.split(digits, "(?!^)(?=.)"), lambda d: F.get(_list(speak.UNITS), d.cast("int"))), " ")
    small = F.get(_list(["zero", *_BELOW_THOUSAND[1:]]), digits.try_cast("int"))
    return F.when(F.length(digits) > 18, each).when(F.length(digits) <= 3, small).otherwise(let(F.lpad(digits, 18, "0"), groups))


def cardinal(n: Column) -> Column:
    """Of a whole number. Null gives null."""
    digits = F.ltrim(n.cast("decimal(38,0)").cast("string"), F.lit("-"))
    return F.when(n.isNotNull(), F.concat(F.when(n < 0, "negative ").otherwise(""), let(digits, _cardinal)))


def to_ordinal(words: Column) -> Column:
    """The last word of a cardinal changed."""
    irregular = F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in speak.IRREGULAR.items())), F.lit(","), F.lit(":"))

    def change(w: Column) -> Column:
        last = F.regexp_extract(w, "[a-z]+$", 0)
        nth = F.coalesce(F.try_element_at(irregular, last), F.when(last.endswith("y"), F.regexp_replace(last, "y$", "tieth")).otherwise(F.concat(last, F.lit("th"))))
        return F.concat(F.regexp_replace(w, "[a-z]+$", ""), nth)

    return let(words, change)


def ordinal(n: Column) -> Column:
    return to_ordinal(cardinal(n))


def year(n: Column) -> Column:
    def read(n: Column) -> Column:
        high, low = F.floor(n / 100).cast("int"), F.pmod(n, F.lit(100)).cast("int")
        head = F.when(n.between(2001, 2009), "two thousand").otherwise(_hundred(high))
        tail = F.when(low == 0, "hundred").when(low < 10, F.concat(F.when(n < 2000, "oh ").otherwise(""), _hundred(low))).otherwise(_hundred(low))
        return F.when(~n.between(1000, 2099) | (n % 1000 == 0), cardinal(n)).otherwise(_say(head, tail))

    return let(n.cast("long"), read)


_SHAPE = r"^([-−]?)([$£€¥]?)([0-9,]*)(?:\.([0-9]*))?(?:(st|nd|rd|th)|([kmbtKMBT]))?(%?)$"


def expand(token: Column) -> Column:
    """Words of a numeric token, empty if it isn't one; see cadence.functions.speak.expand."""

    def read(p: Column) -> Column:
        sign, money, fraction, nth, letter, percent, whole, said = (p[k] for k in ("sign", "money", "fraction", "nth", "letter", "percent", "whole", "said"))
        digits = F.array_join(F.transform(F.split(fraction, "(?!^)(?=.)"), lambda d: F.get(_list(speak.UNITS), d.try_cast("int"))), " ")
        pointed = F.when(fraction == "", said).otherwise(F.concat(said, F.lit(" point "), digits))
        minus, cent = F.when(sign != "", "negative"), F.when(percent != "", "percent")
        names = [_currency(money, k) for k in range(4)]
        unit = F.when(F.ltrim(whole, F.lit("0")) == "1", names[0]).otherwise(names[1])
        small = F.rpad(fraction, 2, "0").try_cast("int")
        cents = F.when(small > 0, _say(F.lit("and"), _hundred(small), F.when(small == 1, names[2]).otherwise(names[3])))
        scale = F.coalesce(*(F.when(letter == k, F.lit(v)) for k, v in MAGNITUDES.items()), F.lit(""))
        bare = (sign == "") & (money == "") & (fraction == "") & (letter == "") & (percent == "") & p["raw"].rlike("^(1[0-9]|20)[0-9]{2}$")
        out = (
            F.when(nth != "", _say(minus, to_ordinal(said), cent))
            .when(bare, year(whole.try_cast("long")))
            .when(money == "", _say(minus, pointed, letter, cent))
            .when(letter != "", _say(minus, pointed, scale, names[1], cent))
            .when((names[2] != "") & F.length(fraction).between(1, 2), _say(minus, said, unit, cents, cent))
            .otherwise(_say(minus, pointed, unit, cent))
        )
        return F.when((whole == "") & (fraction == ""), "").otherwise(out)

    def named(parts: Column) -> Column:
        """Of the seven groups of the shape; null if there are others, as of what hasn't the shape."""
        part = lambda k: F.get(parts, k - 1)
        whole = F.replace(part(3), F.lit(","), F.lit(""))
        said = F.when(whole == "", "zero").otherwise(cardinal_digits(whole))
        fields = {"sign": part(1), "money": part(2), "raw": part(3), "fraction": part(4), "nth": part(5), "letter": F.lower(part(6)), "percent": part(7), "whole": whole, "said": said}
        return F.when(F.size(parts) == 7, F.struct(*(c.alias(k) for k, c in fields.items())))

    # one match splits a token: its groups are written out with a separator that no token of the shape holds
    token = F.translate(F.trim(token), "\x01", "?")
    split = F.split(F.regexp_replace(token, _SHAPE, "\x01".join(f"${k}" for k in range(1, 8))), "\x01")
    return F.when(token.isNotNull(), F.coalesce(let(let(split, named), read), F.lit("")))


def _currency(sign: Column, k: int) -> Column:
    """Of a currency's sign: its unit, in the plural, its part, in the plural."""
    return F.coalesce(*(F.when(sign == c, F.lit((v.split() + ["", ""])[k])) for c, v in CURRENCIES.items()), F.lit(""))


def date(month: Column, day: Column, the_year: Column) -> Column:
    """Null for a month or day that no calendar has; two digits are a year from 1969 to 2068."""
    full = F.when(the_year < 69, the_year + 2000).when(the_year < 100, the_year + 1900).otherwise(the_year)
    return F.when(month.between(1, 12) & day.between(1, 31), _say(F.get(_list(MONTHS), month.cast("int") - 1), ordinal(day), year(full)))


def clock(hour: Column, minute: Column, half: Column | None = None) -> Column:
    past = F.when(minute == 0, "o clock").when(minute < 10, F.concat(F.lit("oh "), cardinal(minute))).otherwise(cardinal(minute))
    said = _say(cardinal(hour), past, *([F.when(half != "", F.concat(F.lower(half), F.lit(" m")))] if half is not None else []))
    return F.when(hour.between(0, 23) & minute.between(0, 59), said)


def ratio(a: Column, b: Column) -> Column:
    return F.concat_ws(" ", cardinal(a), cardinal(b))


def fraction(top: Column, bottom: Column) -> Column:
    part = F.when(bottom == 2, "half").when(bottom == 4, "quarter").otherwise(F.element_at(F.split(ordinal(bottom), " "), -1))
    many = F.when(part == "half", "halves").otherwise(F.concat(part, F.lit("s")))
    return F.concat_ws(" ", cardinal(top), F.when(top == 1, part).otherwise(many))


def roman_value(numeral: Column) -> Column:
    """Of a numeral in capitals; null for what is none."""
    pairs = {"CM": 900, "CD": 400, "XC": 90, "XL": 40, "IX": 9, "IV": 4}
    ones = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
    rest, total = numeral, F.lit(0)
    for pair, value in pairs.items():
        total = total + F.when(numeral.contains(pair), value).otherwise(0)
        rest = F.replace(rest, F.lit(pair), F.lit(""))
    for one, value in ones.items():
        total = total + value * (F.length(rest) - F.length(F.replace(rest, F.lit(one), F.lit(""))))
    return F.when(numeral.rlike("^(?=.)M{0,4}(C[MD]|D?C{0,3})(X[CL]|L?X{0,3})(I[XV]|V?I{0,3})$"), total)
