"""The scanner: one text to an array of tokens, by readers tried in order at each place.

Whether a reader takes what its pattern matches can depend on what the match says (a month 13 is no date), and what one takes moves where the
next begins, so this runs in Arrow batches. Plain lines don't come here: see cadence.operators.tokens.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from itertools import filterfalse

from cadence.functions import speak
from cadence.tables import APOSTROPHES, CONTRACTION, EMOJI, EMOJI_RANGES, REGISTRY_LABELS, SHORTHAND, SYMBOL, TLDS, VULGAR

#: raw, kind, candidates, words, silent, approx, note. candidates None: words hold the reading.
Token = tuple[str, str, list[str] | None, list[str] | None, bool, bool, str]

_FOLD = str.maketrans(dict.fromkeys(APOSTROPHES, "'") | {k: f" {v} " for k, v in VULGAR.items()})
_FOLDED = re.compile(f"[{re.escape(''.join(map(chr, _FOLD)))}]")
_RUN = re.compile("(?P<glyphs>[{0}]+)|[^{0}]+".format("".join(f"{chr(a)}-{chr(b)}" for a, b in EMOJI_RANGES)))


def is_url(body: str) -> bool:
    if re.match(r"(?i)https?://|www\.", body):
        return True
    *inner, top = [""] + list(filter(None, speak.host_of(body).lower().split(".")))
    labels = inner[1:] + [top]
    if not inner or len(labels) == 1:
        return False
    if top in TLDS or {"/", "?"} & set(body) and len(top) > 1 and top.isalpha():
        return True
    return len(labels) > 2 and len(top) == 2 and labels[-2] in REGISTRY_LABELS


def is_full_url(raw: str) -> bool:
    """One with a scheme, a path or a query."""
    return bool(re.match("(?i)https?://", raw)) or "?" in raw or bool(raw.partition("/")[2].strip("/ "))


def looks_junk(word: str) -> bool:
    """No plausible word: very long, of erratic case, or long without a vowel."""
    inner = word[1:]
    flips = sum(x.isupper() is not y.isupper() for x, y in zip(inner, inner[1:]) if x.isalpha() and y.isalpha())
    return len(word) > 15 or flips > 3 or len(word) > 6 and not re.search("[aeiou]", word.lower())


def strip_marks(text: str) -> str:
    return text if text.isascii() else "".join(filterfalse(unicodedata.combining, unicodedata.normalize("NFKD", text)))


def collapse(word: str) -> list[str]:
    """Runs of three or more of a character as one, then as two; the word alone if it has none."""
    forms = [re.sub(r"(.)\1\1+", keep, word) for keep in (r"\1", r"\1\1")]
    return list(dict.fromkeys(forms))


def normalise(text: str) -> str:
    return unicodedata.normalize("NFKC", text.translate(_FOLD) if _FOLDED.search(text) else text)


def emoji_note(run: str) -> str:
    shown = [c for c in run if c != "‍" and not "︀" <= c <= "️"]
    return ", ".join(EMOJI.get(c, "emoji") for c in shown) or "emoji"


def word_token(raw: str, known: Callable[[str], bool]) -> Token:
    """known tells whether the lexicon has a word: a numeral that is one is no numeral."""
    bare = raw.strip("'’-")
    if len(bare) > 1 and bare.isalpha() and bare.isupper() and speak.ROMAN_SHAPE.fullmatch(bare) and not known(bare.lower()):
        value = speak.roman_value(bare)
        if value <= 10:
            return raw, "number", None, speak.cardinal(str(value)), False, True, "roman numeral"
        return raw, "word", [], None, False, False, "roman numeral (ambiguous)"
    low = raw.lower().strip("'’-")
    forms = collapse(low)
    note = "elongation" if forms[0] != low else ""
    for fold in (strip_marks, lambda c: re.sub("[^a-z]+", "", c)):
        forms += [f for f in map(fold, list(forms)) if f]
    if low in CONTRACTION:
        forms.append(CONTRACTION[low])
        note = note or "contraction"
    return raw, "word", list(dict.fromkeys(forms)), None, False, False, note


def _spoken(kind: str, note: str, read: Callable[[re.Match], list[str]], approx: bool = False):
    """A reader that gives up where read finds no words."""

    def reader(m: re.Match) -> Token | None:
        words = read(m)
        return (m.group(), kind, None, words, False, approx, note) if words else None

    return reader


def _slash_date(m: re.Match) -> list[str]:
    a, b, y = (int(m.group(k)) for k in "aby")
    return speak.date(b, a, y) if a > 12 >= b else speak.date(a, b, y)


_TWO, _NTH = r"\d{1,2}", "(?:st|nd|rd|th)"
_FACES = (
    "</?3", "x+D+", "X+D+", r">?[:;=]'?-?[3DOPco0p()/|\[\]\\]", r"\^[-._]?\^", "-_-", "[0Oo]_[0Oo]", r"[Oo]\.[Oo]", "[Tt]_[Tt]", r"[Tt]\.[Tt]", ";_;",
)
_FACE = re.compile("|".join(_FACES))
_SHORT = re.compile(r"(?i)(?:w/o|w/|b/c)(?![/\w])")
#: Readings of what begins with a digit, in the order in which they are tried.
_DIGIT_READERS = [
    (re.compile(rf"\b(?P<y>\d{{4}})-(?P<a>{_TWO})-(?P<b>{_TWO})\b"), _spoken("date", "date", lambda m: speak.date(int(m["a"]), int(m["b"]), int(m["y"])), True)),
    (re.compile(rf"\b(?P<a>{_TWO})/(?P<b>{_TWO})/(?P<y>\d{{2,4}})\b"), _spoken("date", "date", _slash_date, True)),
    (re.compile(rf"(?i)(?P<h>{_TWO}):(?P<m>[0-5]\d)(?::\d{{2}})?\s*(?P<half>[ap])[.]?\s?m[.]?"), _spoken("time", "time", lambda m: speak.clock(int(m["h"]), int(m["m"]), m["half"]), True)),
    (re.compile(rf"\b(?P<h>{_TWO}):(?P<m>[0-5]\d)(?![:\d])"), _spoken("time", "time", lambda m: speak.clock(int(m["h"]), int(m["m"]), None), True)),
    (re.compile(r"\b(?P<a>\d{1,3})-(?P<b>\d{1,3})(?![-\w])"), _spoken("ratio", "ratio", lambda m: speak.plain(m["a"]) + speak.plain(m["b"]), True)),
    (re.compile(rf"\b(?P<a>{_TWO})/(?P<b>{_TWO})(?![/\d])"), _spoken("fraction", "fraction", lambda m: speak.fraction(int(m["a"]), int(m["b"])), True)),
]
_NAME = re.compile(r"[@#](?P<name>\w+)")
_NUMBER = re.compile("(?i)" + "".join(["[−-]?", "[¥€£$]?", r"\d[,\d]*", r"(?:[.]\d+)?", "%?", f"{_NTH}?", "(?:[bkmt](?![a-z]))?"]))
_LETTERS = r"[^\d\W_]+"
_WORD = re.compile(f"{_LETTERS}(?:[-'’]{_LETTERS})*")
_LABEL = r"[-\w]+"
_LINK = re.compile(rf"(?i)\bwww\.\S+|\bhttps?://\S+|\b{_LABEL}(?:\.{_LABEL})+(?:/\S*)?")
_ADDRESS = re.compile(rf"\b[-+.\w]+@{_LABEL}\.[-.\w]+\b")


def _read_name(m: re.Match) -> Token:
    name = m["name"]
    if m.group()[0] == "@":
        words, note = ["at", *speak.split_handle(name)], "mention"
    elif re.fullmatch(rf"(?i)\d+{_NTH}?", name):
        words, note = ["number", *speak.expand(name)], "number sign"
    else:
        words, note = speak.split_handle(name), "hashtag"
    return m.group(), "word", None, words, False, False, note


_read_number = _spoken("number", "number", lambda m: speak.expand(m.group()))


def scan_plain(text: str, known: Callable[[str], bool], out: list[Token]) -> None:
    """Tokens of a text without links and emoji."""
    at, end = 0, len(text)
    while at < end:
        c = text[at]
        if c.isspace():
            at += 1
            continue
        m = _FACE.match(text, at)
        if m and not text[m.end() : m.end() + 1].isalnum():
            out.append((m.group(), "emoji", None, None, True, False, "emoticon"))
            at = m.end()
            continue
        m = _SHORT.match(text, at)
        if m:
            out.append((m.group(), "word", None, [SHORTHAND[m.group().lower()]], False, False, "shorthand"))
            at = m.end()
            continue
        token = None
        for pattern, reader in _DIGIT_READERS if c.isdigit() else ():
            m = pattern.match(text, at)
            token = m and reader(m)
            if token:
                break
        if not token and (m := _NAME.match(text, at)):
            token = _read_name(m)
        if not token and (m := _NUMBER.match(text, at)):
            token = _read_number(m)
        if token:
            out.append(token)
            at = m.end()
            continue
        m = _WORD.match(text, at)
        if m:
            raw = m.group()
            parts = raw.split("-") if len(raw) > 3 else [raw]
            out += [word_token(p, known) for p in parts if p]
            at = m.end()
            continue
        words = SYMBOL.get(c)
        out.append((c, "punct", None, None, True, False, "") if words is None else (c, "symbol", None, words, not words, False, "symbol"))
        at += 1


#: What a text of words alone has none of, once normalised: anything but letters, spaces, these marks, and hyphens and apostrophes between letters; what would be
#: folded once more; a mark before a letter, as links have; and what a link may begin with.
_UNWORDY = re.compile(rf"[{re.escape(''.join(map(chr, _FOLD.keys() - {ord(chr(39))})))}]|" + r"""[^\w\s.,!?"'-]|[\d_]|[.,!?"](?=[^\W\d_])|(?<![^\W\d_])['-]|['-](?![^\W\d_])|(?i:www\.)""")
_PIECE = re.compile(rf'{_LETTERS}(?:[-\']{_LETTERS})*|[.,!?"]')


def pieces(text: str) -> list[str] | None:
    """The words and marks of a text that has no others, each of which scan() reads by itself as it does in the text; None of any other text."""
    folded = text if text.isascii() else normalise(text)
    return None if _UNWORDY.search(folded) else _PIECE.findall(folded)


def scan(text: str, known: Callable[[str], bool]) -> list[Token]:
    """All tokens of a text, in order."""
    out: list[Token] = []
    for run in _RUN.finditer(normalise(text)):
        part = run.group()
        if run["glyphs"]:
            out.append((part, "emoji", None, None, True, False, emoji_note(part)))
            continue
        spans = [(m.span(), True) for m in _ADDRESS.finditer(part)] + [(m.span(), False) for m in _LINK.finditer(part) if is_url(m.group())]
        at = 0
        # of two that begin and end alike the address holds
        for (a, b), address in sorted(spans, key=lambda s: (s[0], not s[1])):
            if a < at:
                continue
            scan_plain(part[at:a], known, out)
            out.append((part[a:b], "url", None, (speak.read_email if address else speak.read_host)(part[a:b]), False, False, "spoken url"))
            at = b
        scan_plain(part[at:], known, out)
    return out
