"""The counting of single texts in plain Python: behind the SQL functions, and what tests hold the DataFrame plan against."""

from __future__ import annotations

import re
from collections.abc import Callable

from cadence.operators.scan import collapse, is_full_url, looks_junk, pieces, scan, strip_marks
from cadence.tables import ACRONYM, AMBIGUOUS, CONTRACTION, INITIALISM, SLANG

Traced = tuple[str, int, str, str, str]
#: Most words, and most letters of one, whose answers a task keeps.
MEMO_WORDS, MEMO_LETTERS = 1 << 16, 40
_CURATED = frozenset([*SLANG, *AMBIGUOUS, *INITIALISM, *ACRONYM, *CONTRACTION])
_DRAWN = re.compile(r"(.)\1\1")


def _aloud(word: str) -> int:
    return len(word) + 2 * word.count("w")


Answer = tuple[int, str, str, str]


def _unsure(why: str) -> Answer:
    return 0, "abstain", "none", why


def _word(forms: list[str], raw: str, lexicon: dict[str, int]) -> Answer:
    for form in forms:
        if form in SLANG:
            return SLANG[form], "slang", "exact", ""
        if form in AMBIGUOUS:
            return _unsure("ambiguous initialism")
        for source, table in (("initialism", INITIALISM), ("cmudict", lexicon), ("acronym", ACRONYM)):
            if form in table:
                return table[form], source, "exact", ""
    capitals = [raw.lower()] if forms and 1 < len(raw) < 7 and raw.isalpha() and raw.isupper() else []
    for form in capitals + [f for f in forms if 1 < len(f) < 7 and f.isalpha() and not set("aeiouy") & set(f)]:
        dashed = "-".join(form)
        return _aloud(form), "letters", "exact", dashed
    return _unsure("OOV")


def _kept(memo: dict, piece: str, answer: Callable[[str], tuple | list]) -> tuple | list:
    """What answer() says of a piece of text, kept in memo while there is room: the most frequent ones come early."""
    found = memo.get(piece)
    if found is None:
        found = answer(piece)
        if len(memo) < MEMO_WORDS and len(piece) <= MEMO_LETTERS:
            memo[piece] = found
    return found


def trace_text(text: str, lexicon: dict[str, int], memo: dict | None = None) -> list[Traced]:
    """(raw, n, source, confidence, note) of each token. With a memo, of one lexicon and this function alone, words of texts that have nothing else are answered once."""
    if memo is not None and (each := pieces(text)) is not None:
        return [row for piece in each for row in _kept(memo, piece, lambda x: trace_text(x, lexicon))]
    out: list[Traced] = []
    for raw, kind, forms, words, silent, approx, note in scan(text, lexicon.__contains__):
        if silent:
            out.append((raw, 0, kind, "exact", note))
        elif words is None:
            n, source, sure, own = _word(forms or [], raw.strip("'’-"), lexicon)
            out.append((raw, n, source, sure, "; ".join(x for x in (note, own) if x)))
        else:
            said = [(w, (lexicon[w], "") if w in lexicon else _word([w], "", lexicon)[:2]) for w in words]
            lost = [w for w, (_, source) in said if source == "abstain"]
            total = sum(n for _, (n, _) in said)
            if lost:
                why = f"{note} [OOV: {' '.join(lost)}]"
                out.append((raw, total, "abstain", "approx", why.strip()))
            else:
                sure = ("exact", "approx")[approx]
                out.append((raw, total, kind, sure, note))
    return out


def count_text(text: str, lexicon: dict[str, int], most: int | None = None) -> int | None:
    """The sure count of a text without a scorer, or None."""
    total = 0
    for raw, n, source, _, note in trace_text(text, lexicon):
        if source == "abstain" or "spoken url" in note and is_full_url(raw):
            return None
        total += n
    return total if most is None or total <= most else None


def _unknown(raw: str, lexicon: dict[str, int]) -> tuple | None:
    """line_sums() of a word of letters that nothing knows, as most of other languages are; None of any other piece of text, and of what a closer look must tell."""
    if not raw.isalpha() or raw.isupper() or raw[-1] == "D":
        return None
    low = raw.lower()
    if low.isascii():
        bare, forms = low, (low,)
    else:
        bare = strip_marks(low)
        forms = (low, bare, re.sub("[^a-z]+", "", low), re.sub("[^a-z]+", "", bare))
    for f in forms:
        if f in lexicon or f in _CURATED or 1 < len(f) < 7 and f.isalpha() and not any(v in f for v in "aeiouy"):
            return None
    if _DRAWN.search(low):
        return None
    if len(raw) > 15 or not raw[1:].islower() and looks_junk(raw) or len(raw) > 6 and not any(v in low for v in "aeiou"):
        return 0, 1, 0, 0, True, ()
    return 0, 1, 0, 1, False, (bare or low,)


def line_sums(text: str, lexicon: dict[str, int], memo: dict | None = None) -> tuple[int, int, int, int, bool, list[str]]:
    """(total, n_uncertain, det, oov_n, hard, oov): a text's whole count, how many tokens are unsure, the sum of what is sure, and what
    becomes of the rest: words that a scorer may be asked for, in order, and whether the text is given up. What policy.classify() does of token rows.
    With a memo, of one lexicon and this function alone, words of texts that have nothing else are answered once.
    """
    total = unsure = det = 0
    hard, oov = False, []
    if memo is not None and (each := pieces(text)) is not None:
        for piece in each:
            t, u, d, _, h, words = memo.get(piece) or _kept(memo, piece, lambda x: _unknown(x, lexicon) or line_sums(x, lexicon))
            total += t
            unsure += u
            det += d
            hard |= h
            oov += words
        return total, unsure, det, len(oov), hard, oov
    for raw, n, source, _, note in trace_text(text, lexicon):
        total += n
        lost = source == "abstain"
        unsure += lost
        if "spoken url" in note and (lost or is_full_url(raw)):
            hard = True
        elif not lost:
            det += n
        elif note.split(";")[-1].strip() == "OOV" and not any(x in note for x in ("[OOV:", "initialism", "roman")) and any(map(str.isalpha, raw)) and not looks_junk(raw):
            low = raw.lower()
            oov.append(strip_marks(collapse(low)[0]) or low)
        else:
            hard = True
    return total, unsure, det, len(oov), hard, oov
