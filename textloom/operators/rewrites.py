"""Cleaning steps that depend on whether a word is known, as functions of a text and a
lexicon, run by ``lexicon.rewrite``."""

from __future__ import annotations

import re

from textloom.functions.clean import ACCENTED, BRANDS, CYRILLIC, LATIN, PROTECTED
from textloom.functions.tokenize import UK
from textloom.operators.lexicon import Lexicon

A = "'’ʼ"
W = f"[{UK}{A}-]"
_CONTROL = re.compile("([а-яіїєґ'’ʼ́-]+)[\x00-\x08\x0b-\x12\x14-\x1f਍]\n?([а-яіїєґ'’ʼ́-]+)", re.I)
_TRIPLE = re.compile(f"[{UK}][а-яіїєґ{A}-]+(?:ннн|ттт)[а-яіїєґ][а-яіїєґ{A}-]*")
_BROKEN_I = re.compile(rf"\b([{UK}{A}]+) і ([а-яіїєґ{A}]+)\b")
_OI = re.compile(r"([а-яіїєґА-ЯІЇЄҐ][а-яіїєґ'-]+[а-яіїєґ])о[іi]\b")
_II = re.compile(r"([а-яіїєґА-ЯІЇЄҐ][а-яіїєґ'-]+[а-яіїєґ][стц])[іi][іi]\b")
_SPACED = re.compile(f"([{UK}]+) ([{A}][яєюїЯЄЮЇ][{UK}]+)")
_NOT_SIGN = re.compile(f"([{UK}{A}-]*[{UK}])¬ ?([{UK}][{UK}{A}-]*)")
_TILDE = re.compile(f"([{UK}{A}-]*[{UK}])~([{UK}][{UK}{A}-]*)")
_LEADING_SURE = re.compile(r"(\.[ \t]+[-–‑—])([А-ЯІЇЄҐ][^.-])")
_LEADING = re.compile(rf"(^|(?<!\bна)[ \t]|[,:;?!])([-–‑—])([А-ЯІЇЄҐ][а-яіїєґ{A}-]+|[а-яіїєґ{A}-]{{4,}})", re.M)
_QUOTED_WRAP = re.compile(f"([{UK}-]+)[ \t]*-\n([ \t]*)([«„\"][а-яіїєґ{A}-]+[»“\"])([,;.!?])?")
_WRAP = re.compile(rf"({W}+)[-–‑][ \t]*\n(?:[ \t]*\n)?([ \t]*)({W}+)([,;.!?])?")
_NOT_WRAP = re.compile(f"({W}+)¬ *\n([ \t]*)([а-яіїєґ{A}-]+)")
_SPLIT = re.compile(f"({W}+)\n([ \t]*)([а-яіїєґ][а-яіїєґ{A}-]*)([,;.!?])?")
_LONE_G = re.compile(rf"\b([гГ])[ \t]+([а-яіїєґ{A}-]{{3,}})")
_LAT = LATIN + "".join(ACCENTED)
_MIX_WORD = re.compile(f"[{UK}́{A}a-zA-Z{''.join(ACCENTED)}-]+")
_MIX = re.compile(f"[{UK}][a-zA-Zóáíýúé]|[a-zA-Zóáíýúé][{UK}]")
_TO_CYR = re.compile(f"[{UK}][{A}]?[{_LAT}]|[{_LAT}][{UK}]")
_TO_LAT = re.compile(f"[a-zA-Z][{A}]?[{CYRILLIC}]|[{CYRILLIC}][{A}]?[a-zA-Z]")
_LATIN_WORD = re.compile(f"[{UK}a-zA-Z][{UK}{A}a-zA-Z-]{{3,}}(?![0-9])")
_BETWEEN_CYR = re.compile(f"([{UK}][{A}]?)([{_LAT}])(?=[{A}]?[{UK}])")
_BETWEEN_LAT = re.compile(f"([a-zA-Z][{A}]?)([{CYRILLIC}])(?=[{A}]?[a-zA-Z])")
_ALL_EN_UK = re.compile(rf"^([A-Za-z]+)([а-яіїєґ{A}]+)$")
# Words that a hyphen must not make, and short mixes that count as words.
BAD_COMPOUND = re.compile("(?:дійн|ленськ)(?:ий|ого|ому|им|ім|а|ої|ій|у|ою|е|і|их|ими)", re.I)
_SHORT_MIX = re.compile("[ІI][ТT]|[ТT][іiеe]|[НH][іiаaуy]")
_GUARD = ""
TO_CYR = dict(zip(LATIN, CYRILLIC)) | ACCENTED
TO_LAT = {c: x for x, c in zip(LATIN, CYRILLIC)}


def _first(lexicon: Lexicon, *candidates: str) -> str | None:
    return next((c for c in candidates if lexicon.has(c)), None)


def control_in_word(text: str, x: Lexicon) -> str:
    """A control character inside a word: with a hyphen or joined, if that is known."""
    return _CONTROL.sub(lambda m: _first(x, f"{m[1]}-{m[2]}", m[1] + m[2]) or m[0], text)


def broken_i(text: str, x: Lexicon) -> str:
    """``перемог і я``-like breaks: two pieces around a lone і that make a known word while
    neither is a word itself. Not part of the plan unless asked for."""

    def word(w: str) -> bool:
        return x.has(w) and not re.fullmatch("[гґдзклмнпрстфхцчшщ]", w)

    return _BROKEN_I.sub(lambda m: m[0] if word(m[1]) or word(m[2]) else _first(x, f"{m[1]}і{m[2]}") or m[0], text)


def tripled(text: str, x: Lexicon) -> str:
    """ннн and ттт as нн and тт, if that makes a known word."""
    return _TRIPLE.sub(lambda m: _first(x, re.sub("т(тт)", r"\1", re.sub("н(нн)", r"\1", m[0], flags=re.I), flags=re.I)) or m[0], text)


def feminine_endings(text: str, x: Lexicon) -> str:
    """оі as ої, and іі after с, т, ц as ії, if known."""
    text = _OI.sub(lambda m: _first(x, m[1] + "ої") or m[0], text)
    return _II.sub(lambda m: _first(x, m[1] + "ії") or m[0], text)


def spaced_apostrophes(text: str, x: Lexicon) -> str:
    return _SPACED.sub(lambda m: _first(x, m[1] + m[2]) or m[0], text)


def not_sign_hyphens(text: str, x: Lexicon) -> str:
    """¬ as hyphen after a digit, or inside a word with a hyphen or joined, if known."""
    text = re.sub(f"([0-9])¬([{UK}0-9])", r"\1-\2", text)
    return _NOT_SIGN.sub(lambda m: _first(x, f"{m[1]}-{m[2]}", m[1] + m[2]) or m[0], text)


def tilde_hyphens(text: str, x: Lexicon) -> str:
    def one(m):
        if x.has(f"{m[1]}-{m[2]}"):
            return f"{m[1]}-{m[2]}"
        return f"{m[1]} {m[2]}" if x.has(m[1]) and x.has(m[2]) else m[0]

    return _TILDE.sub(one, text)


def leading_hyphens(text: str, x: Lexicon) -> str:
    """A dash stuck to the word after it."""
    text = _LEADING_SURE.sub(r"\1 \2", text)
    return _LEADING.sub(lambda m: f"{m[1]}{m[2]} {m[3]}" if x.has(m[3]) else m[0], text)


def line_end_hyphens(text: str, x: Lexicon) -> str:
    """Words broken at line ends: with the hyphen if that is known, else joined if known;
    the line end moves behind the word."""
    text = _QUOTED_WRAP.sub(lambda m: f"{m[1]}-{m[3]}{m[4] or ''}\n{m[2]}", text)

    def one(m):
        tail = (m[4] or "") + "\n" + m[2]
        if x.has(f"{m[1]}-{m[3]}") and not BAD_COMPOUND.fullmatch(m[3]):
            return f"{m[1]}-{m[3]}{tail}"
        return m[1] + m[3] + tail if x.has(m[1] + m[3]) else m[0]

    return _NOT_WRAP.sub(r"\1\3\n\2", _WRAP.sub(one, text))


def split_words(text: str, x: Lexicon) -> str:
    """Words split over a line end without a hyphen."""

    def either(w: str) -> bool:
        return x.has(w) or x.has(w, "ru")

    def one(m):
        if m[4] == "." or len(m[1]) + len(m[3]) < 4 or re.search("[А-ЯІЇЄҐ]{2,}", m[0]):
            return m[0]
        return f"{m[1]}{m[3]}{m[4] or ''}\n{m[2]}" if not either(m[1]) and not either(m[3]) and x.has(m[1] + m[3]) else m[0]

    return _SPLIT.sub(one, text)


def lone_g(text: str, x: Lexicon) -> str:
    """``Г оловний`` as ``Головний``."""
    return _LONE_G.sub(lambda m: m[1] + m[2] if not x.has(m[2]) and x.has(m[1] + m[2]) else m[0], text)


def _apart(word: str, x: Lexicon) -> str:
    m = re.search("[а-яіїєґ][A-Z]", word)
    if m:
        left, right = word[: m.start() + 1], word[m.start() + 1 :]
        if len(left) > 1 and len(right.split(" ")[0]) > 2 and x.has(left) and x.has(right, "en"):
            return f"{left} {right}"
        return word
    m = _ALL_EN_UK.match(word)
    if m and len(m[1]) > 2 and len(m[2]) > 3 and x.has(m[2]) and x.has(m[1], "en"):
        return f"{m[1]} {m[2]}"
    return word


def _all_cyrillic(word: str, x: Lexicon) -> str:
    if not _TO_CYR.search(word) or len(word) < 3 and not _SHORT_MIX.search(word) or x.has(word):
        return word
    fixed = "".join(TO_CYR.get(c, c) for c in word)
    return fixed if x.has(fixed) else word


def _all_latin(word: str, x: Lexicon) -> str:
    if not _TO_LAT.search(word):
        return word
    fixed = "".join(TO_LAT.get(c, c) for c in word)
    return fixed if x.has(fixed, "en") else word


def mixed_letters(text: str, x: Lexicon) -> str:
    """Words of Latin and Cyrillic letters: known brands stay, glued words come apart,
    then all Cyrillic or all Latin if known, then single letters between others."""
    if not _MIX.search(text):
        return text
    text = re.sub(f"([{UK}])({PROTECTED})", rf"\1{_GUARD}\2", text, flags=re.I)
    for a, b in BRANDS:
        text = text.replace(a + b, a + _GUARD + b)
    if _MIX.search(text):
        text = re.sub(f"[{UK}{A}a-zA-Z-]+", lambda m: _apart(m[0], x), text)
        text = _MIX_WORD.sub(lambda m: _all_cyrillic(m[0], x), text)
        text = _LATIN_WORD.sub(lambda m: _all_latin(m[0], x), text)
        text = _BETWEEN_CYR.sub(lambda m: m[1] + TO_CYR.get(m[2], m[2]), text)
        text = _BETWEEN_LAT.sub(lambda m: m[1] + TO_LAT[m[2]], text)
    return text.replace(_GUARD, "")
