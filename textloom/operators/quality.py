"""Gates and diagnostics of a text, as Columns. Null texts give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.tokenize import UK

# Letters of one alphabet only, endings that stand alone in broken words.
ONLY_UK, ONLY_RU = "іїєґ", "ыэъё"
BROKEN = r"[ \t-](?:[вжтч]ання|[вжчт]ення|лись|н?ість|нів|н?ня|ної|ност[іи]|вської|обов(?!['’ʼ])|ств[оа]|ськ(?:а|ий|им|ого|ому|ої)|ться|[ює]ть|[єю]ться|ючи)(?![\p{L}\p{N}_])"
PAGE_NUMBER = r"^[ \t]*[-_–—~][ \t]*[0-9]{1,4}[ \t]*[-_–—~][ \t]*\z"
LONG_LINE, LONG_WORD = 4096, 36


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def ukrainian_words(text: Column) -> Column:
    """Words of two or more letters of the Ukrainian alphabet."""
    words = F.split(text, "[^А-ЯІЇЄҐа-яіїєґё'’ʼ́-]+")
    return F.size(F.filter(words, lambda w: w.rlike("^[А-ЩЬЮЯІЇЄҐа-щьюяіїєґ][А-ЩЬЮЯІЇЄҐа-щьюяіїєґ'’ʼ́-]+$")))


def letters_of(text: Column, letters: str) -> Column:
    """How many of the letters the text holds, in either case."""
    return F.length(F.regexp_replace(F.lower(text), f"[^{letters}]", ""))


def alphabet_ok(text: Column, min_words: int = 0) -> Column:
    """Enough letters that only Ukrainian has, and no fewer than those only Russian has."""
    uk, ru = letters_of(text, ONLY_UK), letters_of(text, ONLY_RU)
    return (uk >= (min_words / 20 if min_words >= 20 else 0)) & (uk >= ru)


def two_columns(text: Column) -> Column:
    """Whether the text is laid out in two columns: five or more wide gaps, on more than
    three lines of four, and the second column starts at one place five times."""
    left = F.regexp_extract_all(text, F.lit(r"(?ium)(.*?[а-яїієґ] {4,})[а-яіїєґ].{4}"), F.lit(1))
    widths = F.transform(F.slice(left, 1, 5), F.length)
    gaps = F.length(text) - F.length(F.regexp_replace(text, "    ", "   "))
    aligned = (F.size(left) >= 5) & (F.size(left) > (F.size(_lines(text)) - 1) * 0.75) & (F.array_min(widths) == F.array_max(widths))
    # the expensive part only where there are gaps at all
    return F.when(gaps < 5, False).otherwise(aligned)


def suspect_empty_lines(text: Column) -> Column:
    """Blank lines inside sentences; a note only, nothing is rejected for it."""
    body = F.regexp_replace(text, r"^[^\n]*\n[^\n]*\n", "")
    return (_count(text, "\n\n") > 5) & body.rlike(rf"[{UK},:—–-]\s*\n\n[а-яіїєґ]")


def page_number_lines(text: Column) -> Column:
    return F.size(F.filter(_lines(text), lambda x: x.rlike(PAGE_NUMBER)))


def long_lines(text: Column) -> Column:
    return F.size(F.filter(_lines(text), lambda x: F.length(x) > LONG_LINE))


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(_lines(text), F.length))


def long_word_lines(text: Column) -> Column:
    return F.size(F.filter(_lines(text), lambda x: x.rlike(rf"[{UK}'’ʼ]{{{LONG_WORD}}}")))


def broken_word_lines(text: Column) -> Column:
    return F.size(F.filter(_lines(text), lambda x: x.rlike(BROKEN)))


def leftovers(text: Column) -> dict[str, Column]:
    """What cleaning has left in the text."""
    return {
        "has_control": text.rlike(r"[\x{00}-\x{08}\x{0B}-\x{12}\x{14}-\x{1F}]"),
        "has_private": text.rlike(r"[\x{E000}-\x{F8FF}]"),
        "has_soft_hyphen": text.contains("­"),
        "has_not_sign": text.contains("¬"),
        "has_mix": text.rlike(rf"[{UK}][a-zA-Z]|[a-zA-Z][{UK}]"),
        "has_wrap": text.rlike(rf"[{UK}][-–‑¬][ \t]*\n"),
    }


def diagnostics(text: Column) -> Column:
    """Names of all that is suspect about a text, in order."""
    notes = {
        "page_numbers": page_number_lines(text) >= 3,
        "long_lines": long_lines(text) > 0,
        "long_words": long_word_lines(text) > 0,
        "broken_words": broken_word_lines(text) > 5,
        "empty_lines": suspect_empty_lines(text),
    } | {k.removeprefix("has_"): v for k, v in leftovers(text).items()}
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in notes.items())))
