"""Paragraphs, sentences and words as array columns (no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the Ukrainian alphabet, and of English and Ukrainian upper case.
UK = "а-яіїєґА-ЯІЇЄҐ"
UPPER = "A-ZА-ЯІЇЄҐ"
SPACE = r"[ \t\n\r\f\x0B]"
#: A private-use character that stands for a sentence boundary while it is decided.
MARK = ""
PARAGRAPH = r"(?s)[ \t\n\r\f\x0B]*[^ \t\n\r\f\x0B].*?(?:\n\n|\z)"
WORD = r"\p{L}[\p{L}\p{M}\p{N}]*(?:['’ʼ–-][\p{L}\p{N}][\p{L}\p{M}\p{N}]*)*|\p{N}+(?:[.,:/-]\p{N}+)*(?:-\p{L}+)?"
TOKEN = WORD + r"|[^ \t\n\r\f\x0B\p{L}\p{N}]"

# Abbreviations after which a capital letter does not begin a sentence.
ABBREVIATIONS = "вул|просп|пл|обл|р-н|ім|див|напр|тис|млн|млрд|стор|рис|табл|проф|акад|доц|гр|буд|кв|св|о|м|с|т|ст|ред|Mr|Mrs|Dr|St|No|Prof"
NOT_PARTICLES = ["себ-то", "цеб-то", "як-от", "ф-но", "то-то", "тим-то", "аби-то", "єй-бо", "їй-бо", "от-от", "от-от-от", "ото-то"]
PARTICLE = rf"(?iu)^([{UK}][{UK}'’ʼ-]+)[-–](бо|но|то|от|таки)$"


def paragraphs(text: Column) -> Column:
    """Paragraphs with the blank lines that follow them, of any length; leading blank lines stay
    with the next paragraph. Concatenated they give the text back (but for a blank tail).
    Null and blank texts have none."""
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def sentences(text: Column, separator: str | None = None, newline: str = " ") -> Column:
    """Sentences of a paragraph: after . ! ? or … before a capital, a digit or an opening
    quote, but for known abbreviations and initials. ``separator`` is one more
    regular expression that ends sentences and is dropped; line ends become ``newline``."""
    t = F.regexp_replace(text, separator, f".{MARK} ") if separator else text
    marked = F.regexp_replace(t, rf"([.!?…][»”\")]*)({SPACE}+)([«„“\"(—–-]*{SPACE}?[{UPPER}\d])", f"$1{MARK}$2$3")
    kept = F.regexp_replace(marked, rf"((?:^|[^\p{{L}}])(?:{ABBREVIATIONS}|[{UPPER}])\.){MARK}", "$1")
    if separator:
        kept = F.regexp_replace(kept, rf"\.{MARK} ", f"{MARK} ")
    parts = F.split(kept, rf"{MARK}{SPACE}*")
    parts = F.transform(parts, lambda s: F.replace(F.regexp_replace(s, rf"{SPACE}+\z", ""), F.lit("\n"), F.lit(newline)))
    return F.filter(parts, lambda s: s.rlike(rf"[^ \t\n\r\f\x0B]"))


def lines(text: Column) -> Column:
    """One sentence for each non-blank line."""
    return F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^ \t\n\r\f\x0B]"))


def tokens(sentence: Column, keep_space: bool = False, newline: str = " ") -> Column:
    """Words, numbers and single other characters; with ``keep_space`` also the white
    space between them (line ends as ``newline``, tabs as blanks)."""
    if not keep_space:
        return F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))
    return F.transform(F.regexp_extract_all(sentence, F.lit(TOKEN + rf"|{SPACE}+"), F.lit(0)), lambda w: F.replace(F.replace(w, F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit(newline)))


def only_words(sentence: Column) -> Column:
    """Tokens that hold a letter or digit, footnote marks [n] and accents dropped."""
    plain = F.regexp_replace(F.regexp_replace(sentence, r"\[[0-9]+\]", ""), "́", "")
    return particles(F.filter(tokens(plain), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def is_particle_word(word: Column) -> Column:
    """Whether the word ends in a particle that is split off (сідай-но, не як-от)."""
    low = F.regexp_replace(F.lower(word), "–", "-")
    return low.contains("-") & ~low.isin(NOT_PARTICLES) & word.rlike(PARTICLE)


def split_particle(word: Column) -> Column:
    """``[base, -particle]`` of a word, null if it has none."""
    return F.when(is_particle_word(word), F.array(F.regexp_extract(word, PARTICLE, 1), F.concat(F.lit("-"), F.regexp_extract(word, PARTICLE, 2))))


def particles(words: Column, hyphen: bool = True) -> Column:
    """The words with particles as words of their own."""
    lead = "-" if hyphen else ""
    return F.flatten(F.transform(words, lambda w: F.when(is_particle_word(w), F.array(F.regexp_extract(w, PARTICLE, 1), F.concat(F.lit(lead), F.regexp_extract(w, PARTICLE, 2)))).otherwise(F.array(w))))


def split_abbreviation_dot(words: Column) -> Column:
    """``англ.`` as ``англ`` and ``.``."""
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(rf"^[{UK}]{{2,}}\.$"), F.array(F.regexp_replace(w, r"\.$", ""), F.lit("."))).otherwise(F.array(w))))


def word_lists(sentence: Column, separator: str = "|") -> Column:
    """Words of a sentence as one string."""
    return F.array_join(tokens(sentence), separator)
