"""Normal forms of tags, words, numbers and marks used by the statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag parts that statistics leave out, words whose right neighbour counts.
RATE_PARTS = r":(xp[1-9]|up[0-9]{2}|comp.|predic|insert|vulg|coll|ns)"
CORE_PARTS = r":(arch|coll|slang|bad|vulg|up[0-9]{2}|ns)"
RIGHT_WORDS = (
    r"^(?:є|її|це|саме|[ву]с[еі]|за|всередині|відповідно|перед|протягом|близько|навколо|довкола|наприкінці|неподалік|[ву]глиб|поза"
    r"|брати|(?:українськ|англійськ)(?:а|у|ою|ій)|рівні|доросл.*|майбутн(?:є|ього|ім|ому)|більше|добре|геть|тільки)$"
)


def tag_for_rate(tags: Column) -> Column:
    """The tag without the parts that word and tag rates leave out."""
    return F.regexp_replace(tags, RATE_PARTS, "")


def tag_core(tags: Column) -> Column:
    """The tag without style marks, as contexts use it."""
    return F.regexp_replace(tags, CORE_PARTS, "")


def part_of_speech(tags: Column) -> Column:
    return F.split(tags, ":")[0]


def word_ending(word: Column, tags: Column, length: int = 3) -> Column:
    """The ending by which inflected words are counted; null where there is none. Two
    letters more for reflexive verbs, one more where a hyphen stands at its start."""
    n = F.when(tags.rlike("^(verb|advp):rev"), length + 2).when(F.substring(word, -length, 1) == "-", length + 1).otherwise(length)
    fits = (
        tags.rlike("^(noun|adj|verb|adv)")
        & ~tags.contains(":nv")
        & word.rlike("[а-яіїєґ]$")
        & ~word.rlike("-(що|бо|то|от|но|таки)$")
        & (F.length(word) > length)
        & (F.length(word) > n)
    )
    return F.when(fits, F.right(word, n))


def number(word: Column) -> Column:
    """Years keep their last two digits, integers the kind of plural they take (0, 1, 2),
    decimals become 0,0; other words are null."""
    year = r"^(?:(?:1[6789]|20)[0-9]{2}[-–—])?(?:1[6789]|20)([0-9]{2})$"
    plain = F.regexp_replace(word, " ", "")
    return (
        F.when(word.rlike(year), F.concat(F.lit("YY"), F.regexp_extract(word, year, 1)))
        .when(plain.rlike(r"^(?:[0-9]+[-—–])?[0-9]+$"), F.when(plain.rlike("([05-9]|1[0-9])$"), "0").when(plain.rlike("[234]$"), "2").otherwise("1"))
        .when(plain.rlike(r"^(?:[0-9,]+[–—-])?[0-9]+[,.][0-9]+$"), "0,0")
    )


def mark(word: Column) -> Column:
    """Dashes, quotes, dots and ?.. in one form."""
    return (
        F.when(word == "...", "…")
        .when(word.isin("–", "—"), "-")
        .when(word == "„", "«")
        .when(word == "“", "»")
        .when(word.rlike(r"^[?!]\.+$"), F.substring(word, 1, 1))
        .otherwise(word)
    )


def hyphened(word: Column, tags: Column) -> Column:
    """En dash as hyphen; ``2000-го`` as ``0-го`` for nouns and adjectives."""
    w = F.regexp_replace(word, "–", "-")
    return F.when(tags.rlike("^(adj|noun)") & w.rlike("^[0-9-]*[0-9]-[а-яіїєґ]+$"), F.regexp_replace(w, "^[0-9-]*([0-9])-([а-яіїєґ]+)$", "$1-$2")).otherwise(w)


def context_word(word: Column, lemma: Column, tags: Column) -> Column:
    """The word as a context: by kind of token, in small letters if the lemma is."""
    w = hyphened(word, tags)
    low = F.when(lemma.rlike("^[а-яіїєґ]"), F.lower(word)).otherwise(word)
    return F.when((tags == "number") & number(word).isNotNull(), number(word)).when(w != word, w).when(tags == "punct", mark(word)).otherwise(low)


def uses_right_context(word: Column) -> Column:
    return F.lower(word).rlike(RIGHT_WORDS)


def known_form(word: Column) -> Column:
    """The form under which the lexicon is asked: one apostrophe, no accent."""
    return F.regexp_replace(F.regexp_replace(word, "[’ʼ]", "'"), "́", "")


def snippet(text: Column, start: Column, end: Column, around: int = 10) -> Column:
    """Context of a place, line ends written as \\n."""
    a = F.greatest(start - around, F.lit(1))
    return F.replace(F.substring(text, a, end + around - a), F.lit("\n"), F.lit("\\n"))
