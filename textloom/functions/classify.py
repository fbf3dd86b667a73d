"""Classes of tokens that the dictionary does not know, in order of precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes of each token class.
PUNCT = r"[,.:;!?/()\[\]{}«»„“\"'…–—”•■♦-]+"
SYMBOL = r"[%&@$*+=<>\x{A0}-\x{BF}\x{2000}-\x{20CF}\x{2100}-\x{218F}\x{2200}-\x{22FF}]+"
XML_TAG = r"</?[a-zA-Z_0-9]+>"
UKRAINIAN = r"(?:.*-)?[а-яіїєґА-ЯІЇЄҐ][а-яіїєґА-ЯІЇЄҐ'ʼ’]+(?:-.*)?"
NOT_UKRAINIAN = r"^[#№u2013-]|[ыэъёЫЭЪЁ]|[а-яіїєґА-ЯІЇЄҐ][a-zA-Z]|[a-zA-Z][а-яіїєґА-ЯІЇЄҐ]"
SINGLE = r"[а-зй-яіїєґА-ЗЙ-ЯІЇЄҐ]"


def token_class(token: Column) -> Column:
    """punct, symb, xmltag, unknown, noninfl or unclass; null for a null token."""

    def whole(pattern: str) -> Column:
        return token.rlike(rf"^(?:{pattern})\z")

    return (
        F.when(whole(PUNCT), "punct")
        .when(whole(SYMBOL), "symb")
        .when(whole(XML_TAG), "xmltag")
        .when(whole(UKRAINIAN) & ~token.rlike(NOT_UKRAINIAN), "unknown")
        .when(whole(SINGLE), "noninfl")
        .when(token.isNotNull(), "unclass")
    )


def multi_column(text: Column) -> Column:
    """Whether a word broken at a hyphen is followed by a wide gap, as in columns."""
    return text.rlike(r"[‑-]   +[а-яіїєґ]")
