"""Rewriting steps stated once and run in either engine: as a Column expression in the JVM,
or on a Python string inside an Arrow pass that has to be there anyway."""

from __future__ import annotations

import functools

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


def sub(pattern: str, replacement: str) -> tuple:
    """A regular expression (as Java writes it) and its replacement with $n."""
    return ("sub", pattern, replacement)


def put(a: str, b: str) -> tuple:
    """A literal replacement."""
    return ("put", a, b)


def letters(a: str, b: str) -> tuple:
    """Letter by letter."""
    return ("map", a, b)


@functools.cache
def _compiled(pattern: str) -> regex.Pattern:
    """The pattern in Python's spelling: \\x{...} as the character, (?iu) as (?i), blanks."""
    p = regex.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: regex.escape(chr(int(m[1], 16)), special_only=False), pattern)
    return regex.compile(p.replace("(?iu)", "(?i)"))


@functools.cache
def _template(replacement: str) -> str:
    return regex.sub(r"\$(\d)", r"\\g<\1>", replacement.replace("\\", "\\\\"))


class Step:
    """Operations in order, applied where ``when`` is found in the text. Null stays null."""

    def __init__(self, *operations: tuple, when: str | None = None, rounds: int = 1):
        self.operations, self.when = operations * rounds, when

    def __call__(self, text: Column) -> Column:
        t = text
        for kind, a, b in self.operations:
            t = F.regexp_replace(t, a, b) if kind == "sub" else F.replace(t, F.lit(a), F.lit(b)) if kind == "put" else F.translate(t, a, b)
        return t if self.when is None else F.when(text.rlike(self.when), t).otherwise(text)

    def text(self, text: str) -> str:
        if self.when is not None and not _compiled(self.when).search(text):
            return text
        for kind, a, b in self.operations:
            text = _compiled(a).sub(_template(b), text) if kind == "sub" else text.replace(a, b) if kind == "put" else text.translate(str.maketrans(a, b))
        return text
