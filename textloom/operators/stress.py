"""Stress marks: syllables, accents and the marking of text from a stress table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = "аеєиіїоуюяАЕЄИІЇОУЮЯ"
LOW_VOWELS = "аеєиіїоуюя"
ACCENT = "́"


def syllables(word: Column) -> Column:
    return F.length(F.regexp_replace(word, f"[^{VOWELS}]", ""))


def strip_accent(word: Column) -> Column:
    return F.replace(word, F.lit(ACCENT), F.lit(""))


def accents(word: Column) -> Column:
    """Numbers of the vowels (small letters only) that bear an accent, from 1."""
    ends = F.regexp_extract_all(word, F.lit(f"[^{ACCENT}]*{ACCENT}"), F.lit(0))
    counts = F.transform(ends, lambda x: F.length(F.regexp_replace(x, f"[^{LOW_VOWELS}]", "")))
    return F.transform(counts, lambda x, i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0), lambda a, b: a + b))


def apply_accents(word: Column, at: Column) -> Column:
    """The word with an accent after each vowel whose number is in ``at``."""
    chars = F.split(word, "")
    n = F.transform(chars, lambda c, i: syllables(F.array_join(F.slice(chars, 1, i + 1), "")))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(f"[{VOWELS}]") & F.array_contains(at, F.element_at(n, i + 1)), F.concat(c, F.lit(ACCENT))).otherwise(c)), "")


def restore_accent(lemma: Column, word: Column, offset: Column) -> Column:
    """The accents of the lemma on another of its forms, moved by ``offset`` vowels."""
    return apply_accents(word, F.transform(accents(lemma), lambda a: a + offset))


def tag_key(tags: Column) -> Column:
    """The part of a tag that decides the stress."""
    t = F.replace(tags, F.lit(":inanim"), F.lit(""))
    t = F.regexp_replace(t, "^(noun(?::(?:un)?anim)?:[mnfps]|(?:noun(?::(?:un)?anim)?).*&pron|verb(?::perf|:imperf)+|adj(?:.*?:&adjp)?|[a-z]+).*$", "$1")
    return F.regexp_replace(t, "adj.*?:&adjp", "adj:&adjp")


def stress(tokens: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """``(key..., value, stressed)``: variants of the stressed word joined by ``/``.

    ``tokens`` have ``value`` and ``readings``; ``table(lemma, tag_key, form, base, offset)``. Words
    of one syllable, with an accent already, or without an entry stay as they are.
    """
    t = tokens.select(*key, "value", "readings")
    ask = t.filter((syllables(F.col("value")) > 1) & ~F.col("value").contains(ACCENT))
    r = ask.select(*key, "value", F.posexplode("readings").alias("__no", "r")).select(*key, "value", "__no", F.col("r.lemma").alias("lemma"), tag_key(F.col("r.tags")).alias("tag_key"))
    hit = r.join(table.select("lemma", "tag_key", "form", "base", "offset"), ["lemma", "tag_key"])
    same = F.lower("value") == strip_accent(F.lower("form"))
    hit = hit.withColumn("out", F.when(same, apply_accents(F.col("value"), accents(F.lower("form")))).when(F.col("base") == 1, restore_accent(F.lower("form"), F.col("value"), F.coalesce("offset", F.lit(0))))).filter("out is not null")
    best = hit.groupBy(*key).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("__no", "out"))), lambda x: x["out"])), "/").alias("__s"))
    return t.join(best, key, "left").select(*key, "value", F.coalesce("__s", "value").alias("stressed"))


def stress_counts(stressed: DataFrame) -> DataFrame:
    """One row: words of several syllables without an entry, and with several variants."""
    many = syllables(F.col("value")) > 1
    return stressed.agg(F.count_if(many & ~F.col("stressed").contains(ACCENT)).alias("unknown"), F.count_if(F.col("stressed").contains("/") & F.col("stressed").contains(ACCENT)).alias("homonyms"))
