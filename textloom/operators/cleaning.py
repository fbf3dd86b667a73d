"""The cleaning plan: native steps and lexicon steps in one fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.config import CleanConfig
from textloom.functions import clean as C
from textloom.functions.tokenize import UK
from textloom.operators import quality
from textloom.operators import rewrites as R
from textloom.operators.langmark import mark_russian
from textloom.operators.lexicon import Rewrite, rewrite


def native(df: DataFrame, steps: list, text_col: str = "text") -> DataFrame:
    """The steps as one projection (each step is a Column function)."""
    for s in steps:
        df = df.withColumn(text_col, s(F.col(text_col)))
    return df


def plan(config: CleanConfig) -> list[Rewrite]:
    """All steps between the line ends, in order, as functions of a text and a lexicon."""
    native = lambda *steps: [lambda t, _, s=s: s.text(t) for s in steps]
    steps = [*native(C.direction_marks, C.unit_separator_hyphens), R.control_in_word, *native(C.control_chars, C.corpus_fixes), *([R.broken_i] if config.merge_broken_i else []), *native(C.typos), R.tripled, *native(C.quotes, C.combining)]
    steps += [] if "oi" in config.disabled_rules else [R.feminine_endings]
    steps += [*native(C.apostrophes), R.spaced_apostrophes, *native(C.soft_hyphens), R.not_sign_hyphens, R.tilde_hyphens, *native(C.line_separators, C.digit_three)]
    if not config.simple:
        steps += [*native(C.mix_shortcuts, C.roman_numbers), R.mixed_letters, *native(C.lone_latin)]
    steps.append(R.leading_hyphens)
    if not config.simple:
        steps += [*native(C.dangling_numbers), R.line_end_hyphens, R.split_words, *native(C.letter_spacing), R.lone_g]
    return steps


def clean(df: DataFrame, lexicons: dict[str, DataFrame], config: CleanConfig = CleanConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` cleaned and the columns ``status`` and ``changed``.

    ``status`` is ok, two_columns, few_words or few_letters; rejected texts are null.
    DOS line ends are taken off and put back. ``lexicons``: uk, ru, en.
    """
    raw = "__raw"
    df = df.withColumn(raw, F.col(text_col)).withColumn(text_col, C.orphan_cr(F.col(text_col)))
    df = df.withColumn("__dos", F.coalesce(C.has_dos_newlines(F.col(text_col)), F.lit(False))).withColumn(text_col, C.without_cr(F.col(text_col)))
    status: Column = F.lit("ok")
    if not config.simple and not config.allow_two_columns:
        status = F.when(quality.two_columns(F.col(text_col)), "two_columns").otherwise(status)
    df = df.withColumn("status", status)
    if config.journal:
        df = native(repeated_footers(df, id_col=id_col, text_col=text_col), [C.abstracts], text_col)
    if config.split_long_lines:
        df = df.withColumn(text_col, F.coalesce(C.split_long_lines(F.col(text_col)), text_col))
    # the steps that ask the lexicon lie between the others, so all run in one Arrow pass
    df = _in_chunks(df, config, lexicons, id_col, text_col) if config.chunk_chars else rewrite(df, plan(config), lexicons, text_col)
    status = F.col("status")
    if config.min_words:
        status = F.when(status != "ok", status).when(quality.ukrainian_words(F.col(text_col)) < config.min_words, "few_words").when(~quality.alphabet_ok(F.col(text_col), config.min_words), "few_letters").otherwise("ok")
    df = df.withColumn("status", status)
    df = df.withColumn(text_col, F.when(F.col("status") == "ok", F.col(text_col)))
    if config.mark_languages != "none":
        df = mark_russian(df, lexicons, config.mark_languages, config.paragraph_delimiter, id_col, text_col)
    df = df.withColumn(text_col, F.when(F.col("__dos"), C.dos_newlines(F.col(text_col))).otherwise(F.col(text_col)))
    return df.withColumn("changed", ~F.col(text_col).eqNullSafe(F.col(raw))).drop(raw, "__dos")


def _in_chunks(df: DataFrame, config: CleanConfig, lexicons: dict[str, DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The rewriting steps with giant texts as several rows, so that they are cleaned in parallel and
    no Arrow batch holds one whole. A word that is broken where two chunks meet stays broken."""
    n = config.chunk_chars
    giant = F.coalesce(F.length(text_col) > n, F.lit(False))
    whole = rewrite(df.filter(~giant), plan(config), lexicons, text_col)
    pieces = F.regexp_extract_all(text_col, F.lit(rf"(?s).{{1,{n}}}(?:\n|\z)|.{{1,{n}}}"), F.lit(0))
    parts = df.filter(giant).select(*(c for c in df.columns if c != text_col), F.posexplode(pieces).alias("__part", text_col))
    parts = rewrite(parts, plan(config), lexicons, text_col)
    others = [F.first(c).alias(c) for c in df.columns if c not in (id_col, text_col)]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__part", text_col))), lambda x: x[text_col]), "").alias(text_col)
    return whole.unionByName(parts.groupBy(id_col).agg(*others, joined))


def repeated_footers(df: DataFrame, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the footers of journal pages: lines that stand ``least`` times or more in a
    document when their page number is taken off, and lines of copyright or ISSN. Captions
    and tables of contents stay. A document's distinct lines are counted, then its text is
    filtered in place."""
    key = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^ *[0-9]+ {2,}| {2,}[0-9]+ *$", ""), " {8,}", "        "))
    lines = df.select(id_col, F.explode(F.split(text_col, "\n")).alias("line"))
    numbered = lines.filter(F.col("line").rlike(r"^ *[0-9]+ {2,}\S|\S {2,}[0-9]+ *$") & ~F.col("line").rlike(r"Таблиця|група|ЗМІСТ №|Рис\.|\.{6,}"))
    often = numbered.groupBy(id_col, key(F.col("line")).alias("k")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    heads = often.groupBy(id_col).agg(F.collect_set("k").alias("__heads"))
    out = df.join(heads, id_col, "left")
    keep = F.filter(F.split(text_col, "\n"), lambda x: ~x.rlike(r"^(?:[0-9]*\s{10,})?(?:© |ISSN [0-9])") & ~F.coalesce(F.array_contains("__heads", key(x)), F.lit(False)))
    return out.withColumn(text_col, F.array_join(keep, "\n")).select(*df.columns)


def native_clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All native steps of the plan, one projection each, for streams and quick passes."""
    return native(df, [C.orphan_cr, C.without_cr, *C.STEPS, C.mix_shortcuts, C.roman_numbers, C.lone_latin, C.dangling_numbers, C.letter_spacing], text_col)


def counters(before: Column, after: Column) -> dict[str, Column]:
    """Counts of a pass: mixes of letters and broken words before and after."""
    mix = F.lit(rf"[{UK}][a-zA-Z]|[a-zA-Z][{UK}]")
    wrap = F.lit(rf"[{UK}][-–‑¬][ \t]*\n")
    n = lambda c, p: F.size(F.regexp_extract_all(c, p, F.lit(0)))
    return {"mixes_fixed": n(before, mix) - n(after, mix), "wraps_fixed": n(before, wrap) - n(after, wrap)}
