"""Marking of Russian paragraphs in Ukrainian text.

Words are weighed in both languages, weights are averaged for each paragraph by one
aggregation, and paragraphs that are more Russian are wrapped or cut. Paragraphs keep
their delimiters, so joining them gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.lexicon import with_known
from textloom.runtime import spread

WORD = r"[а-яіїєґёА-ЯІЇЄҐЁ'’ʼ́-]+"
#: Stands for the cut paragraph.
PLACEHOLDER = '<span lang="ru">---</span>'


def delimiter(text: Column, how: str = "auto") -> Column:
    """What parts paragraphs: a blank line if the text has any, else a line end."""
    if how != "auto":
        return F.lit("\n" if how == "single_nl" else "\n\n")
    return F.when(text.rlike(r"[^\s]\n\n+[^\s]"), "\n\n").otherwise("\n")


def _split(text: Column, how: str) -> Column:
    """Paragraphs without their delimiters; joined by the delimiter they give the text."""
    return F.when(delimiter(text, how) == "\n\n", F.split(text, "\n\n")).otherwise(F.split(text, "\n"))


def chunks(df: DataFrame, how: str = "auto", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, chunk)``: paragraphs by position."""
    return spread(df.select(id_col, text_col)).select(id_col, F.posexplode(_split(F.col(text_col), how)).alias("pos", "chunk"))


def words_of(chunk: Column) -> Column:
    """Cyrillic words, apostrophes around them stripped."""
    words = F.transform(F.regexp_extract_all(chunk, F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, "^['’ʼ]+|['’ʼ]+$", ""))
    return F.filter(words, lambda w: w.rlike("[а-яіїєґёА-ЯІЇЄҐЁ]"))


def rates(parts: DataFrame, lexicon_uk: DataFrame, lexicon_ru: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, pos, uk_rate, ru_rate)`` of the chunks that hold Cyrillic words."""
    words = parts.select(id_col, "pos", "chunk", words_of(F.col("chunk")).alias("w"))
    marks = {"has_ru": F.col("chunk").rlike("[ыэъё]"), "has_uk": F.col("chunk").rlike("[ієїґ]")}
    words = words.select(id_col, "pos", *(c.alias(k) for k, c in marks.items()), F.size("w").alias("n"), F.explode("w").alias("word"))
    # each distinct word is looked up once; the counts come back by an equi-join
    distinct = with_known(with_known(words.select("word").distinct(), "word", lexicon_uk).withColumnRenamed("known", "in_uk"), "word", lexicon_ru).withColumnRenamed("known", "in_ru")
    low = F.lower("word")
    # words that have substandard readings only weigh little
    weak = F.lit(False)
    if "tags" in lexicon_uk.columns:
        good = lexicon_uk.filter(~F.coalesce(F.col("tags").rlike(":(bad|subst)"), F.lit(False)))
        distinct = with_known(distinct, "word", good).withColumnRenamed("known", "good_uk")
        weak = ~F.col("good_uk")
    uk = F.when(low.rlike("[іїєґ'’ʼ]|^й$"), 10).when(F.col("in_uk"), F.when(weak, 2).otherwise(8)).otherwise(0)
    ru = F.when(uk == 10, 0).when(low.rlike("^[бвгдежзклмнпрстфхцчшщю]$"), 0).when(low.rlike("[ыэёъ]"), 10).when(F.col("in_ru"), 8).otherwise(0)
    weights = distinct.select("word", uk.alias("uk"), ru.alias("ru"))
    mean = lambda c: F.sum(c) / F.count("*") / 10
    got = words.join(weights, "word").groupBy(id_col, "pos", "has_ru", "has_uk", "n").agg(mean("uk").alias("uk_rate"), mean("ru").alias("ru_rate"), F.max(F.col("uk") == 10).alias("sure_uk"), F.max(F.col("ru") == 10).alias("sure_ru"))
    short = (F.col("n") < 10) & (~F.col("has_ru") | F.col("has_uk"))
    all_ru = F.col("sure_ru") & ~F.col("sure_uk") | (F.col("uk_rate") == 0) & (F.col("ru_rate") > 0.1)
    return got.select(id_col, "pos", F.when(short, 0.5).otherwise(F.col("uk_rate")).alias("uk_rate"), F.when(short, 0.1).when(all_ru, 1.0).otherwise(F.col("ru_rate")).alias("ru_rate"))


def russian_chunks(df: DataFrame, lexicons: dict[str, DataFrame], how: str = "auto", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, chunk, rate)`` of the paragraphs that are more Russian: what a cut
    writes to its side output."""
    parts = chunks(df, how, id_col, text_col)
    return parts.join(rates(parts, lexicons["uk"], lexicons["ru"], id_col), [id_col, "pos"]).filter("uk_rate < ru_rate").select(id_col, "pos", "chunk", F.round("ru_rate", 2).alias("rate"))


def mark_russian(df: DataFrame, lexicons: dict[str, DataFrame], mode: str = "mark", how: str = "auto", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with Russian paragraphs wrapped in a span (trailing white space outside) or
    replaced by a placeholder. Texts without any pass through unshuffled in content."""
    ru = russian_chunks(df, lexicons, how, id_col, text_col)
    span = F.concat(F.lit('<span lang="ru" rate="'), F.col("rate").cast("string"), F.lit('">'), F.regexp_replace("chunk", r"[\s]+$", ""), F.lit("</span>"), F.regexp_extract("chunk", r"[\s]+$", 0))
    new = ru.select(id_col, "pos", (span if mode == "mark" else F.lit(PLACEHOLDER)).alias("new"))
    found = new.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("__new"))
    out = df.join(found, id_col, "left")
    t = F.col(text_col)
    new = F.transform(_split(t, how), lambda c, i: F.coalesce(F.element_at("__new", i), c))
    joined = F.when(delimiter(t, how) == "\n\n", F.array_join(new, "\n\n")).otherwise(F.array_join(new, "\n"))
    return out.withColumn(text_col, F.when(F.col("__new").isNotNull(), joined).otherwise(t)).drop("__new").select(*df.columns)
