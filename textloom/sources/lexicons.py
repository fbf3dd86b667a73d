"""Lexicon and statistics files as tables. All are read line by line, natively."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of one file, in order. The line number comes from splitting the
    whole text, so it does not depend on how Spark splits the file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).filter("line <> ''")


def _blocks(spark: SparkSession, path: str, between: str) -> DataFrame:
    """``(block)``: the non-empty pieces of a file between the matches of a pattern."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.split("value", between)).alias("block")).filter("block <> ''")


def word_statistics(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``word_stats(word, lemma, postag, rate)`` and ``word_ctx_stats`` of a file of head
    lines and context lines that begin with a tab. The first line names the version; another
    than ``version`` is an error."""
    if version is not None:
        head = _numbered(spark, path).filter("line_no = 0").first()
        found = head.line.removeprefix("# version: ").strip() if head and head.line.startswith("# version: ") else ""
        if found != version:
            raise ValueError(f"statistics of version {found!r}, not {version!r}")
    # a head line and the indented lines after it are one block, so no order of lines is needed
    blocks = _blocks(spark, path, r"\r?\n(?![\t\r\n])").filter("not block like '#%'")
    parts = lambda x: F.split(F.regexp_replace(x, r"^\h+|\h+$", ""), r"\h+")
    blocks = blocks.select(F.split("block", "\r?\n").alias("lines")).select(parts(F.col("lines")[0]).alias("h"), F.filter(F.slice("lines", 2, 2**30), lambda x: x != "").alias("rest"))
    words = blocks.select(F.col("h")[0].alias("word"), F.col("h")[1].alias("lemma"), F.col("h")[2].alias("postag"), F.col("h")[3].cast("double").alias("rate"))
    filled = blocks.select("h", F.explode("rest").alias("line")).select("h", parts(F.col("line")).alias("p"))
    ctx = filled.select(*(F.col("h")[k].alias(n) for k, n in enumerate(("word", "lemma", "postag"))), F.col("p")[0].cast("int").alias("offset"), F.col("p")[1].alias("ctx_word"), F.regexp_replace(F.col("p")[2], r"^\^$", "").alias("ctx_lemma"), F.col("p")[3].alias("ctx_postag"), F.col("p")[4].cast("double").alias("cnt"))
    return words, ctx


def suffix_statistics(spark: SparkSession, path: str) -> DataFrame:
    """``(suffix, add_del, postag, cnt)`` of a file of four fields."""
    p = _numbered(spark, path).filter("not line like '#%'").select(F.split(F.regexp_replace("line", r"^\h+|\h+$", ""), r"\h+").alias("p"))
    return p.filter(F.size("p") >= 4).select(F.col("p")[0].alias("suffix"), F.col("p")[1].alias("add_del"), F.col("p")[2].alias("postag"), F.col("p")[3].cast("int").alias("cnt"))


def semantic_tags(spark: SparkSession, path: str, pos: str) -> DataFrame:
    """``(lemma, pos, semtag, cond)`` of a CSV file of one part of speech; comments, a byte
    order mark and repeated lines are left out, a third field counts if it begins with a colon."""
    p = _numbered(spark, path).select(F.split(F.trim(F.regexp_replace(F.regexp_replace("line", "^﻿", ""), r"\s*#.*", "")), ",").alias("p")).filter(F.size("p") >= 2)
    third = F.trim(F.get("p", F.lit(2)))
    return p.select(F.col("p")[0].alias("lemma"), F.lit(pos).alias("pos"), F.col("p")[1].alias("semtag"), F.when(third.startswith(":"), third).otherwise("").alias("cond")).distinct()


def derivations(spark: SparkSession, path: str) -> DataFrame:
    """``(advp_lemma, verb_lemma)``."""
    return _numbered(spark, path).select(F.split(F.regexp_replace("line", r"^\h+|\h+$", ""), r"\h+").alias("p")).select(F.col("p")[0].alias("advp_lemma"), F.col("p")[1].alias("verb_lemma"))


def ud_map(spark: SparkSession, path: str) -> DataFrame:
    """``(part, ud)`` of a CSV file with a head line: the first column is the feature, the
    second the part of the tag."""
    x = spark.read.option("header", True).csv(path)
    feature, part = x.columns[:2]
    return x.select(F.trim(F.col(f"`{part}`")).alias("part"), F.trim(F.col(f"`{feature}`")).alias("ud")).filter("part is not null and part <> ''")


def stress_table(spark: SparkSession, path: str) -> DataFrame:
    """``(lemma, tag_key, form, base, offset)``: a line without indent begins a lemma, indented
    lines are its forms, ``/n/`` moves the accent of all forms by n vowels."""
    from textloom.operators.stress import accents, strip_accent, tag_key

    # an entry and its indented lines are one block
    clean = F.filter(F.transform(F.split("block", "\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s*#.*", ""), r"^\s+|\s+$", "")), lambda x: x != "")
    x = _blocks(spark, path, r"\r?\n(?![ /\r\n#])").select(clean.alias("lines")).filter(F.size("lines") > 0)
    x = x.select(F.split(F.col("lines")[0], " ").alias("h"), F.explode("lines").alias("t"))
    move = F.regexp_extract("t", "^/(-?[0-9]+)/$", 1)
    x = x.withColumns({"p": F.split("t", " "), "move": F.when(move != "", move.cast("int"))})
    full = F.col("h")[0]
    return x.select(strip_accent(full).alias("lemma"), tag_key(F.col("h")[1]).alias("tag_key"), F.when(F.col("move").isNull(), F.col("p")[0]).otherwise(full).alias("form"), F.when(F.col("move").isNotNull(), 1).otherwise(0).alias("base"), F.coalesce("move", F.lit(0)).alias("offset"))
