"""Tagging: dictionary readings joined to tokens, classes for the rest, and the shapes
in which readings are handed on.

The lexicon is grouped by form first, so the join brings all readings of a token at
once and no regrouping of tokens is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import tokenize as T
from textloom.functions.classify import token_class
from textloom.functions.normalize import known_form

READING = "array<struct<lemma:string,tags:string>>"


def explode_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_line: bool = False) -> DataFrame:
    """``(doc_id, para_id, sent_id, tok_id, value, clean, whitespace_before)`` of all
    documents, without a shuffle. Ordinals count from 0."""
    p = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.paragraphs(F.col(text_col))).alias("para_id", "para"))
    parts = T.lines(F.col("para")) if per_line else T.sentences(F.col("para"))
    s = p.select("doc_id", "para_id", F.posexplode(parts).alias("sent_id", "sent"))
    all_ = F.regexp_extract_all("sent", F.lit(rf"{T.SPACE}*(?:{T.TOKEN})"), F.lit(0))
    t = s.select("doc_id", "para_id", "sent_id", F.posexplode(all_).alias("tok_id", "raw"))
    value = F.regexp_replace("raw", rf"^{T.SPACE}+", "")
    return t.select("doc_id", "para_id", "sent_id", "tok_id", value.alias("value"), known_form(value).alias("clean"), (F.length("raw") > F.length(value)).alias("whitespace_before"))


def usable(readings: Column) -> Column:
    """Readings with a tag that is no sentence end and no multi-word mark."""
    return F.filter(readings, lambda r: r["tags"].isNotNull() & (r["tags"] != "") & ~r["tags"].endswith("_END") & ~r["tags"].startswith("<"))


def readings_by_form(lexicon: DataFrame) -> DataFrame:
    """``(form, readings)``: distinct usable readings of each form, by tag and lemma; a
    reading without a lemma takes the form as lemma."""
    x = lexicon.filter("form is not null").select(known_form(F.col("form")).alias("form"), F.coalesce("lemma", "form").alias("lemma"), "tags").distinct()
    x = x.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("lemma", "tags"))).alias("readings"))
    return x.withColumn("readings", usable(F.col("readings"))).filter(F.size("readings") > 0)


def tag(tokens: DataFrame, lexicon: DataFrame, single: bool = False, lemma_for_unknown: bool = False, split_parts: bool = False) -> DataFrame:
    """``tokens`` with ``readings``: those of the lexicon, of the form as it is or in small
    letters, else one reading with the token's class. ``split_parts`` makes particles
    (сідай-но) tokens of their own; unknown words have an empty lemma unless asked."""
    if split_parts:
        tokens = split_particles(tokens)
    # one join for both letter cases: the forms that differ in case only stand together
    by_low = readings_by_form(lexicon).groupBy(F.lower("form").alias("__low")).agg(F.collect_list(F.struct("form", "readings")).alias("__v"))
    clean = known_form(F.coalesce("clean", "value"))
    t = tokens.withColumns({"__f": clean, "__low": F.lower(clean)}).join(by_low, "__low", "left")
    of = lambda form: F.get(F.filter("__v", lambda x: x["form"] == F.col(form)), F.lit(0))["readings"]
    t = t.withColumns({"__a": of("__f"), "__b": of("__low")}).drop("__v")
    kind = token_class(F.col("value"))
    lemma = F.when((kind == "unknown") & F.lit(not lemma_for_unknown), "").otherwise(F.coalesce("clean", "value"))
    fallback = F.when(kind.isNotNull(), F.array(F.struct(lemma.alias("lemma"), kind.alias("tags"))))
    found = F.when(F.col("value") == "—", fallback).otherwise(F.coalesce("__a", "__b", fallback))
    if split_parts:
        part = F.array(F.struct(F.regexp_replace("value", "^-", "").alias("lemma"), F.lit("part").alias("tags")))
        found = F.when(F.col("is_part"), part).otherwise(found)
    t = t.withColumn("readings", F.slice(found, 1, 1) if single else found)
    return t.drop("__f", "__low", "__a", "__b")


def split_particles(tokens: DataFrame) -> DataFrame:
    """Particles as tokens of their own, with ``part_no`` and ``is_part``."""
    pieces = F.coalesce(T.split_particle(F.col("value")), F.array("value"))
    t = tokens.select("*", F.size(pieces).alias("__k"), F.posexplode_outer(pieces).alias("part_no", "__v"))
    t = t.withColumns({"value": F.coalesce("__v", "value"), "is_part": F.coalesce(F.col("part_no") > 0, F.lit(False))})
    return t.withColumns({"clean": F.when(F.col("__k") > 1, F.col("value")).otherwise(F.col("clean")), "whitespace_before": F.col("whitespace_before") & ~F.col("is_part")}).drop("__v", "__k")


def token_shape(readings: Column) -> Column:
    """First reading with the others as alternatives."""
    return F.struct(readings[0].alias("token"), F.slice(readings, 2, 10_000).alias("alts"))


def sentences(tagged: DataFrame, paragraph_marks: bool = False) -> DataFrame:
    """``(doc_id, para_id, sent_id, tokens)``, tokens in order; with ``paragraph_marks`` an
    empty sentence after each paragraph. A sentence is a bounded group."""
    keys = ["doc_id", "para_id", "sent_id"]
    order = ["tok_id", "part_no"] if "part_no" in tagged.columns else ["tok_id"]
    rest = [c for c in ("value", "clean", "whitespace_before", "readings", "semtags", "level", "guessed", "confidence") if c in tagged.columns]
    s = tagged.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*rest).alias("t")))), lambda x: x["t"]).alias("tokens"))
    if paragraph_marks:
        marks = s.groupBy("doc_id", "para_id").agg((F.max("sent_id") + 1).alias("sent_id"))
        s = s.unionByName(marks.withColumn("tokens", F.lit(None).cast(s.schema["tokens"].dataType)))
    return s


def neighbours(tagged: DataFrame) -> DataFrame:
    """Token, the one before and the one after it in the sentence; __BEG and __END at the
    ends. The last token of a sentence never serves as right context, so the last two have
    __END."""
    w = W.partitionBy("doc_id", "para_id", "sent_id").orderBy("tok_id")
    n = F.count("*").over(W.partitionBy("doc_id", "para_id", "sent_id"))
    k = F.row_number().over(w)
    return tagged.select("doc_id", "para_id", "sent_id", "tok_id", "value", F.coalesce(F.lag("value").over(w), F.lit("__BEG")).alias("left"), F.when(k < n - 1, F.lead("value").over(w)).otherwise("__END").alias("right"))


def space_after(tagged: DataFrame) -> DataFrame:
    """Whether white space follows the token; null for the last of a sentence."""
    w = W.partitionBy("doc_id", "para_id", "sent_id").orderBy("tok_id")
    return tagged.withColumn("space_after", F.lead("whitespace_before").over(w))
