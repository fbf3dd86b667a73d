"""Corpus statistics of tagged tokens. All are partial and final hash aggregations.

``tagged``: one row for each token, with ``value``, ``clean`` (the token cleaned) and
``readings array<struct<lemma, tags>>`` in order. Null readings count as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CYRILLIC = "[а-яіїєґА-ЯІЇЄҐ]"


def first_tag() -> Column:
    return F.col("readings")[0]["tags"]


def _capital_lemma() -> Column:
    return F.exists("readings", lambda r: r["lemma"].rlike("^[А-ЯІЇЄҐA-Z]"))


def counts_by_class(tagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tokens by what their first reading says: known (a Cyrillic letter and a tag),
    unknown, unclass."""
    tag = first_tag()
    return tagged.groupBy(*(by or [])).agg(
        F.count_if(tag == "unknown").alias("unknown"),
        F.count_if(tag == "unclass").alias("unclass"),
        F.count_if(~tag.isin("unknown", "unclass") & F.col("value").rlike(CYRILLIC)).alias("known"),
    )


def unknown_words(tagged: DataFrame, lexicon_ru: DataFrame | None = None) -> DataFrame:
    """``(value, n)`` of the unknown words, without those that Russian knows (anti join)."""
    out = tagged.filter(first_tag() == "unknown").groupBy("value").agg(F.count("*").alias("n"))
    if lexicon_ru is not None:
        ru = lexicon_ru.filter("form is not null").select(F.lower("form").alias("__low")).distinct()
        out = out.withColumn("__low", F.lower("value")).join(ru, "__low", "left_anti").drop("__low")
    return out


def unknown_report(tagged: DataFrame) -> DataFrame:
    """One row: totals and percentages of unknown words, all and distinct."""
    tag = first_tag()
    per = tagged.filter(F.col("value").rlike(CYRILLIC)).groupBy("value").agg(F.count_if(tag == "unknown").alias("bad"), F.count("*").alias("n"))
    pct = lambda a, b: F.round(F.coalesce(100 * a / F.nullif(b, F.lit(0)), F.lit(0.0)), 2)
    letters = F.col("value").rlike(f"^[а-яіїєґА-ЯІЇЄҐ'’ʼ]+$")
    out = per.agg(F.sum("n").alias("total"), F.sum("bad").alias("bad"), F.count("*").alias("distinct"), F.count_if(F.col("bad") > 0).alias("bad_distinct"), F.count_if((F.col("bad") > 0) & letters).alias("bad_letters"), F.count_if(letters).alias("letters"))
    out = out.fillna(0)
    return out.select("total", "bad", pct(F.col("bad"), F.col("total")).alias("pct"), "distinct", "bad_distinct", pct(F.col("bad_distinct"), F.col("distinct")).alias("distinct_pct"), pct(F.col("bad_letters"), F.col("letters")).alias("letters_pct"))


def unknown_rate_by_document(tagged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, per_mille, known)``: unknown words in thousandths, 0 for documents without words."""
    c = counts_by_class(tagged, [id_col])
    return c.select(id_col, F.coalesce(F.floor(F.col("unknown") * 1000 / F.nullif(F.col("known") + F.col("unknown"), F.lit(0))), F.lit(0)).cast("bigint").alias("per_mille"), "known")


def unclass_report(tagged: DataFrame) -> DataFrame:
    return tagged.filter(first_tag() == "unclass").groupBy("value").agg(F.count("*").alias("n"))


def word_frequency(tagged: DataFrame) -> DataFrame:
    """``(word, n)`` of tagged Cyrillic words, in small letters unless a lemma is capitalised."""
    good = tagged.filter(F.col("clean").rlike(CYRILLIC) & (first_tag() != "") & ~first_tag().isin("unclass"))
    return good.groupBy(F.when(_capital_lemma(), F.col("clean")).otherwise(F.lower("clean")).alias("word")).agg(F.count("*").alias("n"))


def lemma_frequency(tagged: DataFrame) -> DataFrame:
    """``(lemma, n, ambiguous, pos)``. Every distinct lemma of a token counts once, so an
    ambiguous token counts several times."""
    r = tagged.filter(F.col("value").rlike(CYRILLIC)).select(F.filter("readings", lambda x: x["tags"].isNotNull() & ~x["tags"].isin("unknown", "unclass") & (x["lemma"] != "")).alias("r"))
    r = r.withColumn("lemmas", F.array_distinct(F.transform("r", lambda x: x["lemma"])))
    one = r.select(F.explode("lemmas").alias("lemma"), (F.size("lemmas") > 1).alias("amb"), "r").select("lemma", "amb", F.array_distinct(F.transform(F.filter("r", lambda x: x["lemma"] == F.col("lemma")), lambda x: F.split(x["tags"], ":")[0])).alias("pos"))
    return one.groupBy("lemma").agg(F.count("*").alias("n"), F.max("amb").alias("ambiguous"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pos")))), ",").alias("pos"))


def homonyms(tagged: DataFrame) -> DataFrame:
    """``(homonym, n, words, readings, heads)`` of tokens with several readings."""
    t = tagged.withColumn("r", F.filter("readings", lambda x: x["tags"].isNotNull() & (x["lemma"] != ""))).filter(F.size("r") > 1)
    each = F.transform("r", lambda x: F.concat_ws("/", x["lemma"], x["tags"]))
    heads = F.array_distinct(F.transform("r", lambda x: F.concat_ws("/", x["lemma"], F.split(x["tags"], ":")[0])))
    word = F.when(_capital_lemma(), F.col("value")).otherwise(F.lower("value"))
    return t.groupBy(F.array_join(each, "|").alias("homonym")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(word)), ",").alias("words"), F.first(F.size("r")).alias("readings"), F.first(F.size(heads)).alias("heads"))


def merge(parts: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Counts of several runs as one: sums by key."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def grammar_rating(matches: DataFrame, words: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, rating, rules)``: matches for a hundred words, two decimals, and distinct
    rules of each document; ``words`` has the number of words of each."""
    m = matches.groupBy(id_col).agg(F.count("*").alias("m"), F.countDistinct("rule_id").alias("rules"))
    return words.join(m, id_col, "left").select(id_col, F.coalesce(F.round(F.col("m") * 10000 / F.nullif(F.col("n_words"), F.lit(0))) / 100, F.lit(0.0)).alias("rating"), F.coalesce("rules", F.lit(0)).alias("rules"))
