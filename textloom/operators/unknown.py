"""Guesses for words that the dictionary does not know, from statistics of endings.

Native: an equi-join on the ending, candidates weighted by count and context, ranked by
a window over the token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUFFIX = 4
# Titles before surnames, by gender.
MALE = "пан|містер|гер|сеньйор|монсеньйор|добродій|князь"
FEMALE = "пані|міс|місіс|княгиня|фрау|сеньора|сеньйоріта|мадам|маде?муазель|добродійка"


def suffix_statistics(lexicon: DataFrame) -> DataFrame:
    """``(suffix, add_del, postag, cnt)`` learned from a lexicon: for each form of a word the
    ending, what is taken off and put on for its lemma, and the tag."""
    x = lexicon.filter("form is not null and lemma is not null and tags is not null").filter(F.length("form") >= SUFFIX + 2).distinct()
    n = F.when(F.col("form").endswith("ться"), SUFFIX + 2).otherwise(SUFFIX)
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("form"), F.length("lemma"))), lambda k: F.substring("form", F.lit(1), k) == F.substring("lemma", F.lit(1), k)))
    x = x.select(F.right("form", n).alias("suffix"), F.concat(F.expr("substring(lemma, 1 + size(filter(sequence(1, least(length(form), length(lemma))), k -> substring(form, 1, k) = substring(lemma, 1, k))))"), F.lit("/"), (F.length("form") - same).cast("string")).alias("add_del"), F.col("tags").alias("postag"))
    return x.groupBy("suffix", "add_del", "postag").agg(F.count("*").cast("int").alias("cnt"))


def guess(tokens: DataFrame, suffix_stats: DataFrame, key: list[str]) -> DataFrame:
    """``(key..., value, rank, lemma, tags, confidence)`` of the guesses.

    ``tokens``: ``key``, ``value``, ``first`` (first of its sentence) and, of the token
    before, ``left_lemma`` and ``left_tags`` (null at the start).
    """
    v = F.col("value")
    numbered = v.rlike("^[А-ЯІЇЄҐ]+-[0-9]+[а-яіїєґА-ЯІЇЄҐ]*$")
    capitals = v.rlike("^[А-ЯІЇЄҐ]{2,6}$")
    short = tokens.filter(numbered | capitals).select(*key, "value", F.lit(1).alias("rank"), v.alias("lemma"), F.when(numbered, "noninfl").otherwise("noninfl:abbr").alias("tags"), F.lit(-0.7).alias("confidence"))
    rest = tokens.filter(~(numbered | capitals))
    prefixed = r"^([А-ЯІЇЄҐA-Z0-9]+[-–])([а-яіїєґ].*)$"
    rest = rest.withColumns({"__pre": F.regexp_extract("value", prefixed, 1), "__w": F.when(v.rlike(prefixed), F.regexp_extract("value", prefixed, 2)).otherwise(v)})
    n = F.when(F.col("__w").endswith("ться"), SUFFIX + 2).otherwise(SUFFIX)
    rest = rest.withColumn("suffix", F.right("__w", n)).filter(F.length("__w") >= n + 2)
    j = rest.join(suffix_stats, "suffix")
    j = j.withColumns({"__add": F.substring_index("add_del", "/", 1), "__del": F.substring_index("add_del", "/", -1).cast("int")})
    proper = F.col("postag").contains("prop")
    gender = F.regexp_extract("postag", ":([mf]):", 1)
    title = F.when(gender == "m", F.col("left_lemma").rlike(f"^(?:{MALE})$")).when(gender == "f", F.col("left_lemma").rlike(f"^(?:{FEMALE})$"))
    with_name = F.col("left_tags").contains("fname") & (F.regexp_extract("left_tags", ":([mf]):", 1) == gender) & (gender != "")
    weight = (
        F.when(proper & ~F.col("__w").rlike("^[А-ЯІЇЄҐA-Z]"), 0)
        .when(proper & ~F.col("first") & F.col("postag").contains("lname") & (F.coalesce(title, F.lit(False)) | F.coalesce(with_name, F.lit(False))), F.col("cnt") * 10000)
        .when(proper & ~F.col("first"), F.col("cnt") * 100)
        .when(proper & F.col("__w").rlike("[а-яіїєґ]-[А-ЯІЇЄҐ][а-яіїєґ']"), F.col("cnt") * 100)
        .otherwise(F.col("cnt"))
    )
    j = j.withColumn("__weight", weight).filter((F.col("__weight") > 0) & (F.length("__w") >= F.col("__del") + 2))
    lemma = F.concat(F.expr("substring(__w, 1, length(__w) - __del)"), F.col("__add"))
    lemma = F.concat("__pre", F.when(F.col("postag").contains(":prop"), lemma).otherwise(F.lower(lemma)))
    w = W.partitionBy(*key)
    out = j.select(*key, "value", F.row_number().over(w.orderBy(F.desc("__weight"), "postag", "add_del")).alias("rank"), lemma.alias("lemma"), F.col("postag").alias("tags"), F.when(F.count("*").over(w) > 1, -0.5).otherwise(-0.6).alias("confidence"))
    return short.unionByName(out)
