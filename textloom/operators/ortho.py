"""Older orthographies: spellings are tried against the lexicon in a fixed order and the
first that is known gives the readings. One join for all candidates of all words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.tag import readings_by_form

_C = "бвгґджзклмнпрстфхцчшщ"


def _r(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.regexp_replace(c, a, b)
    return c


# Fixed values: (pattern, replacement) of each attempt, in order. Attempts of the first
# table build on one another where the comment says so.
LESYA = [
    [("(?iu)йі", "ї"), ("(?iu)([іо])і$", "$1ї")],
    [("(?iu)(.)і", "$1и")],
    [("(?iu)^и", "і")],
    [("(?iu)рь$", "р")],
    [("(?iu)ійш", "іш")],
    [("(?iu)лько$", "льки")],
    [("(?iu)иї$", "ії")],
    [("(?iu)([яа][нр])е$", "$1и")],
    [("(?iu)ів$", "ей")],
    [("(?iu)([ндтч])\\1ів$", "$1ь")],
    [("(?iu)жу$", "джу")],
    [("(?iu)ови$", "ові")],
    [("(?iu)ов$", "ів")],
    [("(?iu)а$", "у")],
]
ZHELEH_BASE = [(f"(?iu)([{_C}])ї", "$1і"), ("(?iu)([сц])к", "$1ьк"), ("(?iu)ьсь$", "сь")]
ZHELEH = [
    [("ьованє", "ювання"), ("ованє", "ування"), ("ьова", "юва"), ("ова", "ува")],
    [("(?iu)йі", "ї")],
    [(f"(?iu)([{_C}])їй", "$1і")],
    [(f"(?iu)([{_C}])ї", "$1і")],
    [("пись$", "пис")],
    [("(?iu)([сц])к", "$1ьк")],
    [("н?нє$", "ння"), ("л?лє$", "лля"), ("т?тє$", "ття")],
    [("(?iu)ссь", "сь"), ("(?iu)зь(?=[кс])", "з")],
    [("(а)([нлт])([яю])", "$1$2$2$3")],
    [("(?iu)([бвпмфр])([юяє])", "$1'$2")],
    [("(?iu)([сцз])ь([бвпмф])([ія])", "$1$2$3")],
]


def candidates(word: Column, module: str) -> Column:
    """``array<struct<no, form>>`` of the spellings to try."""
    rules = LESYA if module == "lesya" else ZHELEH
    base = _r(word, *ZHELEH_BASE[:1]) if module == "zheleh" else word
    tries = [word]
    if module == "zheleh":
        tries.append(_r(word, *ZHELEH_BASE))
    for k, pairs in enumerate(rules):
        # from the fourth rule on, the second table reads і for ї after a consonant
        tries.append(_r(base if module == "zheleh" and k > 3 else word, *pairs))
    every = F.array(*(F.struct(F.lit(k).alias("no"), t.alias("form")) for k, t in enumerate(tries)))
    return F.filter(every, lambda x: (x["no"] == 0) | (x["form"] != word))


def retag(words: DataFrame, lexicon: DataFrame, module: str, extra: DataFrame | None = None) -> DataFrame:
    """``(value, readings)`` of the distinct words (``value``, ``next`` the word after) that an
    older spelling makes known. The value stays as written; with ``lesya`` every tag gets
    ``:alt``, and the last attempt counts for masculine genitives only. With ``zheleh`` a
    word before ся is tried as reflexive first, and ``extra(word, tags)`` lists old words.
    """
    w = words.select("value", "next").distinct() if "next" in words.columns else words.select("value", F.lit(None).cast("string").alias("next")).distinct()
    w = w.filter("value is not null").withColumn("low", F.lower("value"))
    c = w.select("value", "next", F.explode(candidates(F.col("low"), module)).alias("c")).select("value", "next", "c.no", "c.form")
    if module == "zheleh":
        sya = c.filter("next = 'ся'").select("value", "next", (F.col("no") - 100).alias("no"), F.concat("form", F.lit("ся")).alias("form"))
        c = c.unionByName(sya)
    got = c.join(readings_by_form(lexicon), "form")
    if module == "lesya":
        last = F.lit(len(LESYA))
        got = got.filter((F.col("no") < last) | F.exists("readings", lambda r: r["tags"].contains(":m:v_rod")))
        alt = F.transform("readings", lambda r: F.struct(r["lemma"].alias("lemma"), F.when(r["tags"].contains(":alt"), r["tags"]).otherwise(F.concat(r["tags"], F.lit(":alt"))).alias("tags")))
        got = got.withColumn("readings", F.when(F.col("no") > 0, alt).otherwise(F.col("readings")))
    best = got.groupBy("value", "next").agg(F.min_by("readings", F.col("no")).alias("readings"))
    if extra is not None:
        x = extra.groupBy(F.lower("word").alias("low")).agg(F.array_sort(F.collect_set("tags")).alias("tags"))
        old = w.join(best, ["value"], "left_anti").join(x, "low").select("value", "next", F.transform("tags", lambda t: F.struct(F.col("low").alias("lemma"), t.alias("tags"))).alias("readings"))
        best = best.unionByName(old)
    return best
