"""Semantic tags of readings: lookups by lemma and part of speech with spelling
fallbacks, all as joins on the semantic lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed(lemma: Column, tags: Column, semtag: Column) -> Column:
    """Whether a semantic tag fits the reading (people, animals, places...)."""
    return (
        F.when(tags.contains("pron"), semtag.rlike(":deictic|:quantif"))
        .when(~tags.startswith("noun"), True)
        .when(tags.contains(":anim") & tags.contains("name"), semtag.rlike(":hum|:supernat"))
        .when(tags.contains(":anim"), semtag.rlike(":hum|:supernat|:animal|:org"))
        .when(tags.contains(":unanim"), semtag.contains(":animal"))
        .when(lemma.rlike("^[А-ЯІЇЄҐA-Z]") & tags.contains(":geo"), semtag.contains(":loc"))
        .otherwise(semtag.contains(":hum:group") | ~semtag.rlike(":hum|:supernat|:animal"))
    )


def _fallback(lemma: Column) -> Column:
    """The other spelling to try, of the first kind that applies; null if none does."""
    return (
        F.when(lemma.contains("ґ"), F.regexp_replace(lemma, "ґ", "г"))
        .when(lemma.contains("ія"), F.regexp_replace(lemma, "ія", "іа"))
        .when(lemma.contains("тер"), F.regexp_replace(lemma, "тер$", "тр"))
        .when(lemma.contains("льо"), F.regexp_replace(lemma, "льо", "ло"))
    )


def semantic_tags(readings: DataFrame, semtags: DataFrame, derivats: DataFrame) -> DataFrame:
    """Distinct ``(lemma, tags, semtags)`` of the readings that have semantic tags, joined by ``;``.

    ``semtags(lemma, pos, semtag, cond)``: ``cond`` is empty or a part the tag must hold.
    Adverbial participles are looked up by their verb (``derivats``).
    """
    r = readings.select("lemma", "tags").filter("lemma is not null and tags is not null").distinct()
    pos = F.split("tags", ":")[0]
    d = derivats.select(F.col("advp_lemma").alias("lemma"), "verb_lemma").dropDuplicates(["lemma"])
    r = r.join(d, "lemma", "left")
    advp = pos.startswith("advp")
    r = r.withColumns({"key": F.when(advp, F.col("verb_lemma")).otherwise(F.col("lemma")), "pos": F.when(advp, "verb").otherwise(pos)}).filter("key is not null")
    entries = semtags.withColumn("no", F.monotonically_increasing_id()).groupBy("lemma", "pos").agg(F.array_sort(F.collect_list(F.struct("no", F.coalesce("cond", F.lit("")).alias("cond"), "semtag"))).alias("e"))
    r = r.withColumn("other", _fallback(F.col("key")))
    r = r.join(entries.withColumnsRenamed({"lemma": "key", "e": "a"}), ["key", "pos"], "left")
    r = r.join(entries.withColumnsRenamed({"lemma": "other", "e": "b"}), ["other", "pos"], "left")
    fits = F.filter(F.coalesce("a", "b"), lambda e: ((e["cond"] == "") | F.col("tags").contains(e["cond"])) & allowed(F.col("key"), F.col("tags"), e["semtag"]))
    out = F.array_join(F.array_distinct(F.transform(fits, lambda e: e["semtag"])), ";")
    return r.withColumn("semtags", out).filter("semtags <> ''").select("lemma", "tags", "semtags")
