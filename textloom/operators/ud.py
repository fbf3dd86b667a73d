"""Conversion of tags to Universal Dependencies: UPOS, FEATS and MISC as Columns.

The map of tag parts is a table (``ud_map(part, ud)``) of about a hundred rows; it
is read into a map literal. An unknown part gives ``_`` and is listed, nothing stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP_ROWS = 1000
LEFT_OUT = "^(xp[0-9]|pron|predic|insert)$"


def ud_map(table: DataFrame) -> Column:
    """The table as a map; of rows of one part the last in order of ``ud`` wins, ``numr`` is always a
    part of speech. A table of more than ``MAP_ROWS`` rows is an error."""
    rows = table.filter("part is not null and part <> ''").orderBy("part", "ud").limit(MAP_ROWS + 1).collect()
    if len(rows) > MAP_ROWS:
        raise ValueError(f"a map of more than {MAP_ROWS} tag parts")
    m = {r["part"].replace("v_zna:", ""): r["ud"] for r in rows if r["part"] != "numr" or r["ud"].startswith("Upos")}
    return F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) if m else F.create_map().cast("map<string,string>")


def tag_parts(tags: Column) -> Column:
    """Parts of a tag, compound heads in one piece, paradigm and class marks left out."""
    t = F.replace(F.replace(tags, F.lit("conj:"), F.lit("conj+")), F.lit("noninfl:predic"), F.lit("noninfl+predic"))
    return F.filter(F.split(t, ":"), lambda p: ~p.rlike(LEFT_OUT))


def _mapped(tags: Column, m: Column) -> tuple[Column, Column]:
    """UPOS entry of the head and mapped features of all parts."""
    parts = tag_parts(tags)
    head = F.element_at(m, F.replace(parts[0], F.lit("+"), F.lit(":")))
    head_parts = F.split(head, "; ")
    rest = F.transform(F.slice(parts, 2, 100), lambda p: F.element_at(m, F.when(p == "obsc", "vulg").otherwise(p)))
    rest = F.transform(rest, lambda u: F.regexp_replace(u, "Gender=(Masc|Fem|Neut)", "$0; Number=Sing"))
    rest = F.filter(rest, lambda u: u.isNotNull() & (u != "-"))
    return head_parts[0], F.concat(rest, F.coalesce(F.slice(head_parts, 2, 100), F.array().cast("array<string>")))


def upos(tags: Column, m: Column) -> Column:
    head, feats = _mapped(tags, m)
    pos = F.regexp_replace(head, "^Upos=", "")
    return F.when(F.array_contains(feats, "Upos=PROPN"), "PROPN").when((pos == "NOUN") & F.array_contains(feats, "PronType=Prs"), "PRON").otherwise(F.coalesce(pos, F.lit("_")))


def feature_list(tags: Column, lemma: Column, m: Column, negatives: Column, gender: Column | None = None) -> Column:
    """Distinct features in order of their names without regard to case."""
    _, feats = _mapped(tags, m)
    feats = F.filter(feats, lambda u: u != "Upos=PROPN")
    more = F.array(F.when(F.array_contains(negatives, lemma), "Polarity=Neg"), F.when(tags.rlike("^verb(?!.*(?::inf|:impers))"), "VerbForm=Fin"), gender if gender is not None else F.lit(None).cast("string"))
    all_ = F.flatten(F.transform(F.concat(feats, F.array_compact(more)), lambda u: F.split(F.trim(u), r"; |\|")))
    all_ = F.array_distinct(F.transform(all_, F.trim))
    all_ = F.filter(all_, lambda u: (u != "VerbForm=Fin") | tags.startswith("verb"))
    return F.transform(F.array_sort(F.transform(all_, lambda u: F.struct(F.lower(u).alias("k"), u.alias("u")))), lambda x: x["u"])


def feats(features: Column, tags: Column) -> Column:
    s = F.array_join(F.filter(features, lambda u: u != "Uninflect=Yes"), "|")
    s = F.when(tags.startswith("noun"), F.replace(s, F.lit("NumType=Ord"), F.lit("NumType=Card"))).otherwise(s)
    return F.when(s == "", "_").otherwise(s)


def misc(features: Column, semtags: Column, space_after: Column, level: Column, confidence: Column) -> Column:
    every = F.array(
        F.when(F.array_contains(features, "Uninflect=Yes"), "Uninflect=Yes"),
        F.when(semtags.isNotNull(), F.concat(F.lit("SemTags="), semtags)),
        F.when(~space_after, "SpaceAfter=No"),
        F.when(level.isNotNull(), F.concat(F.lit("TagLevel="), level)),
        F.when(confidence.isNotNull(), F.concat(F.lit("TagConfidence="), confidence.cast("string"))),
    )
    s = F.array_join(F.array_compact(every), "|")
    return F.when(s == "", "_").otherwise(s)


def plural_genders(lexicon: DataFrame) -> DataFrame:
    """``(lemma, pos_key, gender)``: gender of a plural noun or adjective, from the
    nominative singular of its lemma; masculine before feminine before neuter."""
    one = lexicon.filter(F.col("tags").rlike("^(noun|adj).*:[mfn]:v_naz")).select("lemma", F.regexp_extract("tags", "^(noun(?::(?:un|in)?anim)?|adj)", 1).alias("pos_key"), F.regexp_extract("tags", ":([mfn]):v_naz", 1).alias("g"))
    rank = F.when(F.col("g") == "m", 1).when(F.col("g") == "f", 2).otherwise(3)
    return one.groupBy("lemma", "pos_key").agg(F.min(rank).alias("r")).select("lemma", "pos_key", F.when(F.col("r") == 1, "Gender=Masc").when(F.col("r") == 2, "Gender=Fem").otherwise("Gender=Neut").alias("gender"))


def convert(tagged: DataFrame, table: DataFrame, negatives: list[str], lexicon: DataFrame | None = None) -> DataFrame:
    """``tagged`` (first readings count) with ``lemma, tags, upos, feats, misc``."""
    m, neg = ud_map(table), F.array(*(F.lit(x) for x in negatives)) if negatives else F.array().cast("array<string>")
    t = tagged.withColumns({"lemma": F.col("readings")[0]["lemma"], "tags": F.col("readings")[0]["tags"]})
    gender = None
    if lexicon is not None:
        plural = F.col("tags").rlike("^(noun|adj).*:p:v_") & ~(F.col("lemma").startswith("пів") & F.col("tags").contains("nv:up92"))
        t = t.withColumn("pos_key", F.regexp_extract("tags", "^(noun(?::(?:un|in)?anim)?|adj)", 1)).join(plural_genders(lexicon), ["lemma", "pos_key"], "left")
        gender = F.when(plural, F.col("gender"))
    get = lambda c: F.col(c) if c in t.columns else F.lit(None).cast("string")
    t = t.withColumn("__f", feature_list(F.col("tags"), F.col("lemma"), m, neg, gender))
    space = F.col("space_after") if "space_after" in t.columns else F.lit(None).cast("boolean")
    out = t.withColumns({"upos": upos(F.col("tags"), m), "feats": feats(F.col("__f"), F.col("tags")), "misc": misc(F.col("__f"), get("semtags"), space, get("level"), get("confidence"))})
    return out.drop("__f", "pos_key", "gender")
