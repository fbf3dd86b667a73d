"""Whole runs from documents to output, under the option classes of ``config``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.config import TagConfig, TokenizeConfig
from textloom.functions.clean import CONTROL
from textloom.operators import disambig, ortho, semtags, stats, tag, ud, unknown
from textloom.sources import sinks

TOKEN_KEY = ["doc_id", "para_id", "sent_id", "tok_id"]


@dataclass(frozen=True)
class Tables:
    """The lexicon and statistics tables of a tagging run; all but the lexicon may be null."""

    lexicon: DataFrame
    word_stats: DataFrame | None = None
    word_ctx_stats: DataFrame | None = None
    suffix_stats: DataFrame | None = None
    semtags: DataFrame | None = None
    derivats: DataFrame | None = None
    ud_map: DataFrame | None = None
    extra_words: DataFrame | None = None
    negatives: tuple[str, ...] = ()


def tag_tokens(docs: DataFrame, tables: Tables, config: TagConfig = TagConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tagged tokens of the documents: readings, ``level`` (stats for guesses) and
    ``confidence`` of guesses as the options say."""
    c = config.adjusted()
    if c.strip_control:
        docs = docs.withColumn(text_col, F.regexp_replace(text_col, CONTROL, ""))
    t = tag.explode_tokens(docs, id_col, text_col, c.sentence_per_line)
    t = tag.tag(t, tables.lexicon, lemma_for_unknown=c.set_lemma_for_unknown, split_parts=c.split_hyphen_parts)
    for module in sorted(c.modules):
        t = _older(t, tables, module)
    t = t.withColumns({"level": F.lit(None).cast("string"), "confidence": F.lit(None).cast("decimal(6,3)")})
    if c.tag_unknown and tables.suffix_stats is not None:
        t = _guessed(t, tables, c)
    if c.semantic_tags and tables.semtags is not None:
        t = _with_semtags(t, tables)
    if c.single_token_only and not c.disambiguate:
        t = t.withColumn("readings", F.slice("readings", 1, 1))
    return t


def _older(t: DataFrame, tables: Tables, module: str) -> DataFrame:
    """Readings of words that an older spelling makes known."""
    w = W.partitionBy("doc_id", "para_id", "sent_id").orderBy("tok_id")
    t = t.withColumn("next", F.lead("value").over(w))
    strange = F.col("readings")[0]["tags"] == "unknown"
    ask = t.filter(strange | (F.col("next") == "ся")).select("value", F.when(F.col("next") == "ся", "ся").alias("next"))
    known = ortho.retag(ask, tables.lexicon, module, tables.extra_words if module == "zheleh" else None).withColumnRenamed("readings", "__r")
    t = t.withColumn("__n", F.when(F.col("next") == "ся", "ся"))
    t = t.join(known.withColumnsRenamed({"next": "__n2", "value": "__v"}), (F.col("value") == F.col("__v")) & F.col("__n").eqNullSafe(F.col("__n2")), "left")
    return t.withColumn("readings", F.when(strange | F.col("__n").isNotNull(), F.coalesce("__r", "readings")).otherwise(F.col("readings"))).drop("next", "__n", "__n2", "__v", "__r")


def _guessed(t: DataFrame, tables: Tables, c: TagConfig) -> DataFrame:
    """Guesses in place of unknown readings, best first."""
    key = [*TOKEN_KEY, "part_no"] if "part_no" in t.columns else TOKEN_KEY
    w = W.partitionBy("doc_id", "para_id", "sent_id").orderBy(*key[3:])
    ctx = t.select(*key, "value", (F.row_number().over(w) == 1).alias("first"), F.lag(F.col("readings")[0]["lemma"]).over(w).alias("left_lemma"), F.lag(F.col("readings")[0]["tags"]).over(w).alias("left_tags"), (F.col("readings")[0]["tags"] == "unknown").alias("ask"))
    g = unknown.guess(ctx.filter("ask").drop("ask"), tables.suffix_stats, key)
    g = g.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", F.struct("lemma", "tags").alias("r"), "confidence"))).alias("__g"))
    t = t.join(g, key, "left")
    has = F.col("__g").isNotNull()
    return t.withColumns(
        {
            "readings": F.when(has, F.transform("__g", lambda x: x["r"])).otherwise(F.col("readings")),
            "level": F.when(has & F.lit(c.show_level), "stats"),
            "guessed": has,
            "confidence": F.when(has & F.lit(c.unknown_rate), F.col("__g")[0]["confidence"].cast("decimal(6,3)")),
        }
    ).drop("__g")


def _with_semtags(t: DataFrame, tables: Tables) -> DataFrame:
    """Semantic tags of the first reading."""
    first = t.select(F.col("readings")[0]["lemma"].alias("lemma"), F.col("readings")[0]["tags"].alias("tags"))
    empty = t.sparkSession.createDataFrame([], "advp_lemma string, verb_lemma string")
    s = semtags.semantic_tags(first, tables.semtags, tables.derivats if tables.derivats is not None else empty)
    return t.withColumns({"lemma": F.col("readings")[0]["lemma"], "tags": F.col("readings")[0]["tags"]}).join(s, ["lemma", "tags"], "left").drop("lemma", "tags")


def tag_sentences(docs: DataFrame, tables: Tables, config: TagConfig = TagConfig(), **columns: str) -> DataFrame:
    """Sentences of tagged tokens; with ``disambiguate`` readings are ranked (with context
    where there are context statistics) and cut to one unless all are asked for."""
    c = config.adjusted()
    # paragraph ends are marked in output of tokens only
    s = tag.sentences(tag_tokens(docs, tables, c, **columns), paragraph_marks=c.token_format and c.output in ("xml", "json"))
    if c.disambiguate and tables.word_stats is not None:
        ctx = tables.word_ctx_stats
        if ctx is None:
            ctx = docs.sparkSession.createDataFrame([], "word string, lemma string, postag string, offset int, ctx_word string, ctx_lemma string, ctx_postag string, cnt double")
        s = disambig.rank_sentences(s, tables.word_stats, ctx)
        s = s if c.show_rate and c.output != "conllu" else s.drop("rates")
    if c.single_token_only:
        s = s.withColumn("tokens", F.transform("tokens", lambda t: t.withField("readings", F.slice(t["readings"], 1, 1))))
    return s


def tag_documents(docs: DataFrame, tables: Tables, config: TagConfig = TagConfig(), **columns: str) -> DataFrame:
    """``(doc_id, body)``: each document in the output format of the options."""
    c = config.adjusted()
    if c.output == "conllu":
        return _conllu(tag_sentences(docs, tables, c, **columns), tables)
    s = tag_sentences(docs, tables, c, **columns)
    if c.lemma_only:
        parts = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_id", "sent_id", sinks.txt(F.col("tokens"), True).alias("s")))).alias("x"))
        return parts.select("doc_id", F.array_join(F.transform("x", lambda x: x["s"]), "\n").alias("body"))
    return sinks.documents(s, c.output, c.token_format)


def _conllu(s: DataFrame, tables: Tables) -> DataFrame:
    """``(doc_id, body)`` of sentences in CoNLL-U, by the first reading of each token: the best one where
    readings are ranked."""
    keys = ["doc_id", "para_id", "sent_id"]
    last = F.size("tokens") - 1
    space = F.transform("tokens", lambda t, i: F.when(i < last, F.get("tokens", i + 1)["whitespace_before"]))
    t = s.withColumn("space", space).select(*keys, F.posexplode(F.arrays_zip("tokens", "space")).alias("tok_id", "x")).select(*keys, "tok_id", "x.tokens.*", F.col("x.space").alias("space_after"))
    gap = F.transform("tokens", lambda x: F.concat(F.when(F.coalesce(x["whitespace_before"], F.lit(True)), " ").otherwise(""), x["value"]))
    rows = sinks.conllu(ud.convert(t, tables.ud_map, list(tables.negatives), tables.lexicon), s.select(*keys, F.array_join(gap, "").alias("text")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_id", "sent_id", "conllu"))), lambda x: x["conllu"]), "\n").alias("body"))


def tokenize_documents(docs: DataFrame, config: TokenizeConfig = TokenizeConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, body)`` of the tokenizer."""
    c = config.adjusted()
    return sinks.tokenised(docs, c.words, c.only_words, c.output, c.separator, id_col, text_col, c.preserve_whitespace, c.newline)


def reports(tagged: DataFrame, lexicon_ru: DataFrame | None = None) -> dict[str, DataFrame]:
    """All statistics reports of tagged tokens, by name."""
    return {
        "unknown": stats.unknown_words(tagged, lexicon_ru),
        "unknown_summary": stats.unknown_report(tagged),
        "unknown_rate": stats.unknown_rate_by_document(tagged),
        "unclass": stats.unclass_report(tagged),
        "frequency": stats.word_frequency(tagged),
        "lemma": stats.lemma_frequency(tagged),
        "homonym": stats.homonyms(tagged),
    }


def ranking_counters(sentences: DataFrame, word_stats: DataFrame) -> DataFrame:
    """One row: tokens with several readings, and how many of them the word statistics, or
    only the endings, know."""
    t = sentences.select(F.explode("tokens").alias("t")).filter(F.size("t.readings") > 1).select(F.lower("t.value").alias("word"), F.right(F.lower("t.value"), F.lit(3)).alias("suffix"))
    words = word_stats.select("word").distinct().withColumn("in_words", F.lit(True))
    ends = disambig.suffix_rates(word_stats).select("suffix").distinct().withColumn("in_ends", F.lit(True))
    j = t.join(words, "word", "left").join(ends, "suffix", "left")
    return j.agg(F.count("*").alias("total"), F.count_if("in_words").alias("word"), F.count_if(F.col("in_words").isNull()).alias("no_word"), F.count_if(F.col("in_words").isNull() & F.col("in_ends")).alias("word_end"))
