"""Queries of the library over the tables of a data folder. Whole tables, no subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.config import CleanConfig, TagConfig
from textloom.functions import clean as C
from textloom.functions import normalize as N
from textloom.functions import tokenize as T
from textloom.functions.classify import multi_column, token_class
from textloom.operators import checks, disambig, langmark, lexicon, ortho, quality, semtags, spacing, stats, stress, tag, ud, unknown
from textloom.operators.cleaning import clean, counters, native
from textloom.plans import pipeline
from textloom.runtime import new_folder, spread, table
from textloom.sources import files, lexicons, sinks

LETTERS = "A-Za-zА-Яа-яІіЇїЄєҐґЁёЎў"
# What the parts of tags in the test lexicon are in Universal Dependencies.
UD_PARTS = [("noun", "Upos=NOUN"), ("adj", "Upos=ADJ"), ("verb", "Upos=VERB"), ("adv", "Upos=ADV"), ("prep", "Upos=ADP"), ("part", "Upos=PART"), ("conj:coord", "Upos=CCONJ"), ("conj:subord", "Upos=SCONJ"), ("punct", "Upos=PUNCT"), ("symb", "Upos=SYM"), ("unknown", "Upos=X"), ("unclass", "Upos=X"), ("noninfl", "Uninflect=Yes"), ("anim", "Animacy=Anim"), ("inanim", "Animacy=Inan"), ("m", "Gender=Masc"), ("f", "Gender=Fem"), ("n", "Gender=Neut"), ("p", "Number=Plur"), ("v_naz", "Case=Nom"), ("v_rod", "Case=Gen"), ("v_dav", "Case=Dat"), ("v_zna", "Case=Acc"), ("v_oru", "Case=Ins"), ("v_mis", "Case=Loc"), ("v_kly", "Case=Voc"), ("imperf", "Aspect=Imp"), ("perf", "Aspect=Perf"), ("pres", "Tense=Pres; Mood=Ind"), ("past", "Tense=Past; Mood=Ind"), ("futr", "Tense=Fut; Mood=Ind"), ("inf", "VerbForm=Inf"), ("s", "Number=Sing"), ("1", "VerbForm=Fin; Person=1"), ("2", "VerbForm=Fin; Person=2"), ("3", "VerbForm=Fin; Person=3"), ("pron", "-")]
NEGATIVES = ["ніхто", "ніщо", "ніякий", "нічий", "ніде", "ніколи", "нікуди", "ніяк", "жоден"]
RULES = [("REPEATED_WORD", r"(?iu)(?<!\p{L})(\p{L}{2,}) \1(?!\p{L})", "one word"), ("COMMA_SPACE", r"\p{L},\p{L}", "blank after the comma"), ("THREE_MARKS", r"!!!", "!")]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _lexicons(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {x: table(s, d, f"lexicon_{x}") for x in ("uk", "ru", "en")}


def _tokens(s: SparkSession, d: str) -> DataFrame:
    """The token table without its exact duplicates."""
    return table(s, d, "tokens").withColumnRenamed("tok_value", "value").distinct()


def _tagged(s: SparkSession, d: str) -> DataFrame:
    return tag.tag(_tokens(s, d), table(s, d, "lexicon_uk"), lemma_for_unknown=True)


def _word_stats(s: SparkSession, d: str) -> DataFrame:
    """Word statistics made from the tokens: a form's share of all tokens, divided among
    its distinct readings."""
    t = _tokens(s, d)
    n = t.count()
    by = t.groupBy(F.lower(N.known_form(F.coalesce("clean", "value"))).alias("word")).agg(F.count("*").alias("n"))
    r = tag.readings_by_form(table(s, d, "lexicon_uk"))
    r = r.select(F.col("form").alias("word"), F.size("readings").alias("k"), F.explode("readings").alias("r"))
    return by.join(r, "word").select("word", F.col("r.lemma").alias("lemma"), F.col("r.tags").alias("postag"), (F.col("n") / n / F.col("k")).alias("rate"))


# sources and tokenizing


def paragraph_count(s, d):
    return _docs(s, d).select("doc_id", F.size(T.paragraphs(F.col("text"))).alias("n_paragraphs"))


def paragraph_spans(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_id", "paragraph"))


def sentence_split(s, d):
    p = _docs(s, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_id", "p"))
    return p.select("doc_id", "para_id", F.posexplode(T.sentences(F.col("p"))).alias("sent_id", "sentence"))


def sentence_length_stats(s, d):
    x = sentence_split(s, d).join(_docs(s, d).select("doc_id", "source"), "doc_id")
    return x.groupBy("source").agg(F.count("*").alias("n_sentences"), F.round(F.avg(F.length("sentence")), 4).alias("mean_length"), F.max(F.length("sentence")).alias("longest"))


def sentence_per_line(s, d):
    return _docs(s, d).select("doc_id", F.size(T.lines(F.col("text"))).alias("n_lines"))


def word_tokenize_count(s, d):
    return _docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))


def tokens_with_space(s, d):
    t = T.tokens(F.col("text"), keep_space=True, newline="\n")
    return _docs(s, d).select("doc_id", F.size(t).alias("n_pieces"), F.md5(F.array_join(t, "")).alias("joined"))


def only_words(s, d):
    return _docs(s, d).select("doc_id", F.array_join(T.only_words(F.col("text")), "|").alias("words"))


def particle_split(s, d):
    """Particles of the tokens, also of each token with a particle put to it."""
    v = _tokens(s, d).select("value")
    v = v.unionByName(v.select(F.concat("value", F.lit("-но")).alias("value"))).unionByName(v.select(F.concat("value", F.lit("–таки")).alias("value"))).distinct()
    return v.select("value", F.array_join(T.split_particle(F.col("value")), "|").alias("parts")).filter("parts is not null")


def tokenizer_json(s, d):
    return sinks.tokenised(_docs(s, d), words=True, output="json")


def token_class_counts(s, d):
    return _tokens(s, d).groupBy(token_class(F.col("value")).alias("class")).agg(F.count("*").alias("n"))


def word_frequency(s, d):
    """Documents to paragraphs, sentences, tokens, classes and counts. The words of a document are
    sorted, so that the first of equal ones tells that the document has the word: one exchange."""
    words = F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p: F.flatten(F.transform(T.sentences(p), lambda x: T.tokens(x)))))
    words = F.transform(F.filter(words, lambda w: w.rlike(rf"^[{LETTERS}]+\z")), F.lower)
    w = _docs(s, d).select(F.array_sort(words).alias("w"))
    each = F.transform("w", lambda x, i: F.struct(x.alias("word"), ((i == 0) | (F.get("w", i - 1) != x)).alias("first")))
    w = w.select(F.explode(each).alias("x")).select("x.word", "x.first")
    return w.groupBy("word").agg(F.count("*").alias("n"), F.count_if("first").alias("n_docs"))


def word_frequency_by_source(s, d):
    w = _docs(s, d).select("source", F.explode(F.regexp_extract_all("text", F.lit(rf"[{LETTERS}]+"), F.lit(0))).alias("w"))
    return w.groupBy("source", F.lower("w").alias("word")).agg(F.count("*").alias("n"))


def multi_column_route(s, d):
    """Requests that are in columns when gaps are set after their hyphens."""
    return table(s, d, "clean_requests").filter(multi_column(F.replace("text", F.lit("-"), F.lit("-    ")))).select("request_id")


# dictionary and statistics


def dictionary_tagging(s, d):
    return _tagged(s, d).select("doc_id", "para_id", "sent_id", "tok_id", "value", F.size("readings").alias("n_readings"), F.col("readings")[0]["lemma"].alias("lemma"), F.col("readings")[0]["tags"].alias("tags"))


def single_reading(s, d):
    t = tag.tag(_tokens(s, d), table(s, d, "lexicon_uk"), single=True)
    return t.groupBy(N.part_of_speech(F.col("readings")[0]["tags"]).alias("pos")).agg(F.count("*").alias("n"))


def known_word_semi(s, d):
    return lexicon.known(_tokens(s, d).select("value").distinct(), "value", table(s, d, "lexicon_uk"))


def unknown_word_anti(s, d):
    return lexicon.unknown(_tokens(s, d).select("value").distinct(), "value", table(s, d, "lexicon_uk"))


def class_counts(s, d):
    return stats.counts_by_class(_tagged(s, d))


def unknown_words(s, d):
    return stats.unknown_words(_tagged(s, d), table(s, d, "lexicon_ru"))


def unknown_report(s, d):
    return stats.unknown_report(_tagged(s, d))


def unknown_rate_by_document(s, d):
    return stats.unknown_rate_by_document(_tagged(s, d))


def unclass_report(s, d):
    return stats.unclass_report(_tagged(s, d))


def tagged_word_frequency(s, d):
    return stats.word_frequency(_tagged(s, d))


def lemma_frequency(s, d):
    return stats.lemma_frequency(_tagged(s, d))


def homonym_groups(s, d):
    return stats.homonyms(_tagged(s, d))


def merged_counts(s, d):
    t = _tokens(s, d).groupBy("value").agg(F.count("*").alias("n"))
    return stats.merge([t, t], ["value"], ["n"])


# cleaning


def _step(s, d, *steps):
    r = spread(table(s, d, "clean_requests").select("request_id", "text"))
    return native(r, list(steps)).select("request_id", F.md5("text").alias("digest"))


def clean_control_chars(s, d):
    return _step(s, d, C.direction_marks, C.control_chars)


def clean_orphan_cr(s, d):
    return _step(s, d, C.orphan_cr)


def clean_combining(s, d):
    return _step(s, d, C.combining)


def clean_apostrophes(s, d):
    return _step(s, d, C.apostrophes)


def clean_soft_hyphens(s, d):
    return _step(s, d, C.soft_hyphens)


def clean_line_separators(s, d):
    return _step(s, d, C.line_separators)


def clean_lone_latin(s, d):
    return _step(s, d, C.lone_latin)


def clean_dos_newlines(s, d):
    return table(s, d, "clean_requests").select("request_id", C.has_dos_newlines(F.col("text")).alias("dos"))


def homoglyph_translation(s, d):
    return table(s, d, "lexicon_uk").select("form", C.to_latin(F.col("form")).alias("latin"), C.to_cyrillic(C.to_latin(F.col("form"))).alias("back")).distinct()


def clean_native_steps(s, d):
    return _step(s, d, *C.STEPS, C.mix_shortcuts, C.roman_numbers, C.lone_latin, C.dangling_numbers, C.letter_spacing)


def clean_full(s, d):
    r = table(s, d, "clean_requests").select("request_id", "text")
    return clean(r, _lexicons(s, d), CleanConfig(min_words=5), id_col="request_id").select("request_id", "status", "changed", F.length("text").alias("n_chars"))


def despaced(s, d):
    """The forms of the lexicon, written with blanks between the letters, as words again."""
    forms = table(s, d, "lexicon_uk").filter(F.col("form").rlike("^[а-яіїєґ]{5,}$")).select("form").distinct()
    spaced = forms.withColumn("result", F.array_join(F.split("form", ""), " "))
    return lexicon.rewrite(spaced, [spacing.despace], _lexicons(s, d), "result")


# gates and diagnostics


def quality_lines(s, d):
    t = F.coalesce("text", F.lit(""))
    return table(s, d, "clean_requests").select("request_id", quality.page_number_lines(t).alias("page_numbers"), quality.long_lines(t).alias("long_lines"), quality.longest_line(t).alias("longest"), quality.long_word_lines(t).alias("long_words"))


def word_count_gate(s, d):
    return _docs(s, d).select("doc_id", quality.ukrainian_words(F.col("text")).alias("n_words"))


def alphabet_gate(s, d):
    t = F.col("text")
    return _docs(s, d).select("doc_id", quality.letters_of(t, quality.ONLY_UK).alias("n_uk"), quality.letters_of(t, quality.ONLY_RU).alias("n_ru"), quality.alphabet_ok(t, 100).alias("ok"))


def leftover_marks(s, d):
    r = table(s, d, "clean_requests")
    return r.agg(*(F.count_if(v).alias(k) for k, v in quality.leftovers(F.col("text")).items()))


def diagnostics(s, d):
    r = table(s, d, "clean_requests").select("request_id", F.explode(quality.diagnostics(F.col("text"))).alias("note"))
    return r.groupBy("note").agg(F.count("*").alias("n"))


def two_columns(s, d):
    """Requests whose text is in two columns when the letters of its lines are laid out so."""
    letters = lambda x: F.regexp_replace(x, "[^а-яіїєґ]+", "")
    lines = F.transform(F.split(F.lower("text"), "\n"), lambda x: F.concat(F.rpad(F.substring(letters(x), 1, 10), 16, " "), F.substring(letters(x), 11, 10)))
    t = table(s, d, "clean_requests").filter("text is not null").select("request_id", F.array_join(lines, "\n").alias("text"))
    return t.filter(quality.two_columns(F.col("text"))).select("request_id")


# normal forms, ranking, contexts


def tag_norm(s, d):
    return table(s, d, "lexicon_uk").filter("tags is not null").select("tags", N.tag_for_rate(F.col("tags")).alias("rate_tags"), N.tag_core(F.col("tags")).alias("core_tags"), N.part_of_speech(F.col("tags")).alias("pos")).distinct()


def word_ending(s, d):
    return table(s, d, "lexicon_uk").filter("form is not null and tags is not null").select("form", "tags", N.word_ending(F.col("form"), F.col("tags")).alias("ending")).distinct()


def number_norm(s, d):
    v = _tokens(s, d).filter(F.col("value").rlike("^[0-9]")).select("value").distinct()
    return v.select("value", N.number(F.col("value")).alias("norm"))


def mark_norm(s, d):
    v = _tokens(s, d).filter(token_class(F.col("value")) == "punct").groupBy(N.mark(F.col("value")).alias("mark")).agg(F.count("*").alias("n"))
    return v


def tag_stats_normalised(s, d):
    return disambig.tag_rates(_word_stats(s, d)).select("tags", F.round("share", 6).alias("share"))


def suffix_stats(s, d):
    return disambig.suffix_rates(_word_stats(s, d)).select("suffix", "tags", F.round("rate", 8).alias("rate"))


def reading_rank(s, d):
    key = ["doc_id", "para_id", "sent_id", "tok_id"]
    t = _tagged(s, d).filter(F.size("readings") > 1).withColumn("value", F.lower(N.known_form(F.coalesce("clean", "value"))))
    r = disambig.rank_by_rate(t, _word_stats(s, d), key)
    return r.groupBy("value", "lemma", "tags", "rank", "confidence").agg(F.count("*").alias("n"))


def _context_stats(s: SparkSession, d: str) -> DataFrame:
    """Contexts of the tokens with one reading: the token before and the one after it, where these
    have one reading too."""
    w = W.partitionBy("doc_id", "para_id", "sent_id").orderBy("tok_id", "value")
    word = F.lower(N.known_form(F.coalesce("clean", "value")))
    one = F.when(F.size("readings") == 1, F.struct(word.alias("word"), F.col("readings")[0]["lemma"].alias("lemma"), F.col("readings")[0]["tags"].alias("tags")))
    t = _tagged(s, d).select(one.alias("t"), F.array(F.struct(F.lit(-1).alias("offset"), F.lag(one).over(w).alias("c")), F.struct(F.lit(1).alias("offset"), F.lead(one).over(w).alias("c"))).alias("near"))
    t = t.filter("t is not null").select("t", F.explode("near").alias("x")).filter("x.c is not null")
    return t.groupBy(F.col("t.word").alias("word"), F.col("t.lemma").alias("lemma"), F.col("t.tags").alias("postag"), F.col("x.offset").alias("offset"), F.col("x.c.word").alias("ctx_word"), F.col("x.c.lemma").alias("ctx_lemma"), N.tag_core(F.col("x.c.tags")).alias("ctx_postag")).agg(F.count("*").cast("double").alias("cnt"))


def context_stats(s, d):
    return _context_stats(s, d)


def ranked_sentences(s, d):
    r = disambig.rank_sentences(tag.sentences(_tagged(s, d)), _word_stats(s, d), _context_stats(s, d))
    first = r.select(F.explode("tokens").alias("t")).select(F.col("t.value").alias("value"), F.col("t.readings")[0]["tags"].alias("tags"))
    return first.groupBy("value", "tags").agg(F.count("*").alias("n"))


def prev_next_context(s, d):
    return tag.neighbours(_tokens(s, d)).groupBy("value", "left", "right").agg(F.count("*").alias("n"))


def space_after(s, d):
    return tag.space_after(_tokens(s, d)).groupBy("value", "space_after").agg(F.count("*").alias("n"))


# unknown words, orthography, stress, inflection, dependencies


def unknown_suffix_guess(s, d):
    """Guesses for the unknown tokens, each with the reading of the token before it."""
    w = W.partitionBy("doc_id", "para_id", "sent_id").orderBy("tok_id", "value")
    first = F.col("readings")[0]
    t = _tagged(s, d).select("value", first["tags"].alias("tag"), (F.row_number().over(w) == 1).alias("first"), F.lag(first["lemma"]).over(w).alias("left_lemma"), F.lag(first["tags"]).over(w).alias("left_tags"))
    t = t.filter("tag = 'unknown'").drop("tag").distinct().withColumn("key", F.concat_ws("|", "value", F.col("first").cast("string"), "left_lemma", "left_tags"))
    return unknown.guess(t, unknown.suffix_statistics(table(s, d, "lexicon_uk")), ["key"])


def older_spelling(s, d):
    """Words in an older spelling: the unknown words, and the forms of the lexicon with і for и."""
    t = stats.unknown_words(_tagged(s, d)).select("value")
    t = t.unionByName(table(s, d, "lexicon_uk").filter("form is not null").select(F.regexp_replace("form", "(.)и", "$1і").alias("value")))
    return ortho.retag(t, table(s, d, "lexicon_uk"), "lesya").select("value", F.size("readings").alias("n_readings"))


def syllable_count(s, d):
    return table(s, d, "lexicon_uk").filter("form is not null").select("form", stress.syllables(F.col("form")).alias("n")).distinct()


def stress_key(s, d):
    return table(s, d, "lexicon_uk").filter("tags is not null").select("tags", stress.tag_key(F.col("tags")).alias("tag_key")).distinct()


def inflect_genitive(s, d):
    x = table(s, d, "lexicon_uk").filter(F.col("tags").rlike("^(?:noun:inanim:.:v_rod.*)$"))
    return x.groupBy("lemma").agg(F.array_join(F.array_sort(F.collect_set("form")), ",").alias("forms"))


def dependencies(s, d):
    t = tag.space_after(_tagged(s, d))
    m = s.createDataFrame(UD_PARTS, "part string, ud string")
    return ud.convert(t, m, NEGATIVES, table(s, d, "lexicon_uk")).groupBy("upos", "feats").agg(F.count("*").alias("n"))


def vertical_output(s, d):
    return sinks.documents(tag.sentences(_tagged(s, d)), "vertical")


def json_output(s, d):
    return sinks.documents(tag.sentences(_tagged(s, d)), "json")


def xml_output(s, d):
    return sinks.documents(tag.sentences(_tagged(s, d)), "xml", token_format=True)


def conllu_output(s, d):
    t = tag.space_after(_tagged(s, d))
    m = s.createDataFrame(UD_PARTS, "part string, ud string")
    keys = ["doc_id", "para_id", "sent_id"]
    gap = F.when(F.coalesce("whitespace_before", F.lit(True)), " ").otherwise("")
    texts = t.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", F.concat(gap, "value").alias("v")))), lambda x: x["v"]), "").alias("text"))
    return sinks.conllu(ud.convert(t, m, NEGATIVES, table(s, d, "lexicon_uk")), texts)


# language marking, checks, extras, streams


def language_rates(s, d):
    parts = langmark.chunks(_docs(s, d))
    r = langmark.rates(parts, table(s, d, "lexicon_uk"), table(s, d, "lexicon_ru"))
    return r.select("doc_id", "pos", F.round("uk_rate", 4).alias("uk_rate"), F.round("ru_rate", 4).alias("ru_rate"))


def language_marks(s, d):
    return langmark.mark_russian(_docs(s, d).select("doc_id", "text"), _lexicons(s, d), "mark").filter(F.col("text").contains('<span lang="ru"')).select("doc_id", F.size(F.regexp_extract_all("text", F.lit('<span lang="ru"'), F.lit(0))).alias("n_marks"))


def russian_chunks(s, d):
    """What a cut of Russian paragraphs writes to its side output."""
    return langmark.russian_chunks(_docs(s, d).select("doc_id", "text"), _lexicons(s, d)).select("doc_id", "pos", F.md5("chunk").alias("chunk"), "rate")


def rule_matches(s, d):
    return checks.matches(_docs(s, d), RULES).groupBy("rule_id").agg(F.count("*").alias("n"))


def grammar_rating(s, d):
    m = checks.matches(_docs(s, d), RULES[1:]).select("doc_id", "rule_id")
    words = _docs(s, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(rf"[{LETTERS}]+"), F.lit(0))).alias("n_words")).filter("n_words > 0")
    return stats.grammar_rating(m, words)


def documents_rollup(s, d):
    r = _docs(s, d).rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.grouping_id().cast("int").alias("level"))
    return r


def streaming_word_count(s, d):
    """The same count by a stream over the documents, to its end."""
    from textloom.streaming import streams

    x = streams.documents_stream(s, f"{d}/documents.parquet", _docs(s, d).schema)
    x = x.select(F.explode(F.regexp_extract_all("text", F.lit(rf"[{LETTERS}]+"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    return streams.run_once(x, "complete", new_folder(s, "word-counts"))


# whole runs, files, and tables made from others


def document_tagging(s, d):
    """Documents to tokens with their readings, particles apart, under options."""
    t = pipeline.tag_tokens(_docs(s, d), pipeline.Tables(table(s, d, "lexicon_uk")), TagConfig(strip_control=True))
    first = F.col("readings")[0]
    return t.select("doc_id", "para_id", "sent_id", "tok_id", F.coalesce("part_no", F.lit(0)).alias("part_no"), "value", F.size("readings").alias("n_readings"), first["lemma"].alias("lemma"), first["tags"].alias("tags"))


def line_tagging(s, d):
    """The same with a sentence for each line and one reading for each token."""
    t = pipeline.tag_tokens(_docs(s, d), pipeline.Tables(table(s, d, "lexicon_uk")), TagConfig(sentence_per_line=True, single_token_only=True, split_hyphen_parts=False, set_lemma_for_unknown=True))
    return t.groupBy("value", F.col("readings")[0]["lemma"].alias("lemma"), F.col("readings")[0]["tags"].alias("tags")).agg(F.count("*").alias("n"), F.max(F.size("readings")).alias("most"))


def alternatives(s, d):
    """Tokens by their first reading and the others."""
    t = _tagged(s, d).select(tag.token_shape(F.col("readings")).alias("x"))
    return t.groupBy(F.col("x.token.lemma").alias("lemma"), F.col("x.token.tags").alias("tags"), F.size("x.alts").alias("n_alts")).agg(F.count("*").alias("n"))


def class_counts_by_document(s, d):
    return stats.counts_by_class(_tagged(s, d), ["doc_id"])


def semantic_tag_lookup(s, d):
    """Semantic tags of the lexicon's readings, from entries for every lemma."""
    x = table(s, d, "lexicon_uk").filter("lemma is not null and tags is not null").select("lemma", "tags").distinct()
    entries = x.select("lemma", N.part_of_speech(F.col("tags")).alias("pos")).distinct()
    kinds = [("1:conc:hum", ""), ("2:abst", ""), ("3:conc:animal", ""), ("4:quantif", ""), ("5:case", ":v_rod")]
    entries = entries.select("lemma", "pos", F.inline(F.array(*(F.struct(F.lit(a).alias("semtag"), F.lit(b).alias("cond")) for a, b in kinds))))
    none = s.createDataFrame([], "advp_lemma string, verb_lemma string")
    got = semtags.semantic_tags(x, entries, none)
    return got.select("lemma", "tags", F.array_join(F.array_sort(F.split("semtags", ";")), ";").alias("semtags"))


def _stressed(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lexicon_uk").filter("form is not null and lemma is not null and tags is not null").select("form", "lemma", "tags").distinct()
    entries = x.select("lemma", stress.tag_key(F.col("tags")).alias("tag_key"), F.regexp_replace("form", f"^([^{stress.VOWELS}]*[{stress.VOWELS}])", f"$1{stress.ACCENT}").alias("form"), F.lit(0).alias("base"), F.lit(0).alias("offset")).distinct()
    t = _tagged(s, d).select("value", "readings").distinct().withColumn("key", F.col("value"))
    return stress.stress(t, entries, ["key"]).select("value", "stressed").distinct()


def stress_tokens(s, d):
    """Tokens with the accents of entries that stress the first vowel."""
    return _stressed(s, d)


def stress_summary(s, d):
    return stress.stress_counts(_stressed(s, d))


def ranking_summary(s, d):
    """Tokens with several readings, and which statistics know them."""
    return pipeline.ranking_counters(tag.sentences(_tagged(s, d)), _word_stats(s, d))


def clean_summary(s, d):
    """Mixes of letters and broken words before and after quick cleaning, by request."""
    r = table(s, d, "clean_requests").filter("text is not null").select("request_id", "text")
    after = native(r.withColumn("before", F.col("text")), [C.lone_latin, C.line_separators])
    return after.select("request_id", *(v.alias(k) for k, v in counters(F.col("before"), F.col("text")).items()))


def paradigm_shares(s, d):
    """How the words of a lemma divide among paradigms (here by the length of the form)."""
    w = _word_stats(s, d).withColumn("postag", F.concat("postag", F.lit(":xp"), (F.length("word") % 3 + 1).cast("string")))
    return disambig.paradigm_rates(w).select("lemma", "xp", F.round("share", 6).alias("share"))


def not_excluded(s, d):
    """Request files whose name is not on the list of those sent again."""
    r = table(s, d, "clean_requests").filter("file_path is not null").select("request_id", F.col("file_path").alias("path"))
    name = F.substring_index("path", "/", -1)
    often = r.groupBy(name.alias("name")).agg(F.count("*").alias("n")).filter("n > 1 or length(name) % 2 = 0")
    return files.without_excluded(r, often).select("request_id", "path")


def report_file(s, d):
    """The report of unclassified words, written sorted and read back."""
    path = new_folder(s, "report")
    sinks.write_report(stats.unclass_report(_tagged(s, d)), path, [F.desc("n"), "value"])
    return s.read.option("sep", "\t").schema("value string, n bigint").csv(path)


def text_files(s, d):
    """Documents written in order as lines of text files and read back whole."""
    path = new_folder(s, "texts")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[\n\r]", " "))
    sinks.write_ordered(_docs(s, d).filter("text is not null").select("doc_id", line.alias("body")), path, ["doc_id"])
    return _lines_of(files.read_texts(s, path))


def _lines_of(texts: DataFrame) -> DataFrame:
    rows = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return rows.select(F.substring_index("line", "\t", 1).cast("bigint").alias("doc_id"), F.md5(F.regexp_replace("line", "^[^\t]*\t", "")).alias("digest"))


def _written(s: SparkSession, d: str) -> str:
    """Documents as text files in two folders, one of them with results (it is named so)."""
    path = new_folder(s, "files")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[\n\r]", " "))
    lines = _docs(s, d).filter("text is not null").select("doc_id", line.alias("body"))
    sinks.write_ordered(lines, f"{path}/in", ["doc_id"])
    sinks.write_ordered(lines.limit(0), f"{path}/in-good", ["doc_id"])
    return path


def decoded_files(s, d):
    """Files read as bytes, without folders of results, and decoded."""
    return _lines_of(files.decoded(files.read_binary(s, _written(s, d))))


def listed_files(s, d):
    """Files named in a list, read whole."""
    path = _written(s, d)
    files.read_texts(s, f"{path}/in").select("path").coalesce(1).write.text(f"{path}/list")
    return _lines_of(files.read_listed(s, f"{path}/list"))


def statistics_file(s, d):
    """Word and context statistics written as a file of head and context lines, and loaded."""
    path = new_folder(s, "statistics")
    head = _word_stats(s, d).filter("word not rlike '[ ]' and lemma not rlike '[ ]' and word not like '#%'")
    line = F.concat_ws(" ", "word", "lemma", "postag", F.col("rate").cast("string"))
    ctx = F.concat(F.lit("\n\t-1\t__BEG\t^\tBEG\t"), F.length("word").cast("string"))
    head.select(F.concat(line, ctx).alias("value")).coalesce(1).write.text(path)
    words, contexts = lexicons.word_statistics(s, path)
    return words.join(contexts.drop("rate"), ["word", "lemma", "postag"]).select("word", "lemma", "postag", F.round("rate", 9).alias("rate"), "offset", "ctx_word", "ctx_lemma", "cnt").distinct()


def cleaned_by_status(s, d):
    """Cleaned requests, kept apart by status, as they lie in the folders."""
    path = new_folder(s, "cleaned")
    r = table(s, d, "clean_requests").select("request_id", "text")
    sinks.write_by_status(clean(r, _lexicons(s, d), CleanConfig(min_words=5), id_col="request_id").select("request_id", "text", "status"), path)
    return s.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"), F.count("text").alias("n_texts"))
