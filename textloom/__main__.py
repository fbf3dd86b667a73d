"""Command line: python -m textloom tokenize|tag|clean|stats|inflect --input PATH --output PATH."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.config import FORMATS, CleanConfig, TagConfig, TokenizeConfig
from textloom.operators import langmark, lexicon, tag
from textloom.operators.cleaning import clean
from textloom.plans import pipeline
from textloom.sources import files, sinks


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="textloom")
    p.add_argument("what", choices=("tokenize", "tag", "clean", "stats", "inflect"))
    p.add_argument("-i", "--input", nargs="+", help="files or folders of .txt files")
    p.add_argument("-o", "--output")
    p.add_argument("--lexicon", help="parquet table form, lemma, tags; ru and en beside it: --lexicon-ru, --lexicon-en")
    p.add_argument("--lexicon-ru")
    p.add_argument("--lexicon-en")
    p.add_argument("--format", choices=FORMATS, default="txt")
    p.add_argument("--words", action="store_true")
    p.add_argument("--only-words", action="store_true")
    p.add_argument("--lemma-only", action="store_true")
    p.add_argument("--modules", nargs="*", default=[])
    p.add_argument("--min-words", type=int, default=0)
    p.add_argument("--simple", action="store_true")
    p.add_argument("--mark-languages", choices=("none", "mark", "cut"), default="none")
    p.add_argument("--cut-output", help="folder for the Russian paragraphs that --mark-languages cut takes out")
    p.add_argument("--exclude", help="text file with the names of files that are not to be cleaned")
    p.add_argument("--as-is-output", help="folder for excluded and undecodable files as they were")
    p.add_argument("--journal", action="store_true")
    p.add_argument("--split-long-lines", action="store_true")
    p.add_argument("--chunk-chars", type=int, default=0)
    p.add_argument("--no-disambig", action="store_true")
    p.add_argument("--newline", default=" ")
    p.add_argument("--preserve-whitespace", action="store_true")
    p.add_argument("--disable", nargs="*", default=[])
    p.add_argument("--lemma")
    p.add_argument("--tag", default=".*")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    read = lambda path: spark.read.parquet(path) if path else None
    lex = read(a.lexicon)
    if a.what == "inflect":
        for r in lexicon.inflect(lex, a.lemma, a.tag).orderBy("form").collect():
            print(r.form)
        return
    docs = files.read_texts(spark, a.input).withColumnRenamed("path", "doc_id")
    if a.what == "tokenize":
        out = pipeline.tokenize_documents(docs, TokenizeConfig(words=a.words, only_words=a.only_words, output=a.format, newline=a.newline, preserve_whitespace=a.preserve_whitespace))
    elif a.what == "tag":
        out = pipeline.tag_documents(docs, pipeline.Tables(lex), TagConfig(output=a.format, lemma_only=a.lemma_only, no_disambig=a.no_disambig, modules=frozenset(a.modules)))
    elif a.what == "clean":
        empty = lex.limit(0)
        lexicons = {"uk": lex, "ru": read(a.lexicon_ru) if a.lexicon_ru else empty, "en": read(a.lexicon_en) if a.lexicon_en else empty}
        config = CleanConfig(min_words=a.min_words, simple=a.simple, mark_languages=a.mark_languages, disabled_rules=frozenset(a.disable), journal=a.journal, split_long_lines=a.split_long_lines, chunk_chars=a.chunk_chars)
        raw = all_ = files.read_binary(spark, a.input[0])
        if a.exclude:
            raw = files.without_excluded(all_, spark.read.text(a.exclude).select(F.trim("value").alias("name")))
        decoded = files.decoded(raw)
        if a.as_is_output:
            good = decoded.filter("text is not null").select("path")
            sinks.write_as_is(all_.join(good, "path", "left_anti"), a.as_is_output)
        texts = decoded.withColumnRenamed("path", "doc_id")
        if a.cut_output and a.mark_languages == "cut":
            sinks.write_ordered(langmark.russian_chunks(texts, lexicons).select("doc_id", "pos", F.col("chunk").alias("body")), a.cut_output, ["doc_id", "pos"])
        return sinks.write_by_status(clean(texts, lexicons, config), a.output)
    else:
        tagged = tag.tag(tag.explode_tokens(docs), lex, lemma_for_unknown=True)
        for name, df in pipeline.reports(tagged, read(a.lexicon_ru)).items():
            sinks.write_report(df, f"{a.output}/{name}", [F.col(df.columns[0])])
        return
    sinks.write_ordered(out, a.output, ["doc_id"])


if __name__ == "__main__":
    main()
