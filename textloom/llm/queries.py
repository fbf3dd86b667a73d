"""The queries of the ten problems over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import encoding_repair, languages, mixing, print_form, quality, scan_repair, sentence_units, subject_areas, term_counts, tokenize_ids
from textloom.runtime import cut, table


def _requests(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "clean_requests").select("request_id", "text", *columns)


def _lexicons(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, f"lexicon_{x}") for x in ("uk", "ru", "en")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(languages.paragraph_languages(_requests(spark, d, "lang")))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return languages.paragraph_languages(_requests(spark, d, "lang"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segment_languages(_requests(spark, d, "lang")).drop("label")


def p1_requests(spark: SparkSession, d: str) -> DataFrame:
    return languages.request_languages(languages.paragraph_languages(_requests(spark, d, "lang")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return print_form.alike_pairs(_requests(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return print_form.members(_requests(spark, d))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return print_form.normalise(_requests(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    all_ = _requests(spark, d, "out_path")
    asked = all_.filter(F.col("out_path").endswith(".sent.txt"))
    return sentence_units.sentences(asked, sentence_units.corpus_counts(all_))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.shapes(_requests(spark, d)).filter("shape <> 'prose'").select("request_id", "shape")


def p4_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.shapes(_requests(spark, d)).select("request_id", *quality.STATS, "shape")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(_requests(spark, d)).filter("mark is not null").select("term", "mark")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(_requests(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.damages(_requests(spark, d), _lexicons(spark, d))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired_texts(_requests(spark, d), _lexicons(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.garbled_lines(_requests(spark, d))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.restored_texts(_requests(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize_ids.encode(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each document's text as its ids give it back."""
    back = tokenize_ids.decode_column(tokenize_ids.encode(table(spark, d, "documents")))
    return back.select("doc_id", F.md5("text").alias("digest"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """How many characters the token spans of each document cover, and whether they do so in order and
    without a gap."""
    x = tokenize_ids.spans(table(spark, d, "documents"))
    apart = F.exists(F.zip_with(F.slice("starts", 2, 2**30), F.expr("slice(ends, 1, greatest(size(ends) - 1, 0))"), lambda a, b: a > b), lambda bad: bad)
    empty = F.exists(F.zip_with("starts", "ends", lambda a, b: a >= b), lambda bad: bad)
    covered = F.coalesce(F.try_element_at("ends", F.lit(-1)) - F.try_element_at("starts", F.lit(1)), F.lit(0))
    return x.select("doc_id", covered.alias("covered"), (~apart & ~empty).alias("in_order"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = cut(mixing.sized_documents(table(spark, d, "documents")))
    return sized, mixing.source_report(sized, table(spark, d, "mix_targets"))


def _reached(spark: SparkSession, d: str) -> DataFrame:
    sized, report = _mixed(spark, d)
    return mixing.reached(report, mixing.mix(sized, report))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d).filter("short").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d).select("source", "target_share", "max_repeats", "n_docs", "size", "total", "epochs", "reached", F.round("reached_share", 6).alias("reached_share"), "short")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    sized, report = _mixed(spark, d)
    return mixing.mix(sized, report)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas.subjects_of(*subject_areas.subject_shares(*(table(spark, d, t) for t in ("documents", "subject_labels", "subjects"))))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("n_docs"), F.round(F.avg("share"), 6).alias("mean_share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries, by name, in the order of the problems."""
    found = {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}
    return dict(sorted(found.items(), key=lambda x: (int(x[0][1 : x[0].index("_")]), x[0])))
