"""Serialised forms of tagged sentences, as Columns, and ordered writes.

``tokens``: ``array<struct<value, clean, whitespace_before, readings>>`` in order; null or
empty tokens are a paragraph end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _join(c: Column, by: str = "") -> Column:
    return F.array_join(c, by)


def txt(tokens: Column, lemma_only: bool = False) -> Column:
    """``value[lemma/tags,...]`` of each token, blanks as in the text; or first lemmas."""

    def one(t: Column, i: Column) -> Column:
        gap = F.when((i == 0) | ~F.coalesce(t["whitespace_before"], F.lit(True)), "").otherwise(" ")
        if lemma_only:
            return F.concat(gap, F.coalesce(t["readings"][0]["lemma"], t["value"]))
        body = _join(F.transform(t["readings"], lambda r: F.concat(F.when(r["tags"].isin("punct", "symb"), "").otherwise(r["lemma"]), F.lit("/"), r["tags"])), ",")
        return F.concat(gap, t["value"], F.lit("["), body, F.lit("]"))

    return _join(F.transform(tokens, one))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _xml_token(t: Column, r: Column, close: str) -> Column:
    punct = (r["tags"] == "punct") & ~F.coalesce(t["whitespace_before"], F.lit(True))
    return F.concat(F.lit('<token value="'), xml_escape(t["value"]), F.lit('" lemma="'), xml_escape(F.coalesce(r["lemma"], F.lit(""))), F.lit('" tags="'), xml_escape(r["tags"]), F.lit('"'), F.when(punct, ' whitespaceBefore="false"').otherwise(""), F.lit(close))


def xml(tokens: Column, token_format: bool = False) -> Column:
    """A sentence with its readings; with ``token_format`` the first reading of each token
    and the others as alternatives. Only & < > and double quotes are escaped."""
    if not token_format:
        one = lambda t: F.concat(F.lit("  <tokenReading>\n"), _join(F.transform(t["readings"], lambda r: F.concat(F.lit("    "), _xml_token(t, r, " />\n")))), F.lit("  </tokenReading>\n"))
    else:

        def one(t: Column) -> Column:
            first, rest = t["readings"][0], F.slice(t["readings"], 2, 10_000)
            alts = F.concat(F.lit("    <alts>\n"), _join(F.transform(rest, lambda r: F.concat(F.lit("      "), _xml_token(t, r, " />\n")))), F.lit("    </alts>\n"))
            return F.concat(F.lit("  "), F.when(F.size(rest) > 0, F.concat(_xml_token(t, first, ">\n"), alts, F.lit("  </token>\n"))).otherwise(_xml_token(t, first, " />\n")))

    body = F.concat(F.lit("<sentence>\n"), _join(F.transform(tokens, one)), F.lit("</sentence>\n"))
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) > 0, body).otherwise("<paragraph/>\n")


def json(tokens: Column, token_format: bool = False) -> Column:
    """A sentence as JSON, null fields left out: readings of each token, or (bare array) the
    first reading with alternatives."""

    def struct(t: Column, r: Column, *more: Column) -> Column:
        punct = (r["tags"] == "punct") & ~F.coalesce(t["whitespace_before"], F.lit(True))
        return F.struct(t["value"].alias("value"), r["lemma"].alias("lemma"), r["tags"].alias("tags"), F.when(punct, False).alias("whitespaceBefore"), *more)

    if not token_format:
        each = F.transform(tokens, lambda t: F.struct(F.transform(t["readings"], lambda r: struct(t, r)).alias("tokens")))
        return F.to_json(F.struct(each.alias("tokenReadings")))

    def one(t: Column) -> Column:
        rest = F.slice(t["readings"], 2, 10_000)
        return struct(t, t["readings"][0], F.when(F.size(rest) > 0, F.transform(rest, lambda r: struct(t, r))).alias("alts"))

    return F.to_json(F.transform(tokens, one))


def vertical(tokens: Column, semtags: bool = False) -> Column:
    """One token to a line; <g/> before a mark without a blank, alternatives after ||."""

    def one(t: Column, i: Column) -> Column:
        r = t["readings"][0]
        glue = F.when((i > 0) & (r["tags"] == "punct") & ~F.coalesce(t["whitespace_before"], F.lit(False)), "<g/>\n").otherwise("")
        alts = _join(F.transform(F.slice(t["readings"], 2, 10_000), lambda x: F.concat(F.lit(" || "), x["tags"], F.lit(" "), x["lemma"])))
        line = F.concat(glue, t["value"], F.lit("\t"), r["tags"], F.lit("\t"), r["lemma"], alts)
        if semtags:
            line = F.concat(line, F.coalesce(F.concat(F.lit("\tsemTags="), t["semtags"]), F.lit("\t_")))
        return F.concat(line, F.lit("\n"))

    return F.when(F.size(tokens) > 0, F.concat(F.lit("<s>\n"), _join(F.transform(tokens, one)), F.lit("</s>\n"))).otherwise("")


def conllu(converted: DataFrame, texts: DataFrame) -> DataFrame:
    """``(doc_id, para_id, sent_id, conllu)`` of tokens converted by ``ud.convert``;
    ``texts`` has the ``text`` of each sentence."""
    keys = ["doc_id", "para_id", "sent_id"]
    lines = converted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tok_id", "value", "lemma", "upos", "tags", "feats", "misc"))).alias("t"))
    row = lambda t, i: F.concat_ws("\t", (i + 1).cast("string"), t["value"], t["lemma"], t["upos"], t["tags"], t["feats"], F.lit("_"), F.lit("_"), F.lit("_"), t["misc"])
    body = _join(F.transform("t", row), "\n")
    head = F.concat(F.lit("# sent_id = "), (F.col("sent_id") + 1).cast("string"), F.lit("\n# text = "), F.trim("text"), F.lit("\n"))
    return lines.join(texts, keys).select(*keys, F.concat(head, body, F.lit("\n")).alias("conllu"))


def wrapped(body: Column, output: str) -> Column:
    """A document's sentences inside the outer element or object."""
    if output == "xml":
        return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<text>\n'), body, F.lit("</text>\n"))
    return F.concat(F.lit('{"sentences": [\n'), body, F.lit("\n]}\n"))


def documents(sents: DataFrame, output: str, token_format: bool = False) -> DataFrame:
    """``(doc_id, body)``: each document's sentences in order, serialised and wrapped. One
    group is one document."""
    one = {"txt": lambda: txt(F.col("tokens")), "xml": lambda: xml(F.col("tokens"), token_format), "json": lambda: json(F.col("tokens"), token_format), "vertical": lambda: vertical(F.col("tokens"))}[output]()
    rows = sents.select("doc_id", F.struct("para_id", "sent_id", one.alias("s")).alias("x"))
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"])
    body = F.array_join(parts, ",\n" if output == "json" else "" if output in ("xml", "vertical") else "\n")
    out = rows.groupBy("doc_id").agg(body.alias("body"))
    return out.withColumn("body", wrapped(F.col("body"), output)) if output in ("xml", "json") else out


def tokenised(docs: DataFrame, words: bool = False, only_words: bool = False, output: str = "txt", separator: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_space: bool = False, newline: str = " ") -> DataFrame:
    """``(id, body)`` of the tokenizer: sentences or word lists as txt, xml or json; with
    ``keep_space`` the white space between words too, line ends as ``newline``. Native, without a shuffle."""
    from textloom.functions import tokenize as T

    sents = F.flatten(F.transform(T.paragraphs(F.col(text_col)), lambda p: T.sentences(p, separator, "\n" if keep_space else newline)))
    if not words and not only_words:
        body = {"txt": F.array_join(sents, "\n"), "json": F.to_json(sents), "xml": F.concat(F.lit("<text>\n"), F.array_join(F.transform(sents, lambda s: F.concat(F.lit("<sentence>"), xml_escape(s), F.lit("</sentence>\n"))), ""), F.lit("</text>\n"))}[output]
        return docs.select(id_col, body.alias("body"))
    lists = F.transform(sents, lambda s: T.only_words(s) if only_words else T.particles(T.tokens(s, keep_space, newline)))
    sep = " " if only_words else "|"
    body = {"txt": F.array_join(F.transform(lists, lambda w: F.array_join(w, sep)), "\n"), "json": F.to_json(lists), "xml": F.concat(F.lit("<text>\n"), F.array_join(F.transform(lists, lambda w: F.concat(F.lit("<sentence>"), F.array_join(F.transform(w, lambda x: F.concat(F.lit("<word>"), xml_escape(x), F.lit("</word>"))), ""), F.lit("</sentence>\n"))), ""), F.lit("</text>\n"))}[output]
    return docs.select(id_col, body.alias("body"))


def write_ordered(df: DataFrame, path: str, order: list[str], column: str = "body") -> None:
    """Text files in order of the keys: range-partitioned and sorted within files, so the
    files in name order give the whole and no task holds everything."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, order: list) -> None:
    """A statistics report as tab-separated files, sorted."""
    df.orderBy(*order).write.mode("overwrite").option("sep", "\t").csv(path)


def write_by_status(cleaned: DataFrame, path: str) -> None:
    """Cleaned texts in folders by status, so that rejected ones are kept apart."""
    cleaned.write.mode("overwrite").partitionBy("status").parquet(path)


def write_as_is(raw: DataFrame, path: str) -> None:
    """Files that are not cleaned (excluded, or decoded without a text), with their bytes as they were:
    ``(path, content)`` as a table."""
    raw.select("path", "content").write.mode("overwrite").parquet(path)
