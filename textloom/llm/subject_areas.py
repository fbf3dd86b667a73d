"""Problem 10: subject areas of documents, by label propagation.

The graph links documents by the verified terms that they share. It is kept in factors
(document-term links): what a document passes to its terms, and these to the sentences of other
documents, is what it would pass along its similarity links, without a row for each pair of
documents. A link is verified when its term is in enough documents and when the labels of its documents
differ enough from the corpus; a term of a large part of the corpus or of a language (it may
only be a common word there) when they also differ enough from those of its languages.

Hand-made labels are checked once: in the first round all of them are passed on, and a
label that its own document's links contradict is not trusted. Trusted labels are clamped in every
later round, whatever the graph says. A document keeps every subject that at least a quarter of
its sentences deal with. Rounds end when the mean change of the documents' shares is less than
``TOLERANCE``, or after ``ROUNDS``.

Equal texts are one document: the one with the least id stands for all of them, takes
their labels together and gives its subjects to each.

Every round is a chain of DataFrame joins and sums. Only the table of verified terms is broadcast:
a term in it makes up at least ``LEAST_SHARE`` of all (document, term) pairs, so it has at most
1 / ``LEAST_SHARE`` rows.

Defined cases: null, empty and blank texts, and texts without verified terms, have no
subject; labels with unknown subjects, null ids or ids of no document are left out;
repeated labels count once; without labels there are no subjects.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.encoding_repair import legible
from textloom.llm.sentence_units import Splitter, corpus_counts, top_words
from textloom.runtime import cut, cut_by, spread

LEAST_SHARE = 2e-6
#: Share of documents, of the corpus and of a language, above which a term must also tell
#: something beyond the language of its documents.
MOST_SHARE, MOST_SHARE_OF_LANGUAGE = 0.1, 0.25
#: Documents of a language from which its own share counts.
LANGUAGE_DOCS = 20
#: Most rounds; mean change of a document's shares (summed over subjects) at which they end.
ROUNDS, TOLERANCE = 10, 0.02
#: Prior labels of a term; least information (nats) of a verified term; bounds of its
#: weight; least probability, given its terms, for a sentence to have a subject.
PRIOR, INFORMATION, LOW, HIGH, SURE = 2.0, 0.15, -2.5, 3.0, 0.75
#: Share of a document's sentences from which it deals with a subject; share from
#: which it passes a subject on; share under which the graph contradicts a label.
DEALS, PASSES, CONTRADICTS = 0.25, 0.2, 0.1
_TERM = re.compile(r"[^\W\d_]{3,}(?:['’ʼ-][^\W\d_]+)*")


def sentence_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, lang, n_sentences, sentences)``: the terms of each sentence, as hashes."""
    # words by share of the corpus, at most 1 / LEAST_SHARE of them; of rarer ones the document tells
    counts = cut(corpus_counts(docs, text_col).filter((F.col("dot") > 0) | (F.col("cap_start") > 0)))
    held = docs.sparkSession.sparkContext.broadcast(top_words(counts, LEAST_SHARE))

    def run(batches):
        corpus = held.value
        memo: dict[str, int] = {}
        for b in batches:
            sents = []
            for text in b.column(2).to_pylist():
                doc = []
                text = legible(text)
                for a, z in Splitter(text, corpus).spans():
                    terms = set(_TERM.findall(text[a:z].lower()))
                    for t in terms:
                        if t not in memo:
                            memo[t] = xxhash.xxh64_intdigest(t) - (1 << 63)
                    doc.append(sorted(memo[t] for t in terms))
                if len(memo) > 300_000:
                    memo.clear()
                sents.append(doc)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sents], pa.int32()), pa.array(sents, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "lang", "n_sentences", "sentences"])

    lang = F.coalesce(F.regexp_extract(F.lower(F.substring(F.trim(lang_col), 1, 2)), "^[a-z]{2}$", 0), F.lit(""))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text")).filter("text is not null and doc_id is not null")
    return spread(src).mapInArrow(run, "doc_id bigint, lang string, n_sentences int, sentences array<array<bigint>>").filter("n_sentences > 0")


def text_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, of)``: the least id of the documents with the same text."""
    each = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("same")).filter("doc_id is not null and same is not null")
    return each.join(each.groupBy("same").agg(F.min("doc_id").alias("of")), "same").select("doc_id", "of")


def verified_terms(d: DataFrame) -> DataFrame:
    """``(term, docs, often)`` of the terms in enough documents, and whether they are in so
    many, of the corpus or of a language, that they may be common words."""
    of = d.groupBy("lang").agg(F.count("*").alias("n_lang"), F.sum(F.size(F.array_distinct(F.flatten("sentences")))).alias("pairs"))
    langs = of.collect()  # two small letters, else "": at most 677 languages
    n, total = sum(r.n_lang for r in langs), sum(r.pairs for r in langs)
    by = d.select("lang", F.explode(F.array_distinct(F.flatten("sentences"))).alias("term")).groupBy("term", "lang").agg(F.count("*").alias("n"))
    share = F.coalesce(*(F.when(F.col("lang") == r.lang, F.col("n") / r.n_lang) for r in langs if r.n_lang >= LANGUAGE_DOCS), F.lit(0.0))
    terms = by.groupBy("term").agg(F.sum("n").alias("docs"), F.max(share).alias("share"))
    often = (F.col("docs") > MOST_SHARE * max(n, LANGUAGE_DOCS)) | (F.col("share") > MOST_SHARE_OF_LANGUAGE)
    return terms.filter(F.col("docs") >= max(2, total * LEAST_SHARE)).select("term", "docs", often.alias("often"))


def seeds(labels: DataFrame, names: list[str], copies: DataFrame) -> DataFrame:
    """``(doc_id, s0, s1, ...)``: how many copies of the text were labelled with each subject."""
    s = F.lower(F.trim("subject"))
    each = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.max((s == name).cast("double")).alias(f"s{k}") for k, name in enumerate(names)))
    return each.join(copies, "doc_id").groupBy(F.col("of").alias("doc_id")).agg(*(F.sum(c).alias(c) for c in _cols(len(names)))).fillna(0.0)


def _cols(k: int) -> list[str]:
    return [f"s{i}" for i in range(k)]


def _weights(passed: DataFrame, d: DataFrame, terms: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """``(term, w0, w1, ...)`` of the terms whose documents' labels tell something, and the
    share of each subject in what the documents pass on."""
    s, e = _cols(k), [f"e{i}" for i in range(k)]
    passed = d.select("doc_id", "lang", F.array_distinct(F.flatten("sentences")).alias("t")).join(passed, "doc_id")
    by = passed.groupBy("lang").agg(*(F.sum(c).alias(c) for c in s)).collect()
    total = {c: sum(r[c] for r in by) for c in s}
    mass = sum(total.values())
    if not mass:
        return terms.select("term", *(F.lit(0.0).alias(f"w{i}") for i in range(k))).limit(0), [1 / max(k, 1)] * k
    prior = [max(total[c] / mass, 1e-4) for c in s]
    # what a document of its language passes on: the labels to expect of a term that tells nothing more
    mean = [(r["lang"], *(max(r[c] / sum(r[c] for c in s), 1e-4) for c in s)) for r in by]
    mean = d.sparkSession.createDataFrame(mean, "lang string, " + ", ".join(f"{c} double" for c in e))
    # the documents are partitioned by id: only what is passed on moves, then sums by term
    pairs = passed.join(F.broadcast(mean), "lang").select(*s, *e, F.explode("t").alias("term"))
    got = pairs.join(F.broadcast(terms.select("term", "often")), "term").groupBy("term", "often").agg(*(F.sum(c).alias(c) for c in s + e))
    n = sum((F.col(c) for c in s), F.lit(0.0))
    n_e = sum((F.col(c) for c in e), F.lit(0.0))

    def told(p, q):
        return sum((x * F.log(x / y) for x, y in zip(p, q)), F.lit(0.0))

    p = [(F.col(c) + PRIOR * q) / (n + PRIOR) for c, q in zip(s, prior)]
    of_languages = [F.col(c) / n_e for c in e]
    beyond = told([(F.col(c) + PRIOR * q) / (n + PRIOR) for c, q in zip(s, of_languages)], of_languages)
    return got.filter((told(p, prior) > INFORMATION) & (~F.col("often") | (beyond > INFORMATION))).select("term", *(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.log(x / q))).alias(f"w{i}") for i, (x, q) in enumerate(zip(p, prior)))), prior


def _shares(d: DataFrame, weights: DataFrame, prior: list[float], k: int) -> DataFrame:
    """``(doc_id, s0, s1, ...)``: share of the document's sentences with each subject."""
    w = [f"w{i}" for i in range(k)]
    sents = d.select("doc_id", "n_sentences", F.posexplode("sentences").alias("sent", "terms")).select("doc_id", "n_sentences", "sent", F.explode("terms").alias("term"))
    each = sents.join(F.broadcast(weights), "term").groupBy("doc_id", "n_sentences", "sent").agg(*(F.sum(c).alias(c) for c in w))
    # the probability of each subject given the sentence's terms; the array is made once for each sentence
    odds = F.array(F.array(*(F.exp(F.col(c)) * q for c, q in zip(w, prior))))

    def winner(o):
        return F.when(F.array_max(o) >= SURE * F.aggregate(o, F.lit(0.0), lambda a, x: a + x), F.array_position(o, F.array_max(o)) - 1)

    each = each.select("doc_id", "n_sentences", F.transform(odds, winner)[0].alias("best")).filter("best is not null")
    return each.groupBy("doc_id", "n_sentences").agg(*((F.sum((F.col("best") == i).cast("double")) / F.col("n_sentences")).alias(f"s{i}") for i in range(k))).drop("n_sentences")


def trusted(shares: DataFrame, seeded: DataFrame, k: int) -> DataFrame:
    """``(doc_id, s0, s1, ...)``: the labels that the links of their documents do not contradict,
    as shares of what the document passes on. Documents without a trusted label are left out."""
    s = _cols(k)
    both = seeded.join(shares.select("doc_id", *(F.col(c).alias(f"g{c}") for c in s)), "doc_id")
    good = {c: F.when(F.col(f"g{c}") >= CONTRADICTS, F.col(c)).otherwise(0.0) for c in s}
    total = sum(good.values(), F.lit(0.0))
    return both.filter(total > 0).select("doc_id", *((good[c] / total).alias(c) for c in s))


def _pass_on(shares: DataFrame, clamped: DataFrame, k: int) -> DataFrame:
    """What the documents pass on: the clamped labels, else the subjects that enough of their
    sentences have."""
    s = _cols(k)
    found = {c: F.when(F.col(c) >= PASSES, F.col(c)).otherwise(0.0) for c in s}
    total = sum(found.values(), F.lit(0.0))
    free = shares.filter(total > 0).select("doc_id", *((found[c] / total).alias(c) for c in s))
    return free.join(clamped.select("doc_id"), "doc_id", "left_anti").unionByName(clamped)


def change(a: DataFrame, b: DataFrame, k: int) -> float:
    """Mean change of the shares of a document between two rounds."""
    s = _cols(k)
    both = a.join(b.select("doc_id", *(F.col(c).alias(f"b{c}") for c in s)), "doc_id", "full")
    zero = F.lit(0.0)
    moved = sum((F.abs(F.coalesce(c, zero) - F.coalesce(f"b{c}", zero)) for c in s), zero)
    return both.agg(F.avg(moved)).first()[0] or 0.0


def subject_shares(docs: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[str]]:
    """``(doc_id, s0, s1, ...)`` with the share of sentences for each subject, and the
    names of the subjects (a short fixed table)."""
    names = [r[0] for r in subjects.select(F.lower(F.trim("subject"))).filter("subject is not null").distinct().orderBy(F.lower(F.trim("subject"))).collect()]
    k = len(names)
    copies = cut(text_copies(docs))
    d = cut_by(sentence_terms(docs), "doc_id", within=copies.filter("doc_id = of"))
    terms = cut(verified_terms(d))
    seeded = seeds(labels, names, copies)
    n = sum((F.col(c) for c in _cols(k)), F.lit(0.0))
    passed = seeded.filter(n > 0).select("doc_id", *((F.col(c) / n).alias(c) for c in _cols(k)))
    clamped = shares = None
    for _ in range(rounds):
        before, shares = shares, cut(_shares(d, *_weights(passed, d, terms, k), k), partitioned=True)
        if before is None:
            clamped = cut(trusted(shares, seeded, k), partitioned=True)
        elif change(before, shares, k) < TOLERANCE:
            break
        passed = _pass_on(shares, clamped, k)
    return copies.join(shares.withColumnRenamed("doc_id", "of"), "of").drop("of"), names


def subjects_of(shares: DataFrame, names: list[str]) -> DataFrame:
    """``(doc_id, subject, share)`` of each subject that a document deals with."""
    each = F.array(*(F.struct(F.lit(name).alias("subject"), F.col(f"s{i}").alias("share")) for i, name in enumerate(names)))
    return shares.select("doc_id", F.explode(each).alias("x")).filter(F.col("x.share") >= DEALS).select("doc_id", "x.subject", F.round("x.share", 6).alias("share"))
