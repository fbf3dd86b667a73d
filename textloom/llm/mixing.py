"""Problem 9: mixing sources to target shares, sized in tokens.

Efraimidis-Spirakis sampling: each document draws u from a hash of its id and
gets the key ``-ln(u) / weight``; a source takes whole epochs of its documents
first and then, in key order, documents until the rest of its budget is filled. The document
that crosses the rest is taken if that comes nearer to it than leaving it.

A source may hold any share of the corpus, so no window runs over a whole source: documents
fall into ``BINS`` bins in order of their keys, sizes are pre-aggregated by (source, bin),
the running totals of that small table give every bin its offset, and only
documents of the same bin are ordered against each other. Bins are even whatever the weights:
a key's bin is its rank as expected from the source's weights, counted in ``WEIGHTS`` steps.

Defined cases: null text has size 0; a null or unnamed source takes no part;
source names are compared without outer blanks and letter case; a source of the
targets without documents is reported with size 0; null shares or repeats count
as 0; documents of size 0 come as often as whole epochs are taken; no document comes more often than
``max_repeats``; ties in the key are broken by document id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.tokenize_ids import sizes

#: Ordered key bins of each source; a bin holds about 1/4096 of it. Steps of the weights.
BINS, WEIGHTS = 4096, 16


def source_key(c: Column) -> Column:
    """Source name without outer blanks and letter case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$", ""))


def quality_weight(text: Column) -> Column:
    """Sampling weight in [0.1, 1]: the share of letters and blanks in the text."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{M} \n]", ""))
    return F.greatest(F.lit(0.1), F.coalesce(plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.1)))


def sized_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, src, weight, n_tokens)`` of the documents with a source."""
    d = docs.select("doc_id", source_key(F.col("source")).alias("src"), quality_weight(F.col("text")).alias("weight"), "text")
    return sizes(d.filter(F.col("src").isNotNull()), ["doc_id", "src", "weight"], path=path)


def source_report(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source of the targets: what is there, what is wanted, how many
    epochs and what rest it takes, and whether it falls short.

    The total is the size of all documents whose source is named; every source
    may take ``target_share`` of it, at most ``max_repeats`` times what it has.
    """
    t = targets.select("source", source_key(F.col("source")).alias("src"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    by = sized.groupBy("src").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n_docs"))
    # targets is a short table of fixed size; by has at most one row for each of them
    named = t.join(by, "src", "left").withColumns({"size": F.coalesce("size", F.lit(0)), "n_docs": F.coalesce("n_docs", F.lit(0))})
    named = named.withColumn("total", F.sum("size").over(W.partitionBy()))
    want = F.col("target_share") * F.col("total")
    can = F.col("size") * F.col("max_repeats")
    named = named.withColumns({"wanted": want, "short": can < want, "budget": F.least(want, can.cast("double"))})
    named = named.withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(0).cast("int"))
    return named.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))


def reached(report: DataFrame, mixture: DataFrame) -> DataFrame:
    """The report with the ``reached`` size and share of the documents that ``mix`` takes,
    which are whole: off the plan by up to half a document of a source."""
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached"))
    r = report.join(got, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    return r.withColumn("reached_share", F.coalesce(F.col("reached") / F.nullif(F.sum("reached").over(W.partitionBy()), F.lit(0)), F.lit(0.0)))


def _binned(sized: DataFrame, seed: int) -> DataFrame:
    """``sized`` with its sampling ``key`` and ``bin``."""
    u = (F.abs(F.xxhash64("doc_id", F.lit(seed)) % (1 << 40)) + 0.5) / float(1 << 40)
    step = F.ceil(F.col("weight") * WEIGHTS) / WEIGHTS
    # how a source's weights are spread: at most WEIGHTS numbers for each source of the targets
    by = sized.groupBy("src", step.alias("w")).agg(F.count("*").alias("n"))
    spread = by.groupBy("src").agg(F.collect_list(F.struct("w", "n")).alias("weights"), F.sum("n").alias("of"))
    keyed = sized.withColumn("key", -F.log(u) / F.col("weight")).join(F.broadcast(spread), "src")
    rank = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x["n"] * (1 - F.exp(-x["w"] * F.col("key")))) / F.col("of")
    return keyed.withColumn("bin", F.least(F.floor(rank * BINS), F.lit(BINS - 1)).cast("int")).drop("weights", "of")


def mix(sized: DataFrame, report: DataFrame, seed: int = 42) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of the documents that the mixture takes.

    ``sized`` is read three times; pass a cut DataFrame. The report has a row for each source of
    the targets, so sizes and weights by source may be broadcast.
    """
    quota = report.select("src", "source", "epochs", "rest", "max_repeats")
    keyed = _binned(sized.join(F.broadcast(quota.select("src")), "src", "left_semi"), seed)
    per_bin = keyed.groupBy("src", "bin").agg(F.sum("n_tokens").alias("bin_size"))
    before = per_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(W.partitionBy("src").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("src", "bin", "before")
    edge = before.join(F.broadcast(quota), "src")
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("src", "bin").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    more = (F.col("n_tokens") > 0) & (F.col("before") + inside + F.col("n_tokens") / 2 < F.col("rest"))
    out = keyed.join(F.broadcast(edge), ["src", "bin"]).withColumn("copies", F.least(F.col("epochs") + more.cast("int"), F.col("max_repeats")))
    return out.filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")
