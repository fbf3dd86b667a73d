"""Problem 5: frequency of every term, by last-seen counters.

Each task walks its records in order. A term keeps its occurrences, the number of
records that hold it and the last record that did; no set of records is kept.
A record lies wholly in one task, so the counters of all tasks add up exactly, and
a term that holds a third of all tokens shuffles one row from each task.

Defined cases: null texts are no records; empty and blank texts are records
without terms; rows with equal ids are separate records.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import spread

TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Counters held by a task before they are handed on; bounds its memory.
HELD = 300_000
#: A term is rare up to so many records, common in more than this share of them.
RARE_RECORDS, COMMON_ONE_IN = 1, 5


def lower_each(s: str) -> str:
    """Lower case character by character (a final sigma is like any other)."""
    return "".join(map(str.lower, s)) if "Σ" in s else s.lower()


def _counted(counters: dict) -> pa.RecordBatch:
    c = list(counters.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counters), pa.string()), pa.array([x[0] for x in c], pa.int64()), pa.array([x[1] for x in c], pa.int64())], names=["term", "occurrences", "records"]
    )


def _partial(batches):
    counters: dict[str, list[int]] = {}
    record = 0
    for b in batches:
        for text in b.column(0).to_pylist():
            record += 1
            for term in TERM.findall(lower_each(text)):
                c = counters.get(term)
                if c is None:
                    counters[term] = [1, 1, record]
                else:
                    c[0] += 1
                    if c[2] != record:
                        c[1] += 1
                        c[2] = record
            if len(counters) > HELD:
                yield _counted(counters)
                counters = {}
    if counters:
        yield _counted(counters)


def term_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, occurrences, records, mark)``; mark is rare, common or null."""
    texts = df.select(F.col(text_col).alias("text")).filter("text is not null")
    n = texts.count()
    out = spread(texts).mapInArrow(_partial, "term string, occurrences bigint, records bigint")
    out = out.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    # in a collection so small that one record is more than the share, rare goes first
    return out.withColumn("mark", F.when(F.col("records") <= RARE_RECORDS, "rare").when(F.col("records") * COMMON_ONE_IN > n, "common"))
