"""Problem 4: per-document text statistics and a verdict of prose, list, table or junk.

The statistics of ``shape_features`` are counted in one Arrow pass. Ordered rule lists are
induced by incremental reduced-error pruning on labelled documents, each exported as a SQL CASE,
applied natively, and the verdict is that of most lists. The labelled documents are laid out by
rule from words and sentences of a bounded sample of the corpus (``shape_examples``), so the
label is known. A quarter of them is held out to measure the lists; on the texts of the sample, which
have no labels, it is measured how often the lists agree.

Damage by encoding does not count: garbled lines are restored and odd characters made
legible first, and what is lost for good counts as letters.

Defined cases: null, empty and blank texts have null statistics and a null verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import rule_lists
from textloom.llm.char_model import CharModel
from textloom.llm.encoding_repair import TOGETHER, Repairer, legible
from textloom.llm.encoding_repair import fit as fit_encoding
from textloom.llm.shape_examples import examples
from textloom.llm.shape_features import FEATURES, STATS, features, word_hashes
from textloom.llm.term_counts import term_counts
from textloom.runtime import spread

__all__ = ["STATS", "Shapes", "common_words", "learn_shapes", "shapes"]

#: Documents laid out by rule, and texts drawn for their words and sentences;
#: of a longer text only as much is drawn as ``DRAWN_CHARS`` (an excerpt for training; every
#: text is judged whole).
EXAMPLES, DRAWN, DRAWN_CHARS = 9_000, 500, 20_000
#: Rule lists induced on three quarters of them, each on other splits for growing and pruning.
TRIALS = 9
ORDER, DEFAULT = ["table", "junk", "list"], "prose"
NAMES = [DEFAULT, *ORDER]
#: Words that count as common: those in the most records.
COMMON = 150


class Shapes:
    """The learned rule lists with the hashes of the common words, and how often their verdict
    errs on held-out documents; ``agreed`` is the share of corpus texts on which all lists agree."""

    def __init__(self, lists: list[list[rule_lists.Rule]], common: np.ndarray, held_out: float, agreed: float):
        self.lists, self.common, self.held_out, self.agreed = lists, common, held_out, agreed

    def decide(self, texts: list[str | None]) -> np.ndarray:
        """The verdicts of texts, as ``column`` gives them; blank texts are ``prose``."""
        return vote(np.nan_to_num(features(texts, self.common)), self.lists)

    def column(self) -> Column:
        """The verdict of most lists over the columns of ``FEATURES``; of equal ones the first
        of ``NAMES``."""
        # one number holds the votes for each verdict, so that no CASE is stated twice
        code = {n: f"{1 << 8 * k}" for k, n in enumerate(NAMES)}
        votes = sum((F.expr(rule_lists.to_sql(rules, FEATURES, DEFAULT, code)) for rules in self.lists), F.lit(0))

        def top(v: Column) -> Column:
            count = [F.shiftright(v, 8 * k).bitwiseAND(255) for k in range(len(NAMES))]
            most = F.greatest(*count)
            return F.coalesce(*(F.when(c == most, n) for c, n in zip(count, NAMES)))

        return F.transform(F.array(votes), top)[0]


def vote(x: np.ndarray, lists: list[list[rule_lists.Rule]]) -> np.ndarray:
    """The verdict of most lists on each row of features."""
    said = np.stack([rule_lists.decide(x, rules, DEFAULT) for rules in lists])
    return np.array(NAMES)[np.stack([(said == n).sum(0) for n in NAMES]).argmax(0)]


def common_words(df: DataFrame, text_col: str = "text") -> list[str]:
    """The ``COMMON`` terms in the most records (a list of fixed length)."""
    t = term_counts(df, text_col).filter("not term rlike '[0-9]'").orderBy(F.desc("records"), "term").limit(COMMON)
    return [r.term for r in t.select("term").collect()]


def _induce(x: np.ndarray, y: np.ndarray) -> tuple[list[list[rule_lists.Rule]], float]:
    """The rule lists, and the share of held-out documents on which their verdict errs."""
    held = np.arange(len(x)) % 4 == 3
    lists = [rule_lists.induce(x[~held], y[~held], ORDER, seed=trial) for trial in range(TRIALS)]
    return lists, float((vote(x[held], lists) != y[held]).mean())


def learn_shapes(df: DataFrame, common: list[str], fitted: tuple, id_col: str = "request_id", text_col: str = "text", n: int = EXAMPLES) -> Shapes:
    """The rule lists learned on ``n`` documents laid out by rule."""
    drawn = df.filter(F.col(text_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(DRAWN).select(F.substring(text_col, 1, DRAWN_CHARS).alias("text"))
    repairer = Repairer(*fitted)
    texts = [r.text for r in drawn.collect()]
    repairer.prepare(texts)
    texts = [legible(repairer.text(t)) for t in texts]
    laid_out = examples(texts, n)
    hashes = word_hashes(common)
    x, y = features([legible(t) for t, _ in laid_out], hashes), np.array([s for _, s in laid_out])
    x, y = x[~np.isnan(x[:, 0])], y[~np.isnan(x[:, 0])]
    lists, errs = _induce(x, y)
    own = features(texts, hashes)
    said = np.stack([rule_lists.decide(own[~np.isnan(own[:, 0])], rules, DEFAULT) for rules in lists])
    return Shapes(lists, hashes, errs, float((said == said[0]).all(0).mean()) if said.size else 1.0)


def shapes(df: DataFrame, id_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """``(id, statistics..., shape)``, one row for each input row."""
    fitted = fit_encoding(df, text_col, id_col)
    learned = learn_shapes(df, common_words(df, text_col), fitted, id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast((fitted[0].counts, fitted[1], learned.common))

    def run(batches):
        counts, margins, common = held.value
        r = Repairer(CharModel(counts), margins)
        for b in batches:
            texts = b.column(1).to_pylist()
            for k in range(0, len(texts), TOGETHER):
                part = texts[k : k + TOGETHER]
                r.prepare(part)
                x = features([t and legible(r.text(t)) for t in part], common)
                stats = [pa.array(c, pa.float64(), from_pandas=True) for c in x.T]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, len(part)), *stats], names=["id", *FEATURES])

    kind = df.schema[id_col].dataType.simpleString()
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    out = src.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} double" for c in FEATURES))
    return out.withColumn("shape", F.when(F.col("n_lines").isNotNull(), learned.column())).withColumnRenamed("id", id_col)
