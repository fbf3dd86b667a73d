"""Known words: joins on the lexicon tables, and rewrites that ask whether a word is known.

Lexicons are DataFrames. Where an operator only filters or looks up, it is a join and
Catalyst chooses the strategy. A rewrite whose outcome depends on the answer for a
word it has itself put together runs in one Arrow pass: with the forms broadcast if
there are at most ``BROADCAST_FORMS`` of them, else in rounds, in which the words asked
for are joined with the lexicon until no text asks for more.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.normalize import known_form
from textloom.runtime import cut, spread

#: Forms up to which a lexicon is broadcast (some 50 MB).
BROADCAST_FORMS = 1_000_000
Rewrite = Callable[[str, "Lexicon"], str]


def forms(lexicon: DataFrame, column: str = "form") -> DataFrame:
    """Distinct non-null forms of a lexicon, in the form in which it is asked."""
    return lexicon.filter(F.col(column).isNotNull()).select(known_form(F.col(column)).alias("form")).distinct()


def known(df: DataFrame, word: str, lexicon: DataFrame) -> DataFrame:
    """Rows whose word the lexicon knows, as it is or in small letters (left semi join)."""
    return _with_known(df, word, lexicon).filter("known").drop("known")


def unknown(df: DataFrame, word: str, lexicon: DataFrame) -> DataFrame:
    """Rows whose word is not null and not known."""
    return _with_known(df, word, lexicon).filter("not known").drop("known")


def _with_known(df: DataFrame, word: str, lexicon: DataFrame) -> DataFrame:
    """``df`` (null words left out) with a column ``known``."""
    # one join for both letter cases: the forms that differ in case only stand together
    x = forms(lexicon).groupBy(F.lower("form").alias("__low")).agg(F.collect_list("form").alias("__v"))
    w = known_form(F.col(word))
    df = df.filter(F.col(word).isNotNull()).withColumns({"__w": w, "__low": F.lower(w)}).join(x, "__low", "left")
    known = F.array_contains("__v", F.col("__w")) | F.array_contains("__v", F.col("__low"))
    return df.withColumn("known", F.coalesce(known, F.lit(False))).drop("__w", "__low", "__v")


def with_known(df: DataFrame, word: str, lexicon: DataFrame) -> DataFrame:
    """``df`` with a column ``known``, false for null words."""
    return _with_known(df, word, lexicon).unionByName(df.filter(F.col(word).isNull()).withColumn("known", F.lit(False)))


def inflect(lexicon: DataFrame, lemma: str, tag_pattern: str) -> DataFrame:
    """Distinct forms of a lemma whose tags match the whole pattern."""
    return lexicon.filter((F.col("lemma") == lemma) & F.col("tags").rlike(f"^(?:{tag_pattern})$")).select("form").distinct()


class Lexicon:
    """What a rewrite may ask: is a word known in uk, ru or en; has it a lemma."""

    def __init__(self, answers: dict[str, frozenset | set], complete: bool = True):
        self.answers, self.complete = answers, complete
        self.asked: set[tuple[str, str]] = set()
        self.told: dict[tuple[str, str], bool] = {}

    def has(self, word: str, lang: str = "uk") -> bool:
        w = word.replace("’", "'").replace("ʼ", "'").replace("́", "")
        return any(self._one(x, lang) for x in {w, w.lower()})

    def _one(self, w: str, lang: str) -> bool:
        if self.complete:
            return w in self.answers.get(lang, ())
        if (lang, w) in self.told:
            return self.told[lang, w]
        self.asked.add((lang, w))
        return False


class Prepared:
    """Lexicons made ready for rewrites: broadcast, or the table if they are too large."""

    def __init__(self, lexicons: dict[str, DataFrame], limit: int = BROADCAST_FORMS):
        self.table, self.held = None, None
        for lang, x in lexicons.items():
            f = forms(x).select(F.lit(lang).alias("lang"), "form")
            self.table = f if self.table is None else self.table.unionByName(f)
        if self.table is None:
            return
        rows = self.table.limit(limit + 1).toArrow()
        if rows.num_rows <= limit:
            answers: dict[str, set] = {}
            for lang, form in zip(rows.column("lang").to_pylist(), rows.column("form").to_pylist()):
                answers.setdefault(lang, set()).add(form)
            self.held = self.table.sparkSession.sparkContext.broadcast(answers)


def rewrite(df: DataFrame, steps: list[Rewrite], lexicons: dict[str, DataFrame] | Prepared, text_col: str = "text", limit: int = BROADCAST_FORMS) -> DataFrame:
    """``df`` with ``text_col`` rewritten by the steps in order. Null stays null."""
    p = lexicons if isinstance(lexicons, Prepared) else Prepared(lexicons, limit)
    if p.table is not None and p.held is None:
        return _in_rounds(df, steps, p.table, text_col)
    held = p.held

    def apply(text, _):
        x = Lexicon(held.value if held else {})
        for s in steps:
            text = s(text, x)
        return text, []

    return _pass(df, text_col, apply).drop("__asked")


def _pass(df: DataFrame, text_col: str, apply, told: bool = False) -> DataFrame:
    others = [c for c in df.columns if c != text_col and c != "__told"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others) + f", `{text_col}` string, `__asked` array<string>"

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 2).to_pylist()
            answers = b.column(b.num_columns - 1).to_pylist()
            out = [(None, []) if t is None else apply(t, a) for t, a in zip(texts, answers)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))], names=[*others, text_col, "__asked"])

    src = df.select(*others, text_col, F.col("__told") if told else F.lit(None).cast("array<string>").alias("__told"))
    return spread(src).mapInArrow(run, schema)


def _in_rounds(df: DataFrame, steps: list[Rewrite], table: DataFrame, text_col: str) -> DataFrame:
    """The rewrite for a lexicon that may not be broadcast: every round answers what the
    texts asked in the round before. A round answers a new question of every row that is left,
    so they end."""
    columns = df.columns
    todo = cut(df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__told", F.array().cast("array<string>")))
    done = None

    def apply(text, told):
        x = Lexicon({}, complete=False)
        for entry in told or ():
            yes, lang, w = entry.split("\t", 2)
            x.told[lang, w] = yes == "1"
        out = text
        for s in steps:
            out = s(out, x)
        return (text, sorted(f"{lang}\t{w}" for lang, w in x.asked)) if x.asked else (out, [])

    while True:
        ran = cut(_pass(todo, text_col, apply, told=True))
        finished = ran.filter(F.size("__asked") == 0)
        done = finished if done is None else done.unionByName(finished)
        rest = ran.filter(F.size("__asked") > 0)
        if rest.isEmpty():
            break
        asked = rest.select("__row", F.explode("__asked").alias("q")).withColumns({"lang": F.substring_index("q", "\t", 1), "form": F.substring_index("q", "\t", -1)})
        told = asked.join(table.withColumn("__yes", F.lit("1")), ["lang", "form"], "left").withColumn("a", F.concat(F.coalesce("__yes", F.lit("0")), F.lit("\t"), "q"))
        told = told.groupBy("__row").agg(F.collect_list("a").alias("__new"))
        before = todo.select("__row", "__told")
        todo = cut(rest.drop("__asked").join(before, "__row").join(told, "__row").withColumn("__told", F.concat("__told", "__new")).drop("__new"))
    return done.select(*columns)
