"""Ranking of readings by corpus statistics.

``rank_by_rate`` and the derivation of statistics are native joins, aggregations and
windows. ``rank_sentences`` adds context and agreement; it depends on what was
chosen for the token before, so it folds over each sentence in one Arrow pass. The
statistics of a dictionary are of fixed size; they are broadcast when they have at most
``BROADCAST_ROWS`` rows, and beyond that the native ranking is the way.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from textloom.functions import normalize as N

BROADCAST_ROWS = 3_000_000
# Weights of the parts of a rate.
WORD_CONTEXT, TAG_CONTEXT, SHARE = 1e4, 1.2e8, 3.5
SUFFIX_SCALE, TAG_SCALE, UNFORCED = 6.1e3, 6.2e3, 6.1e5
PROPER_FACTOR, PROPER_RATE, LEMMA_FACTOR, AGREEMENT = 50.0, 0.9, 100.0, 0.35
_PROPER = re.compile(r"[А-ЯІЇЄҐ][а-яіїєґ'-]{3,}(-[А-ЯІЇЄҐ][а-яіїєґ'-]{3,})?")
_RIGHT = re.compile(N.RIGHT_WORDS)


def tag_rates(word_stats: DataFrame) -> DataFrame:
    """``(tags, rate, share)`` of normalised tags over the word statistics."""
    by = word_stats.groupBy(N.tag_for_rate(F.col("postag")).alias("tags")).agg(F.sum("rate").alias("rate"))
    return by.withColumn("share", F.col("rate") / F.sum("rate").over(W.partitionBy()))


def suffix_rates(word_stats: DataFrame, length: int = 3) -> DataFrame:
    """``(suffix, tags, rate)`` of word endings and normalised tags."""
    t = N.tag_for_rate(F.col("postag"))
    return word_stats.select(N.word_ending(F.col("word"), t, length).alias("suffix"), t.alias("tags"), "rate").filter("suffix is not null").groupBy("suffix", "tags").agg(F.sum("rate").alias("rate"))


def paradigm_rates(word_stats: DataFrame) -> DataFrame:
    """``(lemma, xp, share)``: how a lemma's words divide among its paradigms."""
    x = word_stats.filter(F.col("postag").contains(":xp")).groupBy("lemma", F.regexp_extract("postag", "xp[0-9]", 0).alias("xp")).agg(F.sum("rate").alias("rate"))
    return x.select("lemma", "xp", (F.col("rate") / F.sum("rate").over(W.partitionBy("lemma"))).alias("share"))


def write_derived(word_stats: DataFrame, path: str) -> None:
    """The derived statistics as parquet tables: tags, suffixes, paradigms."""
    for name, df in (("tags", tag_rates(word_stats)), ("suffixes", suffix_rates(word_stats)), ("paradigms", paradigm_rates(word_stats))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def rank_by_rate(tokens: DataFrame, word_stats: DataFrame, key: list[str]) -> DataFrame:
    """One row for each reading, with ``rate``, ``rank`` and ``confidence``. Ties keep the
    order of the readings. Null rates count as 0; a token without rates has confidence 0."""
    r = tokens.select(*key, "value", F.posexplode("readings").alias("reading_id", "r")).select(*key, "value", "reading_id", "r.lemma", "r.tags")
    stats = word_stats.select(F.col("word").alias("value"), "lemma", F.col("postag").alias("tags"), "rate").groupBy("value", "lemma", "tags").agg(F.max("rate").alias("rate"))
    r = r.join(stats, ["value", "lemma", "tags"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    w = W.partitionBy(*key)
    sum_ = F.sum("rate").over(w)
    return r.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("rate"), "reading_id")), "confidence": F.round(F.when(sum_ > 0, F.col("rate") / sum_).otherwise(0.0), 3)})


def agreements(tags: str) -> set[tuple]:
    """What gender (or plural), case and animacy a tag can agree in."""
    m = re.search(r":([mfnp])(?=:|$)", tags)
    c = re.search(r":v_(naz|rod|dav|zna|oru|mis|kly)", tags)
    if not m or not c:
        return set()
    if c[1] != "zna" or m[1] not in "mp":
        return {(m[1], c[1], "")}
    if tags.startswith("noun"):
        both = ":unanim" in tags
        return {(m[1], "zna", a) for a in ("anim", "inanim") if both or f":{a}:" in f"{tags}:"}
    if "rinanim" in tags:
        return {(m[1], "zna", "inanim")}
    return {(m[1], "zna", "anim")} if "ranim" in tags else {(m[1], "zna", "anim"), (m[1], "zna", "inanim")}


def _norm(tags: str) -> str:
    return re.sub(N.RATE_PARTS, "", tags)


def ending(word: str, tags: str, length: int = 3) -> str | None:
    """Python form of ``normalize.word_ending`` for the fold."""
    if not re.match("noun|adj|verb|adv", tags) or ":nv" in tags or len(word) <= length or not re.search("[а-яіїєґ]$", word) or re.search("-(що|бо|то|от|но|таки)$", word):
        return None
    n = length + 2 if re.match("(verb|advp):rev", tags) else length + 1 if word[-length] == "-" else length
    return word[-n:] if len(word) > n else None


class Statistics:
    """Rates by word, tag and ending, with the rates of their contexts."""

    def __init__(self, words: list[tuple], contexts: list[tuple]):
        self.word = defaultdict(dict)
        self.tag, self.suffix = defaultdict(float), defaultdict(float)
        self.paradigm = defaultdict(float)
        for word, lemma, postag, rate in words:
            t = _norm(postag)
            self.word[word][lemma, postag] = rate
            self.tag[t] += rate
            if e := ending(word, t):
                self.suffix[e, t] += rate
            if x := re.search("xp[0-9]", postag):
                self.paradigm[lemma, x[0]] += rate
        lemma_sum = defaultdict(float)
        for (lemma, _), rate in self.paradigm.items():
            lemma_sum[lemma] += rate
        self.paradigm = {k: v / lemma_sum[k[0]] for k, v in self.paradigm.items()}
        for table in (self.tag, self.suffix):
            total = sum(table.values()) or 1.0
            for k in table:
                table[k] /= total
        self.found: dict[tuple, _Contexts] = {}
        self.ctx = {"word": defaultdict(dict), "tag": defaultdict(lambda: defaultdict(float)), "suffix": defaultdict(lambda: defaultdict(float))}
        for word, lemma, postag, offset, c_word, c_lemma, c_tag, n in contexts:
            c, t = (offset, c_word, c_lemma, re.sub(N.CORE_PARTS, "", c_tag)), _norm(postag)
            self.ctx["word"][word, lemma, postag][c] = n
            self.ctx["tag"][t][c] += n
            if e := ending(word, t):
                self.ctx["suffix"][e, t][c] += n


def context_form(word: str, lemma: str, tags: str) -> str:
    """Python form of ``normalize.context_word`` for the fold."""
    if tags == "number":
        if m := re.fullmatch(r"(?:(?:1[6789]|20)[0-9]{2}[-–—])?(?:1[6789]|20)([0-9]{2})", word):
            return f"YY{m[1]}"
        plain = word.replace(" ", "")
        if re.fullmatch(r"(?:[0-9]+[-—–])?[0-9]+", plain):
            return "0" if re.search("([05-9]|1[0-9])$", plain) else "2" if plain[-1] in "234" else "1"
        if re.fullmatch(r"(?:[0-9,]+[–—-])?[0-9]+[,.][0-9]+", plain):
            return "0,0"
    w = word.replace("–", "-")
    if re.match("adj|noun", tags):
        w = re.sub("^[0-9-]*([0-9])-([а-яіїєґ]+)$", r"\1-\2", w)
    if w != word:
        return w
    if tags == "punct":
        return {"...": "…", "—": "-", "„": "«", "“": "»"}.get(word, word[0] if re.fullmatch(r"[?!]\.+", word) else word)
    return word.lower() if re.match("[а-яіїєґ]", lemma) else word


def _context(tokens: list[dict], at: int, offset: int) -> set[tuple]:
    """(offset, word, lemma, tag) of the readings of a neighbour; the ends have marks."""
    k = at + offset
    if not 0 <= k < len(tokens) - 1:
        return {(offset, "__BEG" if offset < 0 else "__END", "", "BEG" if offset < 0 else "END")}
    t = tokens[k]
    out = set()
    for r in t["readings"] or ():
        lemma = r["lemma"] or ""
        out.add((offset, context_form(t["clean"] or t["value"], lemma, r["tags"]), lemma.replace("–", "-"), re.sub(N.CORE_PARTS, "", r["tags"])))
    return out


class _Contexts:
    """The contexts of one word, tag or ending, found by neighbour word, tag or lemma."""

    def __init__(self, known: dict):
        self.by: dict[tuple, list[tuple[int, float]]] = defaultdict(list)
        for k, ((offset, word, lemma, tag), n) in enumerate(known.items()):
            self.by["w", offset, word].append((k, n))
            self.by["t", offset, tag].append((k, n))
            if tag.startswith("verb"):
                self.by["l", lemma].append((k, n))

    def sum(self, keys) -> float:
        """Counts of the contexts that any of the keys finds, each once."""
        found: dict[int, float] = {}
        for key in keys:
            found.update(self.by.get(key, ()))
        return sum(found.values())


def _by_context(s: Statistics, table: str, key, tags: str, tokens, at: int, chosen: list) -> float:
    by_tag = table != "word"
    total = 0.0
    known = s.ctx[table].get(key)
    if known:
        index = s.found.get((table, key))
        if index is None:
            index = s.found[table, key] = _Contexts(known)
        left = _context(tokens, at, -1)
        right = _context(tokens, at, 1) if _RIGHT.match((tokens[at]["clean"] or tokens[at]["value"]).lower()) else set()
        keys = {("w", o, w) for o, w, _, _ in left | right} | {("t", o, t) for o, _, _, t in right}
        if by_tag:
            keys |= {("t", o, t) for o, _, _, t in left if re.match("adj|noun|verb|advp", t)}
        total = index.sum(keys)
        if re.match(r"(adj|noun)(?!.*v_naz)", tags):
            total += LEMMA_FACTOR * index.sum({("l", lemma) for _, _, lemma, t in left if t.startswith("verb")})
    if by_tag and total < 1 and _agrees(tags, tokens, at, chosen):
        total = min(total + AGREEMENT, 1.0)
    return total


def _agrees(tags: str, tokens: list[dict], at: int, chosen: list) -> bool:
    """An adjective with the noun after it (or after one more adjective), a noun with the
    adjective chosen before it."""
    here = agreements(tags)

    def first_lemma(k: int) -> str:
        r = tokens[k]["readings"]
        return r[0]["lemma"] if r else ""

    def of(k: int, pos: str) -> set:
        return {a for r in tokens[k]["readings"] or () if r["tags"].startswith(pos) and not (pos == "noun" and "pron" in r["tags"]) for a in agreements(r["tags"])}

    if tags.startswith("adj"):
        linked = (tokens[at]["clean"] or "").lower() != "та" and first_lemma(at) != "який"
        if not linked or at + 1 >= len(tokens):
            return False
        if of(at + 1, "noun"):
            return bool(here & of(at + 1, "noun"))
        return at + 2 < len(tokens) and first_lemma(at + 1) != "який" and bool(here & of(at + 1, "adj")) and bool(here & of(at + 2, "noun"))
    if tags.startswith("noun") and "pron" not in tags and at and chosen[-1] and first_lemma(at) != "який":
        return chosen[-1].startswith("adj") and ":nv" not in chosen[-1] and bool(here & agreements(chosen[-1]))
    return False


def rank_tokens(tokens: list[dict], s: Statistics) -> list[list[tuple[float, int]]]:
    """For each token its readings as (rate, index), best first, chosen left to right."""
    chosen, out = [], []
    for at, t in enumerate(tokens):
        readings = t["readings"] or []
        word = t["clean"] or t["value"]
        if word not in s.word and word[:1].isupper() and any(":prop" not in r["tags"] for r in readings):
            word = word.lower()
        stats = s.word.get(word)
        norm = [_norm(r["tags"]) for r in readings]
        paradigms = [1 + s.paradigm.get((r["lemma"], m[0]), 0.0) / 10 if (m := re.search("xp[0-9]", r["tags"])) else 1.0 for r in readings]
        tag_sum = sum(s.tag.get(n, 0.0) * p for n, p in zip(norm, paradigms))
        ends = [ending(word, r["tags"]) for r in readings]
        end_sum = sum(s.suffix.get((e, n), 0.0) for e, n in zip(ends, norm) if e)
        rates = []
        for k, r in enumerate(readings):
            rate = (stats or {}).get((r["lemma"], r["tags"]), 0.0)
            if rate:
                rate += _by_context(s, "word", (word, r["lemma"], r["tags"]), r["tags"], tokens, at, chosen) * WORD_CONTEXT
            unforced = stats is not None and all(lemma != r["lemma"] for lemma, _ in stats)
            if at and ":prop" in r["tags"] and _PROPER.fullmatch(r["lemma"] or ""):
                rate = rate * PROPER_FACTOR if rate else PROPER_RATE
            for table, key, total, scale, factor in (("suffix", (ends[k], norm[k]), end_sum, SUFFIX_SCALE, 1.0), ("tag", norm[k], tag_sum, TAG_SCALE, paradigms[k])):
                base = getattr(s, table).get(key, 0.0) if table == "tag" or ends[k] else 0.0
                if base and total:
                    part = base / SHARE / total
                    part += _by_context(s, table, key, norm[k], tokens, at, chosen) * TAG_CONTEXT
                    rate += part * factor / (UNFORCED if unforced else scale)
            rates.append((rate, k))
        # guesses for an unknown word keep their order, but after a preposition
        if not t.get("guessed") or at and any(r["tags"].startswith("prep") for r in tokens[at - 1]["readings"] or ()):
            rates.sort(key=lambda x: -x[0])
        out.append(rates)
        chosen.append(readings[rates[0][1]]["tags"] if rates else "")
    return out


def load(word_stats: DataFrame, word_ctx_stats: DataFrame) -> Statistics:
    """The statistics, if they are small enough to broadcast."""
    for x in (word_stats, word_ctx_stats):
        if x.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            raise ValueError(f"more than {BROADCAST_ROWS} rows of statistics; use rank_by_rate")
    rows = lambda df, *columns: list(zip(*(c.to_pylist() for c in df.select(*columns).toArrow().columns)))
    return Statistics(rows(word_stats, "word", "lemma", "postag", "rate"), rows(word_ctx_stats, "word", "lemma", "postag", "offset", "ctx_word", "ctx_lemma", "ctx_postag", "cnt"))


def rank_sentences(sents: DataFrame, word_stats: DataFrame, word_ctx_stats: DataFrame, trace: bool = False) -> DataFrame:
    """``sents`` (of ``tag.sentences``) with readings in order of rate and ``rates``, three
    decimals of the share of each token's readings; ``trace`` adds a column with the rates themselves."""
    s = load(word_stats, word_ctx_stats)
    held = sents.sparkSession.sparkContext.broadcast((dict(s.word), dict(s.tag), dict(s.suffix), dict(s.paradigm), {k: {a: dict(b) for a, b in v.items()} for k, v in s.ctx.items()}))
    columns = ["rates", "trace"] if trace else ["rates"]
    schema = StructType([*sents.schema.fields, *(StructField(c, ArrayType(ArrayType(DoubleType()))) for c in columns)])

    def run(batches):
        x = Statistics([], [])
        x.word, x.tag, x.suffix, x.paradigm, x.ctx = held.value
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                tokens = r["tokens"] or []
                ranked = rank_tokens(tokens, x)
                r["rates"] = [[round(a / t, 3) if (t := sum(v for v, _ in rates)) else 0.0 for a, _ in rates] for rates in ranked]
                if trace:
                    r["trace"] = [[a for a, _ in rates] for rates in ranked]
                for t, rates in zip(tokens, ranked):
                    t["readings"] = [t["readings"][k] for _, k in rates] if t["readings"] else t["readings"]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = to_arrow_schema(schema)
    return sents.mapInArrow(run, schema)
