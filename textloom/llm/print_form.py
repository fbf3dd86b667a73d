"""Problem 2: one consistent form for text that prints alike.

A batch of Arrow text becomes one numpy code-point array. A lookup table gives
each code point its expansion (none, one or more code points), offsets place the
expansions, marks are put into canonical order, and letters are composed with
their marks vectorially. No string function runs per row.

What is folded: width forms, canonical decompositions and ligatures, characters
without ink, kinds of blank, kinds of apostrophe, the alphabet of letters of the
same shape, carriage returns before line feeds. What stays: words, digits, letter
case, accents, dashes, other punctuation and line breaks.

Defined cases: null stays null, empty stays empty; blank texts and texts equal as
strings make no pair; blanks at line ends and repeated blanks have no ink of their own
and count as written.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.codepoints import to_points, to_strings
from textloom.runtime import blank_to_null, cut, spread

# Letters of the same shape, each with the Latin letter that stands for it.
SAME_SHAPE = {
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ",
    "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "к": "κ", "æ": "ӕ", "Æ": "Ӕ", "ə": "ә", "Ə": "Ә", "ɵ": "ө", "Ɵ": "Ө", "Г": "Γ", "П": "Π", "Ф": "Φ", "ф": "φ",
}
APOSTROPHES = "'‘’‛ʼʻʽʹˈ′`´՚ꞌꞋ׳ߴ＇"
INKLESS_LETTERS = "͏ᅟᅠ឴឵ㅤﾠ"
LINE_BREAKS = "\u0085  "
LAST = 0x30000
HANGUL_S, HANGUL_N, HANGUL_V, HANGUL_T = 0xAC00, 11172, 21, 28
JAMO_L, JAMO_V, JAMO_T = 0x1100, 0x1161, 0x11A7


def _inkless(c: str, cat: str) -> bool:
    p = ord(c)
    return cat in ("Cf", "Cc") or c in INKLESS_LETTERS or 0x180B <= p <= 0x180F or 0xFE00 <= p <= 0xFE0F or 0xE0000 <= p <= 0xE0FFF


def _fold(c: str, shapes: dict[str, str]) -> str:
    """Expansion of one character, by the rules above."""
    cat = unicodedata.category(c)
    if c == "\n":
        return c
    if c in LINE_BREAKS:
        return "\n"
    if cat == "Zs" or c == "\t":
        return " "
    if c in APOSTROPHES:
        return "'"
    if _inkless(c, cat):
        return ""
    kind, _, rest = unicodedata.decomposition(c).rpartition("> ")
    kind = kind.lstrip("<")
    if rest and (kind in ("", "wide", "narrow", "noBreak") or kind == "compat" and cat[0] in "L" and ord(c) > 0xFF or kind == "compat" and 0x2160 <= ord(c) < 0x2180):
        return "".join(_fold(chr(int(x, 16)), shapes) for x in rest.split())
    return shapes.get(c, c)


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """The lookup tables, built once per process from Unicode's character data."""
    shapes = {c: base for base, same in SAME_SHAPE.items() for c in same}
    one = np.arange(0x110000, dtype=np.uint32)
    n = np.ones(0x110000, np.int8)
    many: dict[int, list[int]] = {}
    marks = np.zeros(0x110000, np.uint8)
    pairs: dict[tuple[int, int], int] = {}
    special = set(shapes) | set(APOSTROPHES) | set(INKLESS_LETTERS) | set(LINE_BREAKS) | {"\t"}
    for p in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, LAST), *range(0xE0000, 0xE1000)]:
        c = chr(p)
        marks[p] = unicodedata.combining(c)
        if 0xE0000 <= p or c in special or unicodedata.decomposition(c) or unicodedata.category(c)[0] in "ZC":
            x = [ord(y) for y in _fold(c, shapes)] if unicodedata.category(c) not in ("Cn", "Co", "Cs") else [p]
            n[p] = len(x)
            if len(x) == 1:
                one[p] = x[0]
            elif x:
                many[p] = x
            d = unicodedata.decomposition(c)
            if d and d[0] != "<" and len(d.split()) == 2 and unicodedata.normalize("NFC", c) == c:
                a, b = (_fold(chr(int(y, 16)), shapes) for y in d.split())
                # a letter that itself decomposes is found in composed form when its marks join one by one
                a = unicodedata.normalize("NFC", a)
                if len(a) == len(b) == 1:
                    pairs.setdefault((ord(a), ord(b)), p)
    big = np.array(sorted(many), np.uint32)
    start = np.cumsum([0, *(len(many[int(k)]) for k in big)])
    # after folding, a pair may be met by letters of several alphabets: one result for all
    keys = np.array([a << 21 | b for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return {
        "one": one, "n": n, "big": big, "start": start[:-1], "parts": np.array([y for k in big for y in many[int(k)]], np.uint32), "ccc": marks,
        "pair": keys[order], "to": np.array(list(pairs.values()), np.uint32)[order],
    }


def _row_of(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def _expand(points: np.ndarray, offs: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    after = np.append(points[1:], 0)
    last = np.zeros(len(points), bool)
    last[offs[1:][offs[1:] > offs[:-1]] - 1] = True
    cr = (points == 13) & ((after != 10) | last)  # a lone carriage return is a line break
    n = t["n"][points].astype(np.int64)
    n[cr] = 1
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.repeat(np.where(cr, 10, t["one"][points]).astype(np.uint32), n)
    wide = np.flatnonzero(n > 1)
    if len(wide):
        k = np.searchsorted(t["big"], points[wide])
        reps = n[wide]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out[np.repeat(at[wide], reps) + inner] = t["parts"][np.repeat(t["start"][k], reps) + inner]
    return _join_jamo(out, at[offs], np.repeat(points, n) == out)


def _join_jamo(p: np.ndarray, offs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hangul syllables from the letters that join (``own``: written so, not folded from
    letters that stand alone): first with second, then with a third one."""
    for first, n, step, second, m in ((JAMO_L, 19, 1, JAMO_V, HANGUL_V), (HANGUL_S, HANGUL_N, HANGUL_T, JAMO_T + 1, HANGUL_T - 1)):
        a = p.astype(np.int64) - first
        b = p.astype(np.int64) - second
        starts = np.zeros(len(p) + 1, bool)
        starts[offs] = True
        hit = np.flatnonzero((own & (a >= 0) & (a < n) & (a % step == 0))[:-1] & (own & (b >= 0) & (b < m))[1:] & ~starts[1:-1])
        if not len(hit):
            continue
        p[hit] = HANGUL_S + (a[hit] * HANGUL_V + b[hit + 1]) * HANGUL_T if step == 1 else p[hit] + b[hit + 1] + 1
        kept = np.ones(len(p), bool)
        kept[hit + 1] = False
        p, own, offs = p[kept], own[kept], np.concatenate([[0], np.cumsum(kept)])[offs]
    return p, offs


def _order_marks(p: np.ndarray, begins: np.ndarray, t: dict) -> np.ndarray:
    """Marks between two starters, sorted by combining class (stable); none goes past the beginning
    of its row (``begins``)."""
    ccc = t["ccc"][p]
    if not ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:])).any():
        return p
    run = np.cumsum((ccc == 0) | begins)
    return p[np.lexsort((np.arange(len(p)), ccc, run))]


def _compose(p: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Join starters with their marks, one mark of every starter at a time."""
    while True:
        ccc = t["ccc"][p]
        starter = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(p)), -1)) if len(p) else np.empty(0, np.int64)
        m = np.flatnonzero((ccc > 0) & (starter >= 0))
        m = m[row[starter[m]] == row[m]]
        # not blocked: directly after the starter, or the mark before it has a lower class
        m = m[(m - 1 == starter[m]) | (ccc[m - 1] < ccc[m])]
        if not len(m) or not len(t["pair"]):
            return p, row
        key = p[starter[m]].astype(np.int64) << 21 | p[m]
        k = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        hit = t["pair"][k] == key
        m, k = m[hit], k[hit]
        if not len(m):
            return p, row
        s, first = np.unique(starter[m], return_index=True)
        p = p.copy()
        p[s] = t["to"][k[first]]
        gone = np.ones(len(p), bool)
        gone[m[first]] = False
        p, row = p[gone], row[gone]


def print_form(col: pa.Array) -> pa.Array:
    """The consistent form of each text of an Arrow string array; nulls stay null."""
    t = tables()
    points, offs = to_points(col)
    p, offs = _expand(points, offs, t)
    row = _row_of(offs)
    begins = np.zeros(len(p), bool)
    begins[offs[:-1][offs[:-1] < offs[1:]]] = True
    p = _order_marks(p, begins, t)
    p, row = _compose(p, row, t)
    offs = np.searchsorted(row, np.arange(len(offs)))
    valid = np.asarray(col.is_valid()) if col.null_count else None
    return to_strings(p, offs, valid)


def normalise(df: DataFrame, id_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """``(id, print_text)``: every text in the consistent form."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), print_form(b.column(1)).cast(pa.string())], names=["id", "print_text"])

    kind = df.schema[id_col].dataType.simpleString()
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return src.mapInArrow(run, f"id {kind}, print_text string").withColumnRenamed("id", id_col)


def classes(df: DataFrame, id_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """``(id, form, variant)`` of every text that has ink: 128-bit digests of the
    consistent form and of the string as it is. Equal forms print alike."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), print_form(b.column(1)).cast(pa.string()), b.column(2)], names=["id", "form", "variant"])

    kind = df.schema[id_col].dataType.simpleString()
    src = df.filter(blank_to_null(F.col(text_col)).isNotNull())
    src = spread(src.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    src = src.withColumn("variant", F.md5("text"))
    out = src.mapInArrow(run, f"id {kind}, form string, variant string")
    return out.filter(blank_to_null(F.col("form")).isNotNull()).select(F.col("id").alias(id_col), F.md5("form").alias("form"), "variant")


def members(df: DataFrame, id_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, n_variants, n_texts)`` of every text that has ink: the least id of the
    texts that print alike, how many strings and how many texts they are. One row for each text,
    however many copies there are; a hot class is split by the adaptive skew join."""
    c = cut(classes(df, id_col, text_col))
    by = c.groupBy("form", "variant").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    by = by.groupBy("form").agg(F.min("least").alias("class_id"), F.count("*").alias("n_variants"), F.sum("n").alias("n_texts"))
    return c.join(by, "form").select(id_col, "class_id", "n_variants", "n_texts")


def alike_pairs(df: DataFrame, id_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """Pairs ``(id_a, id_b)``, a < b, of texts that differ as strings and print alike.

    Copies of one string never meet: only the distinct strings of a form are
    joined with each other, then with the rows that hold them, so the work beyond the scan is
    what the result holds. Hot forms are left to the adaptive skew join.
    """
    c = cut(classes(df, id_col, text_col))
    several = c.groupBy("form").agg(F.min("variant").alias("lo"), F.max("variant").alias("hi")).filter("lo <> hi").select("form")
    c = c.join(several, "form", "left_semi")
    v = c.select("form", "variant").distinct()
    vp = v.alias("x").join(v.alias("y"), "form").filter("x.variant < y.variant").select("form", F.col("x.variant").alias("va"), F.col("y.variant").alias("vb"))
    left = c.select("form", F.col("variant").alias("va"), F.col(id_col).alias("ia"))
    right = c.select("form", F.col("variant").alias("vb"), F.col(id_col).alias("ib"))
    both = vp.join(left, ["form", "va"]).join(right, ["form", "vb"])
    return both.select(F.least("ia", "ib").alias(f"{id_col}_a"), F.greatest("ia", "ib").alias(f"{id_col}_b"))
