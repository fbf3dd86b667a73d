"""Problem 3: sentences of texts in many languages and scripts, with their place.

Document-centred disambiguation: whether a stop ends a sentence depends on whether the
word before it is an abbreviation and whether the word after it opens sentences or is
a proper name. Both are decided from unambiguous occurrences elsewhere in the same
document, and from counts over the whole corpus where the document is silent. Scripts
with stops of their own end there; in scripts without stops the writer's blank does.

The counts of the corpus are joined to the documents on the words in question only. The most
frequent words, in nearly every document, would be hot keys of that join; they are broadcast
instead, which are at most 1 / ``TOP_SHARE`` words whatever the corpus holds.

Defined cases: null, empty and blank texts have no sentence; a quotation and the words
that report it are one sentence; an unclosed quotation has no effect.
"""

from __future__ import annotations

import functools
from collections import ChainMap

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import cut, spread

#: Counts kept for a word (in lower case): with a stop and, after it, a small letter
#: or mark; with a stop and a digit; with a stop in all; without a stop; written small;
#: capital inside a sentence; capital where a sentence surely starts; with a stop at the
#: end of a paragraph.
COUNTS = ["dot_small", "dot_digit", "dot", "bare", "small", "cap_inside", "cap_start", "dot_end"]
#: Share of paragraph ends among a word's stops before capitals and ends, from which it ends sentences.
FINAL_SHARE = 0.04
HELD = 200_000
# Abbreviations that often end a sentence, months after an ordinal number.
FINAL = {"etc", "usw", "itd", "itp", "ін", "інш", "др", "пр", "проч", "под", "p.m", "a.m", "прим", "шт", "кг", "км"}
MONTHS = {"januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"}
QUOTES = {"«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》"}
QUOTED = regex.compile("[" + regex.escape("".join({c for a, b in QUOTES.items() for c in a + b} | {'"'}), special_only=False) + "]")
CLOSERS = "»”“\"'’)]」』）》"
#: Share of all words from which a word is one of the most frequent: at most 1 / TOP_SHARE are.
TOP_SHARE = 1e-4
#: A word is surely no abbreviation if the corpus has it so often with a stop, no more than this
#: share of its stops before small letters or digits, and if it is longer than ``LONG`` letters or this share of
#: its occurrences is without a stop.
SURE_STOPS, SURE_INSIDE, SURE_BARE, LONG = 20, 0.02, 0.5, 5
VOWELS = set("аеєиіїоуюяыэёaeiouyąęóäöü")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:[.'’ʼ-]\p{L}[\p{L}\p{M}]*)*")
BEFORE = regex.compile(r"(?r)(?:\p{L}[\p{L}\p{M}.'’ʼ-]*|\d+)")
CAPITAL = regex.compile(r"[\p{Lu}\p{Lt}]")
LEAD_WORD = regex.compile(r"(?r)(\S+)\s+")
DIGIT_BEFORE = regex.compile(r"(?r)\d\s*")
STOPS = regex.compile(r"[.!?…．！？。｡।॥؟۔]+")
FULL = set("。｡！？।॥؟۔")
PARA = regex.compile(r"\n(?:[^\S\n]*\n)+")
_WRAPS = "-‐¬\xad"
OPENERS = "«„“\"'‘(「『["
CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Devanagari}\p{Thai}\p{Arabic}\p{Hebrew}\p{Lao}\p{Khmer}\p{Myanmar}]")
UNSTOPPED = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\d])\s+(?=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\d«“\"(])")
LEADING = OPENERS + "—– "
UNSTOPPED_LETTER = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def count_words(text: str, counts: dict[str, list[int]]) -> None:
    """Add the counts of a text's words."""
    last = -1  # end of the word before
    n = len(text)
    for m in WORD.finditer(text):
        w, a, b = m.group(), m.start(), m.end()
        key = w.lower()
        c = counts.get(key)
        if c is None:
            c = counts[key] = [0] * len(COUNTS)
        if b < n and text[b] in _WRAPS or last >= 0 and text[last] in _WRAPS and "\n" in text[last:a]:
            last = b  # part of a word broken at the line end
            continue
        if b < n and text[b] == ".":
            c[2] += 1
            k = b + 1
            while k < n and text[k].isspace():
                k += 1
            after = text[k] if k < n else ""
            if after.islower() or after in (",", ";", ":"):
                c[0] += 1
            elif after.isdigit():
                c[1] += 1
            elif not after or "\n" in text[b:k] and text[b:k].count("\n") > 1:
                c[7] += 1
        else:
            c[3] += 1
        if w[0].islower():
            c[4] += 1
        elif w[0].isupper():
            gap = text[last:a] if last >= 0 else "\n\n"
            if not gap.strip() and gap.count("\n") < 2:
                c[5] += 1
            elif gap.count("\n") > 1 or gap[0] in "!?…":
                c[6] += 1
            elif "." in gap and last >= 0 and _plain_word(text, last):
                c[6] += 1
        last = b


def _plain_word(text: str, end: int) -> bool:
    """Whether a word of five or more small letters ends here: no abbreviation, most likely."""
    return end >= 5 and text[end - 5 : end].isalpha() and text[end - 5 : end].islower()


def word_before(text: str, start: int, end: int) -> str:
    """The word or number that ends at ``end``, sought backwards; empty if there is none."""
    m = BEFORE.match(text, start, end)
    return m.group() if m else ""


def word_after(text: str, at: int) -> str:
    """The word that follows, only blanks, opening marks and dashes between; empty if none does."""
    n = len(text)
    while at < n and (text[at] in LEADING or text[at].isspace()):
        at += 1
    m = WORD.match(text, at)
    return m.group() if m else ""


def words_in_question(text: str) -> set[str]:
    """Words before and after the stops of a text, in lower case."""
    out = set()
    for m in STOPS.finditer(text):
        end = m.end()
        while end < len(text) and text[end] in CLOSERS:
            end += 1
        out.add(word_before(text, 0, m.start()).lower())
        out.add(word_after(text, end).lower())
    out.discard("")
    return out


def _pairs(text: str) -> list[tuple[int, int]]:
    """Places of the quotations and brackets that are closed in this paragraph."""
    out, open_ = [], []
    straight = -1
    for m in QUOTED.finditer(text):
        i, c = m.start(), m.group()
        if open_ and c in QUOTES[text[open_[-1]]]:
            out.append((open_.pop(), i))
        elif c in QUOTES:
            open_.append(i)
        elif c == '"':
            if straight >= 0 and (i + 1 == len(text) or not text[i + 1].isalnum()):
                out.append((straight, i))
                straight = -1
            elif straight < 0 and (i == 0 or not text[i - 1].isalnum()):
                straight = i
    return out


class Splitter:
    """Splits one document, with the counts of its own words and of the corpus."""

    def __init__(self, text: str, corpus: dict[str, list[int]]):
        self.text, self.corpus = text, corpus

    @functools.cached_property
    def own(self) -> dict[str, list[int]]:
        """Counts of the document's own words, made when they are first asked for."""
        counts: dict[str, list[int]] = {}
        count_words(self.text, counts)
        return counts

    def _get(self, w: str) -> tuple[list[int], list[int]]:
        zero = [0] * len(COUNTS)
        return self.own.get(w, zero), self.corpus.get(w) or self.own.get(w, zero)

    def abbreviation(self, w: str) -> bool:
        """Whether the word before a stop is an abbreviation."""
        low = w.lower()
        if len(w) == 1 or "." in w or low in FINAL:
            return True
        c = self.corpus.get(low)
        if c and c[2] >= SURE_STOPS and c[0] + c[1] <= SURE_INSIDE * c[2] and (len(w) > LONG or c[3] >= SURE_BARE * (c[2] + c[3])):
            return False
        for c in self._get(low):
            if c[3] > 0.2 * (c[2] + c[3]):
                return False
            if c[2] and c[0] + c[1] >= 0.3 * c[2] and (c[0] or c[2] > 1 and len(w) <= LONG):
                return True
        # nothing sure: short, never without a stop, and cut off after a consonant
        return len(w) <= LONG and c[2] >= (2 if low[-1] not in VOWELS else 8)

    def surely_final(self, w: str) -> bool:
        """Whether the corpus alone tells that the word ends sentences, abbreviation or not."""
        c = self.corpus.get(w.lower())
        return bool(c) and c[2] >= SURE_STOPS and c[0] + c[1] <= SURE_INSIDE * c[2] and c[7] > 0 and c[7] >= FINAL_SHARE * (c[2] - c[0] - c[1])

    def final(self, w: str) -> bool:
        """Whether the abbreviation also ends sentences: it does at the ends of paragraphs."""
        c = self._get(w.lower())[1]
        ends = c[2] - c[0] - c[1]
        return c[7] >= FINAL_SHARE * ends and c[7] > 0 if ends >= 8 else w.lower() in FINAL or c[7] > 0

    def opens(self, x: str) -> bool:
        """Whether the capitalised word opens sentences rather than being a name."""
        for c in self._get(x.lower()):
            capital = c[2] + c[3] - c[4]
            if c[4] > 0.05 * (c[4] + capital) and c[4] >= 0.2 * c[5]:
                return True
            if c[5] > c[6]:
                return False
            if c[6] >= 0.2 * capital and c[6] > 0:
                return True
        return False

    def takes_number(self, w: str) -> bool:
        """Whether a number often follows the abbreviation."""
        own, all_ = self._get(w.lower())
        return all_[1] >= 0.25 * max(1, all_[2])

    def ends(self, start: int, a: int, b: int, end: int, quoted: bool, led: bool) -> bool:
        """Whether a sentence that began at ``start`` ends with the stops at ``a:b`` and the
        closers up to ``end``; ``led``: words lead up to the quotation that closes here."""
        text, stops = self.text, self.text[a:b]
        k = end
        while k < len(text) and text[k].isspace():
            k += 1
        if k == len(text):
            return True
        after, blank = text[k], k > end
        if CASELESS.match(after) or stops[-1] in FULL and not after.islower():
            # no capitals to go by
            if quoted:
                return led
            return stops[-1] in FULL or blank and stops[-1] in "!?…。" or blank and stops == "." and not text[max(0, a - 1)].isdigit() or blank and stops == "." and CASELESS.search(text, start, a) is not None
        if after in ",;:)" or after in "—–-" and (quoted or stops[-1] != "."):
            return False
        if after in "—–-" and k + 2 < len(text):
            rest = text[k + 1 :].lstrip()[:1]
            return bool(rest) and not rest.islower()
        if after.islower():
            return False
        if not blank and not quoted:
            # a blank was left out between two sentences
            if not after.isupper() or a < 2 or not text[a - 2 : a].isalpha() or not text[a - 1].islower():
                return False
        if stops != "." and stops != "．":
            return not (set(stops) == {"."} and after.isdigit())
        if quoted and end > b:
            return after.isupper() or not after.isalpha()
        w = word_before(text, start, a)
        if not w:
            return True
        if w[0].isdigit():
            only = text[start:a].strip() == w
            return not only and word_after(text, k).split("-")[0].lower() not in MONTHS
        if len(w) > 1 and self.surely_final(w) or not self.abbreviation(w):
            return True
        x = word_after(text, k)
        if after.isdigit():
            return not self.takes_number(w) and (len(w) > 1 and self.final(w) or w.islower() and self._after_number(start, a, w))
        if not CAPITAL.match(x):
            return self.final(w) or self._after_number(start, a, w)
        if len(w) == 1 and w.isupper():
            lead = LEAD_WORD.match(text, start, a - 1)
            return self.opens(x) and len(x) > 1 and lead is not None and lead.group(1).islower() and len(lead.group(1)) > 3
        if self.final(w):
            return True
        return len(x) > 1 and self.opens(x)

    def _after_number(self, start: int, a: int, w: str) -> bool:
        return DIGIT_BEFORE.match(self.text, start, a - len(w)) is not None

    def spans(self) -> list[tuple[int, int]]:
        """Start and end of every sentence, outer white space left out."""
        out, at = [], 0
        for m in [*PARA.finditer(self.text), None]:
            end = m.start() if m else len(self.text)
            out += self._paragraph(at, end)
            at = m.end() if m else end
        return out

    def _paragraph(self, first: int, last: int) -> list[tuple[int, int]]:
        text = self.text
        pairs = [(first + a, first + b) for a, b in _pairs(text[first:last])]
        closing = {b: a for a, b in pairs}
        inside = [(a, b) for a, b in pairs]
        cuts, start = [], first
        while start < last and text[start].isspace():
            start += 1
        begin = start
        for m in STOPS.finditer(text, first, last):
            a, b = m.span()
            if a < begin:
                continue
            end = b
            while end < last and text[end] in CLOSERS and (end in closing or text[end] not in "\"«„“'’" or text[end - 1] in CLOSERS):
                end += 1
            if not text[end:last].strip():
                break  # the paragraph ends here, and the sentence with it
            quoted = any(k in closing for k in range(b, end))
            if any(x < a and y >= end for x, y in inside):
                continue
            opened = min((closing[k] for k in range(b, end) if k in closing), default=begin)
            led = bool(text[begin:opened].strip())
            if self.ends(begin, a, b, end, quoted, led):
                cuts.append((begin, end))
                begin = end
                while begin < last and text[begin].isspace():
                    begin += 1
        if text[begin:last].strip():
            cuts.append((begin, last))
        out = []
        for a, b in cuts:
            if UNSTOPPED_LETTER.search(text, a, b):
                at = a
                for m in UNSTOPPED.finditer(text, a, b):
                    if UNSTOPPED_LETTER.search(text, at, m.start()):
                        out.append((at, m.start()))
                        at = m.end()
                out.append((at, b))
            else:
                out.append((a, b))
        return [(a, b) for a, b in ((a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in out) if a < b]


def _counts(batches):
    counts: dict[str, list[int]] = {}

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(len(COUNTS)))], names=["word", *COUNTS])

    for b in batches:
        for text in b.column(0).to_pylist():
            count_words(text, counts)
            if len(counts) > HELD:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def corpus_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, COUNTS...)`` over all texts."""
    texts = spread(df.select(F.col(text_col).alias("text")).filter("text is not null"))
    out = texts.mapInArrow(_counts, "word string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return out.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def top_words(corpus: DataFrame, share: float) -> dict[str, list[int]]:
    """The words of which at least ``share`` of all words of the corpus are, with their counts: at
    most 1 / ``share``."""
    total = corpus.agg(F.sum(F.col("dot") + F.col("bare"))).first()[0] or 0
    top = corpus.filter(F.col("dot") + F.col("bare") >= F.lit(max(1.0, share * total))).toArrow()
    return dict(zip(top.column("word").to_pylist(), map(list, zip(*(top.column(c).to_pylist() for c in COUNTS)))))


def sentences(df: DataFrame, corpus: DataFrame, id_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """``(id, start_char, end_char)`` of the sentences of ``df``; ``corpus`` are the
    counts of the texts that the documents are compared with."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null"))
    corpus = cut(corpus)
    held = df.sparkSession.sparkContext.broadcast(top_words(corpus, TOP_SHARE))

    def ask(batches):
        top = held.value
        for b in batches:
            asked = [[w for w in words_in_question(t) if w not in top] for t in b.column(1).to_pylist()]
            ids = [i for i, w in zip(b.column(0).to_pylist(), asked) for _ in w]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array([x for w in asked for x in w], pa.string())], names=["id", "word"])

    known = docs.mapInArrow(ask, f"id {kind}, word string").join(corpus, "word")
    # one row for each document; its list is no longer than the document
    known = known.groupBy("id").agg(F.collect_list(F.struct("word", F.array(*COUNTS).alias("n"))).alias("known"))

    def split(batches):
        top = held.value
        for b in batches:
            out = []
            for i, text, known in zip(*(b.column(k).to_pylist() for k in range(3))):
                counts = ChainMap({w["word"]: w["n"] for w in known}, top) if known else top
                out += [(i, *s) for s in Splitter(text, counts).spans()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.column(0).type), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=["id", "start_char", "end_char"])

    return docs.join(known, "id", "left").mapInArrow(split, f"id {kind}, start_char int, end_char int").withColumnRenamed("id", id_col)
