"""Problem 1: the language of each paragraph and request, with a confidence.

Error-correcting output codes: every language has a codeword of ``BITS`` bits, and one
binary character n-gram classifier predicts each bit from hashed 1-, 2- and
3-grams. Decoding chooses the language whose codeword has the least loss, bits weighted
by how well they were predicted for that language on held-out texts; a small lead over the
second language marks the result as ambiguous. A paragraph whose sentences are in several
languages is divided into segments by a Viterbi pass over its sentences.

The classifiers are fitted on the seeds and on all labelled rows, by passes of which only counters
come back. Labels are often wrong, so a paragraph counts only if the classifier fitted so far
agrees with its label.

Defined cases: null, empty and blank texts have no paragraph; a paragraph with fewer
than ``LEAST_LETTERS`` letters, or of a text that is junk, has no language.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import quality
from textloom.llm.char_model import CharModel
from textloom.llm.codepoints import to_points
from textloom.llm.encoding_repair import TOGETHER, Repairer, legible
from textloom.llm.encoding_repair import fit as fit_encoding
from textloom.llm.seeds import SENTENCES
from textloom.runtime import spread

LANGUAGES = list(SENTENCES)
BITS, SLOTS = 24, 1 << 16
#: Rounds in which the classifier is fitted to the labels that it agrees with.
ROUNDS = 2
#: A quarter of the training texts is held out to measure the bits.
HELD_OUT = 4
#: Share of right bits to expect before any is measured, and texts that it counts for.
TRUSTED, SMOOTH = 0.9, 8.0
#: Nats for a change of language between two sentences.
CHANGE = 3.0
LEAST_LETTERS = 20
#: Lead in decoding, as a share of confidence, under which the result is ambiguous.
AMBIGUOUS = 0.6
_M = np.uint64(0x9E3779B97F4A7C15)
_BREAK = re.compile(r"(?:\r?\n|^)[^\S\n]*(?:\n[^\S\n]*)+")
#: Addresses and file names are no words of a language.
_ADDRESS = re.compile(r"[\x21-\x7e]*[A-Za-z0-9][._@/:][A-Za-z0-9][\x21-\x7e]*")
#: A word with a letter, from that letter on.
_LETTERED = re.compile(r"[^\W\d_]\S*")
_SENTENCE = re.compile(r"[.!?…。！？।؟]+[»”\"]?\s+|(?<=[。！？।؟])|\n")


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case letter of each code point; a blank for what is no letter or mark."""
    import unicodedata

    t = np.full(0x110000, 32, np.uint32)
    for p in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0xFFF0)]:
        c = chr(p)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            t[p] = ord(low) if len(low) == 1 else p
    for a, b in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x30000)):
        t[a:b] = np.arange(a, b)
    return t


@functools.cache
def codewords() -> np.ndarray:
    """Languages x BITS of +1 and -1, the farthest apart of a few hundred draws; every
    bit splits the languages about evenly."""
    rng = np.random.default_rng(11)
    best, apart = None, -1
    for _ in range(400):
        c = np.stack([rng.permutation(np.where(np.arange(len(LANGUAGES)) % 2, 1, -1)) for _ in range(BITS)], 1)
        d = min((c[i] != c[j]).sum() for i in range(len(c)) for j in range(i))
        if d > apart:
            best, apart = c, d
    return best


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram slots of all texts (three for each character that begins or continues a
    word) and the text of each."""
    points, offs = to_points(pa.array(texts, pa.large_string()))
    n = np.diff(offs)
    at = np.arange(len(points)) + 2 * np.repeat(np.arange(1, len(n) + 1), n)
    p = np.full(len(points) + 2 * len(n), 32, np.uint64)
    p[at] = _letters()[points]
    row = np.repeat(np.arange(len(n)), n)
    a, b, c = p[at - 2], p[at - 1], p[at]
    keep = (c != 32) | (b != 32)
    a, b, c, row = a[keep], b[keep], c[keep], row[keep]
    out = []
    for order, h in ((1, c), (2, c + (b << np.uint64(20))), (3, c + (b << np.uint64(20)) + (a << np.uint64(40)))):
        h = (h + np.uint64(order << 60)) * _M
        out.append(((h ^ (h >> np.uint64(32))) * _M >> np.uint64(48)).astype(np.int64))
    return np.stack(out, 1), row


class Classifier:
    """Weights of the bit classifiers and of the decoding. What a word's n-grams say is the same
    wherever it stands, so it is summed once and held."""

    HELD = 200_000

    def __init__(self, weights: np.ndarray, trust: np.ndarray):
        self.weights, self.trust = weights, trust
        self.ids: dict[str, int] = {}
        self.sums, self.sizes = np.zeros((1 << 10, BITS), np.float32), np.zeros(1 << 10)

    def _learn(self, words: list[str]) -> None:
        """Sums of margins and numbers of n-grams of new words."""
        for k in range(0, len(words), 20_000):  # in slices, for memory
            part = words[k : k + 20_000]
            first = len(self.ids)
            self.ids.update(zip(part, range(first, first + len(part))))
            while len(self.ids) > len(self.sizes):
                self.sums, self.sizes = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            for j in range(0, len(part), 4_000):
                slots, row = features([w + " " for w in part[j : j + 4_000]])
                if len(row):
                    each = self.weights[slots[:, 0]] + self.weights[slots[:, 1]] + self.weights[slots[:, 2]]
                    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    at = first + j + row[start]
                    self.sums[at] = np.add.reduceat(each, start, axis=0)
                    self.sizes[at] = np.diff(np.append(start, len(row)))

    def margins(self, texts: list[str]) -> np.ndarray:
        """Texts x BITS: mean margin of the bit classifiers over the text's n-grams."""
        out = np.zeros((len(texts), BITS), np.float32)
        words = [t.split() for t in texts]
        if len(self.ids) > self.HELD:
            self.ids.clear()
            self.sums, self.sizes = np.zeros((1 << 10, BITS), np.float32), np.zeros(1 << 10)
        self._learn(list({w: None for ws in words for w in ws if w not in self.ids}))
        size = np.array([len(ws) for ws in words])
        if size.any():
            at = np.fromiter((self.ids[w] for ws in words for w in ws), np.int64, size.sum())
            full = np.flatnonzero(size)
            start = (np.cumsum(size) - size)[full]
            out[full] = np.add.reduceat(self.sums[at], start, axis=0) / np.maximum(np.add.reduceat(self.sizes[at], start), 1)[:, None]
        return out

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Texts x languages: confidence of each language (they sum to 1)."""
        # a bit is predicted right or wrong: its loss for either, weighed by trust for each codeword
        right, wrong = np.logaddexp(0, -2.0 * margins), np.logaddexp(0, 2.0 * margins)
        codes = codewords()
        share = self.trust / self.trust.sum(1, keepdims=True)
        loss = right @ np.where(codes > 0, share, 0).T + wrong @ np.where(codes < 0, share, 0).T
        e = np.exp(-6.0 * (loss - loss.min(1, keepdims=True))) if len(loss) else loss
        return e / e.sum(1, keepdims=True)


class Examples:
    """Texts with their languages and n-grams, counted once."""

    def __init__(self, texts: list[str], langs: np.ndarray):
        self.langs = langs
        # two blanks between words: each says the same by itself
        self.slots, self.row = features(["  ".join(t.split()) + " " for t in texts])

    def only(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = use[self.row]
        return self.slots[keep], self.row[keep]


def _counts(e: Examples, use: np.ndarray) -> np.ndarray:
    """Languages x SLOTS: how often the examples in use have each n-gram."""
    slots, row = e.only(use)
    flat = (e.langs[row][:, None] * SLOTS + slots).ravel()
    return np.bincount(flat, minlength=len(LANGUAGES) * SLOTS).reshape(len(LANGUAGES), SLOTS)


def _weights(counts: np.ndarray) -> np.ndarray:
    """Weights of the n-grams for each bit, from how often each language has them."""
    # every language has the same weight, however many texts it has
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    codes = codewords()
    one, two = (codes > 0).T.astype(float), (codes < 0).T.astype(float)
    weights = np.log((one @ p / one.sum(1, keepdims=True) + 2e-6) / (two @ p / two.sum(1, keepdims=True) + 2e-6)).T.astype(np.float32)
    weights[counts.sum(0) == 0] = 0
    return weights


def _margins(e: Examples, use: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean margins of the examples (zero for those not in use)."""
    slots, row = e.only(use)
    out = np.zeros((len(e.langs), BITS), np.float32)
    for k in range(0, len(slots), 200_000):  # in slices, for memory
        part = slots[k : k + 200_000]
        r = row[k : k + 200_000]
        each = weights[part[:, 0]] + weights[part[:, 1]] + weights[part[:, 2]]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[first]] += np.add.reduceat(each, first, axis=0)
    return out / np.maximum(np.bincount(row, minlength=len(out)), 1)[:, None]


def _held_out(use: np.ndarray) -> np.ndarray:
    return use & (np.cumsum(use) % HELD_OUT == 0)


def _right(e: Examples, held: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Languages x (BITS + 1): of the held-out examples, those for which each bit is right, and all."""
    right = np.ones((len(e.langs), BITS + 1), np.int64)
    right[:, :BITS] = _margins(e, held, weights) * codewords()[e.langs] > 0
    return np.stack([right[held & (e.langs == k)].sum(0) for k in range(len(LANGUAGES))])


def _classifier(counts: np.ndarray, right: np.ndarray) -> Classifier:
    """The classifier of n-gram counts, its bits trusted as they are right on held-out examples."""
    trust, n = np.ones((len(LANGUAGES), BITS)), right[:, BITS:]
    some = n[:, 0] > 0
    trust[some] = ((right[some, :BITS] + TRUSTED * SMOOTH) / (n[some] + SMOOTH)) ** 2
    return Classifier(_weights(counts), trust)


def _fit(e: Examples, use: np.ndarray) -> Classifier:
    """The classifier of the examples in use; how far its bits are trusted is measured by
    weights that have not seen the held-out quarter, on that quarter."""
    held = _held_out(use)
    rest = _counts(e, use & ~held)
    return _classifier(rest + _counts(e, held), _right(e, held, _weights(rest)))


def label(c: Column) -> Column:
    """The label as it is read: lower case, up to the first hyphen; null if none."""
    low = F.lower(F.substring_index(F.trim(c), "-", 1))
    return F.when(~low.isin("", "und"), low)


def paragraphs(text: str) -> list[str]:
    """Paragraphs, parted by blank lines."""
    return [p for p in _BREAK.split(text) if p.strip()]


def _seeds() -> Examples:
    """The seeds, each whole and in sentences."""
    seed = [(s, k) for k, lang in enumerate(LANGUAGES) for s in SENTENCES[lang].split("\n")]
    seed = [(x, k) for s, k in seed for x in (s, *re.split(r"(?<=[.。।])", s)) if x.strip()]
    return Examples([x for x, _ in seed], np.array([k for _, k in seed], int))


def _labelled(b: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Paragraphs of labelled texts, their languages, and which are held out; some texts at a time."""
    for k in range(0, b.num_rows, TOGETHER):
        part = b.slice(k, TOGETHER)
        found = [(p, LANGUAGES.index(lang)) for t, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for p in paragraphs(legible(t)) if len(p) > 30]
        if found:
            yield [p for p, _ in found], np.array([k for _, k in found]), np.array([zlib.crc32(p.encode()) % HELD_OUT == 0 for p, _ in found])


def _count_labelled(c: Classifier, texts: list[str], langs: np.ndarray, held: np.ndarray, total: np.ndarray) -> None:
    """Count the n-grams of the paragraphs with whose labels the classifier agrees, by whether
    they are held out and by language."""
    total = total.reshape(2, len(LANGUAGES), SLOTS)
    agree = c.decode(c.margins(texts)).argmax(1) == langs
    words: dict[tuple[int, int], Counter[str]] = defaultdict(Counter)
    for t, k, h in zip(np.array(texts, object)[agree], langs[agree], held[agree]):
        words[int(h), int(k)].update(t.split())
    for at, n in words.items():
        each, times = list(n), np.fromiter(n.values(), np.int64, len(n))
        for j in range(0, len(each), 20_000):  # in slices, for memory
            slots, row = features([w + " " for w in each[j : j + 20_000]])
            total[at] += np.bincount(slots.ravel(), np.repeat(times[j + row], 3), minlength=SLOTS).astype(np.int64)


def _count_right(c: Classifier, part: Classifier, texts: list[str], langs: np.ndarray, held: np.ndarray, total: np.ndarray) -> None:
    """Count, by language, the held-out paragraphs with whose labels ``c`` agrees for which each bit is right
    by ``part``, and all of them."""
    if held.any():
        texts, langs = [t for t, h in zip(texts, held) if h], langs[held]
        agree = c.decode(c.margins(texts)).argmax(1) == langs
        right = np.ones((len(texts), BITS + 1), np.int64)
        right[:, :BITS] = part.margins(texts) * codewords()[langs] > 0
        np.add.at(total.reshape(len(LANGUAGES), BITS + 1), langs[agree], right[agree])


def _over_labelled(known: DataFrame, start: Callable[[], Callable], size: int) -> np.ndarray:
    """``size`` counters over the paragraphs of all labelled texts; ``start`` gives a task what counts some of them."""

    def run(batches):
        count, total = start(), np.zeros(size, np.int64)
        for b in batches:
            for some in _labelled(b):
                count(*some, total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "n"])

    rows = known.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def _refit(known: DataFrame, e: Examples, c: Classifier) -> Classifier:
    """The classifier of the seeds and of all labelled paragraphs with whose labels ``c`` agrees. A
    quarter of the paragraphs, chosen by their checksums, is held out to measure the bits."""
    sc = known.sparkSession.sparkContext
    all_ = np.ones(len(e.langs), bool)
    held = _held_out(all_)
    before = sc.broadcast((c.weights, c.trust))

    def agreeing():
        c = Classifier(*before.value)
        return lambda *some: _count_labelled(c, *some)

    counts = _over_labelled(known, agreeing, 2 * len(LANGUAGES) * SLOTS).reshape(2, len(LANGUAGES), SLOTS)
    counts += np.stack([_counts(e, ~held), _counts(e, held)])
    rest = _weights(counts[0])
    part = sc.broadcast(rest)

    def right():
        c, p = Classifier(*before.value), Classifier(part.value, before.value[1])
        return lambda *some: _count_right(c, p, *some)

    measured = _over_labelled(known, right, len(LANGUAGES) * (BITS + 1)).reshape(len(LANGUAGES), BITS + 1)
    return _classifier(counts.sum(0), measured + _right(e, held, rest))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """The classifier of the seeds and of all labelled rows."""
    known = spread(df.select(F.col(text_col).alias("text"), label(F.col(lang_col)).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isin(LANGUAGES)))
    e = _seeds()
    c = _fit(e, np.ones(len(e.langs), bool))
    for _ in range(ROUNDS):
        c = _refit(known, e, c)
    return c


Paragraph = tuple[int, str, float, bool]
Segment = tuple[int, int, int, str, float, bool]


def _sentences(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Sentences with words of the paragraphs with enough letters, the paragraph and number of
    words of each; text and number of each paragraph."""
    parts, owner, words, paras = [], [], [], []
    for k, t in enumerate(texts):
        for no, para in enumerate(paragraphs(t) if t else (), 1):
            if len(para) < LEAST_LETTERS or sum(map(str.isalpha, para[: 4 * LEAST_LETTERS])) < LEAST_LETTERS and sum(map(str.isalpha, para)) < LEAST_LETTERS:
                continue
            before = len(parts)
            for s in _SENTENCE.split(_ADDRESS.sub(" ", para)):
                n = len(_LETTERED.findall(s)) if s else 0
                if n:
                    parts.append(s)
                    owner.append(len(paras))
                    words.append(n)
            if len(parts) > before:
                paras.append((k, no))
    return parts, np.array(owner, int), np.array(words, float), paras


def _decoded(texts: list[str | None], c: Classifier) -> tuple:
    """Paragraph, words and confidences by language of every sentence, and the paragraphs."""
    parts, owner, n, paras = _sentences(texts)
    if not paras:
        return owner, n, np.zeros((0, len(LANGUAGES))), paras
    m = c.margins(parts)
    first = np.searchsorted(owner, np.arange(len(paras)))
    whole = np.add.reduceat(m * n[:, None], first, axis=0) / np.bincount(owner, n)[:, None]
    # a sentence of few words leans on its paragraph
    lean = (2.0 / (2.0 + n))[:, None]
    return owner, n, c.decode(m * (1 - lean) + whole[owner] * lean), paras


def classify(texts: list[str | None], c: Classifier) -> list[list[Paragraph]]:
    """For each text its paragraphs that have a language: number, language of most
    words, confidence, whether that is ambiguous."""
    owner, n, said, paras = _decoded(texts, c)
    out: list[list[Paragraph]] = [[] for _ in texts]
    if not paras:
        return out
    each = said * 0.01 + np.eye(len(LANGUAGES))[said.argmax(1)] * n[:, None]
    votes = np.add.reduceat(each, np.searchsorted(owner, np.arange(len(paras))), axis=0)
    lang = votes.argmax(1)
    sure = np.bincount(owner, said[np.arange(len(owner)), lang[owner]] * n) / np.bincount(owner, n)
    for (k, no), best, s in zip(paras, lang, sure):
        out[k].append((no, LANGUAGES[best], round(float(s), 4), bool(s < AMBIGUOUS)))
    return out


def _path(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The likeliest language of each sentence of a paragraph, changes counted."""
    score = np.log(p + 1e-6) * np.minimum(n, 20)[:, None]
    best, back = score[0], []
    for s in score[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - CHANGE
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - CHANGE) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def segments(texts: list[str | None], c: Classifier) -> list[list[Segment]]:
    """For each text the runs of sentences in one language: paragraph, number of the run in
    it, words, language, confidence, whether that is ambiguous."""
    owner, n, said, paras = _decoded(texts, c)
    out: list[list[Segment]] = [[] for _ in texts]
    top = said.argmax(1) if len(paras) else owner
    starts = np.searchsorted(owner, np.arange(len(paras) + 1))
    for (k, no), a, b in zip(paras, starts, starts[1:]):
        path = top[a:b] if (top[a:b] == top[a]).all() else _path(said[a:b], n[a:b])
        new = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        for seg, (x, y) in enumerate(zip(new, [*new[1:], b - a]), 1):
            w = n[a + x : a + y]
            s = float((said[a + x : a + y, path[x]] * w).sum() / w.sum())
            out[k].append((no, seg, int(w.sum()), LANGUAGES[path[x]], round(s, 4), s < AMBIGUOUS))
    return out


def _run(df: DataFrame, id_col: str, text_col: str, lang_col: str, found, columns: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``(id, label, columns...)`` of what ``found`` gives for texts: garbled lines are restored
    first, texts that are junk are left out; one Arrow pass."""
    fitted = fit_encoding(df, text_col, id_col)
    c = fit(df, text_col, lang_col)
    learned = quality.learn_shapes(df, quality.common_words(df, text_col), fitted, id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast((fitted[0].counts, fitted[1], c.weights, c.trust, learned))

    def run(batches):
        counts, margins, weights, trust, shapes = held.value
        r, c = Repairer(CharModel(counts), margins), Classifier(weights, trust)
        for b in batches:
            all_ = b.column(2).to_pylist()
            for k in range(0, len(all_), TOGETHER):
                texts = all_[k : k + TOGETHER]
                r.prepare(texts)
                texts = [t and legible(r.text(t)) for t in texts]
                junk = shapes.decide(texts) == "junk"
                got = found([None if j else t for t, j in zip(texts, junk)], c)
                at = pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]) + k)
                rows = [x for f in got for x in f]
                values = [pa.array([x[i] for x in rows], kind) for i, (_, _, kind) in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *values], names=["id", "label", *(name for name, _, _ in columns)])

    kind = df.schema[id_col].dataType.simpleString()
    src = spread(df.select(F.col(id_col).alias("id"), label(F.col(lang_col)).alias("label"), F.col(text_col).alias("text")))
    return src.mapInArrow(run, f"id {kind}, label string, " + ", ".join(f"{name} {sql}" for name, sql, _ in columns)).withColumnRenamed("id", id_col)


def paragraph_languages(df: DataFrame, id_col: str = "request_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, label, para_no, lang, confidence, ambiguous)`` of the paragraphs that have a
    language. Garbled lines are restored first; texts that are junk are left out."""
    columns = [("para_no", "int", pa.int32()), ("lang", "string", pa.string()), ("confidence", "double", pa.float64()), ("ambiguous", "boolean", pa.bool_())]
    return _run(df, id_col, text_col, lang_col, classify, columns)


def segment_languages(df: DataFrame, id_col: str = "request_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, label, para_no, segment_no, n_words, lang, confidence, ambiguous)``: the runs of
    sentences in one language of each paragraph that has a language, in order."""
    columns = [("para_no", "int", pa.int32()), ("segment_no", "int", pa.int32()), ("n_words", "int", pa.int32()), ("lang", "string", pa.string()), ("confidence", "double", pa.float64()), ("ambiguous", "boolean", pa.bool_())]
    return _run(df, id_col, text_col, lang_col, segments, columns)


def mislabelled(found: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Paragraphs whose language differs from the label, or that have no label."""
    return found.filter(F.col("label").isNull() | (F.col("label") != F.col("lang"))).select(id_col, "para_no", "lang")


def request_languages(found: DataFrame, id_col: str = "request_id") -> DataFrame:
    """``(id, lang, confidence, languages)`` of each request with a language: that of most
    of its paragraphs, with the number of languages in it."""
    per = found.groupBy(id_col, "lang").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    best = per.groupBy(id_col).agg(F.max(F.struct("n", "confidence", "lang")).alias("best"), F.count("*").alias("languages"))
    return best.select(id_col, "best.lang", F.round("best.confidence", 4).alias("confidence"), "languages")
