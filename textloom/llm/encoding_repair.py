"""Problem 7: text decoded with a wrong character encoding.

A smoothed character n-gram model is trained on the clean lines of the corpus.
Each word of a suspect line is read back through every candidate chain of encoding
and decoding; a Viterbi pass over the line chooses, per word, the likeliest chain
(a change of chain costs ``SWITCH``), and the line counts as garbled when the
result is likelier than the line as it is by more than a margin that was validated on all clean
lines of the corpus and on the same lines garbled for the purpose.

Defined cases: null, empty and ASCII-only texts have no garbled line, but for runs
of question marks in place of words; a line with bytes that are lost for good
(U+FFFD, question marks, undecodable bytes) has the empty string as its restoration.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.char_model import CharModel, char_classes, clean_chars, train
from textloom.llm.codepoints import to_points
from textloom.llm.print_form import SAME_SHAPE, tables
from textloom.runtime import spread

# Encodings as Python names them. "ansi" is cp1252 whose unused bytes
# stand for the control characters of Latin-1, so it also covers Latin-1.
WRITTEN_READ = {
    "utf-8": ("ansi", "cp1251", "koi8-u", "cp866", "cp1250", "iso8859-2", "mac-roman", "mac-cyrillic", "cp437", "cp850", "iso8859-5"),
    "cp1251": ("ansi", "cp866", "koi8-u", "mac-cyrillic", "iso8859-5", "cp1250", "cp437"),
    "koi8-u": ("cp1251", "ansi", "cp866", "iso8859-5", "cp1250"),
    "cp866": ("cp1251", "ansi", "koi8-u", "cp1250", "cp437"),
    "iso8859-5": ("cp1251", "ansi", "koi8-u", "cp866"),
    "mac-cyrillic": ("cp1251", "ansi"),
    "cp1250": ("ansi", "cp1251", "cp437"),
    "iso8859-2": ("ansi", "cp1251", "cp1250"),
    "cp1252": ("cp1250", "cp1251", "cp866", "cp437", "mac-roman"),
    "cp852": ("ansi", "cp1250", "cp437"),
}
TWICE = (("utf-8", "ansi", "utf-8", "ansi"), ("utf-8", "cp1251", "utf-8", "cp1251"), ("utf-8", "ansi", "utf-8", "cp1251"), ("utf-8", "cp1251", "utf-8", "ansi"))
CHAINS = [(w, r) for w, rs in WRITTEN_READ.items() for r in rs] + list(TWICE)
#: Nats for a change of chain between two words, and for a character lost in decoding.
SWITCH, LOST = 6.0, 9.0
#: Lines that are garbled and judged together, for memory, when the margin is validated.
VALIDATED = 2_000
#: Margins to choose from; scores of words are counted in steps of ``STEP``.
CUTS, STEP = np.arange(2.0, 30.0, 0.5), 1e-4
#: Least margin for chains through UTF-8 and for 8-bit chains.
LEAST = (2.0, 4.0)
#: Texts whose words are scored together.
TOGETHER = 500
#: Log-probability per character under which a word makes its line suspect, and which the
#: words changed by 8-bit chains must reach together: before validation, and its bounds.
SUSPECT, SUSPECT_BOUNDS = -4.0, (-4.5, -3.5)
READABLE, READABLE_BOUNDS = -4.5, (-5.5, -4.0)
_ASKED = re.compile(r"^[\"'«“(\[-]{0,3}\?[?'’-]*\?[\"'»”)\].,:;!…-]{0,3}$")


@functools.cache
def _ansi() -> dict[int, int]:
    """Character -> byte of cp1252 and Latin-1 together."""
    t = {p: p for p in range(256)}
    for b in range(128, 160):
        try:
            t[ord(bytes([b]).decode("cp1252"))] = b
        except UnicodeDecodeError:
            pass
    return t


def _bytes(s: str, read: str) -> bytes | None:
    try:
        if read == "ansi":
            t = _ansi()
            return bytes([t[ord(c)] for c in s])
        return s.encode(read)
    except (KeyError, UnicodeEncodeError):
        return None


def undo(s: str, chain: tuple[str, ...]) -> str | None:
    """``s`` as it was before ``chain``; lost bytes are U+FFFD; null if impossible."""
    for written, read in zip(chain[-2::-2], chain[::-2]):
        raw = _bytes(s, read)
        if raw is None:
            return None
        try:
            s = raw.decode(written)
        except UnicodeDecodeError:
            if written != "utf-8":
                return None
            s = raw.decode(written, "replace")
    return s


@functools.cache
def _to_byte(read: str) -> np.ndarray:
    """Byte of each character of the code, -1 for others; a line feed stays one."""
    t = np.full(0x10000, -1, np.int16)
    for b in range(256):
        c = bytes([b]).decode(read, "ignore") if read != "ansi" else ""
        if c:
            t[ord(c)] = b
    if read == "ansi":
        t[list(_ansi())] = list(_ansi().values())
    t[10] = 10
    return t


@functools.cache
def _to_char(written: str) -> np.ndarray:
    """Character of each byte of the code; 0 where there is none."""
    return np.array([ord(bytes([b]).decode(written, "ignore") or "\0") for b in range(256)], np.uint32)


@functools.cache
def _fits() -> np.ndarray:
    """Characters that a word read back through an 8-bit chain may have."""
    ok = char_classes()[0].copy()
    ok[0xC0:0x180] = True
    return ok


@functools.cache
def _odd_letters() -> np.ndarray:
    """Letters beyond ASCII."""
    t = np.zeros(0x110000, bool)
    t[[c for c in range(128, 0x30000) if chr(c).isalpha()]] = True
    return t


def _only(points: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The words to keep, of words that end in line feeds."""
    word = np.cumsum(points == 10) - (points == 10)
    return points[keep[word]]


def undo_all(points: np.ndarray, odd: np.ndarray, chain: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``undo`` of all words (code points, each word ended by a line feed) whose ``odd`` is
    true: the numbers of the words for which the result is plausible, their code points without
    lost ones, the places of the line feeds, and the characters lost in each."""
    at = np.flatnonzero(odd)
    points = _only(points, odd)
    lost = np.zeros(len(at), np.int64)
    for written, read in zip(chain[-2::-2], chain[::-2]):
        raw = np.where(points < 0x10000, _to_byte(read)[np.minimum(points, 0xFFFF)], -1)
        new = points == 10
        word = np.cumsum(new) - new
        good = np.bincount(word, raw < 0, minlength=len(at)) == 0
        if written != "utf-8":
            chars = _to_char(written)[raw]
            good &= np.bincount(word, (chars == 0) & (points != 0), minlength=len(at)) == 0
            points, at, lost = chars[good[word]], at[good], lost[good]
        else:
            raw, at, lost = raw[good[word]].astype(np.uint8), at[good], lost[good]
            points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if not len(at):
            return at, points, at, lost
    new = points == 10
    word = np.cumsum(new) - new
    if "utf-8" in chain:
        gone = points == 0xFFFD
        lost = np.bincount(word, gone, minlength=len(at)).astype(np.int64)
        size = np.bincount(word, minlength=len(at)) - 1
        good = (lost == 0) | (size >= 4 * lost) & (np.bincount(word, _odd_letters()[points], minlength=len(at)) > 0)
        keep = good[word] & ~gone
    else:
        good = np.bincount(word, ~_fits()[points] & ~new, minlength=len(at)) == 0
        keep = good[word]
    points = points[keep]
    return at[good], points, np.flatnonzero(points == 10), lost[good]


@functools.cache
def _inked() -> tuple[dict, dict, dict]:
    """Translations: odd blanks, width forms and characters without ink; letters of
    the same shape to Latin; the same to Cyrillic."""
    t = tables()
    plain = {p: chr(t["one"][p]) if t["n"][p] else None for p in [*range(0xA0, 0x500), *range(0x2000, 0x2070), *range(0xFE00, 0x10000)] if t["n"][p] < 2 and (t["n"][p] == 0 or t["one"][p] < 128) and chr(p) not in "’‘´"}
    latin = {ord(c): base for base, same in SAME_SHAPE.items() for c in same if base.isascii()}
    plain = {p: c for p, c in plain.items() if p not in latin}
    return plain, latin, {ord(base): next(c for c in same if "Ѐ" <= c <= "ӿ") for base, same in SAME_SHAPE.items() if base.isascii() and any("Ѐ" <= c <= "ӿ" for c in same)}


@functools.cache
def _known_chars() -> re.Pattern:
    """A word of characters that clean text has, and no others."""
    ok = char_classes()[0]
    return re.compile("[" + re.escape("".join(chr(p) for p in range(0x3000) if ok[p])) + "\u3000-\ud7ff\U00020000-\U0002ffff]*")


def _strange(word: str) -> bool:
    """Whether the word holds a character that clean text does not."""
    return _known_chars().fullmatch(word) is None


_LATIN, _CYRILLIC = re.compile("[A-Za-z]"), re.compile("[Ѐ-ӿ]")
_PLAIN = re.compile("[\x20-\x7eА-яЁёІіЇїЄєҐґ«»—–…’]*")


def readable(word: str) -> str:
    """The word as a reader sees it, for scoring it as it is: writing with odd blanks
    or look-alike letters is no encoding error."""
    plain, latin, cyrillic = _inked()
    if not _PLAIN.fullmatch(word):
        word = word.translate(plain)
    if not _LATIN.search(word):
        return word
    a, b = len(_LATIN.findall(word)), len(_CYRILLIC.findall(word))
    return word.translate(cyrillic if b > a else latin)



@functools.cache
def _ansi_chars() -> dict[int, str]:
    """Byte -> character, the inverse of ``_ansi``."""
    return {b: chr(c) for c, b in _ansi().items()}


def garble(s: str, chain: tuple[str, ...]) -> str | None:
    """What ``s`` looks like after ``chain``; null if it cannot be written so."""
    for written, read in zip(chain[::2], chain[1::2]):
        try:
            raw = s.encode(written)
            s = raw.decode("latin-1").translate(_ansi_chars()) if read == "ansi" else raw.decode(read)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
    return s


_BLANKS = re.compile("([ \t\r]+)")
_ALL_BLANKS = re.compile("[ \t\r\n]+")


class Repairer:
    """Restores lines by the model; one object serves a task, with bounded caches."""

    HELD, OPTIONS_HELD, SLICE = 100_000, 20_000, 2_000

    def __init__(self, model: CharModel, margins: tuple[float, ...]):
        self.model, self.margins = model, margins[:2]
        self.suspects, self.readable = margins[2:] or (SUSPECT, READABLE)
        self.suspect: dict[str, bool] = {}
        self.options: dict[str, np.ndarray] = {}
        self.most: dict[str, float] = {}
        self.held_lines: dict[str, set[int]] = {}

    def learn(self, words: set[str]) -> None:
        """Which of the words make their line suspect: unlikely as they are, or with a
        character that clean text does not have."""
        new = [w for w in words if w not in self.suspect]
        if not new:
            return
        plain = [readable(w) for w in new]
        scores = self.model.scores(plain).tolist()
        self.suspect.update((w, x < self.suspects * (len(w) + 1) or _strange(p)) for w, p, x in zip(new, plain, scores))

    def _learn_options(self, words: set[str]) -> None:
        """The score of each word through every chain (-inf where it cannot be undone). The
        words are undone together, chain by chain, as arrays of code points."""
        new = [w for w in words if w not in self.options]
        for k in range(0, len(new), self.SLICE):
            part = new[k : k + self.SLICE]
            scores = np.full((len(part), len(CHAINS) + 1), -np.inf)
            scores[:, 0] = self.model.scores([readable(w) for w in part])
            odd = np.array([not w.isascii() for w in part])
            points, _ = to_points(pa.array(["\n".join(part) + "\n"] if part else [], pa.large_string()))
            for c, chain in enumerate(CHAINS, 1):
                at, text, ends, lost = undo_all(points, odd, chain)
                if len(at):
                    p = np.where(text == 10, 32, text).astype(np.uint32)
                    starts = np.concatenate([[0], ends[:-1] + 1])
                    scores[at, c] = np.add.reduceat(self.model.logp(p, np.append(starts, len(p))), starts) - LOST * lost
            self.options.update(zip(part, scores))
            self.most.update(zip(part, (scores.max(1) - scores[:, 0]).tolist()))

    def _decoded(self, line: str) -> tuple[str | None, float, bool]:
        """The likeliest reading of the line (lost bytes are U+FFFD), null if that is
        the line itself; by how much it is likelier; whether an 8-bit chain took part."""
        if line.isascii():
            return None, 0.0, False
        words = _BLANKS.split(line)
        odd = [i for i in range(0, len(words), 2) if not words[i].isascii()]
        self.learn({words[i] for i in odd})
        if not any(self.suspect[words[i]] for i in odd):
            return None, 0.0, False
        self._learn_options({words[i] for i in odd})
        # no reading can be likelier than the best of every word by itself
        if sum(self.most[words[i]] for i in odd) <= min(self.margins):
            return None, 0.0, False
        best, back = self.options[words[odd[0]]].copy(), []
        best[1:] -= SWITCH
        plain = self.options[words[odd[0]]][0]
        for i in odd[1:]:
            top = int(best.argmax())
            stay = best >= best[top] - SWITCH
            back.append(np.where(stay, np.arange(len(best)), top))
            s = self.options[words[i]]
            best = np.where(stay, best, best[top] - SWITCH) + s
            plain += s[0]
        k = int(best.argmax())
        gain = float(best[k] - plain)
        path = [k]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        if not any(path):
            return None, gain, True
        was = [undo(words[i], CHAINS[k - 1]) if k else words[i] for i, k in zip(odd, reversed(path))]
        changed = [(words[i], k, x) for i, k, x in zip(odd, reversed(path), was) if k and "utf-8" not in CHAINS[k - 1]]
        if sum(self.options[w][k] for w, k, _ in changed) < self.readable * sum(len(x) + 1 for _, _, x in changed):
            return None, gain, True
        for i, x in zip(odd, was):
            words[i] = x
        return "".join(words), gain, bool(changed)

    def line(self, line: str, lost: bool = False) -> tuple[str | None, float, bool]:
        """What the line was, null when it is fine as it is; by how much the result is
        likelier; whether an 8-bit chain took part. Empty when it can't be regained.
        ``lost``: the text has words of question marks elsewhere."""
        asked = [w for w in line.split() if _ASKED.match(w)] if "??" in line else []
        # words of question marks; a single one counts beside words that are left
        if "�" in line or len(asked) > 1 or asked and len(asked[0]) > 4 and (lost or any(map(str.isalpha, line))):
            return "", 99.0, False
        was, gain, eight_bit = self._decoded(line)
        return ("" if was is not None and "�" in was else was), gain, eight_bit

    def lines(self, text: str) -> dict[int, str]:
        """Garbled lines of a text, by number from 1, with what they were."""
        out = {}
        if text not in self.held_lines:
            self.prepare([text])
        suspect = self.held_lines[text]
        if not suspect and "�" not in text and "??" not in text:
            return out
        lost = "??" in text and sum(_ASKED.match(w) is not None for w in text.split()) > 3
        for k, line in enumerate(text.split("\n"), 1):
            if k not in suspect and "�" not in line and "??" not in line:
                continue
            was, gain, eight_bit = self.line(line, lost)
            if was is not None and gain > self.margins[eight_bit]:
                out[k] = was.removesuffix("\r")
        return out

    def prepare(self, texts: list[str | None]) -> None:
        """Learn about the words of some texts all at once, and which of their lines are suspect;
        what was learned of others is forgotten here when it is much."""
        odd = [[] if not t or t.isascii() else [w for w in _ALL_BLANKS.split(t) if not w.isascii()] for t in texts]
        if len(self.suspect) > self.HELD:
            self.suspect.clear()
        if len(self.options) > self.OPTIONS_HELD:
            self.options.clear()
            self.most.clear()
        self.learn({w for ws in odd for w in ws})
        bad: set[str] = set()
        self.held_lines = {}
        for t, ws in zip(texts, odd):
            if t is None:
                continue
            lines = self.held_lines[t] = set()
            if any(map(self.suspect.__getitem__, ws)):
                for k, line in enumerate(t.split("\n"), 1):
                    ws = [] if line.isascii() else [w for w in _BLANKS.split(line)[::2] if not w.isascii()]
                    if any(map(self.suspect.__getitem__, ws)):
                        bad.update(ws)
                        lines.add(k)
        self._learn_options(bad)

    def text(self, text: str) -> str:
        """The text with its garbled lines restored as far as possible: of a line that
        lost bytes, what is left of it."""
        lines = text.split("\n")
        for k, was in self.lines(text).items():
            if not was:
                rest, gain, eight_bit = self._decoded(lines[k - 1].replace("�", ""))
                was = rest.replace("�", "") if rest is not None and gain > self.margins[eight_bit] else lines[k - 1]
            lines[k - 1] = was
        return "\n".join(lines)


def clean_lines(texts: pa.Array) -> list[str]:
    """The clean lines of all texts that are not ASCII."""
    points, offs = to_points(texts)
    keep = clean_chars(points, offs) if len(points) else points
    lines = []
    for k, t in enumerate(texts.to_pylist()):
        good = keep[offs[k] : offs[k + 1]]
        start = 0
        for x in t.split("\n") if t else ():
            if x and good[start] and not x.isascii():
                lines.append(x)
            start += len(x) + 1
    return lines


def _odd_words(line: str) -> list[str]:
    return [w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if not w.isascii()]


def _trials(model: CharModel, lines: list[str]) -> list[tuple[str, str | None, int, float, float, float]]:
    """Distinct lines; each as the chain that its checksum names garbles it, null if that leaves it as it
    is or cannot be; how often it occurs; the score per character of its least likely garbled word and
    that of its words as they are; a bound that the gain of its restoration is never under."""
    times = Counter(lines)
    garbled = {s: garble(s, CHAINS[zlib.crc32(s.encode()) % len(CHAINS)]) for s in times}
    pairs = [(s, _odd_words(s), g, _odd_words(g)) for s, g in garbled.items() if g and g != s]
    was, now = (list({w for p in pairs for w in p[i]}) for i in (1, 3))
    good, bad = dict(zip(was, model.scores(was).tolist())), dict(zip(now, model.scores([readable(w) for w in now]).tolist()))
    out = [(s, None, times[s], 0.0, 0.0, 0.0) for s, g in garbled.items() if not g or g == s]
    for s, clean, g, odd in pairs:
        likely = sum(good[w] for w in clean)
        # the chain by itself is one of the readings
        least = likely - SWITCH - sum(bad[w] for w in odd)
        out.append((s, g, times[s], min(bad[w] / (len(w) + 1) for w in odd), likely / sum(len(w) + 1 for w in clean), least))
    return out


def _steps(bounds: tuple[float, float]) -> int:
    return round((bounds[1] - bounds[0]) / STEP) + 1


def _step(x: float, bounds: tuple[float, float]) -> int:
    return round((min(max(x, bounds[0]), bounds[1]) - bounds[0]) / STEP)


def _count_scores(model: CharModel, lines: list[str], total: np.ndarray) -> None:
    """Count the scores of garbled and of clean words, in steps between their bounds."""
    first = _steps(SUSPECT_BOUNDS)
    for _, g, n, worst, likely, _ in _trials(model, lines):
        if g:
            total[_step(worst, SUSPECT_BOUNDS)] += n
            total[first + _step(likely, READABLE_BOUNDS)] += n


def _quantile(total: np.ndarray, share: float, bounds: tuple[float, float], default: float) -> float:
    """The quantile of scores counted in steps, between two of them by their distance."""
    n = int(total.sum())
    if not n:
        return default
    at = share * (n - 1)
    a, b = np.searchsorted(np.cumsum(total), [int(at), min(int(at) + 1, n - 1)], side="right")
    return float(round(bounds[0] + STEP * (a + (b - a) * (at - int(at))), 6))


def _count_gains(model: CharModel, repairer: Repairer, lines: list[str], total: np.ndarray) -> None:
    """Count, by chains through UTF-8 and 8-bit chains and by the number of cuts under them, the gains of clean
    lines that would be changed and of garbled lines that are restored."""
    total = total.reshape(2, 2, len(CUTS) + 1)
    trials = _trials(model, lines)
    # a line that surely gains more than every cut needs no reading
    read = [g if g and least <= CUTS[-1] + 0.5 else None for _, g, _, _, _, least in trials]
    repairer.prepare([t[0] for t in trials] + read)
    for (s, g, n, *_), r in zip(trials, read):
        # a line without a suspect word stays
        was, gain, eight_bit = repairer.line(s) if repairer.held_lines[s] or "??" in s else (None, 0.0, False)
        if was is not None:
            total[0, int(eight_bit), np.searchsorted(CUTS, gain)] += n
        if r:
            was, gain, eight_bit = repairer.line(r)
            if was == s:
                total[1, int(eight_bit), np.searchsorted(CUTS, gain)] += n
        elif g:
            total[1, int("utf-8" not in CHAINS[zlib.crc32(s.encode()) % len(CHAINS)]), -1] += n


def _margins(total: np.ndarray) -> tuple[float, float]:
    """The margins of chains through UTF-8 and of 8-bit chains: between the gains of clean and
    of garbled lines, where the fewest go wrong."""
    out = []
    for least, clean, bad in zip(LEAST, *total.reshape(2, 2, len(CUTS) + 1)):
        wrong = (3 * (clean.sum() - np.cumsum(clean)) + np.cumsum(bad))[:-1][CUTS >= least]
        good = CUTS[CUTS >= least][wrong == wrong.min()]
        out.append(float(good[len(good) // 2]) if bad.any() else 2 * least)
    return out[0], out[1]


def _over_lines(texts: DataFrame, start: Callable[[], Callable[[list[str], np.ndarray], None]], size: int) -> np.ndarray:
    """``size`` counters over the clean lines of all texts; ``start`` gives a task what counts some lines."""

    def run(batches):
        count, total = start(), np.zeros(size, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                lines = clean_lines(b.column(0).slice(k, TOGETHER))
                for j in range(0, len(lines), VALIDATED):
                    count(lines[j : j + VALIDATED], total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "n"])

    rows = texts.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def validate_margins(texts: DataFrame, model: CharModel) -> tuple[float, ...]:
    """The margins of chains through UTF-8 and of 8-bit chains, validated on all clean lines of
    ``texts`` and on the same lines garbled; and the scores of suspect and of readable words: those of
    nearly all garbled and clean lines. Two passes, of which only counters come back."""
    held = texts.sparkSession.sparkContext.broadcast(model.counts)

    def scores():
        m = CharModel(held.value)
        return lambda lines, total: _count_scores(m, lines, total)

    first = _steps(SUSPECT_BOUNDS)
    total = _over_lines(texts, scores, first + _steps(READABLE_BOUNDS))
    words = _quantile(total[:first], 0.998, SUSPECT_BOUNDS, SUSPECT), _quantile(total[first:], 0.1, READABLE_BOUNDS, READABLE)

    def gains():
        m = CharModel(held.value)
        r = Repairer(m, (0.0, 0.0, *words))
        return lambda lines, total: _count_gains(m, r, lines, total)

    return *_margins(_over_lines(texts, gains, 4 * (len(CUTS) + 1))), *words


def fit(df: DataFrame, text_col: str = "text", id_col: str = "request_id") -> tuple[CharModel, tuple[float, ...]]:
    """The model over all clean lines and its margins, validated on all of them."""
    model = train(df, text_col)
    texts = spread(df.select(F.col(text_col).alias("text")).filter("text is not null"))
    return model, validate_margins(texts, model)


def garbled_lines(df: DataFrame, id_col: str = "request_id", text_col: str = "text", fitted: tuple[CharModel, tuple[float, ...]] | None = None) -> DataFrame:
    """``(id, line_no, restored)`` for each garbled line."""
    model, margins = fitted or fit(df, text_col, id_col)
    held = df.sparkSession.sparkContext.broadcast(model.counts)

    def run(batches):
        r = Repairer(CharModel(held.value), margins)
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            ids = b.column(0).to_pylist()
            for k in range(0, len(texts), TOGETHER):
                r.prepare(texts[k : k + TOGETHER])
                out += [(i, n, s) for i, t in zip(ids[k : k + TOGETHER], texts[k : k + TOGETHER]) if t for n, s in r.lines(t).items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], b.column(0).type), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())], names=["id", "line_no", "restored"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return src.mapInArrow(run, f"id {kind}, line_no int, restored string").withColumnRenamed("id", id_col)


_ODD = re.compile("[\xa0\xad\u02bb-\u02bd\u0370-\u03ff\u2000-\u2012\u2015-\u2018\u201a-\u2025\u2027-\u206f\u3000\ufb00-\uffff]|[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z]|[\u0405\u0408\u0455\u0458]")


def legible(text: str) -> str:
    """The text with odd blanks, width forms and look-alike letters as a reader sees them."""
    return text if text.isascii() or not _ODD.search(text) else "".join(x if x.isascii() else readable(x) for x in re.split("([ \t\r\n]+)", text))


def restored_texts(df: DataFrame, id_col: str = "request_id", text_col: str = "text", fitted: tuple[CharModel, tuple[float, ...]] | None = None, clear: bool = False) -> DataFrame:
    """``(id, text)`` of all rows, garbled lines restored where that is possible; with
    ``clear`` also legible."""
    model, margins = fitted or fit(df, text_col, id_col)
    held = df.sparkSession.sparkContext.broadcast(model.counts)

    def run(batches):
        r = Repairer(CharModel(held.value), margins)
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for k in range(0, len(texts), TOGETHER):
                r.prepare(texts[k : k + TOGETHER])
                out += [t and (legible(r.text(t)) if clear else r.text(t)) for t in texts[k : k + TOGETHER]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return src.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
