"""Statistics of texts by line and word, for the shape rules: whole batches as arrays of code
points, one table gather for the classes of all characters, sums by line and by text.

Defined cases: null and blank texts (no character but blanks and control characters) have NaN.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

from textloom.llm.codepoints import to_points

STATS = ["n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_share", "common_share"]
FEATURES = [
    *STATS, "words_a_line", "letter_share", "stop_rate", "short_line_share", "lead_share", "pipe_share", "tab_share", "semicolon_share", "comma_share", "gap_share",
    "cell_share", "distinct_share", "hard_share", "hex_share", "repeat_share", "line_length", "long_word_share", "entry_chars", "fill", "longest_line",
    "n_distinct", "unspaced_share", "run_share",
]
#: Texts taken together, so that the arrays stay small.
SLICE = 2_000_000
SHORT = 36
LETTER, MARK, DIGIT, BLANK, CONTROL, CONSONANT, HEX, CJK, END, FULL, CLOSER, STOP, BEFORE_STOP, BULLET, LONG = (1 << k for k in range(15))
_M = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and the lower-case letter of each code point."""
    t, low = np.zeros(0x110000, np.uint16), np.arange(0x110000, dtype=np.uint32)
    for p in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000)]:
        c = chr(p)
        kind = unicodedata.category(c)
        t[p] = LETTER * (kind[0] == "L") | MARK * (kind[0] == "M") | DIGIT * (kind[0] == "N") | BLANK * (c.isspace() or kind[0] == "Z") | CONTROL * (p < 32 or 127 <= p < 160)
        if len(c.lower()) == 1:
            low[p] = ord(c.lower())
    for a, b in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x30000)):
        t[a:b] = LETTER
    for a, b in ((0x4E00, 0xA000), (0x3400, 0x4DC0), (0x3040, 0x3100), (0xE00, 0xE80)):
        t[a:b] |= CJK
    for chars, bit in (
        ("бвгджзйклмнпрстфхцчшщґbcdfghjklmnpqrstvwxz", CONSONANT),
        ("0123456789abcdef", HEX),
        (".!?…。！？।؟:", END),
        ("。！？।؟", FULL),
        ("\"'»”’)」』]", CLOSER),
        (".!?…", STOP),
        (")»”\"%", BEFORE_STOP),
        ("-•▪◦*·", BULLET),
        ("abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяіїєґ0123456789", LONG),
    ):
        for c in chars:
            t[ord(c)] |= bit
    t |= np.where(t & (LETTER | MARK), BEFORE_STOP, 0).astype(np.uint16)
    return t, low


@functools.cache
def _powers(n: int) -> np.ndarray:
    """Multipliers of the places in a word or line."""
    return np.multiply.accumulate(np.full(n, _M | np.uint64(1), np.uint64))


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    d = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each piece; equal pieces have equal hashes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = ends - starts
    size = 1 << int(n.max()).bit_length()
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    v = (points[starts[owner] + place].astype(np.uint64) + np.uint64(1)) * _powers(size)[place]
    v ^= v >> np.uint64(29)
    sums = np.add.reduceat(v * _M, np.cumsum(n) - n)
    return (sums ^ (sums >> np.uint64(32))) * _M


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words in small letters, sorted, for ``features``."""
    points, offs = to_points(pa.array([w for w in words if w], pa.large_string()))
    return np.sort(_hashes(points, offs[:-1], offs[1:])) if len(points) else np.empty(0, np.uint64)


def _distinct(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    if not len(h):
        return np.zeros(n)
    at = np.lexsort((h, rows))
    r, v = rows[at], h[at]
    first = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])
    return np.bincount(r[first], minlength=n).astype(float)


def _plain(text: str | None) -> str:
    """Without carriage returns; what encoding errors have destroyed counts as letters."""
    if not text:
        return ""
    text = text.replace("\r", "").replace("��", "ta").replace("�", "a")
    if text.count("??") > 2:
        words = text.split()
        if sum(w.strip("\"'«»().,:;!…") in ("", "?" * len(w)) and "??" in w or w.startswith("??") and set(w) <= set("?.,:;!»)") for w in words) > 2:
            text = text.replace("??", "ta").replace("?", "a")
    return text


def features(texts: list[str | None], common: np.ndarray) -> np.ndarray:
    """Texts x ``FEATURES``; ``common`` are the hashes of the common words."""
    texts = [_plain(t) for t in texts]
    out, start, size = [], 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            out.append(_features(texts[start:k], common))
            start, size = k, 0
        size += len(t)
    out.append(_features(texts[start:], common))
    return np.concatenate(out)


def _features(texts: list[str], common: np.ndarray) -> np.ndarray:
    n = len(texts)
    points, offs = to_points(pa.array([t + "\n" for t in texts], pa.large_string()))
    if not n:
        return np.empty((0, len(FEATURES)))
    table, lower = _classes()
    kind, low = table[points], lower[points]
    kind_low = table[low]
    row = np.repeat(np.arange(n), np.diff(offs))
    per_row = lambda hit: np.bincount(row[hit], minlength=n).astype(float)
    is_ = lambda bit: (kind & bit) > 0
    newline, blank, letter, digit = points == 10, is_(BLANK), is_(LETTER), is_(DIGIT)
    wordly = is_(LETTER | MARK | DIGIT)
    # lines that hold ink, from their first to their last character of it
    line = np.cumsum(newline) - newline
    ink = np.flatnonzero(~blank)
    at = line[ink]
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(ink) else np.empty(0, np.int64)
    first, last = ink[heads], ink[np.append(heads[1:], len(ink)) - 1] if len(ink) else heads
    m = len(first)
    index = np.full(len(points) + 1, -1)  # line number -> line with ink
    index[line[first]] = np.arange(m)
    of = row[first]
    length = last - first + 1
    inner = index[line]  # line of each character, those of blank lines -1
    inside = (inner >= 0) & (np.arange(len(points)) >= first[inner]) & (np.arange(len(points)) <= last[inner]) if m else np.zeros(len(points), bool)
    per_line = lambda hit: np.bincount(inner[hit], minlength=m)
    before, after = np.concatenate([[10], points[:-1]]), np.concatenate([points[1:], [10]])
    k_before, k_after = np.concatenate([table[10:11], kind[:-1]]), np.concatenate([kind[1:], table[10:11]])
    lines = np.maximum(np.bincount(of, minlength=n), 1).astype(float)
    share = lambda hit: np.bincount(of[hit], minlength=n) / lines

    # the last character of a line that does not close something
    open_ = np.flatnonzero(~blank & ~is_(CLOSER))
    final = np.full(m, 10)
    final[inner[open_]] = points[open_]  # later ones overwrite
    ends = (table[final] & END) > 0
    short = (length < SHORT) & ~ends

    # what a line begins with: bullet, number or letter with a stop or bracket
    j = first[:, None] + np.arange(8)
    window = np.where(j <= last[:, None], points[np.minimum(j, len(points) - 1)], 0)
    w_kind = table[window]
    w_letter, w_digit = (w_kind & LETTER) > 0, (w_kind & DIGIT) > 0

    def then(k: int) -> np.ndarray:
        """A letter at place k, or after a blank."""
        return w_letter[:, k] | (window[:, k] == 32) & w_letter[:, k + 1]

    lead = ((w_kind[:, 0] & BULLET) > 0) & then(1) | w_letter[:, 0] & (window[:, 1] == 41) & then(2)
    for k in (1, 2, 3):
        lead |= w_digit[:, :k].all(1) & np.isin(window[:, k], (46, 41)) & then(k + 1)
        for a, b in ((91, 93), (40, 41)):
            lead |= (window[:, 0] == a) & w_digit[:, 1 : k + 1].all(1) & (window[:, k + 1] == b) & then(k + 2)

    # cells
    def cells(char: int) -> tuple[np.ndarray, np.ndarray]:
        """Marks of a line, and the places of all."""
        hit = (points == char) & inside
        return per_line(hit), np.flatnonzero(hit)

    def some(places: np.ndarray) -> np.ndarray:
        out = np.zeros(m, bool)
        out[inner[places]] = True
        return out

    n_pipe, pipes = cells(124)
    pipe = (n_pipe > 1) | some(pipes[(before[pipes] == 32) & (after[pipes] == 32)])
    tab = some(np.flatnonzero((points == 9) & inside))
    n_semi, semi = cells(59)
    later = np.concatenate([inner[semi][1:] == inner[semi][:-1], [False]]) if len(semi) else np.empty(0, bool)
    tight = after[semi] != 32
    semi_share = some(semi[tight & later]) | (n_semi > 1) & (points[last] == 59) | (n_semi == 1) & some(semi[tight & (semi != first[inner[semi]]) & (semi != last[inner[semi]])])
    n_comma, comma = cells(44)
    spaced = (points == 32) | is_(CJK)
    loose_a, loose_b = np.concatenate([[True], spaced[:-1]]), np.concatenate([spaced[1:], [True]])
    edge = (comma == first[inner[comma]]) | (comma == last[inner[comma]])
    tight_both = ~edge & ~loose_a[comma] & ~loose_b[comma]
    comma_share = (n_comma > 1) & some(comma[tight_both]) | (n_comma == 1) & some(comma[~edge & ~loose_b[comma]]) | (points[last] == 44)
    s, e = _runs((points == 32) & inside)
    wide = e - s
    gap = some(s[(wide > 2) & ((table[points[s - 1]] & STOP) == 0)])
    s2, e2 = _runs(blank & inside)
    n_gaps, n_wide = np.bincount(inner[s2], minlength=m), np.bincount(inner[s2[e2 - s2 > 1]], minlength=m)
    gap |= (n_wide > 1) & (n_gaps == n_wide)

    # words
    a, b = _runs(wordly)
    words_of = row[a]
    words = np.maximum(np.bincount(words_of, minlength=n), 1).astype(float)
    h = _hashes(low, a, b)
    is_common = np.isin(h, common)
    is_hex = (b - a == 2) & ((kind_low[a] & HEX) > 0) & ((kind_low[np.minimum(b - 1, len(points) - 1)] & HEX) > 0)
    la, lb = _runs((kind_low & LONG) > 0)
    long_words = np.bincount(row[la[lb - la > 24]], minlength=n)
    # runs of consonants and of one letter
    hard = np.zeros(len(points) + 1, np.int64)
    for (x, y), least in ((_runs((kind_low & CONSONANT) > 0), 6), (_same(low, letter), 3)):
        keep = y - x >= least
        np.add.at(hard, x[keep], 1)
        np.add.at(hard, y[keep], -1)
    hard = np.cumsum(hard[:-1]) > 0
    letters, digits = per_row(letter), per_row(digit)
    n_ink = np.maximum(per_row(~blank), 1)
    sa, sb = _runs(is_(STOP))
    closed = (k_after[sb - 1] & (BLANK | CLOSER)) > 0
    stops = np.bincount(row[sa[((k_before[sa] & BEFORE_STOP) > 0) & closed]], minlength=n) + per_row(is_(FULL))
    chars = np.maximum(np.diff(offs) - 1, 1).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    distinct = _distinct(words_of, h, n)
    ra, rb = _same(points, ~blank)
    shares = {"pipe_share": share(pipe), "tab_share": share(tab), "semicolon_share": share(semi_share), "comma_share": share(comma_share), "gap_share": share(gap)}
    n_words, n_lines = np.bincount(words_of, minlength=n), np.bincount(of, minlength=n)
    f = shares | {
        "n_words": n_words,
        "n_lines": n_lines,
        "mean_word_length": per_row(wordly) / words,
        "symbol_ratio": per_row(~wordly & ~blank) / n_ink,
        "digit_ratio": digits / n_ink,
        "line_end_share": share(ends),
        "common_share": np.bincount(words_of[is_common], minlength=n) / words,
        "words_a_line": n_words / lines,
        "letter_share": letters / np.maximum(letters + digits, 1),
        "stop_rate": stops / lines,
        "short_line_share": share(short),
        "lead_share": share(lead),
        "cell_share": np.max(list(shares.values()), axis=0),
        "distinct_share": distinct / words,
        "hard_share": per_row(hard & letter) / np.maximum(letters, 1),
        "hex_share": np.bincount(words_of[is_hex], minlength=n) / words,
        "repeat_share": 1 - _distinct(of, _hashes(points, first, last + 1), n) / lines,
        "line_length": chars / lines,
        "long_word_share": long_words / words,
        "entry_chars": np.bincount(of, np.where(lead | short, length, 0), minlength=n) / chars,
        "fill": chars / lines / np.maximum(longest, 1),
        "longest_line": longest,
    }
    f |= {
        "n_distinct": distinct,
        "run_share": np.bincount(row[ra], np.where(rb - ra > 3, rb - ra, 0), minlength=n) / n_ink,
        "unspaced_share": per_row(is_(CJK) & letter) / np.maximum(letters, 1),
    }
    out = np.stack([np.asarray(f[k], float) for k in FEATURES], 1)
    out[per_row(~is_(BLANK | CONTROL)) == 0] = np.nan
    return out


def _same(low: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one and the same character, of those for which ``letter`` is true."""
    new = np.concatenate([[True], (low[1:] != low[:-1]) | ~letter[1:]])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(low))
    keep = letter[starts]
    return starts[keep], ends[keep]
