"""Problem 6: repair of text from scanned pages.

Page furniture is taken out first: page numbers, and lines that repeat title or author
beside them. The remaining lines form one character stream without line ends, and its
words are decoded jointly over a lattice. An arc of the lattice reads one or more pieces of the
stream as words: a piece as it is, through confusions of shapes, joined with the next
over a line end with or without its hyphen, merged with the next ones where a blank was added, or
split where a blank was lost. Costs are negative log-probabilities of words in the corpus, of
confusions and of blanks, and a Viterbi pass takes the cheapest path. Paragraphs are the
cheapest partition of the lines, found by dynamic programming; the cost of a paragraph depends
on all of it (marks that are opened and not closed) and on what lies between its lines.

The vocabulary holds the lexicon (fixed tables) and the words that make up at least
``LEAST_SHARE`` of all words of the corpus, so it cannot exceed 1 / ``LEAST_SHARE``
entries whatever the corpus holds, and a lexicon may give at most ``LEXICON_FORMS`` forms; that is
why it may be broadcast.

Defined cases: null, empty and blank texts, and texts that are not running text broken into
lines (single lines, lists, tables, junk), have no damage; a text of whose words less than
``READABLE`` are known is in no language of the vocabulary and is left as it is; a header or page
number has the empty string as its repair.
"""

from __future__ import annotations

import difflib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.sentence_units import corpus_counts
from textloom.runtime import cut, spread

#: At most 1 / LEAST_SHARE words of the corpus enter the vocabulary.
LEAST_SHARE, LEAST_COUNT = 2e-6, 3
#: Costs in nats: a confusion, a word that nobody knows (in small letters, capitalised),
#: a lost or added blank, a hyphen that is no word break, how much a repair must gain.
CONFUSION, SURELY, UNKNOWN, UNKNOWN_NAME, LOST_BLANK, ADDED_BLANK, SUSPENDED, GAIN = 2.7, 2.2, 16.2, 13.7, 5.0, 8.0, 10.5, 1.0
#: By how much a word outside the lexicon is less likely than its count says.
OUTSIDE = 1.5
#: Confusions in a word, and pieces of a word that blanks have parted.
CONFUSIONS, PIECES = 2, 3
LEXICON_SHARE = 1e-5
#: Forms of the lexicons up to which they are broadcast.
LEXICON_FORMS = 1_000_000
#: Cost of a mark that a paragraph opens and does not close, or the other way; the most for a paragraph.
UNCLOSED, MOST_UNCLOSED = 1.0, 3.0
#: Share of known words (of four letters or more) under which a text is not read.
READABLE = 0.4
# Shapes that scanning confuses, true -> read.
CONFUSED = """о 0|т m|и н|н и|і 1|і !|і l|в 8|п гі|м rn|л д|д л|ю іо|ю io|з 3|б 6|є е|є с|ш щ|щ ш|ж *|ї i|ї і|і i|ы ьі|ы ьi|ч 4|й и|и й|ц ц|е с|с е|а о|о а|г т|ґ г|к н|х ж
e c|c e|s 5|i l|l i|i 1|i !|o 0|l 1|n ri|h li|h b|d cl|m rn|g 9|w vv|b 6|t f|u ii|a o|o a|rn m|cl d|ri n|li h|z 2|q 9|ł l|ę e|ą a|ó o|ś s|ć c|ż z|ź z|ń n|ü ii|ü u|ö o|ä a|ß b|ў у|ё е|y v|v y|u v"""
PAIRS = [tuple(p.split(" ")) for line in CONFUSED.split("\n") for p in line.split("|")]
#: Confusions that stand for one another without a loss of shape cost less.
SURE = {r for _, r in PAIRS if not r.isalpha() or r in ("m", "rn", "гі", "іо", "ri", "cl", "vv", "i")}
CONJUNCTIONS = {"й", "і", "та", "або", "чи", "и", "или", "да", "i", "lub", "und", "oder", "and", "or", "а"}
HYPHENS = "-‐¬\xad"
_WRAP = re.compile(rf"[^\W\d_][\d!*]?[{HYPHENS}] ?$")
_NUMBER = re.compile(r"^[-—–\[\](){}•*|.~=\s]{0,6}(?:(?:стор|с|p|pp|page|seite|str|стр|s)\b\.?\s*)?(\d{1,4})(?:\s*/\s*\d{1,4})?[-—–\[\](){}•*|.~=\s]{0,6}$", re.IGNORECASE)
_CHAPTER = re.compile(r"^(?:[IVXLC]+\.?|(?:розділ|глава|раздзел|rozdział|kapitel|chapter|частина|часть|part|§)\b.*|§.*|[*\s]+)$", re.IGNORECASE)
_CHUNK = re.compile(r"\S+")
_STOP_END = re.compile(r"[.!?…][»”\")]*$")
_ADDRESS = re.compile(r"[._@/\\]")
_LEAD, _TAIL = "«„“”\"'’([{—–-*", ".,;:?…»”“\"'’)]}!*"


#: Confusions by the first character of what is read, with their cost.
BY_READ: dict[str, list[tuple[str, str, float]]] = {}
for _true, _read in PAIRS:
    BY_READ.setdefault(_read[0], []).append((_true, _read, SURELY if _read in SURE else CONFUSION))


Reading = tuple[float, str, str | None, str]  # cost, text, damage and the repaired word (null if none)


class Vocabulary:
    """Words with their cost as a tree of letters, and the parts of compounds with a hyphen."""

    HELD = 200_000

    def __init__(self, counts: dict[str, int], lexicon: set[str]):
        total = max(1, sum(counts.values()))
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        least = -math.log(LEXICON_SHARE)
        for w in lexicon:
            self.cost[w] = min(self.cost.get(w, least), least)
        self.sure = lexicon
        self.left = {w.split("-", 1)[0] for w in self.cost if "-" in w}
        self.right = {w.rsplit("-", 1)[1] for w in self.cost if "-" in w}
        self.tree: dict = {}
        for w in self.cost:
            if not any(map(str.isdigit, w)):
                node = self.tree
                for c in w:
                    node = node.setdefault(c, {})
                node[""] = w
        self.memo: dict[str, tuple[float, float, str]] = {}
        self.pieces: dict[tuple[str, bool], tuple[Reading, bool]] = {}

    def piece(self, text: str, starts: bool) -> tuple[Reading, bool]:
        """The reading of one piece by itself, and whether it begins with small letters that make no
        known word."""
        key = text, starts
        if key not in self.pieces:
            if len(self.pieces) > self.HELD:
                self.pieces.clear()
            self.pieces[key] = _one(text, self, starts), _unknown(text, self)
        return self.pieces[key]

    def word(self, w: str) -> tuple[float, float, str]:
        """Cost of a word in small letters as it is (infinite if nobody knows it); least cost through
        confusions, and the word that gives."""
        if w not in self.memo:
            if len(self.memo) > self.HELD:
                self.memo.clear()
            self.memo[w] = self._word(w)
        return self.memo[w]

    def least(self, w: str) -> tuple[float, str]:
        """The cheaper of the two, an unknown word counted."""
        own, other, word = self.word(w)
        own = min(own, UNKNOWN)
        return (other, word) if other < own else (own, w)

    def _word(self, w: str) -> tuple[float, float, str]:
        own = self.cost.get(w, math.inf) if not any(map(str.isdigit, w)) else math.inf
        if w in self.sure and own < math.inf:
            return own, math.inf, w
        other, word = self._confused(w)
        if own == math.inf and other == math.inf and "-" in w:
            parts = [self.least(p) for p in w.split("-") if p]
            if len(parts) == w.count("-") + 1 and all(c < UNKNOWN for c, _ in parts):
                cost, joined = sum(c for c, _ in parts) / len(parts) + 2, "-".join(x for _, x in parts)
                return (cost, math.inf, w) if joined == w else (math.inf, cost, joined)
        return own, other, word

    def _confused(self, w: str) -> tuple[float, str]:
        """The cheapest known word that ``w`` may be a misreading of: all paths of at most
        ``CONFUSIONS`` confusions through the tree."""
        best, word = math.inf, w
        n = len(w)
        todo = [(0, self.tree, 0.0, 0)]
        while todo:
            at, node, spent, used = todo.pop()
            if at == n:
                y = node.get("")
                if y is not None and used and self.cost[y] + spent < best:
                    best, word = self.cost[y] + spent, y
                continue
            c = w[at]
            if c in node:
                todo.append((at + 1, node[c], spent, used))
            if used < CONFUSIONS:
                for true, read, cost in BY_READ.get(c, ()):
                    if w.startswith(read, at):
                        x = node
                        for t in true:
                            x = x.get(t)
                            if x is None:
                                break
                        else:
                            todo.append((at + len(read), x, spent + cost, used + 1))
        return best, word

    def split(self, w: str) -> tuple[float, str] | None:
        """Two known words that a lost blank has joined."""
        found = [(self.cost[w[:k]] + self.cost[w[k:]] + LOST_BLANK, f"{w[:k]} {w[k:]}") for k in range(3, len(w) - 2) if w[:k] in self.cost and w[k:] in self.cost]
        return min(found) if found else None


class Line:
    """A line of running text: its number, text, words with their places."""

    def __init__(self, no: int, text: str):
        self.no, self.text = no, text
        self.chunks = [(m.start(), m.end()) for m in _CHUNK.finditer(text)]


def core(chunk: str) -> tuple[int, int]:
    """Where the word in a chunk begins and ends; trailing ! stays for the decoder."""
    a = len(chunk) - len(chunk.lstrip(_LEAD))
    return a, max(a, len(chunk.rstrip(_TAIL)))


def in_case(word: str, like: str, starts: bool) -> str:
    """``word`` in the letter case of what was read."""
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    if like[:1].isupper() or not like[:1].isalpha() and starts:
        return word[:1].upper() + word[1:]
    return word


def furniture(lines: list[str], width: int) -> dict[int, str]:
    """Lines (by index) that are page numbers or running headers."""
    found: dict[int, str] = {}
    full = [k for k, x in enumerate(lines) if x.strip()]
    place = {k: n for n, k in enumerate(full)}
    numbers = [k for k in full if _NUMBER.match(lines[k].strip()) and not _CHAPTER.match(lines[k].strip()) and not re.search(r"\d\.$", lines[k].strip())]
    for k in numbers:
        found[k] = "page_number"

    def title(k: int) -> str:
        return " ".join(re.sub(r"[\d\W_]+", " ", lines[k]).split()).casefold()

    def plain(k: int) -> bool:
        x = lines[k].strip()
        return len(x) < 0.85 * width and not _CHAPTER.match(x) and not re.search(r"[.,;:!?…-]$", x) and bool(title(k)) and x[:1] not in "—–"

    count: dict[str, int] = {}
    for k in full:
        if k not in found and plain(k):
            count[title(k)] = count.get(title(k), 0) + 1
    for k in full:
        if k in found or not plain(k):
            continue
        x = lines[k].strip()
        beside = any(full[n] in found for n in (place[k] - 1, place[k] + 1) if 0 <= n < len(full))
        numbered = re.match(r"^\d{1,4}\s{2,}\D+$|^\D+\s{2,}\d{1,4}$", x) is not None
        first = place[k] == 0
        if count[title(k)] > 1 and (beside or numbered) and not first or numbered and (beside or x.upper() == x or count[title(k)] > 1):
            found[k] = "running_header"
        elif beside and not first and count[title(k)] == 1 and (x.isupper() or re.match(r"^\w\. \w+", x) or len(x) < 0.6 * width):
            # a single page: the text goes on across the line
            before = next((full[n] for n in range(place[k] - 1, -1, -1) if full[n] not in found), None)
            after = next((full[n] for n in range(place[k] + 1, len(full)) if full[n] not in found), None)
            if before is not None and after is not None and (not re.search(r"[.!?…][»”\")]*$", lines[before].strip()) or not plain(before) and len(lines[before].rstrip()) > 0.8 * width) and len(lines[after].rstrip()) > 0.5 * width:
                found[k] = "running_header"
    # a header that was once not beside a number, or itself misread; a line that parts a word or sentence
    heads = {title(k) for k, what in found.items() if what == "running_header"}
    for k in full[1:]:
        if k in found or not plain(k):
            continue
        beside = any(full[n] in found for n in (place[k] - 1, place[k] + 1) if 0 <= n < len(full))
        before = next((full[n] for n in range(place[k] - 1, -1, -1) if full[n] not in found), None)
        after = next((full[n] for n in range(place[k] + 1, len(full)) if full[n] not in found), None)
        # no heading stands inside a word or a sentence
        fits = after is not None and len(lines[k].rstrip()) + 1 + len(lines[after].split()[0]) <= width - 4
        open_ = before is not None and (_WRAP.search(lines[before].rstrip()) or fits and len(lines[before].rstrip()) > 0.7 * width and not re.search(r"[.!?…:;][»”\")]*$", lines[before].rstrip()))
        parts = open_ and after is not None and re.match(r"\d{0,4}\s*[^\W\d_]", lines[k].strip()) and not lines[k].strip()[:1].islower() and (lines[after].lstrip()[:1].islower() or lines[after].lstrip()[:1].isdigit()) and len(lines[k].strip()) < 0.8 * width
        # a short line that is no end of a sentence and touches the text; headings stand free
        blank = (k > 0 and not lines[k - 1].strip(), k + 1 < len(lines) and not lines[k + 1].strip())
        touches = after is not None and not all(blank) and re.match(r"(?:\d{1,4}\s+)?[^\W\d_]", lines[k].strip()) and not lines[k].strip()[:1].islower() and len(lines[k].rstrip()) + 1 + len(lines[after].split()[0]) <= width - 4
        same = any(difflib.SequenceMatcher(None, title(k), h).ratio() > 0.75 for h in heads) if beside and heads else False
        if parts or same or touches or title(k) in heads and count[title(k)] > 1:
            found[k] = "running_header"
    return found


def is_wrapped(lines: list[str], width: int) -> bool:
    """Whether the lines are running text broken at a width."""
    if width < 20:
        return False
    gaps = right = 0
    for a, b in zip(lines, lines[1:]):
        if not a.strip() or not b.strip() or b.startswith("   "):
            continue
        gaps += 1
        first = b.split()[0]
        right += len(a.rstrip()) + 1 + len(first) > width - 3 or _WRAP.search(a.rstrip("\r")) is not None
    # two long lines may be two paragraphs; where there are more, chance does not fill them all
    return gaps > 0 and right >= 0.6 * gaps and (width <= 130 or gaps > 3)


def _gaps(lines: list[Line], blank_before: set[int], width: int) -> list[float]:
    """Cost of a boundary before each line, less the cost of none."""
    indents = sum(x.text.startswith("   ") for x in lines)
    out = [0.0]
    for k in range(1, len(lines)):
        before, after = lines[k - 1].text.rstrip(), lines[k].text
        c = 2.0
        if before[-1] in HYPHENS:
            c += 8
        if _STOP_END.search(before):
            c -= 1.5
            if len(before) + 1 + len(after.split(None, 1)[0]) <= width - 3:
                c -= 3
        else:
            c += 3
        if after.lstrip()[:1].islower():
            c += 5
        if after.startswith("   "):
            c -= 5
        elif indents > 1:
            c += 1
        if k in blank_before:
            c -= 3
        out.append(c)
    return out


def _opened(lines: list[Line]) -> list[int]:
    """Quotations and brackets opened less those closed before each line, and in all."""
    out = [0]
    for x in lines:
        out.append(out[-1] + sum(map(x.text.count, "«„([")) - sum(map(x.text.count, "»“)]")))
    return out


def partition_cost(lines: list[Line], blank_before: set[int], width: int, starts: list[int]) -> float:
    """Cost of the paragraphs that begin at ``starts``, the first at 0."""
    gap, open_ = _gaps(lines, blank_before, width), _opened(lines)
    places = sum(max(gap[k], 0.0) if k in starts else max(-gap[k], 0.0) for k in range(1, len(lines)))
    return places + sum(min(UNCLOSED * abs(open_[b] - open_[a]), MOST_UNCLOSED) for a, b in zip(starts, [*starts[1:], len(lines)]))


def paragraphs(lines: list[Line], blank_before: set[int], width: int) -> list[int]:
    """Indices of the lines that begin a paragraph: the cheapest partition of the lines.

    A place between two lines costs something if a paragraph ends there without a sign of it, or
    runs on in spite of one; a paragraph costs something if it does not close what it opens. A
    start is given up once no later line can make it the better one, which the bound
    on the cost of a paragraph tells, so the result is exact and few starts are held.
    """
    n = len(lines)
    gap, open_ = _gaps(lines, blank_before, width), _opened(lines)
    best, at = [0.0] * (n + 1), [0] * (n + 1)
    starts = {0: 0.0}  # start -> cost up to it and of the places run over since
    for j in range(1, n + 1):
        whole = {k: c + min(UNCLOSED * abs(open_[j] - open_[k]), MOST_UNCLOSED) for k, c in starts.items()}
        at[j] = min(whole, key=lambda k: (whole[k], -k))
        best[j] = whole[at[j]]
        if j < n:
            g = gap[j]
            new = best[j] + max(g, 0.0)
            starts = {k: c + max(-g, 0.0) for k, c in starts.items() if c + max(-g, 0.0) < new + MOST_UNCLOSED}
            if new < min(starts.values(), default=math.inf) + MOST_UNCLOSED:
                starts[j] = new
    out, j = [], n
    while j:
        out.append(at[j])
        j = at[j]
    return out[::-1]


def repair(text: str | None, vocab: Vocabulary) -> tuple[list[tuple[int, str, str]], str]:
    """The damages of a text as (line_no, damage, repaired), and the repaired text."""
    if not text:
        return [], text
    lines = [x.rstrip("\r") for x in text.split("\n")]
    sizes = sorted(len(x.rstrip()) for x in lines if x.strip())
    if len(sizes) < 2:
        return [], text
    width = sizes[min(len(sizes) - 1, int(len(sizes) * 0.97))]
    taken = furniture(lines, width)
    if not is_wrapped([x for k, x in enumerate(lines) if k not in taken], width):
        return [], text
    words = [m.group().lower() for k, x in enumerate(lines) if k not in taken for m in re.finditer(r"[^\W\d_]{4,}", x)]
    if sum(w in vocab.cost for w in words) < READABLE * len(words):
        return [], text
    damage = [(k + 1, what, "") for k, what in taken.items()]
    run = [Line(k + 1, x) for k, x in enumerate(lines) if k not in taken and x.strip()]
    blank_before = {n for n in range(1, len(run)) if any(not lines[k].strip() for k in range(run[n - 1].no, run[n].no - 1)) and not any(k in taken for k in range(run[n - 1].no, run[n].no - 1))}
    begins = paragraphs(run, blank_before, width)
    out = []
    for a, b in zip(begins, [*begins[1:], len(run)]):
        if a < b:
            out.append(" ".join(_decode(run[a:b], vocab, damage)))
    return sorted(damage), "\n\n".join(x for x in out if x)


Piece = tuple[int, str, bool]  # line, text, whether a line end follows


def _decode(lines: list[Line], vocab: Vocabulary, damage: list[tuple[int, str, str]]) -> list[str]:
    """The words of a paragraph by the cheapest path through the lattice of its pieces; what was
    repaired is added to ``damage``."""
    pieces: list[Piece] = [(x.no, x.text[a:b], c == len(x.chunks) - 1) for x in lines for c, (a, b) in enumerate(x.chunks)]
    n = len(pieces)
    starts = [True] + [t.rstrip("»”\")'")[-1:] in ".!?…" for _, t, _ in pieces]
    best: list[float] = [0.0] + [math.inf] * n
    back: list[tuple[int, Reading] | None] = [None] * (n + 1)

    def arc(i: int, j: int, r: Reading) -> None:
        if best[i] + r[0] < best[j]:
            best[j], back[j] = best[i] + r[0], (i, r)

    alone = [vocab.piece(text, first) for (_, text, _), first in zip(pieces, starts)]
    for i, (_, text, ends) in enumerate(pieces):
        one = alone[i][0]
        arc(i, i + 1, one)
        if i + 1 < n:
            if ends and _WRAP.search(text):
                joined = _join(text, pieces[i + 1][1], vocab, starts[i])
                if joined:
                    arc(i, i + 2, joined)
            elif one[0] >= min(UNKNOWN, UNKNOWN_NAME) or alone[i + 1][1]:
                for j in range(i + 2, min(n, i + PIECES) + 1):
                    merged = _merge([t for _, t, _ in pieces[i:j]], vocab, starts[i])
                    if merged:
                        arc(i, j, merged)
                    if pieces[j - 1][1][-1:] in _TAIL:
                        break
    out, j = [], n
    while j:
        i, (_, text, what, word) = back[j]
        out.append(text)
        if what:
            damage.append((pieces[i][0], what, word))
        j = i
    return out[::-1]


def _plain(w: str) -> str:
    return w.lower().replace("’", "'").replace("ʼ", "'")


def _unknown(text: str, vocab: Vocabulary) -> bool:
    """Whether the piece begins with small letters that make no known word."""
    a, b = core(text)
    w = text[a:b]
    return a == 0 and w.isalpha() and w.islower() and vocab.word(_plain(w))[0] == math.inf


def _one(text: str, vocab: Vocabulary, starts: bool) -> Reading:
    """The cheapest reading of one piece: as it is, misread, or two words without their blank."""
    a, b = core(text)
    w = text[a:b]
    letters = sum(map(str.isalpha, w))
    if letters < 2 or letters < 0.5 * len(w) or _ADDRESS.search(w):
        return UNKNOWN / 2, text, None, ""
    low = _plain(w)
    own, cost, word = vocab.word(low)
    asis = min(own, UNKNOWN_NAME if w[:1].isupper() and not starts else UNKNOWN)
    # a trailing ! or * may be a letter
    if text[b : b + 1] in ("!", "*") and low not in vocab.sure:
        _, more_cost, more = vocab.word(low + text[b])
        if more_cost < cost:
            b, cost, word = b + 1, more_cost, more
    # a word that only the corpus knows may be a misreading that recurs, the more so if the lexicon has the other
    if cost + GAIN < asis + (OUTSIDE if own < math.inf and word in vocab.sure else 0.0):
        fixed = in_case(word, w, starts)
        return cost, text[:a] + fixed + text[b:], "misread", fixed
    if own == math.inf and w.isalpha():
        two = vocab.split(low)
        if two and two[0] + GAIN < asis:
            return two[0], text[:a] + in_case(two[1], w, starts) + text[b:], None, ""
    return asis, text, None, ""


def _merge(parts: list[str], vocab: Vocabulary, starts: bool) -> Reading | None:
    """The pieces as one known word into which blanks were set."""
    a, end = core(parts[0])[0], core(parts[-1])[1]
    letters = [parts[0][a:], *parts[1:-1], parts[-1][:end]]
    if not all(x.isalpha() for x in letters) or not all(x.islower() for x in letters[1:]):
        return None
    own = vocab.word(_plain("".join(letters)))[0]
    if own == math.inf:
        return None
    return own + ADDED_BLANK * (len(parts) - 1), parts[0][:a] + "".join(letters) + parts[-1][end:], None, ""


def _join(left: str, right: str, vocab: Vocabulary, starts: bool) -> Reading | None:
    """The word that a line end has broken; null if the hyphen is the writer's (Дво- й
    триповерхові). Two unknown halves are one unknown word."""
    a = len(left) - len(left.lstrip(_LEAD))
    end = core(right)[1]
    head, tail = left[a:-1], right[:end]
    if not tail or not head or not (tail[0].isalnum() or tail[0] in "!*'’ʼ"):
        return None
    low_h, low_t = _plain(head), _plain(tail)
    one_cost, one = vocab.least(low_h + low_t)
    two_cost, two = vocab.least(f"{low_h}-{low_t}")
    if one == low_h + low_t and one not in vocab.cost and low_h.rsplit("-", 1)[-1] in vocab.left and low_t in vocab.right:
        two_cost, two = min(two_cost, UNKNOWN - 1), f"{low_h}-{low_t}"
    if two == f"{low_h}-{low_t}" and two not in vocab.cost and not (low_h in vocab.left and low_t in vocab.right):
        two_cost = UNKNOWN + 1
    if low_t in CONJUNCTIONS and min(one_cost, two_cost) > SUSPENDED:
        return None
    best = one if one_cost <= two_cost else two
    word = in_case(best, head, starts)
    if best in (low_h + low_t, f"{low_h}-{low_t}") and any(c.isupper() for c in head[1:]):
        word = head + best[len(low_h) :]
    # the hyphen at the line end is all but certain evidence of one word
    return min(one_cost, two_cost) - UNKNOWN, left[:a] + word + right[end:], "hyphen_wrap", word


def vocabulary(df: DataFrame, lexicons: list[DataFrame], text_col: str = "text") -> tuple[dict[str, int], set[str]]:
    """Counts of the words that make up at least ``LEAST_SHARE`` of the corpus, and the
    forms of the lexicons, all in small letters."""
    counts = cut(corpus_counts(df, text_col).select("word", (F.col("dot") + F.col("bare")).alias("n")).filter("n > 0"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= max(LEAST_COUNT, total * LEAST_SHARE)).filter(~F.col("word").rlike(r"[.]")).toArrow()
    words = dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    forms: set[str] = set()
    for x in lexicons:
        some = x.select(F.lower("form").alias("form")).filter("form is not null").distinct().limit(LEXICON_FORMS + 1).toArrow()
        if some.num_rows > LEXICON_FORMS:
            raise ValueError(f"a lexicon of more than {LEXICON_FORMS} forms")
        forms |= set(some.column(0).to_pylist())
    return {_plain(w): n for w, n in words.items()}, forms


def _apply(df: DataFrame, lexicons: list[DataFrame], id_col: str, text_col: str, run, schema: str) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(vocabulary(df, lexicons, text_col))
    kind = df.schema[id_col].dataType.simpleString()
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return src.mapInArrow(lambda batches: run(batches, Vocabulary(*held.value)), f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def damages(df: DataFrame, lexicons: list[DataFrame], id_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, damage, repaired)`` of every text, one row for each damage."""

    def run(batches, vocab):
        for b in batches:
            out = [(i, *d) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for d in repair(t, vocab)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.column(0).type), pa.array([x[1] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.string()) for k in (2, 3))], names=["id", "line_no", "damage", "repaired"])

    return _apply(df, lexicons, id_col, text_col, run, "line_no int, damage string, repaired string").distinct()


def repaired_texts(df: DataFrame, lexicons: list[DataFrame], id_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """``(id, text)``: scanned texts as continuous paragraphs, other texts as they are."""

    def run(batches, vocab):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([repair(t, vocab)[1] for t in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return _apply(df, lexicons, id_col, text_col, run, "text string")
