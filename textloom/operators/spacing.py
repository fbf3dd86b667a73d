"""De-spacing of lines written with blanks between the letters.

A line that holds a run of spaced letters is taken apart into words, single letters and marks.
Letters that stand one by one are segmented into lexicon words by dynamic programming over
their positions; the segmentation with the largest sum of cubed word lengths over the cube of
their number wins. Two blanks, a stop, and a capital after a small letter part words for sure.
Runs in one Arrow pass with the lexicon as in ``lexicon.rewrite``.
"""

from __future__ import annotations

import re

from textloom.functions.tokenize import UK
from textloom.operators.lexicon import Lexicon

RUN = re.compile(rf"(?<![{UK}'’ʼ-])[{UK}](?:[ ]+[{UK}'’ʼ-](?![{UK}])){{4,}}")
_PIECE = re.compile(rf" {{2,}}|\s|\.+|[{UK}a-zA-Z0-9'’ʼ\u0301\u2011\u2013-]+|[^\s.{UK}a-zA-Z0-9'’ʼ\u0301\u2011\u2013-]+")
_SINGLE = re.compile(rf"['’ʼ-]?[{UK}]\u0301?['’ʼ]?|[-\u2011\u2013]")
#: Marks before which no blank is set, and after which none is.
_NO_BLANK, _OPENING = ".,:;!?»)]", "«([„"
LONGEST, LONGEST_HYPHENED = 30, 45


def good_word(w: str, x: Lexicon) -> bool:
    """Whether a segment may be a word: not too long, known, one letter only if common."""
    if len(w) > (LONGEST_HYPHENED if "-" in w else LONGEST):
        return False
    return w.lower() in ("а", "у", "в", "і", "й", "о", "з", "є", "я") if len(w) == 1 else x.has(w)


def segment(letters: str, x: Lexicon) -> list[str] | None:
    """Words that the letters make, by score; null if they make none."""
    n = len(letters)
    # best[k][i]: largest sum of cubes of k words over the first i letters
    best: list[dict[int, tuple[int, int]]] = [{0: (0, 0)}]
    words = {(i, j): good_word(letters[i:j], x) for i in range(n) for j in range(i + 1, min(n, i + LONGEST) + 1)}
    top: tuple[float, int] | None = None
    for k in range(1, n + 1):
        row: dict[int, tuple[int, int]] = {}
        for i, (s, _) in best[k - 1].items():
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                if words[i, j] and s + (j - i) ** 3 > row.get(j, (-1, 0))[0]:
                    row[j] = (s + (j - i) ** 3, i)
        if not row:
            break
        best.append(row)
        if n in row and (top is None or row[n][0] / k**3 > top[0]):
            top = (row[n][0] / k**3, k)
    if top is None:
        return None
    out, j = [], n
    for k in range(top[1], 0, -1):
        i = best[k][j][1]
        out.append(letters[i:j])
        j = i
    return out[::-1]


def despace(text: str, x: Lexicon) -> str:
    """Lines with five or more spaced letters as words, where the letters can be segmented; other
    lines stay as they are."""
    return "\n".join(_line(line, x) if RUN.search(line) else line for line in text.split("\n"))


def _line(line: str, x: Lexicon) -> str:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        tail = run.pop() if len(run) > 1 and run[-1] in "-‑–" else None
        if run:
            out.extend((len(run) > 1 and segment("".join(run), x)) or run)
        if tail:
            out.append(tail)
        run.clear()

    body = line.strip()
    for m in _PIECE.finditer(re.sub(r"\. (?=\.)", ".", body)):
        piece = m[0]
        if piece == " ":
            continue
        if not _SINGLE.fullmatch(piece) or not run and piece in "-‑–":
            flush()
            if not piece.isspace():
                out.append(piece)
            continue
        if run and run[-1][-1:].islower() and piece[:1].isupper():
            flush()
        run.append(piece)
    flush()
    text = ""
    for w in out:
        text += w if not text or w[0] in _NO_BLANK or text[-1] in _OPENING else " " + w
    start = line.index(body) if body else 0
    return line[:start] + text + line[start + len(body) :]
