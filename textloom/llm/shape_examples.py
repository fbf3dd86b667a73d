"""Labelled documents for the shape classifier, built by layout rules from words
and sentences: prose, lists, tables and junk. Deterministic; the number is a parameter."""

from __future__ import annotations

import random
import re
import textwrap

from textloom.llm.seeds import SENTENCES

STOPS = ".!?…。！？।؟"
LETTERS = ("абвгдежзийклмнопрстуфхцчшщьюяіїєґ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "abcdefghijklmnopqrstuvwxyz")
KEYBOARDS = ("qwertyuiop", "asdfghjkl;", "zxcvbnm,./", "йцукенгшщз", "фівапролджє", "ячсмитьбю.", "1234567890")
SYMBOLS = "!#$%&*+-/<=>@[]^_{|}~\\"


def sentences(texts: list[str]) -> list[str]:
    """Plain sentences found in the texts, by a rough split."""
    out = []
    for t in texts:
        for s in re.split(r"(?<=[.!?…])\s+", t):
            if 2 <= len(s.split()) <= 25 and s[-1] in STOPS and s[0].isupper() and "\n" not in s and sum(c.isalpha() or c == " " for c in s) > 0.7 * len(s):
                out.append(s)
    return out


def _prose(r: random.Random, said: list[str]) -> str:
    said = r.sample(said, min(len(said), r.choice((3, 10, 40, 400))))  # some texts say the same again and again
    pick = [r.choice(said) for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12, 20)))]
    kind = r.choice((0, 1, 2, 2, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8, 9))
    if kind == 9:
        a, b = r.randint(1, 99), r.randint(1, 99)
        pick = [r.choice((f"See pp. {a}–{b}, fig. {a}.{b}, and vol. {b}.", f"Див. с. {a}, рис. {b}.{a} і табл. {a}.", f"Por. s. {a}, rys. {b}.", f"Vgl. S. {a}, Abb. {b}.", f"См. с. {a}, рис. {b}.", f"Version {a}.{b}.1 is out!", f"The ratio rose to {a}.{b} p.c. in 19{a:02d}.", *pick[:6])) for _ in range(r.randint(1, 9))]
    if kind == 8:
        said = re.split(r"(?<=[。！？।؟.])|\n", SENTENCES[r.choice(("ja", "zh", "th", "hi", "ar"))])
        pick = [re.sub(r"\d+", lambda m: str(r.randint(1, 10 ** len(m[0]))), r.choice([x for x in said if x])) for _ in pick]
        return r.choice(("", " ", "\n\n")).join(pick)
    if kind == 0:
        return "\n".join("— " + s for s in pick)
    if kind == 1:
        return "\n\n".join(" ".join(pick[i : i + 3]) for i in range(0, len(pick), 3))
    if kind == 2:
        pages = textwrap.wrap(" ".join(pick), r.randint(38, 70), initial_indent=r.choice(("", "   ")))
        for i in range(len(pages) - 1):
            w = pages[i].split(" ")[-1]
            if len(w) > 5 and r.random() < 0.4:
                pages[i] = pages[i][:-3] + r.choice(("-", "- ", "\xad", "¬", "‐"))
                pages[i + 1] = w[-3:] + " " + pages[i + 1]
        for at in range(len(pages) - 3, 3, -12):
            pages[at:at] = [r.choice((f"— {r.randint(2, 400)} —", f"[{r.randint(2, 400)}]", f"{r.randint(1, 400)}")), r.choice(said)[:20].strip(STOPS)]
        return "\n".join(pages)
    if kind == 3:
        return "\n".join(pick)
    if kind == 4:
        unit = r.choice(("%", "млн", "тис.", "kg", "шт"))
        return " ".join(f"{s.rstrip(STOPS)} {r.randint(1, 99)},{r.randint(0, 9)} {unit}, {r.randint(1900, 2030)}: {r.randint(100, 9999)}." for s in pick)
    if kind == 5:
        mark = r.choice(("{}) ", "- ", "• ", "{}. ", "[{}] "))
        items = [mark.format(k) + " ".join(r.choice(said).split()[: r.randint(1, 3)]).strip(STOPS) + ";" for k in range(1, r.randint(4, 7))]
        more = [" ".join(r.choice(said) for _ in range(r.randint(3, 8))) for _ in range(r.randint(2, 4))]
        return r.choice(("\n\n", "\n")).join([more[0], "\n".join(items), *more[1:]])
    if kind == 6:
        return "\n\n".join([" ".join(r.choice(said).split()[:2]).strip(STOPS), " ".join(pick)])
    return " ".join(pick)


def _lost(r: random.Random, text: str) -> str:
    """The text with letters that encoding has destroyed, all or those of some sentences."""
    if r.random() < 0.5:
        return text.encode("ascii", "replace").decode() if not text.isascii() else text
    return re.sub(r"[^\W\d_]", lambda m: "�" * r.randint(1, 2) if r.random() < 0.5 else m[0], text)


def _entry(r: random.Random, words: list[str], most: int = 4) -> str:
    e = " ".join(r.choice(words) for _ in range(r.randint(1, most)))
    return e.capitalize() if r.random() < 0.4 else e


def _list(r: random.Random, words: list[str], said: list[str]) -> str:
    kind, start = r.randrange(7), r.randint(1, 5)
    marks = "абвгдежзиклмнопрстуфхц" if r.random() < 0.7 else "abcdefghijklmnopqrstuv"
    lines = []
    for k in range(r.randint(5, 32)):
        lead = ("", "- ", "• ", f"{k + start}. ", f"{k + start}) ", f"{marks[(k + start) % 22]}) ", f"[{k + start}] ")[kind]
        tail = r.choice(("", "", "", ",", ";", f" — {r.randint(1, 400)}", f", {r.randint(1, 90)} шт", f" ({r.randint(1, 90)})", "."[: kind > 0 and r.random() < 0.2]))
        lines.append(lead + _entry(r, words) + tail)
    if r.random() < 0.5:
        lines.insert(0, _entry(r, words, 3).capitalize() + r.choice((":", ":", "")))
    if r.random() < 0.2:
        lines.insert(0, r.choice(said))
    return "\n".join(lines)


def _cell(r: random.Random) -> str:
    return r.choice((f"{r.randint(0, 9999)}", f"{r.randint(1, 99)}.{r.randint(0, 99):02d}", f"{r.randint(1, 100)} %", "—", "", f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}"))


def _table(r: random.Random, words: list[str]) -> str:
    cols = r.randint(2, 7)
    rows = [[_entry(r, words, 2).capitalize() for _ in range(cols)]] if r.random() < 0.9 else []
    for _ in range(r.randint(4, 30)):
        rows.append([_entry(r, words, 2) if k == 0 or r.random() < 0.15 else _cell(r) for k in range(cols)])
    kind = r.randrange(6)
    if kind == 4:
        wide = r.randint(12, 18)
        lines = ["".join(c[: wide - 1].ljust(wide) for c in row).rstrip() for row in rows]
    elif kind == 5:
        bar = "+" + "-" * 30 + "+"
        lines = [bar, *("| " + " | ".join(row) + " |" for row in rows), bar]
    else:
        lines = [(",", ";", "\t", " | ")[kind].join(row) for row in rows]
    if r.random() < 0.4:
        lines.insert(0, _entry(r, words, 3).capitalize())
    return "\n".join(lines)


def _junk(r: random.Random, words: list[str]) -> str:
    kind, n = r.choice((0, 1, 2, 3, 4, 5, 6, 6, 7, 8)), r.randint(3, 26)
    abc = r.choice(LETTERS)
    if kind == 0:
        lines = ["".join(r.choice(SYMBOLS) for _ in range(r.randint(8, 60))) for _ in range(n)]
    elif kind == 1:
        lines = [" ".join(f"{r.randrange(256):02x}" for _ in range(16)) for _ in range(n)]
    elif kind == 2:
        blank = r.choice((0.0, 0.03, 0.12))
        lines = ["".join(" " if r.random() < blank else r.choice(abc) for _ in range(r.randint(20, 70))) for _ in range(n)]
    elif kind == 3:
        rows = [row[i : i + r.randint(3, 6)] for row in KEYBOARDS for i in r.sample(range(7), 2)]
        keys = r.sample(rows, r.randint(3, 6)) + r.sample(["123", "1234", "...", "!!!", r.choice(abc) * 3, "???", "--"], r.randint(1, 4))
        lines = [" ".join(r.choice(keys) for _ in range(r.randint(3, 12))) for _ in range(n)]
    elif kind == 4:
        lines = [r.choice(("*", "-", "=", "?", "0 0", "<>", "№", "#", "~", "xX")) * r.randint(0, 25) + str(r.randint(1000, 999999)) for _ in range(n)]
    elif kind == 5:
        lines = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64)) for _ in range(n)]
    elif kind == 8:
        lines = ["".join(r.choice(abc + abc.upper() + "..!!??") * r.randint(9, 50) for _ in range(r.randint(4, 20)))]
    elif kind == 6:
        part = r.choice((r.choice(words), _entry(r, words), _entry(r, words), r.choice(abc) * r.randint(2, 4), "la" + r.choice(abc), r.choice(words) + r.choice("!.- ")))
        lines = [r.choice((" ", "", "-", ", ", "\n", "\n")).join([part] * r.randint(6, 60)) for _ in range(r.choice((1, 1, n)))]
    else:
        lines = ["".join(r.choice(abc + abc.upper() + SYMBOLS + "0123456789    ") for _ in range(r.randint(10, 60))) for _ in range(n)]
    return "\n".join(lines)


def examples(texts: list[str], n: int, seed: int = 7) -> list[tuple[str, str]]:
    """``n`` pairs (text, shape); words and sentences come from ``texts`` and the seeds."""
    r = random.Random(seed)
    seeds = [x for t in SENTENCES.values() for x in re.split(r"(?<=[.!?…])\s+|(?<=[。！？।])|\n", t) if x]
    said = [*seeds, *sentences(texts)]
    words = sorted({w for s in said for w in re.findall(r"[^\W\d_]{3,14}", s.lower())})
    out = []
    for k in range(n):
        shape = ("prose", "list", "prose", "table", "prose", "junk")[k % 6]
        pool = r.sample(words, min(len(words), r.choice((4, 8, 15, 40, 200))))  # some lists repeat themselves
        t = {"prose": lambda: _prose(r, said), "list": lambda: _list(r, pool, said), "table": lambda: _table(r, pool), "junk": lambda: _junk(r, words)}[shape]()
        if shape == "prose" and r.random() < 0.06:
            t = _lost(r, t)
        out.append((t.replace("\n", "\r\n") if r.random() < 0.1 else t, shape))
    return out
