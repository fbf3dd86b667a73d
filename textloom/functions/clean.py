"""Cleaning steps that need no lexicon, in the order of the plan. Each is callable on a
Column, and on a string inside a pass that asks a lexicon.

A step is guarded by a cheap test where it looks for one character, so that its
regular expressions run on few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.steps import Step, letters, put, sub
from textloom.functions.tokenize import UK

L = f"[{UK}]"
A = "'’ʼ"
# Control characters that are removed, apostrophe-like characters, typos.
CONTROL = r"[\x{00}-\x{08}\x{0B}-\x{12}\x{14}-\x{1F}\x{0A0D}]"
ODD_APOSTROPHES = "\"”‟‘′̓΄\u0092´`?*"
TYPOS = [("дербюджет", "держбюджет"), ("фінасуванн", "фінансуванн"), ("адмінстрац", "адміністрац"), ("дистопад", "листопад"), ("заборгованност", "заборгованост"), ("авіакастроф", "авіакатастроф"), ("зазанач", "зазнач"), ("йдетьсяу", "йдеться у")]
MONTHS = "січня|лютого|березня|квітня|травня|червня|липня|серпня|вересня|жовтня|листопада|грудня".split("|")
PHRASES = ["України", "Сесійний зал Верховної Ради", "Оплески", "Після перерви", "Лунає Гімн", "Лунає Державний Гімн", "постановляє", "Хвилина мовчання", "Йде реєстрація", "Шум у залі"]
LATIN, CYRILLIC = "aceiopxyrABCEHIKMOPTXY", "асеіорхугАВСЕНІКМОРТХУ"
ACCENTED = {"á": "а́", "Á": "А́", "é": "е́", "É": "Е́", "í": "і́", "Í": "І́", "ḯ": "ї́", "Ḯ": "Ї́", "ó": "о́", "Ó": "О́", "ú": "и́", "ý": "у́", "Ý": "У́"}
PROTECTED = "Fest|Train|Inform|SOS|Art|City|News|UA"
BRANDS = [("Табло", "ID"), ("Ф", "irtka"), ("Схід", "Side"), ("Оsта", "NNя"), ("Depo", "Дніпро")]


_NOT_BEFORE, _NOT_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: A carriage return without a line feed becomes a line feed.
orphan_cr = Step(sub(r"\r(?!\n)", "\n"), when="\r")
without_cr = Step(put("\r", ""))
dos_newlines = Step(put("\n", "\r\n"))
direction_marks = Step(put("\u200e", ""))
#: U+001D: joins a word at a line end, is a hyphen inside a word.
unit_separator_hyphens = Step(sub(rf"({L})\x{{1D}}\n({L}+[,.;!?]?)", "$1$2\n"), sub(rf"({L})\x{{1D}}({L})", "$1-$2"), when="\x1d")
control_chars = Step(sub(CONTROL, ""))
# Names that a blank has split, and slips of single corpora.
GLUED = [("Крим SOS", "КримSOS"), ("Євромайдан SOS", "ЄвромайданSOS"), ("Чорнобиль Art", "ЧорнобильArt"), ("Золотоноша City", "ЗолотоношаCity"), ("Умань News", "УманьNews"), ("Хутро OFF", "ХутроOFF"), ("Ник Life", "НикLife")]
SLIPS = [("пагороджен", "нагороджен"), ("голсоування", "голосування"), ("річ-чя", "річчя"), ("каналуМнения", "каналу Мнения"), ("номеріжурналу", "номері журналу"), (" зорутут", " зору тут")]
#: Repairs of single corpora.
corpus_fixes = Step(
    *(put(a, b) for a, b in GLUED),
    sub("(?iu)(Армія) (Inform)", "$1$2"),
    sub("(?iu)(Гоголь|Пуленк) (FEST|Train)", "$1$2"),
    *(put(a, b) for a, b in SLIPS),
    sub(r"(Івано)[ \t]+(Франківськ)", "$1-$2"),
    sub(r"(Івано)[ \t]+([–‑-])[ \t]+(Франківськ)", "$1$2$3"),
    sub("([дД]епутата?)([А-ЯІЇЄҐ])", "$1 $2"),
)
#: Abstracts and lists of references of journals, up to the next blank line.
abstracts = Step(sub(r"(?s)\n *(?:[Aa]bstract|ABSTRACT|[Rr]esume|RESUME|[Ll]iteratura|(?:Джерела та|Використана|Цитована) [Лл]ітература|СПИСОК ЛІТЕРАТУРИ)\n.+?(?:\n\n|\n?\z)", "\n"), rounds=2)
#: Typos that are safe without a lexicon.
typos = Step(
    sub(f"тсья{_NOT_AFTER}", "ться"),
    *(put(a, b) for a, b in TYPOS),
    sub(f"{_NOT_BEFORE}(?:мдрд|мрлд|мрд){_NOT_AFTER}", "млрд"),
    sub(f"{_NOT_BEFORE}перс-(служб|центр|секрет|конф)", "прес-$1"),
    sub("(?:повдіомле|повідмле|повідмоле)нн", "повідомленн"),
)
#: Doubled and escaped quotes, U+200B, U+02BA and U+201A.
quotes = Step(
    sub("(?<!')''(?!')", '"'),
    put('\\"', '"'),
    sub(r"([бвгґдзкмнпрстфхш])\\'([яєюї])", "$1'$2"),
    sub(rf"({L})\x{{200B}}([а-яіїєґ])", "$1$2"),
    sub(r"([А-ЯІЄЇҐ])\x{200B}([А-ЯІЄЇҐ])", "$1$2"),
    sub(r"\x{200B}+", " "),
    letters("ʺ‚", '",'),
)
#: Letter and combining mark as ї or й; a Latin i counts as well.
combining = Step(sub(r"[іi]\x{308}", "ї"), sub(r"[ІI]\x{308}", "Ї"), sub(r"и\x{306}", "й"), sub(r"И\x{306}", "Й"), when=r"[\x{306}\x{308}]")
#: Quote-like characters between consonant and є ї ю я; acute before a vowel as accent.
apostrophes = Step(
    sub(f"([бвгґдзкмнпрстфхшБВГҐДЗКМНПРСТФХШ])[{''.join(chr(92) + c if c in '?*' else c for c in ODD_APOSTROPHES)}]([єїюяЄЇЮЯ])", "$1'$2"),
    sub("[´`]([аеєиіїоуюяАЕЄИІЇОУЮЯ])", "\u0301$1"),
)
_W = rf"{UK}a-zA-Z{A}"
#: U+00AD: at a line end it joins the word and the line end moves behind it; between digit
#: and letter it is a hyphen; elsewhere it goes.
soft_hyphens = Step(
    sub(rf"([{_W}][-–—‑]?)\x{{AD}}+(\n[ \t]*)([-–—‑]?[{_W}-]+)([,;.!?]?)", "$1$3$4$2"),
    sub(rf"([0-9])\x{{AD}}+([{UK}a-zA-Z])", "$1-$2"),
    sub(rf"([{_W}:. ][-–—‑]?)\x{{AD}}+([-–—‑]?[{_W} -])", "$1$2"),
    when=r"\x{AD}",
)
line_separators = Step(sub(r"\x{2028}\n?", "\n"))
#: The digit 3 for the letter З, at the start of a sentence.
digit_three = Step(sub(rf"(^|[!?.][\s\p{{Z}}]+)3[аa]([\s\p{{Z}}]*{L})", "$1За$2"))
#: Frequent mixes of Latin and Cyrillic that need no lexicon.
mix_shortcuts = Step(
    sub(f"({L})([hH][tT][tT][pP])", "$1 $2"),
    sub(r"([A-ZŁА-ЯІЇЄҐ]\.?)[ \t]+О[рp]\.[ \t]+[сc][іi]", "$1 Op. ci"),
    put("СOVID", "COVID"),
    sub(f"{_NOT_BEFORE}(?:СO|CО)(2?){_NOT_AFTER}", "CO$1"),
    sub(f"{_NOT_BEFORE}СО2{_NOT_AFTER}", "CO2"),
    sub(rf"(?<=[\p{{L}}\p{{N}}_])[°º][СC]{_NOT_AFTER}", "°C"),
    put("-oї", "-ої"),
    put("-iон", "-іон"),
    put("-pіч", "-річ"),
)
_RUNS = [sub(p, r) for cyr, lat in (("Х", "X"), ("І", "I")) for p, r in ((f"([XVI]){cyr}(?![а-яіїєґa-z])", f"$1{lat}"), (f"{cyr}([XVI])(?![а-яіїєґa-z])", f"{lat}$1"))]
#: Roman numbers written with Cyrillic letters: XVП, XVШ, and Х or І beside X V I; each
#: round puts one more letter of a run right.
roman_numbers = Step(sub(f"{_NOT_BEFORE}[XХ]VП", "XVII"), sub(f"{_NOT_BEFORE}[XХ]VШ", "XVIII"), *_RUNS * 10, when="[XVI][ХІ]|[ХІ][XVI]|V[ПШ]")
#: Latin a, i, o and y as words of their own among Cyrillic words.
lone_latin = Step(sub(rf"([^a-z])[,;–—-] a ({L})", "$1, а $2"), *(sub(rf"([^a-z]) {lat} ({L})", f"$1 {cyr} $2") for lat, cyr in (("i", "і"), ("o", "о"), ("y", "у"))))


def _spaced(phrase: str) -> str:
    """Pattern of a phrase with a blank between the letters; a С at its start in any case and alphabet."""
    spaced = r"[ \t\x{A0}]+".join(" ".join(w) for w in phrase.split())
    return "[СсCc]" + spaced[1:] if spaced.startswith("С") else spaced


#: Known words and phrases written with a blank between the letters.
letter_spacing = Step(
    *(sub(rf"([0-9])[ \t]+{' '.join(word)}{_NOT_AFTER}", f"$1 {word}") for word in ("року", "година")),
    *(put(" ".join(month), month) for month in MONTHS),
    *(sub(_spaced(phrase), phrase) for phrase in PHRASES),
    when=f"(?:{L} ){{3}}",
)
_ENDS = "річчя|ліття|ий|го|ому|им|ої|ій|ою|ї"
#: ``150 - річчя``, ``д - р``, ``будь - що`` without the blanks.
dangling_numbers = Step(
    sub(rf"(?iu)([0-9])\s*([–‑-])\s+({_ENDS}){_NOT_AFTER}", "$1$2$3"),
    sub(rf"(?iu)([0-9])\s+([–‑-])\s*({_ENDS}){_NOT_AFTER}", "$1$2$3"),
    sub(rf"{_NOT_BEFORE}([дД])\s+([–‑-])\s+р{_NOT_AFTER}", "$1$2р"),
    sub(rf"(?iu){_NOT_BEFORE}(будь)\s+([–‑-])[ \t]*(що)[ \t]*([–‑-])[ \t]*(будь){_NOT_AFTER}", "$1$2$3$4$5"),
    sub(rf"(?iu){_NOT_BEFORE}(будь)\s+([–‑-])[ \t]*(як(?:ий|их|ими?|ого|ому|ім|а|ої|ій|у|е|і)?|що|чого|чому|чим|чім){_NOT_AFTER}", "$1$2$3"),
)


def has_dos_newlines(text: Column) -> Column:
    """Whether the first line ends in CR LF."""
    return text.rlike(r"^[^\n]*\r\n")


def to_cyrillic(word: Column) -> Column:
    """Latin letters as the Cyrillic letters of the same shape."""
    t = F.translate(word, LATIN, CYRILLIC)
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ACCENTED.items(), t)


def to_latin(word: Column) -> Column:
    """Cyrillic letters as the Latin letters of the same shape."""
    return F.translate(word, "асеіорхуАВСЕНІКМОРТХУ", "aceiopxyABCEHIKMOPTXY")


def split_long_lines(text: Column, longest: int = 1024, shortest: int = 64) -> Column:
    """A text of one or two lines, one of them too long: the heading becomes a paragraph
    and long sentences get lines of their own; null if the text is not of that kind."""
    parts = F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    heading = r"^([А-ЯІЇЄҐA-Z ,'0-9«»\".:!?()-]+)[ \t]+\n?([А-ЯІЇЄҐ]'?[а-яіїєґ])"
    t = F.when(F.size(parts) < 2, text).when(text.rlike(heading), F.regexp_replace(text, heading, "$1\n\n$2")).when(parts[0].rlike("[а-яіїєґ][ \t]*$"), F.regexp_replace(text, r"^([^\n]*)\n", "$1\n\n")).otherwise(text)
    out = F.regexp_replace(t, rf"(.{{{shortest}}}[{UK}0-9]{{3}}\.) ([А-ЯІЇЄҐ])", "$1\n$2")
    return F.when((F.size(parts) <= 2) & F.exists(parts, lambda x: F.length(x) > longest), out)


#: The steps before the lexicon is asked, in order.
STEPS = [direction_marks, unit_separator_hyphens, control_chars, corpus_fixes, typos, quotes, combining, apostrophes, soft_hyphens, line_separators, digit_three]
