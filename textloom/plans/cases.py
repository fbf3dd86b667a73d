"""Inputs with the results that must come out of them, by operator, for what no SQL over the
tables can say. Each query runs its operator on all of its inputs; its SQL is the list of results.

The inputs need words that the test lexicons lack; ``WORDS`` are added to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import CleanConfig, TagConfig, TokenizeConfig
from textloom.functions import clean as C
from textloom.functions import normalize as N
from textloom.functions import tokenize as T
from textloom.functions.classify import token_class
from textloom.operators import disambig, langmark, ortho, semtags, spacing, stress, tag, ud, unknown
from textloom.operators.cleaning import clean
from textloom.operators.lexicon import inflect, rewrite
from textloom.plans import pipeline
from textloom.sources import files, sinks

# Words that the inputs hold in their right form, by language.
WORDS = {
    "uk": """урахування ліги прем'єр-ліги прем'єр депутат екс-депутат інтерфакс-україна просторово-часового минулого сучасного майбутнього минулого-сучасного-майбутнього благодійної кудись-інде інде
        сукупність сьогодні єдності кількістю макро та мікропор залізнична необов'язковий баренцово-карського карського прогинання азово-чорноморського чорноморського загальновідоме по-турецьки екс-глава глава конкурент
        агов архієпископ дитина сказав подорожчання викликане люба моя заперечив денетор я вже лічу будь-яким будь-що-будь по-християнськи для мене брат труба нашій донор переконали розповів чоловіка жінки полком поміч
        концентрація не всі даі розвиток на лаві органи агітаторів роздїлив сіс нагородження пузатий зв'язаний новоствореної нацполіції північноірландські року травня головний полова погіршення директор бухгалтер
        ми мили раму вугілля не було ще перед боєм мий мені від січня проф державин непоказна літня гм муркнув він самі з своїм кочегарським обов'язком капітуляція
        десь там за горою квітки пахніли хтось прийшов полі зламав сайт під високим пароль сонцем вісь небом інсайдер дівчата євген іт""",
    "ru": "выйдя развозки остановился раздумывая посидеть полчасика удерживала его теперь месте позволяя голове принимать какие либо резкие решения да дали все как положено под розпись ему из дима у кафе а не ли тут с на",
    "en": "baby abby corporation twitter renault kangoo insider city",
}
SOFT, UNIT = "­", "\u001d"
Case = tuple[str, str | None]


def _lexicons(s: SparkSession, d: str) -> dict[str, DataFrame]:
    out = {}
    for lang, words in WORDS.items():
        more = s.createDataFrame([(w,) for w in words.split()], "form string")
        out[lang] = s.read.parquet(f"{d}/lexicon_{lang}.parquet").select("form").unionByName(more)
    return out


def _rows(s: SparkSession, inputs: list[str | None]) -> DataFrame:
    return s.createDataFrame(list(enumerate(inputs)), "no int, input string")


def _cleaned(**options):
    def run(s: SparkSession, d: str, inputs: list[str]) -> DataFrame:
        df = _rows(s, inputs).withColumn("result", F.col("input"))
        return clean(df, _lexicons(s, d), CleanConfig(**options), id_col="no", text_col="result").select("no", "result")

    return run


def _column(f: Callable):
    return lambda s, d, inputs: _rows(s, inputs).select("no", f(F.col("input")).alias("result"))


# Inputs and results of cleaning, by operator.
CLEANED: dict[str, list[Case]] = {
    "control_chars": [("екс\u001fглава", "екс-глава"), ("екс\u001e\nглава", "екс-глава"), ("пуза\u0008\nтий", "пузатий"), ("abc\u0008", "abc")],
    "typos": [("нагородженння", "нагородження"), ("Польттті", "Польттті")],
    "quotes": [("''депутат'' H'''", "\"депутат\" H'''")],
    "line_end_hyphens": [
        ("ураху-\nвання", "урахування\n"), ("Прем’єр-\nліги", "Прем’єр-ліги\n"), ("екс-\n«депутат»", "екс-«депутат»\n"), ("Інтерфакс-\nУкраїна", "Інтерфакс-Україна\n"), ("просто-\nрово-часового", "просторово-часового\n"),
        ("минулого-сучасного-май-\nбутнього", "минулого-сучасного-майбутнього\n"), ("благо-\nдійної", "благодійної\n"), ("кудись- \nінде", "кудись-інде\n"), ("сукуп-\n \n ність", "сукупність\n "), ("сьо-годні", "сьо-годні"),
        ("єднос‑\nті", "єдності\n"), ("кількістю макро-\n та мікропор.\nу таблиці 1.\n---\n  Для", "кількістю макро-\n та мікропор.\nу таблиці 1.\n---\n  Для"),
    ],
    "soft_hyphens": [(f"За{SOFT}лізнична", "Залізнична"), ("А​Б", "АБ"), ("А ​Б", "А  Б"), (f"14{SOFT}го", "14-го"), (f"необов’{SOFT}\nязковий", "необов’язковий\n"), (f"Івано-{SOFT}франківський", "Івано-франківський")],
    "unit_separators": [(f"Баренцово{UNIT}Карського", "Баренцово-Карського"), (f"прогинан{UNIT}\n ня", "прогинання\n "), (f"Азово{UNIT}Чорно{UNIT}\nморського", "Азово-Чорноморського\n")],
    "not_signs": [("загальновідо¬ме", "загальновідоме"), ("по¬турецьки", "по-турецьки"), ("10¬11", "10-11"), ("о¬е", "о¬е"), ("екс¬глава", "екс-глава"), ("конку¬ рент", "конкурент")],
    "leading_hyphens": [
        ("-Агов", "- Агов"), ("-УВАТ(ИЙ)", "-УВАТ(ИЙ)"), ("-архієпископ\n-Дитина", "- архієпископ\n- Дитина"), ("-то ", "-то "), ("сказав він. -Подорожчання викликане", "сказав він. - Подорожчання викликане"), ("люба моя,-Євген.", "люба моя,- Євген."),
        ("заперечив Денетор. -Я вже лічу", "заперечив Денетор. - Я вже лічу"), ("Т. 2. -С. 212", "Т. 2. -С. 212"), ("Слова на -овець", "Слова на -овець"),
    ],
    "dangling_hyphens": [("будь -яким", "будь-яким"), ("будь - що - будь", "будь-що-будь"), ("150- річчя", "150-річчя"), ("150 \n- річчя", "150-річчя"), ("5  -го  листопада", "5-го  листопада"), ("д - р", "д-р"), ("від - роб", "від - роб")],
    "tildes": [("по~християнськи", "по-християнськи"), ("для~мене", "для мене")],
    "roman_numbers": [("XХІ", "XXI"), ("XVП", "XVII"), ("XVШ", "XVIII")],
    "mixed_letters": [
        ("бpат", "брат"), ("трyба", "труба"), ("bаbу", "baby"), ("Аbbу", "Abby"), ("сіс", "сіс"), ("Сorporation", "Corporation"), ("нашійTwitter", "нашій Twitter"), ("ДонорUA", "ДонорUA"), ("Renault Kangoo", "Renault Kangoo"), ("FREЕДОМ", "FREЕДОМ"),
        ("Moстиск", "Moстиск"), ("пеpeсвідчив", "пеpeсвідчив"), ("цїcapска", "цїcapска"), ("Pianoбой", "Pianoбой"), (" IІвана", " IІвана"), ("квадрокоптери Aquila16-fpv-kit.", "квадрокоптери Aquila16-fpv-kit."), ("Insiderрозповів", "Insider розповів"),
        ("не всi в", "не всі в"), ("ДАI", "ДАІ"), ("розвиток IТ", "розвиток ІТ"), ("Hа лаві", "На лаві"), ("óргани", "о́ргани"), ("ariтаторів", "агітаторів"), ("pоздїлив", "роздїлив"), ("margin'ом", "margin'ом"), ("Kurjeр-ї", "Kurjeр-ї"),
        ("ГогольFest", "ГогольFest"), ("Narodow-ої", "Narodow-ої"), ("скорhйше", "скорhйше"), ("senior'и", "senior'и"),
    ],
    "mix_shortcuts": [("концентрація \u0421O та C\u041e2", "концентрація CO та CO2"), ("Ł. Оp. cit.", "Ł. Op. cit."), ("фото зhttp://www.rvps.kiev.ua/", "фото з http://www.rvps.kiev.ua/")],
    "lone_latin": [("чоловіка i жінки", "чоловіка і жінки"), ("з полком y поміч", "з полком у поміч")],
    "digit_three": [("3а віщо йому таке. Вул. 3алізнична 3а.", "За віщо йому таке. Вул. Залізнична 3а."), ("Як в графах 3а та 3 додатка", "Як в графах 3а та 3 додатка")],
    "spaced_apostrophes": [("зв 'язаний", "зв'язаний")],
    "two_columns": [("десь там                квітки пахніли\nхтось прийшов           на полі\nзламав сайт             під високим\nзламав пароль           сонцем\nзламав вісь             і небом", None), ("десь там квітки", "десь там квітки")],
    "feminine_endings": [("новоствореноі", "новоствореної"), ("МОІ", "МОІ"), ("Північноірландські", "Північноірландські"), ("Нацполіціі", "Нацполіції")],
    "dos_newlines": [("бpат\r\n", "брат\r\n")],
    "letter_spacing": [("2008 р о к у", "2008 року"), ("14 т р а в н я", "14 травня"), ("С е с і й н и й  з а л  В е р х о в н о ї  Р а д и", "Сесійний зал Верховної Ради")],
    "lone_g": [("Г оловний", "Головний"), ("Г полова", "Г полова")],
}
DESPACED: list[Case] = [
    ("м и м и л и р а м у", "ми мили раму"),
    ("В у г і л л я н е б у л о", "Вугілля не було"),
    ("Капітуляція ще п е р е д  б о є м .", "Капітуляція ще перед боєм."),
    ("м и й м е н і в і д с і ч н я п р о ф . В . Д е р ж а в и н : н е п о к а з н а і в ж е л і т н я", "мий мені від січня проф. В. Державин: непоказна і вже літня"),
    ("— Г м . . . — м у р к н у в в і н .", "— Гм... — муркнув він."),
    ("с а м і з с в о ї м к о ч е г а р с ь к и м о б о в ’я з к о м", "самі з своїм кочегарським обов’язком"),
    ("senior'и", "senior'и"),
]
# Inputs and results of the tokenizer and of normal forms.
SENTENCES: list[Case] = [(',десь "такі" підходи', ',десь "такі" підходи'), ("Слово. Діло.", "Слово.¦Діло."), ("", ""), ("  \n", ""), ("На вул. Київській тихо. Так!", "На вул. Київській тихо.¦Так!")]
TOKENS: list[Case] = [
    ("Автомагістраль-Південь, наш 'видатний' автобан. Став схожий на диряве корито", "Автомагістраль-Південь|,|наш|'|видатний|'|автобан|.|Став|схожий|на|диряве|корито"),
    ("Сідай-но", "Сідай|-но"), ("десь–таки", "десь|-таки"), ("себ-то", "себ-то"), ("як-от", "як-от"), ("він-таки прийшов", "він|-таки|прийшов"),
]
ONLY_WORDS: list[Case] = [(',десь "такі" підхо́ди[9]', "десь такі підходи"), ("Сідай-но", "Сідай -но"), ("десь–таки", "десь -таки")]
SEPARATED: list[Case] = [("десь такі||підходи", "десь такі¦підходи")]
DOTTED: list[Case] = [("англ.", "англ|."), ("слово", "слово"), ("ст.", "ст|."), ("а.", "а.")]
NUMBERS: list[Case] = [("89", "0"), ("4", "2"), ("15", "0"), ("13", "0"), ("23", "2"), ("21", "1"), ("0,2-0,3", "0,0"), ("1999", "YY99"), ("1999-2020", "YY20"), ("2999", "0")]
MARKS: list[Case] = [("—", "-"), ("–", "-"), ("?..", "?"), ("...", "…"), ("„", "«"), ("слово", "слово")]
HYPHENED: list[Case] = [("2000-го", "0-го"), ("1945-го", "5-го"), ("Азово–Чорноморський", "Азово-Чорноморський"), ("слово", "слово")]
CORE_TAGS: list[Case] = [("noun:inanim:p:v_zna:ns", "noun:inanim:p:v_zna"), ("adj:m:v_naz:bad", "adj:m:v_naz"), ("noun:anim:m:v_naz:up92", "noun:anim:m:v_naz")]
CLASSES: list[Case] = [("Crow", "unclass"), ("-сніг", "unclass"), ("десяти-", "unknown"), (",", "punct"), ("€", "symb"), ("а", "noninfl"), ("<b>", "xmltag"), ("кікука", "unknown"), ("слово2", "unclass")]
LONG_LINES: list[Case] = [
    ("ЛЮБИЙ ДРУЖЕ! Героїв цієї книжки ти часто бачив у мультиках. Так-так. Усі вони постійно потрапляють у скрутне становище\nі от", "ЛЮБИЙ ДРУЖЕ!\n\nГероїв цієї книжки ти часто бачив у мультиках.\nТак-так. Усі вони постійно потрапляють у скрутне становище\nі от"),
    ("ГЕНЕЗИС ШПИГУНСЬКОГО РОМАНУ: ВІД Р. КІПЛІНГА ДО Я. ФЛЕМІНГА \nПостановка проблеми. У цей час спостерігається стійкий інтерес до вивчення проблеми. Ідеологічного впливу на взаємні", "ГЕНЕЗИС ШПИГУНСЬКОГО РОМАНУ: ВІД Р. КІПЛІНГА ДО Я. ФЛЕМІНГА\n\nПостановка проблеми. У цей час спостерігається стійкий інтерес до вивчення проблеми.\nІдеологічного впливу на взаємні"),
    ("ЛЮБИЙ ДРУЖЕ!\nГероїв цієї книжки ти часто бачив у мультиках.\nУсі вони постійно потрапляють у скрутне становище", None),
]
CONTEXT_RIGHT: list[Case] = [("за", "true"), ("Більше", "true"), ("слово", "false"), ("українською", "true")]
COLUMNS: list[Case] = [("роз-   колір", "true"), ("роз- колір", "false"), ("слово", "false"), ("сло‑    во", "true")]
BROKEN_ENCODING: list[Case] = [("Ñëîâî íà éîãî ïîëå\nслово", "Слово на його поле\nслово"), ("слово", "слово")]
CYRILLIC_OF: list[Case] = [("cop", "сор"), ("óргани", "о́ргани"), ("BAT", "ВАТ"), ("Iван", "Іван")]
# Semantic lexicon, readings, and the semantic tags that these get.
SEMTAGS = [
    ("слово", "noun", "1:conc:speech:2:abst:speech:3:conc:text", ""), ("усе", "adv", "1:dur:max", ""), ("усе", "noun", "1:quantif", ""), ("увесь", "adj", "1:quantif", ""), ("голова", "noun", "1:conc:hum&hierar", ""),
    ("голова", "noun", "1:conc:body:part:2:abst:ment:3:abst:unit", ""), ("аахенський", "adj", "1:abst", ""), ("Вашингтон", "noun", "1:conc:hum", ""), ("Вашингтон", "noun", "1:conc:loc", ""), ("акт", "noun", "1:conc:text", ":xp1"),
    ("акт", "noun", "1:abst:part:2:abst:quantum", ":xp2"), ("один-другий", "adj", "1:abst:quantity", ""), ("хімвиробник", "noun", "1:conc:org", ""), ("півча", "noun", "1:conc:hum:group", ""), ("колега", "noun", "1:conc:hum", ""),
    ("по-турецьки", "adv", "1:manner", ""), ("лежати", "verb", "1:state", ""),
]
SEMANTIC: list[Case] = [
    ("слово noun:inanim:n:v_naz", "1:conc:speech:2:abst:speech:3:conc:text"), ("усе adv", "1:dur:max"), ("усе noun:inanim:n:v_naz:pron:gen", "1:quantif"), ("увесь adj:n:v_naz:pron:gen", "1:quantif"), ("голова noun:anim:f:v_naz", "1:conc:hum&hierar"),
    ("голова noun:anim:m:v_naz", "1:conc:hum&hierar"), ("голова noun:inanim:f:v_naz", "1:conc:body:part:2:abst:ment:3:abst:unit"), ("аахенський adj:f:v_naz", "1:abst"), ("Вашингтон noun:anim:m:v_naz:prop:lname", "1:conc:hum"),
    ("Вашингтон noun:inanim:m:v_naz:prop:geo:xp1", "1:conc:loc"), ("акт noun:inanim:m:v_dav:xp1", "1:conc:text"), ("акт noun:inanim:m:v_rod:xp2", "1:abst:part:2:abst:quantum"), ("один-другий adj:m:v_naz:numr", "1:abst:quantity"),
    ("хімвиробник noun:anim:m:v_naz", "1:conc:org"), ("півча noun:inanim:f:v_naz", "1:conc:hum:group"), ("півчий adj:f:v_naz:bad", None), ("колеґа noun:anim:f:v_naz:alt", "1:conc:hum"), ("по-турецьки adv", "1:manner"), ("лежачи advp:imperf", "1:state"),
]
# Dictionary entries, and the readings of words in older spellings.
OLDER_FORMS = [
    ("звичаї", "звичай", "noun:inanim:m:v_mis"), ("звичаї", "звичай", "noun:inanim:p:v_kly"), ("звичаї", "звичай", "noun:inanim:p:v_naz"), ("звичаї", "звичай", "noun:inanim:p:v_zna"), ("нашої", "наш", "adj:f:v_rod:pron:pos"),
    ("завжди", "завжди", "adv:pron:gen"), ("ідолянин", "ідолянин", "noun:anim:m:v_naz"), ("історичний", "історичний", "adj:m:v_kly"), ("історичний", "історичний", "adj:m:v_naz"), ("історичний", "історичний", "adj:m:v_zna:rinanim"),
    ("миготінь", "миготіння", "noun:inanim:p:v_rod:alt"), ("купається", "купатися", "verb:rev:imperf:pres:s:3"), ("називатися", "називатися", "verb:rev:imperf:inf"),
    ("полювання", "полювання", "noun:inanim:n:v_kly"), ("полювання", "полювання", "noun:inanim:n:v_naz"), ("називати", "називати", "verb:imperf:inf"),
]
LESYA: list[Case] = [
    ("звичайі", "звичай/noun:inanim:m:v_mis:alt,звичай/noun:inanim:p:v_kly:alt,звичай/noun:inanim:p:v_naz:alt,звичай/noun:inanim:p:v_zna:alt"), ("нашоі", "наш/adj:f:v_rod:pron:pos:alt"), ("завжді", "завжди/adv:pron:gen:alt"),
    ("идолянин", "ідолянин/noun:anim:m:v_naz:alt"), ("історічний", "історичний/adj:m:v_kly:alt,історичний/adj:m:v_naz:alt,історичний/adj:m:v_zna:rinanim:alt"), ("кікука", None),
]
ZHELEH: list[Case] = [
    ("миготїнь", "миготіння/noun:inanim:p:v_rod:alt"), ("купаєть ся", "купатися/verb:rev:imperf:pres:s:3"), ("називати ся", "називатися/verb:rev:imperf:inf"), ("називати", "називати/verb:imperf:inf"), ("мїжь", "мїжь/prep"),
    ("польованє", "полювання/noun:inanim:n:v_kly,полювання/noun:inanim:n:v_naz"),
]
# What endings tell (ending, put on / taken off, tag, how often), words after the
# word before, and the guesses.
ENDINGS = [
    ("уляв", "ти/1", "verb:imperf:past:m", 9), ("трів", "/2", "noun:inanim:p:v_rod", 7), ("трів", "о/2", "noun:inanim:p:v_rod", 2), ("енко", "/0", "noun:anim:m:v_naz:prop:lname", 5), ("енко", "/0", "noun:anim:f:v_naz:prop:lname", 9),
    ("ається", "атися/6", "verb:rev:imperf:pres:s:3", 4),
]
GUESSES: list[Case] = [
    ("популяв", "популяти/verb:imperf:past:m -0.6"), ("НС-фільтрів", "НС-фільтр/noun:inanim:p:v_rod -0.5"), ("пан|Кікученко", "Кікученко/noun:anim:m:v_naz:prop:lname -0.5"), ("пані|Кікученко", "Кікученко/noun:anim:f:v_naz:prop:lname -0.5"),
    ("слово|Кікученко", "Кікученко/noun:anim:f:v_naz:prop:lname -0.5"), ("слово|кікученко", None), ("ДСНБ", "ДСНБ/noninfl:abbr -0.7"), ("БМ-21К", "БМ-21К/noninfl -0.7"), ("кікулається", "кікулатися/verb:rev:imperf:pres:s:3 -0.6"),
]
# Stressed entries (lemma, part of the tag, form, base, offset), tokens, their stress.
STRESSED = [("слово", "noun:n", "сло́во", 0, 0), ("просте", "adj", "просте́", 0, 0), ("просте", "adj", "про́сте", 0, 0), ("Київ", "noun:m", "Ки́їв", 1, 0), ("мене", "noun:p", "мене́", 0, 0)]
STRESS: list[Case] = [("Слово слово noun:inanim:n:v_naz", "Сло́во"), ("Києва Київ noun:inanim:m:v_rod:prop:geo", "Ки́єва"), ("те те part", "те"), ("мабобом мабоб unknown", "мабобом"), ("сло́во слово noun:inanim:n:v_naz", "сло́во")]
# Entries and pattern of an inflection.
TOWN = [("місто", "місто", "noun:inanim:n:v_naz"), ("міста", "місто", "noun:inanim:n:v_rod"), ("міста", "місто", "noun:inanim:p:v_naz"), ("місту", "місто", "noun:inanim:n:v_dav")]
RATES: list[Case] = [
    ("дерзаючий озером, а голова просто", "0.5 0.1"), ("– Прим. ред.", None), ("енергозбереженню прийшов повний розгром але зелений друг виручив його в складний момент", "0.8 0.2"),
]
RATE_WORDS = {"uk": "енергозбереженню прийшов повний розгром але зелений друг виручив його в складний момент дерзаючий озером голова просто а у не", "ru": "розгром друг момент в а у не"}
_RU1 = "Выйдя из развозки, Дима остановился у кафе, раздумывая, а не посидеть ли ему тут с полчасика?."
CUT: list[Case] = [(f"Десь там за горою.\n\n{_RU1}\n\nВін прийшов.\n", 'Десь там за горою.\n\n<span lang="ru">---</span>\n\nВін прийшов.\n'), ("Депутате Хмаро, я закликаю вас до порядку.", "Депутате Хмаро, я закликаю вас до порядку."), ("Classmark Р 382.c.367.2.", "Classmark Р 382.c.367.2.")]
MARKED: list[Case] = [(f"{_RU1}\n\nДесь там.", f'<span lang="ru" rate="1.0">{_RU1}</span>\n\nДесь там.'), ("Лариса ГУТОРОВА", "Лариса ГУТОРОВА"), ("- Хай буде щедро!", "- Хай буде щедро!")]
# A sentence of readings (value, lemma, tags; no blank before if it begins with a +).
SPOKEN = "Слово слово noun:inanim:n:v_naz¦+. . punct¦і і conj:coord;і part¦<b> <b> xmltag"
OUTPUTS: list[Case] = [
    ("txt", "Слово[слово/noun:inanim:n:v_naz].[/punct] і[і/conj:coord,і/part] <b>[<b>/xmltag]"),
    ("vertical", "<s>\nСлово\tnoun:inanim:n:v_naz\tслово\n<g/>\n.\tpunct\t.\nі\tconj:coord\tі || part і\n<b>\txmltag\t<b>\n</s>\n"),
    ("xml", '<sentence>\n  <tokenReading>\n    <token value="Слово" lemma="слово" tags="noun:inanim:n:v_naz" />\n  </tokenReading>\n  <tokenReading>\n    <token value="." lemma="." tags="punct" whitespaceBefore="false" />\n  </tokenReading>\n  <tokenReading>\n    <token value="і" lemma="і" tags="conj:coord" />\n    <token value="і" lemma="і" tags="part" />\n  </tokenReading>\n  <tokenReading>\n    <token value="&lt;b&gt;" lemma="&lt;b&gt;" tags="xmltag" />\n  </tokenReading>\n</sentence>\n'),
    ("xml tokens", '<sentence>\n  <token value="Слово" lemma="слово" tags="noun:inanim:n:v_naz" />\n  <token value="." lemma="." tags="punct" whitespaceBefore="false" />\n  <token value="і" lemma="і" tags="conj:coord">\n    <alts>\n      <token value="і" lemma="і" tags="part" />\n    </alts>\n  </token>\n  <token value="&lt;b&gt;" lemma="&lt;b&gt;" tags="xmltag" />\n</sentence>\n'),
    ("json tokens", '[{"value":"Слово","lemma":"слово","tags":"noun:inanim:n:v_naz"},{"value":".","lemma":".","tags":"punct","whitespaceBefore":false},{"value":"і","lemma":"і","tags":"conj:coord","alts":[{"value":"і","lemma":"і","tags":"part"}]},{"value":"<b>","lemma":"<b>","tags":"xmltag"}]'),
    ("lemmas", "слово. і <b>"),
]
UD_ENTRIES = [("adv", "Upos=ADV"), ("noun", "Upos=NOUN"), ("adj", "Upos=ADJ"), ("verb", "Upos=VERB"), ("conj:coord", "Upos=CCONJ"), ("punct", "Upos=PUNCT"), ("noninfl:predic", "Upos=ADV; Uninflect=Yes"), ("compc", "Degree=Cmp"), ("compb", "Degree=Pos"), ("unanim", "Animacy=Anim,Inan"), ("inanim", "Animacy=Inan"), ("anim", "Animacy=Anim"), ("n", "Gender=Neut"), ("m", "Gender=Masc"), ("f", "Gender=Fem"), ("p", "Number=Plur"), ("s", "Number=Sing"), ("v_naz", "Case=Nom"), ("v_kly", "Case=Voc"), ("v_rod", "Case=Gen"), ("pers", "PronType=Prs"), ("1", "Person=1"), ("3", "Person=3"), ("prop", "Upos=PROPN"), ("geo", "NameType=Geo"), ("int", "PronType=Int"), ("rel", "PronType=Rel"), ("rev", "Reflex=Yes"), ("perf", "Aspect=Perf"), ("past", "Tense=Past; Mood=Ind"), ("numr", "NumType=Card")]
UD: list[Case] = [
    ("а conj:coord", "CCONJ _"), ("треба noninfl:predic", "ADV _ Uninflect=Yes"), ("далі adv:compc:predic", "ADV Degree=Cmp"), ("воно noun:unanim:n:v_naz:pron:pers:3", "PRON Animacy=Anim,Inan|Case=Nom|Gender=Neut|Number=Sing|Person=3|PronType=Prs"), ("- punct", "PUNCT _"),
    ("озеро noun:inanim:n:v_naz", "NOUN Animacy=Inan|Case=Nom|Gender=Neut|Number=Sing"), ("Світязь noun:inanim:m:v_naz:prop:geo:xp1", "PROPN Animacy=Inan|Case=Nom|Gender=Masc|NameType=Geo|Number=Sing"), ("де adv:pron:int:rel", "ADV PronType=Int|PronType=Rel"),
    ("я noun:anim:s:v_naz:pron:pers:1", "PRON Animacy=Anim|Case=Nom|Number=Sing|Person=1|PronType=Prs"), ("затриматися verb:rev:perf:past:m", "VERB Aspect=Perf|Gender=Masc|Mood=Ind|Number=Sing|Reflex=Yes|Tense=Past|VerbForm=Fin"), ("шановний adj:p:v_kly:compb", "ADJ Case=Voc|Degree=Pos|Number=Plur"),
]


def _arrays(f: Callable, by: str):
    return _column(lambda c: F.array_join(f(c), by))


def _despaced(s, d, inputs):
    return rewrite(_rows(s, inputs).withColumnRenamed("input", "result"), [spacing.despace], _lexicons(s, d), "result")


def _semantic(s, d, inputs):
    r = _rows(s, inputs).select("no", F.split("input", " ")[0].alias("lemma"), F.split("input", " ")[1].alias("tags"))
    table = s.createDataFrame(SEMTAGS, "lemma string, pos string, semtag string, cond string").coalesce(1)
    verbs = s.createDataFrame([("лежачи", "лежати")], "advp_lemma string, verb_lemma string")
    return r.join(semtags.semantic_tags(r, table, verbs), ["lemma", "tags"], "left").select("no", F.col("semtags").alias("result"))


def _older(module: str):
    def run(s, d, inputs):
        w = _rows(s, inputs).select("no", F.split("input", " ")[0].alias("value"), F.try_element_at(F.split("input", " "), F.lit(2)).alias("next"))
        x = s.createDataFrame(OLDER_FORMS, "form string, lemma string, tags string")
        extra = s.createDataFrame([("мїжь", "prep")], "word string, tags string") if module == "zheleh" else None
        got = ortho.retag(w, x, module, extra)
        text = F.array_join(F.transform("readings", lambda r: F.concat(r["lemma"], F.lit("/"), r["tags"])), ",")
        hit = w.alias("w").join(got.alias("g"), (F.col("w.value") == F.col("g.value")) & F.col("w.next").eqNullSafe(F.col("g.next")), "left")
        return hit.select("no", text.alias("result"))

    return run


def _guessed(s, d, inputs):
    parts = F.split("input", r"\|")
    t = _rows(s, inputs).select("no", F.element_at(parts, -1).alias("value"), (F.size(parts) < 2).alias("first"), F.when(F.size(parts) > 1, parts[0]).alias("left_lemma"), F.lit(None).cast("string").alias("left_tags"))
    table = s.createDataFrame(ENDINGS, "suffix string, add_del string, postag string, cnt int")
    g = unknown.guess(t, table, ["no"]).filter("rank = 1").select("no", F.concat("lemma", F.lit("/"), "tags", F.lit(" "), F.col("confidence").cast("decimal(3,1)").cast("string")).alias("result"))
    return t.select("no").join(g, "no", "left")


def _stressed(s, d, inputs):
    p = F.split("input", " ")
    t = _rows(s, inputs).select("no", p[0].alias("value"), F.array(F.struct(p[1].alias("lemma"), p[2].alias("tags"))).alias("readings"))
    table = s.createDataFrame(STRESSED, "lemma string, tag_key string, form string, base int, offset int")
    return stress.stress(t, table, ["no"]).select("no", F.col("stressed").alias("result"))


def _inflected(s, d, inputs):
    x = s.createDataFrame(TOWN, "form string, lemma string, tags string")
    out = None
    for no, i in enumerate(inputs):
        lemma, pattern = i.split(" ")
        one = inflect(x, lemma, pattern).agg(F.array_join(F.array_sort(F.collect_list("form")), ",").alias("result")).select(F.lit(no).alias("no"), "result")
        out = one if out is None else out.unionByName(one)
    return out


def _rated(s, d, inputs):
    df = _rows(s, inputs).withColumnRenamed("no", "doc_id").withColumnRenamed("input", "text")
    words = {lang: s.createDataFrame([(w,) for w in RATE_WORDS[lang].split()], "form string") for lang in ("uk", "ru")}
    r = langmark.rates(langmark.chunks(df), words["uk"], words["ru"]).select(F.col("doc_id").alias("no"), F.concat(F.round("uk_rate", 1).cast("string"), F.lit(" "), F.round("ru_rate", 1).cast("string")).alias("result"))
    return df.select(F.col("doc_id").alias("no")).join(r.filter("no <> 1"), "no", "left")


def _outputs(s, d, inputs):
    def one(p: str) -> tuple:
        value = p.split(" ")[0].lstrip("+")
        readings = [tuple(x.split(" ")) for x in p.split(" ", 1)[1].split(";")]
        return (value, value, not p.startswith("+"), readings)

    tokens = s.createDataFrame([([one(p) for p in SPOKEN.split("¦")],)], "tokens array<struct<value:string,clean:string,whitespace_before:boolean,readings:array<struct<lemma:string,tags:string>>>>")
    made = {"txt": sinks.txt, "vertical": sinks.vertical, "xml": sinks.xml, "xml tokens": lambda c: sinks.xml(c, True), "json tokens": lambda c: sinks.json(c, True), "lemmas": lambda c: sinks.txt(c, True)}
    each = F.array(*(F.struct(F.lit(no).alias("no"), made[i](F.col("tokens")).alias("result")) for no, i in enumerate(inputs)))
    return tokens.select(F.explode(each).alias("x")).select("x.*")


def _dependencies(s, d, inputs):
    p = F.split("input", " ")
    t = _rows(s, inputs).select("no", F.array(F.struct(p[0].alias("lemma"), p[1].alias("tags"))).alias("readings"))
    c = ud.convert(t, s.createDataFrame(UD_ENTRIES, "part string, ud string"), [])
    return c.select("no", F.concat_ws(" ", "upos", "feats", F.nullif("misc", F.lit("_"))).alias("result"))


# Rates of words and of their contexts, sentences of readings, and the tags chosen.
WORD_RATES = [
    ("а", "а", "conj:coord", 0.6), ("а", "а", "part", 0.2), ("а", "а", "intj", 0.1), ("коса", "коса", "noun:inanim:f:v_naz", 0.1), ("коса", "косий", "adj:f:v_naz", 0.5), ("за", "за", "prep", 0.2), ("за", "за", "adv", 0.3),
    ("рік", "рік", "noun:inanim:m:v_rod", 0.2), ("рік", "рік", "noun:inanim:m:v_dav", 0.2), ("новий", "новий", "adj:f:v_rod", 0.2), ("новий", "новий", "adj:f:v_dav", 0.2),
    ("стало", "стало", "adv", 0.3), ("стало", "стати", "verb:perf:past:n", 0.1),
]
WORD_CONTEXTS = [("коса", "коса", "noun:inanim:f:v_naz", -1, "гостра", "гострий", "adj:f:v_naz", 2.0), ("за", "за", "prep", 1, "рік", "рік", "noun:inanim:m:v_zna", 3.0), ("стало", "стати", "verb:perf:past:n", -1, "YY99", "1999", "number", 1.0)]
RANKED: list[Case] = [
    ("А=а/intj;а/part;а/conj:coord .=./punct", "conj:coord|punct"),
    ("там=там/adv коса=косий/adj:f:v_naz;коса/noun:inanim:f:v_naz .=./punct", "adv|adj:f:v_naz|punct"),
    ("проста=простий/adj:f:v_naz коса=косий/adj:f:v_naz;коса/noun:inanim:f:v_naz .=./punct", "adj:f:v_naz|noun:inanim:f:v_naz|punct"),
    ("гостра=гострий/adj:f:v_naz коса=косий/adj:f:v_naz;коса/noun:inanim:f:v_naz .=./punct", "adj:f:v_naz|noun:inanim:f:v_naz|punct"),
    ("за=за/adv;за/prep рік=рік/noun:inanim:m:v_zna .=./punct", "prep|noun:inanim:m:v_zna|punct"), ("за=за/adv;за/prep день=день/noun:inanim:m:v_naz .=./punct", "adv|noun:inanim:m:v_naz|punct"),
    ("ясної=ясний/adj:f:v_dav;ясний/adj:f:v_rod книги=книга/noun:inanim:f:v_rod .=./punct", "adj:f:v_rod|noun:inanim:f:v_rod|punct"),
    ("ясного=ясний/adj:m:v_rod дня=день/noun:inanim:m:v_dav;день/noun:inanim:m:v_rod .=./punct", "adj:m:v_rod|noun:inanim:m:v_rod|punct"),
    ("1999=1999/number стало=стало/adv;стати/verb:perf:past:n .=./punct", "number|verb:perf:past:n|punct"),
]


def _ranked(s, d, inputs):
    def token(x: str) -> tuple:
        value, readings = x.split("=", 1)
        return value, value, True, [tuple(r.split("/", 1)) for r in readings.split(";")]

    kind = "no int, tokens array<struct<value:string,clean:string,whitespace_before:boolean,readings:array<struct<lemma:string,tags:string>>>>"
    sents = s.createDataFrame([(n, [token(x) for x in i.split(" ")]) for n, i in enumerate(inputs)], kind)
    rates = s.createDataFrame(WORD_RATES, "word string, lemma string, postag string, rate double")
    near = s.createDataFrame(WORD_CONTEXTS, "word string, lemma string, postag string, offset int, ctx_word string, ctx_lemma string, ctx_postag string, cnt double")
    return disambig.rank_sentences(sents, rates, near).select("no", F.array_join(F.transform("tokens", lambda t: t["readings"][0]["tags"]), "|").alias("result"))


# Journal pages, and what is left of them; a text of one long line.
JOURNAL: list[Case] = [
    ("Перша сторінка.\nВісник науки        12\nДруга сторінка.\nВісник науки        13\nТретя сторінка.\nВісник науки        14\n© Видавець", "Перша сторінка.\nДруга сторінка.\nТретя сторінка."),
    ("Один раз        12\nслово", "Один раз        12\nслово"), ("Текст статті.\n\nAbstract\nShort text.\n\nДалі текст.", "Текст статті.\n\nДалі текст."), ("Таблиця 1        5\nТаблиця 1        6\nТаблиця 1        7", "Таблиця 1        5\nТаблиця 1        6\nТаблиця 1        7"),
]
_LONG = "Слово за словом іде довга розповідь про все на світі без кінця і краю аж до вечора. "
ONE_LINE: list[Case] = [(_LONG * 15, (_LONG[:-1] + "\n") * 14 + _LONG), ("Коротко. Так.", "Коротко. Так.")]
# Words as contexts (word, lemma, tags).
CONTEXT_WORDS: list[Case] = [("Слово слово noun:inanim:n:v_naz", "слово"), ("Київ Київ noun:inanim:m:v_naz:prop:geo", "Київ"), ("2000-го 2000-й adj:m:v_rod:numr", "0-го"), ("1999 1999 number", "YY99"), ("— — punct", "-"), ("Азово–Чорноморський азово-чорноморський adj:m:v_naz", "Азово-Чорноморський")]
# What a token has besides its tags, and the last column of its line.
MISC: list[Case] = [("noun:inanim:n:v_naz||true||", "_"), ("noun:inanim:n:v_naz|1:conc|false||", "SemTags=1:conc|SpaceAfter=No"), ("noninfl:predic||true|stats|-0.600", "Uninflect=Yes|TagLevel=stats|TagConfidence=-0.600"), ("strange:tag||true||", "_")]


def _misc(s, d, inputs):
    p = F.split("input", r"\|", -1)
    empty = lambda c: F.nullif(c, F.lit(""))
    t = _rows(s, inputs).select("no", F.array(F.struct(F.lit("x").alias("lemma"), p[0].alias("tags"))).alias("readings"), empty(p[1]).alias("semtags"), (p[2] == "true").alias("space_after"), empty(p[3]).alias("level"), empty(p[4]).alias("confidence"))
    return ud.convert(t, s.createDataFrame(UD_ENTRIES, "part string, ud string"), []).select("no", F.col("misc").alias("result"))


# Texts, and their tokens under the options that show guesses.
LEVELS: list[Case] = [("Він популяв.", "Він unknown||;популяв verb:imperf:past:m|stats|-0.600;. punct||"), ("Слово.", "Слово noun:inanim:n:v_naz||;. punct||¶")]


def _levels(s, d, inputs):
    lex = s.createDataFrame([("слово", "слово", "noun:inanim:n:v_naz")], "form string, lemma string, tags string")
    ends = s.createDataFrame(ENDINGS[:1], "suffix string, add_del string, postag string, cnt int")
    docs = _rows(s, inputs).withColumnsRenamed({"no": "doc_id", "input": "text"})
    t = pipeline.tag_tokens(docs, pipeline.Tables(lex, suffix_stats=ends), TagConfig(tag_unknown=True, unknown_rate=True, show_level=True))
    each = F.concat("value", F.lit(" "), F.col("readings")[0]["tags"], F.lit("|"), F.coalesce("level", F.lit("")), F.lit("|"), F.coalesce(F.col("confidence").cast("string"), F.lit("")))
    marked = tag.sentences(t, paragraph_marks=True).filter("tokens is null and doc_id = 1").select(F.col("doc_id").alias("no"), F.lit("¶").alias("mark"))
    out = t.groupBy(F.col("doc_id").alias("no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", "part_no", each.alias("x")))), lambda x: x["x"]), ";").alias("x"))
    return out.join(marked, "no", "left").select("no", F.concat("x", F.coalesce("mark", F.lit(""))).alias("result"))


# Texts, and the outputs of the tokenizer with white space kept.
SPACED: list[Case] = [("Слово\nі\tділо.", "Слово|\\n|і| |діло|."), ("а  б", "а|  |б")]


def _spaced(s, d, inputs):
    docs = _rows(s, inputs).withColumnsRenamed({"no": "doc_id", "input": "text"})
    out = pipeline.tokenize_documents(docs, TokenizeConfig(words=True, preserve_whitespace=True, newline="\\n"))
    return out.select(F.col("doc_id").alias("no"), F.col("body").alias("result"))


def _decoded(s, d, inputs):
    """Texts given as ``encoding:text``, written in that encoding and read back."""
    rows = [(str(no), bytearray(i.split(":", 1)[1].encode(i.split(":", 1)[0]))) for no, i in enumerate(inputs)]
    df = files.decoded(s.createDataFrame(rows, "path string, content binary"))
    return df.select(F.col("path").cast("int").alias("no"), F.concat_ws(" ", "encoding", "text").alias("result"))


# Texts by the encoding they are written in, and how they are read.
DECODED: list[Case] = [
    ("utf-8:десь там волоська голова\n", "utf-8 десь там волоська голова\n"), ("cp1251:десь там волоська голова\n", "cp1251 десь там волоська голова\n"),
    ("utf-16:Чистота й правильність української мови.\r\n", "utf-16 Чистота й правильність української мови.\r\n"), ("ascii:{\\rtf1" + "x" * 120, "rtf"), ("latin-1:PK\x03\x04" + "\x00" * 120, "zip"), ("utf-8:", "utf-8 "),
]

Runner = Callable[[SparkSession, str, list], DataFrame]
#: Name, operator, and cases of every query of this module.
CASES: dict[str, tuple[Runner, list[Case]]] = {f"case_{k}": (_cleaned(), v) for k, v in CLEANED.items()} | {
    "case_despacing": (_despaced, DESPACED),
    "case_sentences": (_arrays(lambda c: F.flatten(F.transform(T.paragraphs(c), lambda p: T.sentences(p))), "¦"), SENTENCES),
    "case_words": (_arrays(lambda c: T.particles(T.tokens(c)), "|"), TOKENS),
    "case_only_words": (_arrays(T.only_words, " "), ONLY_WORDS),
    "case_separator": (_arrays(lambda c: T.sentences(c, r"\|+"), "¦"), SEPARATED),
    "case_abbreviation_dot": (_arrays(lambda c: T.split_abbreviation_dot(F.array(c)), "|"), DOTTED),
    "case_numbers": (_column(N.number), NUMBERS),
    "case_marks": (_column(N.mark), MARKS),
    "case_hyphened": (_column(lambda c: N.hyphened(c, F.lit("adj:m:v_naz"))), HYPHENED),
    "case_core_tags": (_column(N.tag_core), CORE_TAGS),
    "case_classes": (_column(token_class), CLASSES),
    "case_right_context": (_column(lambda c: N.uses_right_context(c).cast("string")), CONTEXT_RIGHT),
    "case_long_lines": (_column(lambda c: C.split_long_lines(c, 30, 20)), LONG_LINES),
    "case_multi_column": (_column(lambda c: files.multi_column(c).cast("string")), COLUMNS),
    "case_repaired_lines": (_column(files.repair_lines), BROKEN_ENCODING),
    "case_cyrillic_letters": (_column(C.to_cyrillic), CYRILLIC_OF),
    "case_semantic_tags": (_semantic, SEMANTIC),
    "case_lesya": (_older("lesya"), LESYA),
    "case_zheleh": (_older("zheleh"), ZHELEH),
    "case_guesses": (_guessed, GUESSES),
    "case_stress": (_stressed, STRESS),
    "case_inflect": (_inflected, [("місто noun:inanim:n:v_rod.*", "міста"), ("місто noun.*", "міста,місто,місту"), ("місто verb.*", "")]),
    "case_language_rates": (_rated, RATES),
    "case_language_cut": (_cleaned(mark_languages="cut"), CUT),
    "case_language_marks": (_cleaned(mark_languages="mark"), MARKED),
    "case_outputs": (_outputs, OUTPUTS),
    "case_dependencies": (_dependencies, UD),
    "case_decoding": (_decoded, DECODED),
    "case_split_words": (_cleaned(), [("урахув\nання тут", "урахування\n тут"), ("слово\nділо", "слово\nділо"), ("ми\nли.", "ми\nли.")]),
    "case_simple_mode": (_cleaned(simple=True), [("нашійTwitter", "нашійTwitter"), ("ураху-\nвання", "ураху-\nвання"), ("новоствореноі", "новоствореної"), ("-Агов", "- Агов")]),
    "case_journal": (_cleaned(journal=True), JOURNAL),
    "case_one_line": (_cleaned(split_long_lines=True), ONE_LINE),
    "case_disabled_rule": (_cleaned(disabled_rules=frozenset({"oi"})), [("новоствореноі", "новоствореноі")]),
    "case_ranking": (_ranked, RANKED),
    "case_context_words": (_column(lambda c: N.context_word(F.split(c, " ")[0], F.split(c, " ")[1], F.split(c, " ")[2])), CONTEXT_WORDS),
    "case_misc": (_misc, MISC),
    "case_levels": (_levels, LEVELS),
    "case_kept_space": (_spaced, SPACED),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda s, d, run=run, cases=cases: run(s, d, [i for i, _ in cases]).select("no", "result")) for k, (run, cases) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return {k: "SELECT no::INT AS no, result::VARCHAR AS result FROM (VALUES " + ", ".join(f"({n}, {quote(e)})" for n, (_, e) in enumerate(cases)) + ") AS t(no, result)" for k, (_, cases) in CASES.items()}
