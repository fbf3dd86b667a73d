import pytest

from textloom.config import CleanConfig, TagConfig, TokenizeConfig
from textloom.functions import clean as C
from textloom.operators import lexicon, quality, rewrites, spacing
from textloom.operators.cleaning import clean

UK = """урахування турецьки по-турецьки загальновідоме по-християнськи для мене труба нашій новоствореної нацполіції слово слова головний вони
150-річчя зв'язаний віщо розповів здоров'я депутат людей людина людям моделі зала закон війни перемога труби алло""".split()


@pytest.fixture(scope="module")
def lexicons(spark):
    make = lambda words: spark.createDataFrame([(w, w, "noun") for w in words], "form string, lemma string, tags string")
    return {"uk": make(UK), "ru": make(["было", "слово"]), "en": make(["twitter", "insider"])}


def rewritten(spark, lexicons, step, text, limit=lexicon.BROADCAST_FORMS):
    df = spark.createDataFrame([(1, text, "other")], "doc_id long, text string, form string")
    return lexicon.rewrite(df, [step], lexicons, limit=limit).first().text


@pytest.mark.parametrize(
    "step, text, want",
    [
        (C.orphan_cr, "а\rб\r\nв", "а\nб\r\nв"),
        (C.quotes, "''депутат'' H'''", "\"депутат\" H'''"),
        (C.quotes, "сло​во а​ б", "слово а  б"),
        (C.soft_hyphens, "14­го", "14-го"),
        (C.soft_hyphens, "сло­во", "слово"),
        (C.soft_hyphens, "сло­\nво далі", "слово\n далі"),
        (C.combining, "їжак й", "їжак й"),
        (C.apostrophes, "зв”язок", "зв'язок"),
        (C.line_separators, "а б", "а\nб"),
        (C.digit_three, "3а віщо йому таке. Вул. 3алізнична 3а.", "За віщо йому таке. Вул. Залізнична 3а."),
        (C.roman_numbers, "XХІ", "XXI"),
        (C.roman_numbers, "XVП", "XVII"),
        (C.roman_numbers, "XVШ", "XVIII"),
        (C.roman_numbers, "XІІІ", "XIII"),
        (C.letter_spacing, "2008 р о к у", "2008 року"),
        (C.letter_spacing, "14 т р а в н я", "14 травня"),
        (C.dangling_numbers, "150 \n- річчя", "150-річчя"),
        (C.dangling_numbers, "д - р", "д-р"),
        (C.dangling_numbers, "будь - що", "будь-що"),
        (C.typos, "він повернетсья у мрлд", "він повернеться у млрд"),
        (C.lone_latin, "він i вона", "він і вона"),
        (C.mix_shortcuts, "зhttp://a 70-pічний", "з http://a 70-річний"),
        (C.control_chars, "сло\x08во", "слово"),
        (C.corpus_fixes, "Крим SOS, Івано Франківськ, депутатІван", "КримSOS, Івано-Франківськ, депутат Іван"),
        (C.abstracts, "а\n  Abstract\nb c\nd\n\nдалі", "а\nдалі"),
    ],
)
def test_native_steps(one, step, text, want):
    assert one(step, t=text) == want
    assert one(step, t=None) is None and one(step, t="") == ""


@pytest.mark.parametrize(
    "step, text, want",
    [
        (rewrites.line_end_hyphens, "ураху-\nвання", "урахування\n"),
        (rewrites.line_end_hyphens, "по-\nтурецьки так", "по-турецьки\n так"),
        (rewrites.line_end_hyphens, "невідо-\nмещо", "невідо-\nмещо"),
        (rewrites.not_sign_hyphens, "по¬турецьки", "по-турецьки"),
        (rewrites.not_sign_hyphens, "загальновідо¬ме", "загальновідоме"),
        (rewrites.not_sign_hyphens, "о¬е", "о¬е"),
        (rewrites.tilde_hyphens, "по~християнськи", "по-християнськи"),
        (rewrites.tilde_hyphens, "для~мене", "для мене"),
        (rewrites.mixed_letters, "трyба", "труба"),
        (rewrites.mixed_letters, "нашійTwitter", "нашій Twitter"),
        (rewrites.mixed_letters, "ГогольFest", "ГогольFest"),
        (rewrites.mixed_letters, "margin'ом", "margin'ом"),
        (rewrites.feminine_endings, "новоствореноі", "новоствореної"),
        (rewrites.feminine_endings, "Нацполіціі", "Нацполіції"),
        (rewrites.feminine_endings, "МОІ", "МОІ"),
        (rewrites.spaced_apostrophes, "зв 'язаний", "зв'язаний"),
        (rewrites.broken_i, "перемог і труб сл і во", "перемог і труб сл і во"),
        (rewrites.broken_i, "л і юдина моделі", "л і юдина моделі"),
        (rewrites.lone_g, "Г оловний", "Головний"),
        (rewrites.split_words, "депу\nтат прийшов", "депутат\n прийшов"),
        (rewrites.leading_hyphens, "-Алло", "- Алло"),
        (rewrites.control_in_word, "сло\x08во", "слово"),
        (spacing.despace, "с л о в о л ю д и н а", "слово людина"),
    ],
)
def test_lexicon_steps(spark, lexicons, step, text, want):
    assert rewritten(spark, lexicons, step, text) == want


def test_rounds_give_what_a_broadcast_gives(spark, lexicons):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["ураху-\nвання", "по¬турецьки трyба", None, "", "нашійTwitter"])], "doc_id long, text string")
    steps = [rewrites.not_sign_hyphens, rewrites.mixed_letters, rewrites.line_end_hyphens]
    a = {r.doc_id: r.text for r in lexicon.rewrite(df, steps, lexicons).collect()}
    b = {r.doc_id: r.text for r in lexicon.rewrite(df, steps, lexicons, limit=0).collect()}
    assert a == b and a[0] == "урахування\n"


def test_long_chains_of_answers_keep_their_rows(spark):
    def chain(text, lex):
        for k in range(14):
            if not lex.has(f"{text}{k}"):
                return f"{text} {k}"
        return f"{text} end"

    forms = spark.createDataFrame([(f"{t}{k}",) for t, n in (("а", 14), ("б", 13)) for k in range(n)], "form string")
    df = spark.createDataFrame([(1, "а"), (2, "б")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lexicon.rewrite(df, [chain], {"uk": forms}, limit=0).collect()} == {1: "а end", 2: "б 13"}


def test_whole_plan(spark, lexicons):
    texts = ["Ураху-\r\nвання слова\r\n", None, "", "с­лово і трyба", "ы ы ы ы ы"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, status_before string")
    got = {r.doc_id: r for r in clean(df, lexicons, CleanConfig()).collect()}
    assert got[0].text == "Урахування\r\n слова\r\n" and got[0].changed
    assert got[1].text is None and got[2].text == "" and not got[2].changed
    assert got[3].text == "слово і труба" and got[3].status_before == "x"
    again = clean(clean(df, lexicons).select("doc_id", "text"), lexicons)
    assert {r.doc_id: r.changed for r in again.collect()} == dict.fromkeys(range(5), False)
    gated = {r.doc_id: r.status for r in clean(df, lexicons, CleanConfig(min_words=2)).collect()}
    assert gated[4] == "few_words" and gated[0] == "ok"


def test_marking(spark, lexicons):
    ru = "это было быстро и они были здесь ещё тогда когда всё было иначе"
    df = spark.createDataFrame([(1, f"слово слова\n\n{ru}\n\nкінець")], "doc_id long, text string")
    marked = clean(df, lexicons, CleanConfig(mark_languages="mark")).first().text
    assert f'<span lang="ru" rate="1.0">{ru}</span>' in marked and marked.endswith("кінець")
    assert '<span lang="ru">---</span>' in clean(df, lexicons, CleanConfig(mark_languages="cut")).first().text


def test_gates(one):
    two = "\n".join("слово слово" + " " * (20 - 11) + "другий стовпчик тут" for _ in range(8))
    assert one(quality.two_columns, t=two) and not one(quality.two_columns, t="звичайний текст\nу кілька рядків")
    assert one(quality.ukrainian_words, t="слово та діло x") == 3
    assert one(quality.page_number_lines, t="— 12 —\nтекст\n-13-\n 14") == 2
    assert one(quality.diagnostics, t="сло­во¬") == ["soft_hyphen", "not_sign"]
    long = "А" * 5
    assert one(lambda c: C.split_long_lines(c, 30, 20), t=long) is None


def test_configs():
    assert TokenizeConfig(only_words=True).adjusted().words
    t = TagConfig(lemma_only=True).adjusted()
    assert t.output == "txt" and t.disambiguate and t.single_token_only and t.token_format and t.tag_unknown
    assert TagConfig(output="conllu").adjusted().set_lemma_for_unknown
    with pytest.raises(ValueError):
        CleanConfig(mark_languages="x")


def test_steps_are_the_same_in_both_engines(spark):
    texts = [f"{a}{b} {c}" for a in ("сло­во 14­го", "''так'' зв”язок", "XХІ XVП Х", "150 - річчя д - р", "р о к у і й", "3а мрлд") for b in ("\n", "\r", " ", "​", "\x08") for c in ("i вона", "т р а в н я", "СО2 -oї", "повернетсья", "")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").coalesce(2)
    steps = [*C.STEPS, C.mix_shortcuts, C.roman_numbers, C.lone_latin, C.dangling_numbers, C.letter_spacing, C.orphan_cr, C.without_cr]
    from pyspark.sql import functions as F

    got = {r.k: r for r in df.select("k", *(s(F.col("text")).alias(f"s{n}") for n, s in enumerate(steps))).collect()}
    for k, t in enumerate(texts):
        assert [got[k][f"s{n}"] for n in range(len(steps))] == [s.text(t) for s in steps], t


def test_footers(spark):
    page = "рядок тексту\n12    Вісник. Том 3\n"
    df = spark.createDataFrame([(1, page * 3 + "© Автор\nкінець"), (2, page + "далі"), (3, None)], "doc_id long, text string")
    from textloom.operators.cleaning import repeated_footers

    got = {r.doc_id: r.text for r in repeated_footers(df).collect()}
    assert got == {1: "рядок тексту\n" * 3 + "кінець", 2: page + "далі", 3: None}


def test_gates_read_whole_texts(one):
    long = "слово " * 200_000
    assert one(lambda c: quality.letters_of(c, "ы"), t=long + "ы") == 1
    two = "перша колонка      друга колонка\n"
    assert not one(quality.two_columns, t=two * 3_200 + "рядок\n" * 5_000)
    assert one(quality.suspect_empty_lines, t="Рядок.\n" * 20_000 + "рядок,\n\nдалі\n" * 6)


def test_giant_texts_in_chunks(spark):
    lex = {k: spark.createDataFrame([(w,) for w in ("труба", "екс-глава", "загальновідоме")], "form string") for k in ("uk", "ru", "en")}
    text = "трyба тут\nекс¬глава\n\nзагальновідо¬ме " * 40 + "x" * 300
    df = spark.createDataFrame([(1, text, "a"), (2, "трyба", "b"), (3, None, "c"), (4, "", "d"), (5, text + "\n", "e")], "doc_id long, text string, other string")
    want = {r.doc_id: (r.text, r.other, r.changed) for r in clean(df, lex, CleanConfig()).collect()}
    for n in (64, 500):
        got = {r.doc_id: (r.text, r.other, r.changed) for r in clean(df, lex, CleanConfig(chunk_chars=n)).collect()}
        assert got == want
