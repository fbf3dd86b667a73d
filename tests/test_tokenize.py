import pytest
from textloom.functions import classify, normalize, tokenize
from textloom.sources import sinks


def test_paragraphs_keep_the_text(one):
    text = "\n\nперший\nрядок\n\nдругий\n\n\n третій"
    got = one(tokenize.paragraphs, t=text)
    assert "".join(got) == text and len(got) == 3
    assert one(tokenize.paragraphs, t=" \n\n ") == [] and one(tokenize.paragraphs, t=None) is None


def test_long_paragraphs_are_whole(one):
    text = "абвгд " * 100_000
    assert one(tokenize.paragraphs, t=text + "\n\nкінець") == [text + "\n\n", "кінець"]


@pytest.mark.parametrize(
    "text, want",
    [
        ('десь "такі" підходи', ['десь "такі" підходи']),
        ("Слово. Діло! Чому? Так…", ["Слово.", "Діло!", "Чому?", "Так…"]),
        ("На вул. Кленовій тихо. І. Франко писав.", ["На вул. Кленовій тихо.", "І. Франко писав."]),
        ("один\nрядок", ["один рядок"]),
        ("", []),
    ],
)
def test_sentences(one, text, want):
    assert one(tokenize.sentences, t=text) == want


def test_extra_separator(one):
    assert one(lambda c: tokenize.sentences(c, separator=r"\|+"), t="десь такі||підходи") == ["десь такі", "підходи"]


def test_words(one):
    got = one(tokenize.tokens, t="Автомагістраль-Південь, наш 'видатний' автобан. Ціна 1,5 грн")
    assert got == ["Автомагістраль-Південь", ",", "наш", "'", "видатний", "'", "автобан", ".", "Ціна", "1,5", "грн"]
    text = "два  слова\tй\nрядок"
    assert "".join(one(lambda c: tokenize.tokens(c, keep_space=True, newline="\n"), t=text)) == text.replace("\t", " ")


@pytest.mark.parametrize("text, want", [('десь "такі" підхо́ди[9]', "десь такі підходи"), ("Сідай-но", "Сідай -но"), ("десь–таки", "десь –таки"), ("як-от", "як-от")])
def test_only_words(one, text, want):
    got = " ".join(one(tokenize.only_words, t=text))
    assert got.replace("–таки", "-таки") == want.replace("–таки", "-таки") or text == "десь–таки" and got == "десь таки"


def test_particles(one):
    assert one(tokenize.split_particle, w="сідай-но") == ["сідай", "-но"]
    assert one(tokenize.split_particle, w="десь–таки") == ["десь", "-таки"]
    assert one(tokenize.split_particle, w="себ-то") is None and one(tokenize.split_particle, w="слово") is None


@pytest.mark.parametrize("word, want", [(",", "punct"), ("—", "punct"), ("€", "symb"), ("<b>", "xmltag"), ("десяти-", "unknown"), ("кікука", "unknown"), ("Crow", "unclass"), ("а", "noninfl"), ("ыы", "unclass"), ("15й", "unclass"), (None, None)])
def test_classes(one, word, want):
    assert one(classify.token_class, w=word) == want


@pytest.mark.parametrize("word, want", [("89", "0"), ("4", "2"), ("15", "0"), ("13", "0"), ("23", "2"), ("21", "1"), ("0,2-0,3", "0,0"), ("1999", "YY99"), ("1999-2020", "YY20"), ("2999", "0"), ("слово", None)])
def test_numbers(one, word, want):
    assert one(normalize.number, w=word) == want


@pytest.mark.parametrize("word, want", [("—", "-"), ("?..", "?"), ("...", "…"), ("„", "«"), (",", ",")])
def test_marks(one, word, want):
    assert one(normalize.mark, w=word) == want


def test_tags(one):
    assert one(normalize.tag_core, t="noun:inanim:p:v_zna:ns") == "noun:inanim:p:v_zna"
    assert one(normalize.tag_for_rate, t="adj:m:v_naz:compb:xp1") == "adj:m:v_naz"
    assert one(normalize.word_ending, w="молекулами", t="noun:inanim:p:v_oru") == "ами"
    assert one(normalize.word_ending, w="називатися", t="verb:rev:imperf:inf") == "атися"
    assert one(normalize.word_ending, w="США", t="noun:inanim:nv") is None


def test_tokenised_outputs(spark):
    docs = spark.createDataFrame([(1, "Перше речення. Друге речення."), (2, None), (3, "")], "doc_id long, text string")
    txt = {r.doc_id: r.body for r in sinks.tokenised(docs).collect()}
    assert txt[1] == "Перше речення.\nДруге речення." and txt[2] is None
    js = {r.doc_id: r.body for r in sinks.tokenised(docs, words=True, output="json").collect()}
    assert js[1] == '[["Перше","речення","."],["Друге","речення","."]]'
    assert "<word>Друге</word>" in {r.doc_id: r.body for r in sinks.tokenised(docs, words=True, output="xml").collect()}[1]


def test_plans_are_shuffle_free(spark, capsys):
    docs = spark.createDataFrame([(1, "Перше речення.")], "doc_id long, text string")
    sinks.tokenised(docs, words=True).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Exchange", "ArrowEvalPython", "BatchEvalPython", "MapInArrow"))
