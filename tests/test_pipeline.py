import pytest
from pyspark.sql import functions as F

from textloom import __main__ as cli
from textloom.config import TagConfig, TokenizeConfig
from textloom.operators import unknown
from textloom.plans import pipeline

LEX = [("слово", "слово", "noun:inanim:n:v_naz"), ("слово", "слово", "noun:inanim:n:v_zna"), ("діло", "діло", "noun:inanim:n:v_naz"), ("і", "і", "conj:coord"), ("читав", "читати", "verb:imperf:past:m"), ("літав", "літати", "verb:imperf:past:m"), ("нашої", "наш", "adj:f:v_rod")]


@pytest.fixture(scope="module")
def tables(spark):
    lex = spark.createDataFrame(LEX, "form string, lemma string, tags string")
    ws = spark.createDataFrame([("слово", "слово", "noun:inanim:n:v_zna", 0.9), ("слово", "слово", "noun:inanim:n:v_naz", 0.1)], "word string, lemma string, postag string, rate double")
    sem = spark.createDataFrame([("слово", "noun", "1:abst", "")], "lemma string, pos string, semtag string, cond string")
    m = spark.createDataFrame([("noun", "Upos=NOUN"), ("conj:coord", "Upos=CCONJ"), ("n", "Gender=Neut"), ("punct", "Upos=PUNCT")], "part string, ud string")
    return pipeline.Tables(lex, ws, None, unknown.suffix_statistics(lex), sem, None, m)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Слово і діло.\n\nДіло."), (2, None), (3, "")], "doc_id long, text string")


def body(df, k=1):
    return {r.doc_id: r.body for r in df.collect()}.get(k)


def test_formats(docs, tables):
    txt = body(pipeline.tag_documents(docs, tables, TagConfig(output="txt")))
    assert txt.split("\n")[0] == "Слово[слово/noun:inanim:n:v_naz,слово/noun:inanim:n:v_zna] і[і/conj:coord] діло[діло/noun:inanim:n:v_naz].[/punct]"
    assert body(pipeline.tag_documents(docs, tables, TagConfig(lemma_only=True))) == "слово і діло.\nділо."
    xml = body(pipeline.tag_documents(docs, tables, TagConfig(output="xml", token_format=True)))
    assert xml.startswith("<?xml") and xml.count("<paragraph/>") == 2 and "<alts>" in xml
    vertical = body(pipeline.tag_documents(docs, tables, TagConfig(output="vertical")))
    assert vertical.startswith("<s>\nСлово\tnoun:inanim:n:v_zna\tслово\n")
    conllu = body(pipeline.tag_documents(docs, tables, TagConfig(output="conllu")))
    assert conllu.startswith("# sent_id = 1\n# text = Слово і діло.\n1\tСлово\tслово\tNOUN\t") and "SpaceAfter=No" in conllu
    assert body(pipeline.tag_documents(docs, tables, TagConfig(output="json")), 2) is None


def test_options(spark, tables):
    d = spark.createDataFrame([(1, "Малював слово нашоі.")], "doc_id long, text string")
    t = {r["value"]: r for r in pipeline.tag_tokens(d, tables, TagConfig(tag_unknown=True, show_level=True, unknown_rate=True, semantic_tags=True, modules=frozenset({"lesya"}))).collect()}
    assert t["слово"].semtags == "1:abst" and t["слово"].level is None
    assert t["нашоі"].readings[0].tags == "adj:f:v_rod:alt"
    one = pipeline.tag_sentences(d, tables, TagConfig(disambiguate=True, show_rate=True)).first()
    assert [len(x.readings) for x in one.tokens] == [1] * 4 and one.rates[1][0] > 0.8 and one.tokens[1].readings[0].tags.endswith("v_zna")
    counters = pipeline.ranking_counters(pipeline.tag_sentences(d, tables), tables.word_stats).first()
    assert (counters.total, counters.word, counters.no_word) == (1, 1, 0)


def test_tokenizer_and_reports(docs, tables):
    assert body(pipeline.tokenize_documents(docs, TokenizeConfig(only_words=True))) == "Слово і діло\nДіло"
    r = pipeline.reports(pipeline.tag_tokens(docs, tables).withColumn("clean", F.col("clean")))
    assert {x.word: x.n for x in r["frequency"].collect()} == {"слово": 1, "і": 1, "діло": 2} and set(r) >= {"unknown", "homonym", "lemma"}


def test_command_line(spark, tables, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Слово і діло.", encoding="utf-8")
    tables.lexicon.write.parquet(str(tmp_path / "lex"))
    for what, more in (("tokenize", ["--words"]), ("tag", ["--lexicon", f"{tmp_path}/lex"]), ("clean", ["--lexicon", f"{tmp_path}/lex"]), ("stats", ["--lexicon", f"{tmp_path}/lex"])):
        cli.main([what, "-i", str(tmp_path / "in"), "-o", str(tmp_path / what), *more])
    out = "".join(p.read_text() for p in (tmp_path / "tokenize").glob("part-*"))
    assert out.strip() == "Слово|і|діло|."
    assert (tmp_path / "clean" / "status=ok").is_dir() and (tmp_path / "stats" / "lemma").is_dir()
    cli.main(["inflect", "--lexicon", f"{tmp_path}/lex", "--lemma", "слово"])
    assert "слово" in capsys.readouterr().out
