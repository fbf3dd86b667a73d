import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import checks, disambig, lexicon, ortho, semtags, stats, stress, tag, ud, unknown
from textloom.sources import sinks

LEX = [
    ("слово", "слово", "noun:inanim:n:v_naz"), ("слово", "слово", "noun:inanim:n:v_zna"), ("діло", "діло", "noun:inanim:n:v_naz"), ("а", "а", "conj:coord"), ("а", "а", "intj"), ("а", "а", "part"),
    ("нова", "новий", "adj:f:v_naz"), ("книга", "книга", "noun:inanim:f:v_naz"), ("стара", "старий", "adj:f:v_naz"), ("стара", "стара", "noun:anim:f:v_naz"), ("наш", "наш", "adj:m:v_naz:pron:pos"), ("нашої", "наш", "adj:f:v_rod:pron:pos"),
    ("називатися", "називатися", "verb:rev:imperf:inf"), ("сідай", "сідати", "verb:imperf:impr:s:2"), ("книги", "книга", "noun:inanim:p:v_naz"), (None, "x", "noun"), ("порожнє", None, None),
]
TOKENS = "doc_id long, para_id int, sent_id int, tok_id int, value string, clean string, whitespace_before boolean"


@pytest.fixture(scope="module")
def lex(spark):
    return spark.createDataFrame(LEX, "form string, lemma string, tags string")


def tokens(spark, *sents):
    rows = [(1, 0, s, k, w, w, k > 0 and w not in ".,") for s, words in enumerate(sents) for k, w in enumerate(words.split())]
    return spark.createDataFrame(rows, TOKENS)


def by_value(df):
    return {r["value"]: r for r in df.collect()}


def test_readings_and_classes(spark, lex):
    t = by_value(tag.tag(tokens(spark, "Слово Crow кікука € ."), lex))
    assert [r.tags for r in t["Слово"].readings] == ["noun:inanim:n:v_naz", "noun:inanim:n:v_zna"]
    assert {v: t[v].readings[0].tags for v in ("Crow", "кікука", "€", ".")} == {"Crow": "unclass", "кікука": "unknown", "€": "symb", ".": "punct"}
    assert t["кікука"].readings[0].lemma == ""
    assert by_value(tag.tag(tokens(spark, "кікука"), lex, lemma_for_unknown=True))["кікука"].readings[0].lemma == "кікука"


def test_particles_become_tokens(spark, lex):
    t = tag.tag(tokens(spark, "сідай-но"), lex, split_parts=True).orderBy("part_no").collect()
    assert [(r.value, r.readings[0].tags) for r in t] == [("сідай", "verb:imperf:impr:s:2"), ("-но", "part")]


def test_empty_and_null_tokens(spark, lex):
    assert tag.tag(spark.createDataFrame([], TOKENS), lex).count() == 0
    r = tag.tag(spark.createDataFrame([(1, 0, 0, 0, None, None, None)], TOKENS), lex).first()
    assert r.readings is None
    extra = tokens(spark, "слово").withColumn("form", F.lit("x")).withColumn("lemma", F.lit("y"))
    assert tag.tag(extra, lex).first().form == "x"


def test_explode_tokens_is_exact(spark):
    docs = spark.createDataFrame([(1, "Перше слово. Друге, третє."), (2, None), (3, " ")], "doc_id long, text string")
    t = tag.explode_tokens(docs).orderBy("sent_id", "tok_id").collect()
    assert [(r.sent_id, r.value, r.whitespace_before) for r in t] == [(0, "Перше", False), (0, "слово", True), (0, ".", False), (1, "Друге", False), (1, ",", False), (1, "третє", True), (1, ".", False)]


def test_outputs(spark, lex):
    s = tag.sentences(tag.tag(tokens(spark, "Слово ."), lex))
    assert s.select(sinks.txt(F.col("tokens"))).first()[0] == "Слово[слово/noun:inanim:n:v_naz,слово/noun:inanim:n:v_zna].[/punct]"
    assert s.select(sinks.txt(F.col("tokens"), True)).first()[0] == "слово."
    xml = s.select(sinks.xml(F.col("tokens"), True)).first()[0]
    assert '<token value="Слово" lemma="слово" tags="noun:inanim:n:v_naz">' in xml and "<alts>" in xml and 'whitespaceBefore="false"' in xml
    js = s.select(sinks.json(F.col("tokens"))).first()[0]
    assert js.startswith('{"tokenReadings":[{"tokens":[{"value":"Слово","lemma":"слово"')
    assert s.select(sinks.json(F.col("tokens"), True)).first()[0].startswith('[{"value":"Слово"')
    assert s.select(sinks.vertical(F.col("tokens"))).first()[0] == "<s>\nСлово\tnoun:inanim:n:v_naz\tслово || noun:inanim:n:v_zna слово\n<g/>\n.\tpunct\t.\n</s>\n"
    marks = tag.sentences(tag.tag(tokens(spark, "Слово ."), lex), paragraph_marks=True).orderBy("sent_id").select(sinks.xml(F.col("tokens"))).collect()
    assert marks[-1][0] == "<paragraph/>\n"
    docs = sinks.documents(s, "json").first().body
    assert docs.startswith('{"sentences": [')


def test_neighbours(spark):
    n = {r.value: (r.left, r.right) for r in tag.neighbours(tokens(spark, "а б в г")).collect()}
    assert n == {"а": ("__BEG", "б"), "б": ("а", "в"), "в": ("б", "__END"), "г": ("в", "__END")}


def test_statistics(spark, lex):
    t = tag.tag(tokens(spark, "борода Слово слово стара кікука кікука Crow а ."), lex, lemma_for_unknown=True).cache()
    assert {r.value: r.n for r in stats.unknown_words(t).collect()} == {"борода": 1, "кікука": 2}
    ru = spark.createDataFrame([("Борода",), (None,)], "form string")
    assert {r.value for r in stats.unknown_words(t, ru).collect()} == {"кікука"}
    assert {r.value: r.n for r in stats.unclass_report(t).collect()} == {"Crow": 1}
    assert {r.word: r.n for r in stats.word_frequency(t).collect()}["слово"] == 2
    lemmas = {r.lemma: (r.n, r.ambiguous, r.pos) for r in stats.lemma_frequency(t).collect()}
    assert lemmas["слово"] == (2, False, "noun") and lemmas["старий"] == (1, True, "adj") and lemmas["стара"] == (1, True, "noun")
    h = {r.homonym: r for r in stats.homonyms(t).collect()}["слово/noun:inanim:n:v_naz|слово/noun:inanim:n:v_zna"]
    assert (h.n, h.words, h.readings, h.heads) == (2, "слово", 2, 1)
    rate = stats.unknown_rate_by_document(t).first()
    assert rate.per_mille == 428 and rate.known == 4
    two = stats.merge([stats.unclass_report(t)] * 2, ["value"], ["n"]).first()
    assert two.n == 2


def test_one_partition_or_many(spark, lex):
    t = tokens(spark, *["Слово діло кікука"] * 20)
    a = sorted(map(tuple, stats.word_frequency(tag.tag(t.repartition(1), lex)).collect()))
    assert a == sorted(map(tuple, stats.word_frequency(tag.tag(t.repartition(8), lex)).collect()))


def test_ranking(spark, lex):
    t = tag.tag(tokens(spark, "а нова стара"), lex)
    ws = spark.createDataFrame([("а", "а", "conj:coord", 0.6), ("а", "а", "part", 0.2), ("стара", "старий", "adj:f:v_naz", 0.1), ("стара", "стара", "noun:anim:f:v_naz", 0.1)], "word string, lemma string, postag string, rate double")
    r = {(x.value, x.tags): (x["rank"], x.confidence) for x in disambig.rank_by_rate(t, ws, ["doc_id", "sent_id", "tok_id"]).collect()}
    assert r["а", "conj:coord"] == (1, 0.75) and r["а", "part"] == (2, 0.25) and r["а", "intj"] == (3, 0.0) and r["нова", "adj:f:v_naz"] == (1, 0.0)
    ctx = spark.createDataFrame([("а", "а", "intj", -1, "__BEG", "", "BEG", 0.0)], "word string, lemma string, postag string, offset int, ctx_word string, ctx_lemma string, ctx_postag string, cnt double")
    s = disambig.rank_sentences(tag.sentences(t), ws, ctx).first()
    assert [x.tags for x in s.tokens[0].readings] == ["conj:coord", "part", "intj"]
    # the noun agrees with the adjective chosen before it
    assert s.tokens[2].readings[0].tags == "noun:anim:f:v_naz"
    assert disambig.agreements("adj:f:v_naz") == disambig.agreements("noun:anim:f:v_naz")
    assert not disambig.agreements("adj:m:v_zna:rinanim") & disambig.agreements("noun:anim:m:v_zna")


def test_derived_rates(spark):
    ws = spark.createDataFrame([("книгами", "книга", "noun:inanim:p:v_oru", 0.5), ("словами", "слово", "noun:inanim:p:v_oru:xp1", 0.25), ("бар", "бар", "noun:xp2", 0.25)], "word string, lemma string, postag string, rate double")
    assert {r.tags: r.share for r in disambig.tag_rates(ws).collect()} == {"noun:inanim:p:v_oru": 0.75, "noun": 0.25}
    assert {(r.suffix, r.tags): r.rate for r in disambig.suffix_rates(ws).collect()}["ами", "noun:inanim:p:v_oru"] == 0.75
    assert {r.lemma: r.share for r in disambig.paradigm_rates(ws).collect()} == {"слово": 1.0, "бар": 1.0}


def test_guesses(spark):
    lexi = spark.createDataFrame([("читав", "читати", "verb:imperf:past:m"), ("літав", "літати", "verb:imperf:past:m"), ("малював", "малювати", "verb:imperf:past:m"), ("фільтрів", "фільтр", "noun:inanim:p:v_rod")], "form string, lemma string, tags string")
    st = unknown.suffix_statistics(lexi)
    t = spark.createDataFrame([(1, "популював", True, None, None), (2, "НС-фільтрів", True, None, None), (3, "ФАТ-10", True, None, None), (4, "США", True, None, None), (5, "я", True, None, None)], "key long, value string, first boolean, left_lemma string, left_tags string")
    g = by_value(unknown.guess(t, st, ["key"]))
    assert (g["популював"].lemma, g["популював"].tags, g["популював"].confidence) == ("популювати", "verb:imperf:past:m", -0.6)
    assert g["НС-фільтрів"].lemma == "НС-фільтр" and g["ФАТ-10"].tags == "noninfl" and g["США"].tags == "noninfl:abbr" and "я" not in g


def test_semantic_tags(spark):
    st = spark.createDataFrame([("голова", "noun", "1:conc:hum&hierar", ""), ("голова", "noun", "1:conc:body:part", ""), ("грунт", "noun", "1:conc", ""), ("читати", "verb", "1:act", "")], "lemma string, pos string, semtag string, cond string")
    d = spark.createDataFrame([("читаючи", "читати")], "advp_lemma string, verb_lemma string")
    r = spark.createDataFrame([("голова", "noun:anim:m:v_naz"), ("голова", "noun:inanim:f:v_naz"), ("ґрунт", "noun:inanim:m:v_naz"), ("читаючи", "advp:imperf"), (None, None)], "lemma string, tags string")
    got = {(x.lemma, x.tags): x.semtags for x in semtags.semantic_tags(r, st, d).collect()}
    assert got == {("голова", "noun:anim:m:v_naz"): "1:conc:hum&hierar", ("голова", "noun:inanim:f:v_naz"): "1:conc:body:part", ("ґрунт", "noun:inanim:m:v_naz"): "1:conc", ("читаючи", "advp:imperf"): "1:act"}


def test_older_spellings(spark, lex):
    w = spark.createDataFrame([("нашоі", None), ("називати", "ся"), ("щось", None)], "value string, next string")
    assert [(x.lemma, x.tags) for x in by_value(ortho.retag(w, lex, "lesya"))["нашоі"].readings] == [("наш", "adj:f:v_rod:pron:pos:alt")]
    old = spark.createDataFrame([("пір'ям", "пір'я", "noun"), ("святити", "святити", "verb"), ("засідання", "засідання", "noun"), ("питання", "питання", "noun"), ("літопис", "літопис", "noun"), ("галицький", "галицький", "adj")], "form string, lemma string, tags string")
    ask = spark.createDataFrame([(x,) for x in ("пірям", "сьвятити", "засїданя", "питаннє", "літопись", "галицкий")], "value string")
    assert {v: r.readings[0].lemma for v, r in by_value(ortho.retag(ask, old, "zheleh")).items()} == {"пірям": "пір'я", "сьвятити": "святити", "засїданя": "засідання", "питаннє": "питання", "літопись": "літопис", "галицкий": "галицький"}
    got = by_value(ortho.retag(w, lex, "zheleh", spark.createDataFrame([("щось", "part")], "word string, tags string")))
    assert got["називати"].readings[0].lemma == "називатися" and got["щось"].readings[0].tags == "part"


def test_stress(spark, one):
    assert one(stress.syllables, w="Аеродром") == 4
    assert one(stress.accents, w="сло́во") == [1] and one(stress.accents, w="кна") == []
    assert spark.range(1).select(stress.apply_accents(F.lit("Аби"), F.array(F.lit(2)))).first()[0] == "Аби́"
    assert one(stress.tag_key, t="noun:inanim:n:v_naz") == "noun:n" and one(stress.tag_key, t="verb:imperf:past:m") == "verb:imperf"
    table = spark.createDataFrame([("слово", "noun:n", "сло́во", 0, 0)], "lemma string, tag_key string, form string, base int, offset int")
    t = spark.createDataFrame([(1, "Слово", [("слово", "noun:inanim:n:v_naz")]), (2, "та", [("та", "conj")]), (3, "діло", None)], "k long, value string, readings array<struct<lemma:string,tags:string>>")
    got = {r.k: r.stressed for r in stress.stress(t, table, ["k"]).collect()}
    assert got == {1: "Сло́во", 2: "та", 3: "діло"}


def test_dependencies(spark, lex):
    m = spark.createDataFrame([("noun", "Upos=NOUN"), ("adj", "Upos=ADJ"), ("inanim", "Animacy=Inan"), ("f", "Gender=Fem"), ("p", "Number=Plur"), ("v_naz", "Case=Nom"), ("prop", "Upos=PROPN"), ("punct", "Upos=PUNCT")], "part string, ud string")
    t = tag.space_after(tag.tag(tokens(spark, "книга книги ."), lex))
    got = by_value(ud.convert(t, m, [], lex))
    assert (got["книга"].upos, got["книга"].feats) == ("NOUN", "Animacy=Inan|Case=Nom|Gender=Fem|Number=Sing")
    assert got["книги"].feats == "Animacy=Inan|Case=Nom|Gender=Fem|Number=Plur" and got["книги"].misc == "SpaceAfter=No"
    texts = spark.createDataFrame([(1, 0, 0, " книга книги.")], "doc_id long, para_id int, sent_id int, text string")
    out = sinks.conllu(ud.convert(t, m, [], lex), texts).first().conllu
    assert out.startswith("# sent_id = 1\n# text = книга книги.\n1\tкнига\tкнига\tNOUN\tnoun:inanim:f:v_naz\t")


def test_lexicon_joins(spark, lex):
    w = spark.createDataFrame([("Слово",), ("кікука",), (None,)], "word string")
    assert [r.word for r in lexicon.known(w, "word", lex).collect()] == ["Слово"]
    assert [r.word for r in lexicon.unknown(w, "word", lex).collect()] == ["кікука"]
    assert {r.word: r.known for r in lexicon.with_known(w, "word", lex).collect()} == {"Слово": True, "кікука": False, None: False}
    assert [r.form for r in lexicon.inflect(lex, "слово", "noun:inanim:n:v_naz.*").collect()] == ["слово"]


def test_rules_that_match_close_together(spark):
    text = "a!!! b!!! c!!!\n" + "x" * 50 + "!!!" + "y" * 50 + " слово слово слово" + "!" * 200
    df = spark.createDataFrame([(1, text), (2, None), (3, "!!!"), (4, "ab")], "doc_id long, text string")
    rules = [("REPEATED", r"(?iu)(?<!\p{L})(\p{L}{2,}) \1(?!\p{L})", "слово"), ("MARKS", "!!!", "!"), ("EMPTY", "(?=[ab])", "")]
    got = sorted((r.doc_id, r.rule_id, r.found, r.context, len(r.caret) - len(r.found)) for r in checks.matches(df, rules).collect())
    want = [(k, rule, m.group(), t[max(0, m.start() - 40) : m.end() + 40].replace("\n", " "), min(40, m.start())) for k, t in ((1, text), (3, "!!!"), (4, "ab")) for rule, pattern in (("REPEATED", r"(?<!\w)([^\W\d_]{2,}) \1(?!\w)"), ("MARKS", "!!!"), ("EMPTY", "(?=[ab])")) for m in re.finditer(pattern, t)]
    assert got == sorted(want)
    assert checks.matches(df.filter("doc_id = 1"), rules[1:2]).filter("context like 'a!!! b!!! c!!!%'").count() == 3


def test_rules(spark):
    docs = spark.createDataFrame([(1, "слово слово тут!!!"), (2, None), (3, "")], "doc_id long, text string")
    m = checks.matches(docs, [("REPEATED", r"(?iu)(?<!\p{L})(\p{L}{2,}) \1(?!\p{L})", "слово"), ("MARKS", "!!!", "!")])
    got = {r.rule_id: r for r in m.collect()}
    assert got["REPEATED"].found == "слово слово" and got["MARKS"].caret.endswith("^^^")
    words = spark.createDataFrame([(1, 3), (3, 0)], "doc_id long, n_words long")
    assert {r.doc_id: (r.rating, r.rules) for r in stats.grammar_rating(m.select("doc_id", "rule_id"), words).collect()} == {1: (66.67, 2), 3: (0.0, 0)}


def test_contexts_are_brute_force():
    """The index of contexts gives what going through all of them gives."""
    import random
    import re

    r = random.Random(1)
    words, lemmas = ["а", "б", "в", "__BEG"], ["а", "б", "в"]
    tags = ["noun:inanim:m:v_rod", "verb:imperf:inf", "prep", "adj:f:v_naz", "adv"]
    for _ in range(300):
        known = {(r.choice((-1, 1)), r.choice(words), r.choice(lemmas), r.choice(tags)): float(r.randint(1, 9)) for _ in range(8)}
        tokens = [{"value": w, "clean": w, "readings": [{"lemma": r.choice(lemmas), "tags": r.choice(tags)} for _ in range(2)]} for w in (r.choice(words[:3]), r.choice(["за", "б"]), r.choice(words[:3]), ".")]
        s = disambig.Statistics([], [])
        table, own = r.choice(("word", "tag")), r.choice(tags)
        s.ctx[table]["k"] = known
        left, right = disambig._context(tokens, 1, -1), disambig._context(tokens, 1, 1) if tokens[1]["value"] == "за" else set()
        want = 0.0
        for c, n in known.items():
            hit = any(c[0] == x[0] and (c[1] == x[1] or table == "tag" and c[3] == x[3] and re.match("adj|noun|verb|advp", x[3])) for x in left) or any(c[0] == x[0] and (c[1] == x[1] or c[3] == x[3]) for x in right)
            want += n * bool(hit)
            if re.match(r"(adj|noun)(?!.*v_naz)", own) and any(c[2] == x[2] and c[3].startswith("verb") and x[3].startswith("verb") for x in left):
                want += n * disambig.LEMMA_FACTOR
        got = disambig._by_context(s, table, "k", own, tokens, 1, ["noun"])
        assert got == pytest.approx(want) or table == "tag" and want < 1


def test_options_imply_others():
    from textloom.config import TagConfig

    assert TagConfig(output="txt").adjusted().set_lemma_for_unknown and not TagConfig(output="txt").adjusted().disambiguate
    c = TagConfig(output="conllu").adjusted()
    assert c.disambiguate and c.show_rate and c.single_token_only and not c.split_hyphen_parts and c.tag_unknown
    assert not TagConfig(output="vertical", no_disambig=True).adjusted().disambiguate
    assert TagConfig(unknown_rate=True).adjusted().tag_unknown and TagConfig(single_token_only=True).adjusted().token_format
    assert TagConfig(show_rate=True, all_token_readings=True).adjusted().disambiguate and not TagConfig(show_rate=True, all_token_readings=True).adjusted().single_token_only
