import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import char_model, encoding_repair, languages, print_form, quality, rule_lists, scan_repair, sentence_units, shape_examples, shape_features, term_counts
from textloom.llm.codepoints import to_points, to_strings
from textloom.llm.seeds import SENTENCES

UK = SENTENCES["uk"].replace("\n", " ")
EXTRA = "request_id long, text string, id string, shape string, term string"


def requests(spark, texts):
    """Requests with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(k, t, "i", "s", "t") for k, t in enumerate(texts)], EXTRA)


# code points and print forms (problem 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=6))
def test_points_round_trip(texts):
    col = pa.array(texts, pa.string())
    points, offs = to_points(col)
    valid = np.array([t is not None for t in texts], bool)
    assert to_strings(points, offs, valid).to_pylist() == texts


def plain_form(text):
    """Brute force of the print form, character by character."""
    out = unicodedata.normalize("NFD", "".join(print_form._fold(c, {c: b for b, same in print_form.SAME_SHAPE.items() for c in same}) for c in text.replace("\r\n", "\n").replace("\r", "\n")))
    return unicodedata.normalize("NFC", out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aаеєїйіoо'’ʼ ́̆̈ﬁＡ１－—​­\xa0é\n\rЁü.", max_size=14), max_size=5))
def test_print_form_is_brute_force(texts):
    got = print_form.print_form(pa.array(texts, pa.string())).to_pylist()
    assert [unicodedata.normalize("NFC", x) for x in got] == [plain_form(t) for t in texts]


@given(st.lists(st.text(alphabet="한하글가각ᄒ가ᅳᆫᆨᆧㅎㅏ\u200b\u0301a", max_size=14), max_size=5))
def test_print_form_of_hangul_is_brute_force(texts):
    got = print_form.print_form(pa.array(texts, pa.string())).to_pylist()
    assert [unicodedata.normalize("NFC", x) for x in got] == [plain_form(t) for t in texts]
    assert got == print_form.print_form(pa.array([unicodedata.normalize("NFD", t) for t in texts], pa.string())).to_pylist()


def test_print_form_joins_hangul():
    a = print_form.print_form(pa.array(["한글 각", unicodedata.normalize("NFD", "한글 각"), "한글 각", "ᄒ", "ᅡ", "ㅎㅏ", "하"])).to_pylist()
    assert a[:3] == ["한글 각"] * 3 and a[3:5] == ["ᄒ", "ᅡ"] and a[5] != a[6] == "하"


def test_print_form_batches_do_not_mix():
    a = ["́abc", "x", "", None, "̆"]
    assert print_form.print_form(pa.array(a)).to_pylist() == [print_form.print_form(pa.array([t], pa.string())).to_pylist()[0] for t in a]


def test_alike_pairs(spark):
    texts = ["Слово й діло", "Cлово й діло", "Слово\xa0й ділo", "слово й діло", "Слово — діло", None, "", "  ", "Слово й діло", "​"]
    got = {tuple(r) for r in print_form.alike_pairs(requests(spark, texts)).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (1, 8), (2, 8)}
    assert print_form.alike_pairs(requests(spark, [None])).count() == 0
    assert {r.request_id: r.print_text for r in print_form.normalise(requests(spark, ["é", None, ""])).collect()} == {0: "é", 1: None, 2: ""}


def test_classes_of_texts(spark):
    texts = ["Слово", "Cлово", "слово", None, "", "Слово", "Слoво", "​"]
    got = {r.request_id: (r.class_id, r.n_variants, r.n_texts) for r in print_form.members(requests(spark, texts)).collect()}
    assert got == {0: (0, 3, 4), 1: (0, 3, 4), 5: (0, 3, 4), 6: (0, 3, 4), 2: (2, 1, 1)}
    assert print_form.members(requests(spark, [None])).count() == 0


# sentences (problem 3)


def spans(text, corpus=()):
    counts = {}
    for t in corpus:
        sentence_units.count_words(t, counts)
    return [text[a:b] for a, b in sentence_units.Splitter(text, counts).spans()]


@pytest.mark.parametrize(
    "text, n",
    [
        ("Перше речення. Друге речення! Третє?", 3),
        ("Він... помовчав. Тобто... ні!", 2),
        ("«Так. Ні. Не знаю», — відповіла вона. Потім пішла.", 2),
        ("«Хто там? Озвіться!» — спитав сторож. Тиша.", 2),
        ('"Who is it? Speak up!" asked the guard. Nobody came.', 2),
        ("Ціна 2.5 млн, версія 1.2.3 готова. Далі тихо.", 2),
        ("Use e.g. this one, i.e. that. Then stop.", 2),
        ("Рядок без\nкінця далі. Інший.", 2),
        ("Заголовок\n\nРечення одне.", 2),
        ("「誰ですか。返事をしてください。」と番人は言った。早く閉めて！", 2),
        ("守门人问：“谁在外面？请回答！”真的是这样吗？", 2),
        ("क्या यह सच है? मान 80.5 था। ठीक।", 3),
        ("วันนี้อากาศเย็นสบาย ห้องนี้มีหนังสือ72เล่ม", 2),
        ("Скінчилося.Далі нове речення.", 2),
        ("Am 14. Mai 1931 kam er. Gut.", 2),
        ("", 0),
        ("  \n ", 0),
    ],
)
def test_sentences(text, n):
    got = spans(text)
    assert len(got) == n, got
    assert all(s == s.strip() for s in got)


def test_document_decides_about_abbreviations():
    corpus = ["На вул. Кленовій. Стоїть вул. малих будинків. Проф. Квіт прийшов, проф. каже. Купили цвяхи та ін. Потім пішли.\n\nБуло та ін.\n\nДім та ін. Він пішов."] * 4
    assert len(spans("Живе на вул. Кленовій давно. Кінець.", corpus)) == 2
    assert len(spans("Купили дошки та ін. Потім усе.", corpus)) == 2


def test_spans_cover_all_ink():
    text = UK + "\n\n" + SENTENCES["de"] + SENTENCES["zh"]
    assert "".join("".join(spans(text)).split()) == "".join(text.split())


def test_sentence_rows(spark):
    df = requests(spark, ["Одне. Друге.", None, "", "Одне. Друге."])
    got = sorted(map(tuple, sentence_units.sentences(df, sentence_units.corpus_counts(df)).collect()))
    assert got == [(0, 0, 5), (0, 6, 12), (3, 0, 5), (3, 6, 12)]


# terms (problem 5)


def test_terms_are_brute_force(spark):
    texts = ["слово Слово ΣΑΣ x1", "слово", None, "", "É é", "рідко", "слово"] + ["а б в"] * 3
    from collections import Counter

    occ, rec = Counter(), Counter()
    for t in texts:
        if t is not None:
            words = term_counts.TERM.findall("".join(map(str.lower, t)))
            occ.update(words)
            rec.update(set(words))
    n = sum(t is not None for t in texts)
    want = {w: (occ[w], rec[w], "rare" if rec[w] == 1 else "common" if rec[w] * 5 > n else None) for w in occ}
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_counts.term_counts(requests(spark, texts)).collect()}
    assert got == want
    assert term_counts.term_counts(requests(spark, [None])).count() == 0


def test_terms_with_small_counters(spark, monkeypatch):
    texts = ["а б в г", "а б", "в д е"]
    whole = sorted(map(tuple, term_counts.term_counts(requests(spark, texts)).collect()))
    monkeypatch.setattr(term_counts, "HELD", 1)
    parts = list(term_counts._partial(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert len(parts) == 3
    total = {}
    for b in parts:
        for term, o, r in zip(*(c.to_pylist() for c in b.columns)):
            x = total.setdefault(term, [0, 0])
            x[0] += o
            x[1] += r
    assert {t: tuple(v) for t, v in total.items()} == {t: (o, r) for t, o, r, _ in whole}


# encodings (problem 7)


@pytest.fixture(scope="module")
def model():
    texts = [t for lang in ("uk", "ru", "be", "pl", "de", "en") for t in SENTENCES[lang].split("\n")] * 3
    out = next(char_model._count([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]))
    counts = np.zeros(char_model.SLOTS, np.int64)
    counts[out.column(0).to_numpy()] = out.column(1).to_numpy()
    return char_model.CharModel(counts)


@pytest.mark.parametrize("chain", encoding_repair.CHAINS, ids=lambda c: "-".join(c))
def test_chains_undo_themselves(chain):
    done = 0
    for s in UK.split(" ") + SENTENCES["pl"].split():
        g = encoding_repair.garble(s, chain)
        if g is not None:
            assert encoding_repair.undo(g, chain) == s
            done += 1
    assert done


def test_held_out_lines_are_restored(model):
    r = encoding_repair.Repairer(model, (2.0, 6.0))
    right = wrong = 0
    for chain in (("utf-8", "ansi"), ("utf-8", "cp1251"), ("cp1251", "ansi"), ("koi8-u", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("utf-8", "ansi", "utf-8", "ansi")):
        for s in UK.split(". "):
            g = encoding_repair.garble(s, chain)
            if g:
                ok = r.lines(g) == {1: s}
                right, wrong = right + ok, wrong + (not ok)
    assert right >= 0.95 * (right + wrong), (right, wrong)


def test_clean_lines_stay(model):
    r = encoding_repair.Repairer(model, (2.0, 6.0))
    clean = [*UK.split(". "), "Ihr Café in São Paulo", "", "ASCII only?", "Що?! Так...", "日本語", "Пpoeкт визнaчaє\xa0внеcення"]
    assert [t for t in clean if r.lines(t)] == []
    lines = r.lines("добрий рядок\n?????? ?? ????????\nвтра�� ��\nдобрий")
    assert lines == {2: "", 3: ""}


def test_garbled_rows(spark):
    bad = encoding_repair.garble("Діти гралися у дворі, а бабуся готувала обід.", ("cp1251", "ansi"))
    texts = [t for t in SENTENCES["uk"].split("\n")] * 5 + [f"Сьогодні добре.\n{bad}\r\nкінець", None, "", " "]
    df = requests(spark, texts)
    got = [tuple(r) for r in encoding_repair.garbled_lines(df).collect()]
    assert got == [(len(texts) - 4, 2, "Діти гралися у дворі, а бабуся готувала обід.")]
    whole = {r.request_id: r.text for r in encoding_repair.restored_texts(df).collect()}
    assert len(whole) == len(texts) and whole[len(texts) - 3] is None and "бабуся" in whole[len(texts) - 4]


def test_margins_are_validated_on_all_lines(spark):
    """Brute force over every clean line, most of them far into long texts."""
    lines = [x for lang in ("uk", "ru", "be", "pl", "de") for s in SENTENCES[lang].split("\n") for x in (*s.split(", "), *s.split()) if not x.isascii()]
    lines += ["Це слово cлово", "Cон", lines[0], "дуже ˝дивний рядок"]
    texts = ["plain words of no use\n" * 1000 + "\n".join(lines[k::3]) for k in range(3)] + [None, "", "\n"]
    model, margins = encoding_repair.fit(requests(spark, texts))
    clean = [s for s in lines if char_model.clean_chars(*to_points(pa.array([s]))).all()]
    assert len(clean) == len(lines) - 1
    garbled = [encoding_repair.garble(s, encoding_repair.CHAINS[zlib.crc32(s.encode()) % len(encoding_repair.CHAINS)]) for s in clean]
    pairs = [(s, g) for s, g in zip(clean, garbled) if g and g != s]
    score = lambda w: model.scores([w])[0]
    odd = lambda s: [w for w in s.split(" ") if not w.isascii()]
    worst = [min(score(encoding_repair.readable(w)) / (len(w) + 1) for w in encoding_repair._ALL_BLANKS.split(g) if not w.isascii()) for _, g in pairs]
    likely = [sum(map(score, odd(s))) / sum(len(w) + 1 for w in odd(s)) for s, _ in pairs]
    suspects = np.quantile(np.clip(worst, *encoding_repair.SUSPECT_BOUNDS), 0.998)
    legibly = np.quantile(np.clip(likely, *encoding_repair.READABLE_BOUNDS), 0.1)
    assert margins[2:] == pytest.approx((suspects, legibly), abs=2e-4)
    r = encoding_repair.Repairer(model, (0.0, 0.0, *margins[2:]))
    gains = [(s, *r.line(x), kind) for kind, xs in ((0, [(s, s) for s in clean]), (1, pairs)) for s, x in xs]
    for eight_bit, least in enumerate((2.0, 4.0)):
        c = np.array([gain for _, was, gain, e, kind in gains if e == eight_bit and kind == 0 and was is not None])
        b = np.array([gain for s, was, gain, e, kind in gains if e == eight_bit and kind == 1 and was == s])
        cuts = np.arange(least, 30.0, 0.5)
        wrong = np.array([3 * (c > x).sum() + (b <= x).sum() for x in cuts])
        good = cuts[wrong == wrong.min()]
        assert len(b) and margins[eight_bit] == good[len(good) // 2]


# shapes (problem 4) and rule lists


def test_rule_lists_find_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((900, 3))
    y = np.where(x[:, 0] > 0.8, "a", np.where(x[:, 1] < 0.3, "b", "c"))
    rules = rule_lists.induce(x, y, ["a", "b"])
    said = np.full(900, "c", object)
    left = np.ones(900, bool)
    for shape, conditions in rules:
        hit = left & rule_lists.covers(x, conditions)
        said[hit] = shape
        left &= ~hit
    assert (said == y).mean() > 0.97
    assert rule_lists.to_sql([], [], "c") == "'c'" and "CASE WHEN" in rule_lists.to_sql(rules, ["p", "q", "r"], "c")


def test_shapes_on_held_out_documents(spark):
    df = requests(spark, SENTENCES["uk"].split("\n") * 4)
    fitted = encoding_repair.fit(df)
    learned = quality.learn_shapes(df, quality.common_words(df), fitted, n=1500)
    held = shape_examples.examples([], 400, seed=99)
    said = learned.decide([t for t, _ in held])
    assert (said == np.array([s for _, s in held])).mean() > 0.9 and learned.held_out < 0.1
    # the native CASE expressions say the same
    x = spark.createDataFrame([[k, *map(float, f)] for k, f in enumerate(np.nan_to_num(shape_features.features([t for t, _ in held], learned.common)))], ["k", *shape_features.FEATURES])
    assert [r.said for r in x.select("k", learned.column().alias("said")).orderBy("k").collect()] == list(said)


def test_statistics_are_brute_force():
    r = random.Random(5)
    texts = ["".join(r.choice("абвіїABcd1 2  \n\n.,;|-!»ё́") for _ in range(r.randint(0, 120))) for _ in range(300)] + [None, "", " \n", "é" * 3000, "1) а\n2) б"]
    common = ["а", "ab", "абв"]
    got = shape_features.features(texts, shape_features.word_hashes(common))
    for t, f in zip(texts, got):
        f = dict(zip(shape_features.FEATURES, f))
        if not t or not t.strip():
            assert np.isnan(f["n_words"])
            continue
        words = regex.findall(r"[\p{L}\p{M}\p{N}]+", t)
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        want = {
            "n_words": len(words),
            "n_lines": len(lines),
            "mean_word_length": sum(map(len, words)) / max(len(words), 1),
            "common_share": sum(w.lower() in common for w in words) / max(len(words), 1),
            "distinct_share": len({w.lower() for w in words}) / max(len(words), 1),
            "line_end_share": sum(bool(regex.search(r"[.!?:][»\s]*$", x)) for x in lines) / len(lines),
            "longest_line": max(map(len, lines)),
            "repeat_share": 1 - len(set(lines)) / len(lines),
            "symbol_ratio": len(regex.findall(r"[^\p{L}\p{M}\p{N}\s]", t)) / max(len(regex.findall(r"\S", t)), 1),
            "pipe_share": sum(x.count("|") > 1 or " | " in x for x in lines) / len(lines),
        }
        assert {k: round(f[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}, t


def test_shape_rows(spark):
    texts = [UK, "\n".join(f"{k}. слово" for k in range(1, 12)), "\n".join(f"місто;{k};{k * 7};—" for k in range(12)), "\n".join("%[#}\\+_/@#==$~]=*|/>#^<" for _ in range(9)), None, "", " \n"]
    got = {r.request_id: r for r in quality.shapes(requests(spark, texts)).collect()}
    assert [got[k]["shape"] for k in range(7)] == ["prose", "list", "table", "junk", None, None, None]
    assert got[1].n_words == 22 and got[4].n_words is None and got[0].line_end_share == 1.0


# languages (problem 1)


def test_codewords_are_apart():
    c = languages.codewords()
    assert min((c[i] != c[j]).sum() for i in range(len(c)) for j in range(i)) >= 9


def test_languages_held_out():
    texts, langs = [], []
    test, want = [], []
    for k, lang in enumerate(languages.LANGUAGES):
        for n, s in enumerate(SENTENCES[lang].split("\n")):
            (test if n == 1 else texts).append(s)
            (want if n == 1 else langs).append(k)
    e = languages.Examples(texts, np.array(langs))
    c = languages._fit(e, np.ones(len(texts), bool))
    assert (c.decode(c.margins(test)).argmax(1) == np.array(want)).all()


def test_languages_are_fitted_on_all_labelled_rows(spark):
    """Brute force over all paragraphs: more rows than 4,000, one of them long, some with a wrong label."""
    r = random.Random(3)
    some = lambda lang: " ".join(r.choices(SENTENCES[lang].split(), k=8))
    rows = [(lang, f"{some(lang)}\n\n{some('ru' if n % 9 == 0 else lang)}") for lang in languages.LANGUAGES for n in range(370)]
    rows.append(("uk", "\n\n".join([*(some("uk") for _ in range(150)), SENTENCES["uk"].split("\n")[0] + " щґюжщ"])))
    assert len(rows) > 4000 and len(rows[-1][1]) > 5000
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)] + [(-1, None, "uk"), (-2, "", "uk"), (-3, UK, None)], "request_id long, text string, lang string")
    c = languages.fit(df)
    # a word at the end of the long text is known
    assert (c.weights[languages.features(["щґюжщ "])[0]] != 0).any(2).all()
    found = [(p, languages.LANGUAGES.index(lang)) for lang, t in rows for p in languages.paragraphs(encoding_repair.legible(t)) if len(p) > 30]
    e, seeds = languages.Examples([p for p, _ in found], np.array([k for _, k in found])), languages._seeds()
    every = np.ones(len(seeds.langs), bool)
    held, held_seeds = np.array([zlib.crc32(p.encode()) % 4 == 0 for p, _ in found]), np.cumsum(every) % 4 == 0
    want = languages._fit(seeds, every)
    for _ in range(2):
        agree = want.decode(want.margins([p for p, _ in found])).argmax(1) == e.langs
        assert 0.5 < agree.mean() < 1
        rest, own = (languages._counts(e, agree & x) + languages._counts(seeds, y) for x, y in ((~held, ~held_seeds), (held, held_seeds)))
        w = languages._weights(rest)
        right = np.concatenate([languages._margins(x, use, w) * languages.codewords()[x.langs] > 0 for x, use in ((e, agree & held), (seeds, held_seeds))])
        langs, use = np.concatenate([e.langs, seeds.langs]), np.concatenate([agree & held, held_seeds])
        trust = [(right[use & (langs == k)].sum(0) + 0.9 * 8) / ((use & (langs == k)).sum() + 8) for k in range(len(languages.LANGUAGES))]
        want = languages.Classifier(languages._weights(rest + own), np.array(trust) ** 2)
    assert np.array_equal(c.weights, want.weights) and np.allclose(c.trust, want.trust, atol=0.01)


def test_mislabelled(spark):
    ru, uk, en = (SENTENCES[x].split("\n")[0] for x in ("ru", "uk", "en"))
    rows = [(1, uk, "uk-UA"), (2, ru, "UK"), (3, f"{uk}\n \n{ru}\n\n\n{en}", None), (4, None, "uk"), (5, "", "uk"), (6, "Коротко", "ru"), (7, uk, "und"), (8, uk, "")]
    df = spark.createDataFrame(rows, "request_id long, text string, lang string").selectExpr("*", "'x' AS label", "1 AS para_no")
    found = languages.paragraph_languages(df).cache()
    assert sorted(map(tuple, languages.mislabelled(found).collect())) == [(2, 1, "ru"), (3, 1, "uk"), (3, 2, "ru"), (3, 3, "en"), (7, 1, "uk"), (8, 1, "uk")]
    whole = {r.request_id: r.languages for r in languages.request_languages(found).collect()}
    assert whole[3] == 3 and 4 not in whole


def test_segments(spark):
    ru, uk, en = (SENTENCES[x].split("\n")[0] for x in ("ru", "uk", "en"))
    df = spark.createDataFrame([(1, f"{uk} {en}\n\n{ru}", None), (2, None, "uk"), (3, "", None), (4, uk, "uk")], "request_id long, text string, lang string")
    got = sorted((r.request_id, r.para_no, r.segment_no, r.lang) for r in languages.segment_languages(df).collect())
    assert got == [(1, 1, 1, "uk"), (1, 1, 2, "en"), (1, 2, 1, "ru"), (4, 1, 1, "uk")]


# scanned pages (problem 6)

PAGE = """Сьогодні вранці ми поїхали до міста, щоб ку-
пити хліб і молоко. Він не знав, що робити
далі, і тому мовчав. Діти гралися у дв0рі, а
— 12 —

К. Автор. Книга
бабуся готувала обід. Цей будинок збудували
понад сто років тому. Дво- й триповерхові ха-
ти стояли поруч. Північно-східні вітри несли
— 13 —
К. Автор. Книга

вологу. Спокійні вечори тут бувають частіше."""


def test_scanned_page():
    words = {w: 50 for w in "сьогодні вранці ми поїхали до міста щоб купити хліб і молоко він не знав що робити далі тому мовчав діти гралися у дворі а бабуся готувала обід цей будинок збудували понад сто років хати стояли поруч північно-східні вітри несли вологу спокійні вечори тут бувають частіше й".split()}
    v = scan_repair.Vocabulary(words, set())
    found, text = scan_repair.repair(PAGE, v)
    assert set(found) == {(1, "hyphen_wrap", "купити"), (3, "misread", "дворі"), (4, "page_number", ""), (6, "running_header", ""), (8, "hyphen_wrap", "хати"), (10, "page_number", ""), (11, "running_header", "")}
    assert "щоб купити хліб" in text and "Автор" not in text and "Дво- й триповерхові хати" in text and "у дворі, а бабуся" in text
    for t in ("", " ", "один рядок", "1. слово\n2. діло\n3. день", UK):
        assert scan_repair.repair(t, v) == ([], t)


def test_scan_rows(spark):
    lex = spark.createDataFrame([(w,) for w in [*UK.lower().replace(".", "").replace(",", "").split(), None]], "form string")
    df = requests(spark, [PAGE, None, "", UK])
    got = {(r.request_id, r.line_no, r.damage, r.repaired) for r in scan_repair.damages(df, [lex]).collect()}
    assert {(0, 1, "hyphen_wrap", "купити"), (0, 4, "page_number", "")} <= got and {g[0] for g in got} == {0}
    assert scan_repair.repaired_texts(df, [lex]).count() == 4


def test_long_scanned_paragraph_is_whole():
    lines = [scan_repair.Line(k + 1, "слова " * 9 + "далі") for k in range(300)]
    assert scan_repair.paragraphs(lines, set(), 58) == [0]


def test_lattice_merges_splits_and_joins():
    text = "Сьогодні вранці ми поїхали до мі ста щоб ку-\nпити хлібі молоко та сіль. Він не знав ро-\nбити це чи ні, бо ніхто йому не каз ав про\nце нічого й він мовчав до самого вечора."
    words = {w: 50 for w in "сьогодні вранці ми поїхали до міста щоб купити хліб і молоко та сіль він не знав робити це чи ні бо ніхто йому казав про нічого й мовчав самого вечора хлібі молоко".split()}
    words.pop("хлібі")
    found, out = scan_repair.repair(text.replace("хлібі молоко", "хлібмолоко"), scan_repair.Vocabulary(words, set()))
    assert out == "Сьогодні вранці ми поїхали до міста щоб купити хліб молоко та сіль. Він не знав робити це чи ні, бо ніхто йому не казав про це нічого й він мовчав до самого вечора."
    assert found == [(1, "hyphen_wrap", "купити"), (2, "hyphen_wrap", "робити")]


def test_a_misreading_that_recurs_is_still_one():
    v = scan_repair.Vocabulary({"потребує": 600, "потребуе": 5, "лис": 40, "ліс": 50}, {"лис"})
    assert v.word("потребуе")[2] == "потребує" and v.least("потребуе")[1] == "потребує"
    assert v.least("лис")[1] == "лис" and v.least("ліс")[1] == "ліс"


def test_confusions_are_brute_force():
    r = random.Random(2)
    words = {"".join(r.choice("абиноеrnm") for _ in range(r.randint(2, 6))): r.randint(3, 90) for _ in range(60)}
    v = scan_repair.Vocabulary(words, set())

    def tries(w):
        for true, read in scan_repair.PAIRS:
            at = w.find(read)
            while at >= 0:
                yield at, read, w[:at] + true + w[at + len(read) :], true
                at = w.find(read, at + 1)

    for _ in range(60):
        w = "".join(r.choice("абиноеrnm") for _ in range(r.randint(2, 6)))
        cost = lambda read: scan_repair.SURELY if read in scan_repair.SURE else scan_repair.CONFUSION
        best = float("inf")
        for at, read, x, true in tries(w):
            best = min(best, v.cost.get(x, float("inf")) + cost(read))
            for at2, read2, y, _ in tries(x):
                if at2 >= at + len(true):  # the second one further right
                    best = min(best, v.cost.get(y, float("inf")) + cost(read) + cost(read2))
        assert v._confused(w)[0] == pytest.approx(best)


def test_paragraphs_are_the_cheapest_partition():
    r = random.Random(4)
    for _ in range(120):
        lines = [scan_repair.Line(k + 1, r.choice(("   ", "")) + r.choice(("слово ", "«слово ", "(і ", "діло» ")) * r.randint(1, 6) + r.choice(("кінець.", "далі", "пере-", "«так", "ні»."))) for k in range(r.randint(1, 8))]
        blank = {k for k in range(1, len(lines)) if r.random() < 0.2}
        got = scan_repair.paragraphs(lines, blank, 44)
        costs = {}
        for m in range(1 << (len(lines) - 1)):
            starts = [0] + [k for k in range(1, len(lines)) if m >> (k - 1) & 1]
            costs[tuple(starts)] = scan_repair.partition_cost(lines, blank, 44, starts)
        assert costs[tuple(got)] == pytest.approx(min(costs.values()))
