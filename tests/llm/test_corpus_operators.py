import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import mixing, subject_areas, tokenize_ids

HERE = f"{tokenize_ids.TOKENIZER_DIR}/{tokenize_ids.BYTE_BPE}"
pytestmark = pytest.mark.skipif(not os.path.exists(HERE), reason="no tokenizer files")


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_ids_round_trip(text):
    ids = next(tokenize_ids._encodings([text], HERE)).ids
    assert tokenize_ids.decode(ids) == text
    spans = tokenize_ids.token_spans(text, ids)
    assert len(spans) == len(ids) and all(0 <= a <= b <= len(text) for a, b in spans)
    assert not spans or spans[0][0] == 0 and spans[-1][1] == len(text)


def test_against_the_other_library():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    path = HERE.replace(".json", ".tiktoken")
    pattern = __import__("public_tokenizers").PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for t in ("Слово й діло, 12.5 %", "a  b\n\n c", "👩‍🔬 <|endoftext|> x", "", "\u0000�"):
        assert next(tokenize_ids._encodings([t], HERE)).ids == enc.encode_ordinary(t)


def test_ids_of_rows(spark):
    df = spark.createDataFrame([(1, "слово"), (2, None), (3, ""), (4, "<|endoftext|>"), (4, "<|endoftext|>"), (5, "а" * 20000)], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit(9))
    got = [(r.doc_id, r.ids) for r in tokenize_ids.encode(df).collect()]
    assert sorted(len(x) for i, x in got if i in (2, 3)) == [0, 0] and all(50256 not in x for _, x in got) and sum(i == 4 for i, _ in got) == 2
    back = {r.doc_id: r.text for r in tokenize_ids.decode_column(tokenize_ids.encode(df)).collect()}
    assert back[1] == "слово" and back[2] == "" and back[4] == "<|endoftext|>" and len(back[5]) == 20000
    assert tokenize_ids.decode(tokenize_ids.token_bytes() and [0][:0]) == ""


def test_spans_of_rows(spark):
    df = spark.createDataFrame([(1, "слово 👩‍🔬"), (2, None), (3, ""), (4, "a" * 5000)], "doc_id long, text string").withColumn("starts", F.lit("clash")).withColumn("id", F.lit(9))
    got = {r.doc_id: (r.starts, r.ends) for r in tokenize_ids.spans(df).collect()}
    assert got[2] == ([], []) and got[3] == ([], []) and got[1][0][0] == 0 and got[1][1][-1] == len("слово 👩‍🔬") and got[4][1][-1] == 5000
    assert all(a < b for a, b in zip(*got[1]))


def test_byte_alphabet():
    t = tokenize_ids.byte_alphabet()
    assert len(set(t.values())) == 256 and t[ord("a")] == "a" and t[32] == "Ġ" and t[10] == "Ċ"


@pytest.fixture(scope="module")
def sized(spark):
    rows = [(k, "big", 0.5 + (k % 5) / 10, 10) for k in range(600)] + [(1000 + k, "small", 1.0, 5) for k in range(20)] + [(2000, "empty", 1.0, 0)] + [(3000, "other", 1.0, 7)]
    return spark.createDataFrame(rows, "doc_id long, src string, weight double, n_tokens long").cache()


def test_mixture(spark, sized):
    targets = spark.createDataFrame([("Big ", 0.5, 2), ("small", 0.3, 4), ("empty", 0.1, 3), ("absent", 0.1, None)], "source string, target_share double, max_repeats int")
    report = mixing.source_report(sized, targets).cache()
    r = {x.source: x for x in report.collect()}
    assert r["Big "].total == 6100 and not r["Big "].short and r["small"].short and r["empty"].short and r["absent"].short and r["absent"].size == 0
    assert r["small"].epochs == 4 and r["Big "].epochs == 0
    got = mixing.mix(sized, report).collect()
    taken = sum(x.n_tokens * x.copies for x in got if x.source == "Big ")
    assert 3040 <= taken <= 3050 and all(x.copies == 4 for x in got if x.source == "small") and sum(x.source == "small" for x in got) == 20
    again = mixing.mix(sized.repartition(7), report).collect()
    assert {x.doc_id for x in got} == {x.doc_id for x in again}
    # heavier documents are taken more often
    w = dict(sized.select("doc_id", "weight").collect())
    mine = [w[x.doc_id] for x in got if x.source == "Big "]
    assert sum(mine) / len(mine) > 0.7


def test_mixture_is_brute_force(spark, sized):
    """The bins give the same documents as one ordered pass over a source."""
    targets = spark.createDataFrame([("big", 0.37, 1)], "source string, target_share double, max_repeats int")
    report = mixing.source_report(sized, targets)
    got = {r.doc_id for r in mixing.mix(sized, report).collect()}
    u = (F.abs(F.xxhash64("doc_id", F.lit(42)) % (1 << 40)) + 0.5) / float(1 << 40)
    rows = sized.filter("src = 'big'").withColumn("key", -F.log(u) / F.col("weight")).orderBy("key", "doc_id").collect()
    rest, want, total = report.first().rest, set(), 0
    for r in rows:
        if r.n_tokens and total + r.n_tokens / 2 < rest:
            want.add(r.doc_id)
        total += r.n_tokens
    assert got == want


def test_mixture_never_repeats_too_often(spark):
    """Empty texts, whole epochs, and one document larger than the budget."""
    rows = [*((k, "a", 0.1, 0) for k in range(20)), (20, "a", 1.0, 100), (30, "b", 1.0, 100), *((40 + k, "c", 1.0, 1) for k in range(300))]
    sized = spark.createDataFrame(rows, "doc_id long, src string, weight double, n_tokens long")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.12, 9), ("c", 0.48, 3)], "source string, target_share double, max_repeats int")
    report = mixing.source_report(sized, targets)
    got = mixing.mix(sized, report).collect()
    assert {x.copies for x in got if x.source == "a"} == {2} and sum(x.source == "a" for x in got) == 21
    r = {x.source: x for x in mixing.reached(report, mixing.mix(sized, report)).collect()}
    assert (r["a"].reached, r["b"].reached, r["c"].reached) == (200, 100, 240)
    for s in "abc":
        assert r[s].reached == sum(x.n_tokens * x.copies for x in got if x.source == s)


def test_bins_are_even_for_any_weights(spark):
    sized = spark.range(40000).selectExpr("id AS doc_id", "'a' AS src", "IF(id % 3 = 0, 0.1D, 0.1D + (id % 90) / 100D) AS weight", "5L AS n_tokens")
    most = mixing._binned(sized, 42).groupBy("bin").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] < 60 and most[1] > 4000


def test_reached_shares_are_those_of_the_mixture(spark):
    sized = spark.createDataFrame([(1, "big", 1.0, 1000), *((k, "small", 1.0, 10) for k in range(2, 102))], "doc_id long, src string, weight double, n_tokens long")
    report = mixing.source_report(sized, spark.createDataFrame([("Big", 0.25, 1), ("small", 0.25, 1), ("none", 0.5, 1)], "source string, target_share double, max_repeats int"))
    got = {r.source: (r.reached, r.reached_share) for r in mixing.reached(report, mixing.mix(sized, report)).collect()}
    assert got == {"Big": (0, 0.0), "small": (500, 1.0), "none": (0, 0.0)}


def test_source_names(spark):
    df = spark.createDataFrame([(1, "x y", "  Press \n"), (2, None, "press"), (3, "z", None), (4, "z", "")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.src, r.n_tokens) for r in mixing.sized_documents(df).collect()}
    assert got[1] == ("press", 2) and got[2] == ("press", 0) and 3 not in got
    assert mixing.source_report(mixing.sized_documents(df.limit(0)), spark.createDataFrame([("press", 0.5, 2)], "source string, target_share double, max_repeats int")).first().size == 0


def _corpus(spark):
    law = ["Суд розглянув позов та скаргу.", "Вирок і кодекс визначають покарання.", "Адвокат подав апеляцію до суду."]
    sport = ["Команда виграла матч на стадіоні.", "Тренер готує спринт і марафон.", "Турнір завершив сезон перемогою."]
    plain = ["Сьогодні добра погода.", "Люди ходять містом."]
    docs = []
    for k in range(60):
        a = law if k % 2 else sport
        docs.append((k, " ".join([a[k % 3], a[(k + 1) % 3], plain[(k // 2) % 2]]), "uk"))
    docs += [(100, f"{law[0]} {law[1]} {sport[0]} {sport[1]}", "uk"), (101, None, "uk"), (102, "", None), (103, " ".join(plain), "uk"), (104, " ".join([sport[0], *[plain[0]] * 6]), "uk")]
    labels = [(k, ("LAW" if k % 2 else " sport"), "r1") for k in range(12)] + [(13, "sport", "r2"), (None, "law", "r3"), (5, "law", "r4"), (5, "law", "r4"), (7, "unknown", "r5"), (999, "law", "r6")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("subject", F.lit("clash")),
        spark.createDataFrame(labels, "doc_id long, subject string, rater string"),
        spark.createDataFrame([("law", "x"), ("sport", "y")], "subject string, about string"),
    )


def test_subjects(spark, monkeypatch):
    # in so small a corpus every term is in many documents
    monkeypatch.setattr(subject_areas, "MOST_SHARE", 0.6)
    monkeypatch.setattr(subject_areas, "MOST_SHARE_OF_LANGUAGE", 0.6)
    docs, labels, subjects = _corpus(spark)
    got = {(r.doc_id, r.subject) for r in subject_areas.subjects_of(*subject_areas.subject_shares(docs, labels, subjects)).collect()}
    want = {(k, "law" if k % 2 else "sport") for k in range(60)} | {(100, "law"), (100, "sport")}
    assert got == want


def test_subjects_of_a_hot_text_and_a_large_subject(spark):
    # sport is in three texts of four, and one law text is published again until it holds a third of the rows
    said = {"sport": ["Команда виграла матч", "Тренер готує марафон"], "law": ["Суд розглянув позов", "Адвокат подав скаргу"]}
    of = lambda k: "law" if k % 4 == 3 else "sport"
    text = lambda k: f"{said[of(k)][0]} тут і {'абвгд'[k % 5] * 3}. {said[of(k)][1]} тут і {'клмно'[k // 5 % 5] * 3}. Номер {'прсту'[k // 25] * 3}."
    docs = [(k, text(k), "uk") for k in range(100)] + [(1000 + k, text(99), "uk") for k in range(50)]
    labels = [(k, of(k), "r1") for k in range(0, 100, 5)] + [(1000, "law", "r1"), (1001, "law", "r2"), (1002, "sport", "r3")]
    frames = (spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, subject string, rater string"), spark.createDataFrame([("law", "x"), ("sport", "y")], "subject string, about string"))
    got = {(r.doc_id, r.subject) for r in subject_areas.subjects_of(*subject_areas.subject_shares(*frames)).collect()}
    assert got == {(k, of(k)) for k in range(100)} | {(1000 + k, "law") for k in range(50)}


def test_subjects_without_labels(spark):
    docs, labels, subjects = _corpus(spark)
    assert subject_areas.subjects_of(*subject_areas.subject_shares(docs, labels.limit(0), subjects)).count() == 0
