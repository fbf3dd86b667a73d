import json

import pytest
from pyspark.sql import functions as F

from textloom.runtime import cut, spread
from textloom.sources import files, lexicons, sinks
from textloom.streaming import streams


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "x-good").mkdir()
    (tmp_path / "one.txt").write_text("перший\nтекст", encoding="utf-8")
    (tmp_path / "a" / "TWO.TXT").write_text("другий", encoding="utf-8")
    (tmp_path / "a" / "cp.txt").write_bytes("десь там волоська голова\n".encode("cp1251"))
    (tmp_path / "a" / "u16.txt").write_bytes("десь там волоська голова\n".encode("utf-16"))
    (tmp_path / "x-good" / "done.txt").write_text("готово", encoding="utf-8")
    (tmp_path / "zip.txt").write_bytes(b"PK\x03\x04" + b"x" * 200)
    (tmp_path / "r.txt").write_bytes(b"{\\rtf1" + b"x" * 200)
    (tmp_path / "skip.bin").write_bytes(b"x")
    return tmp_path


def test_reading(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_texts(spark, str(folder)).filter("not path like '%zip%'").collect()}
    assert got["one.txt"] == "перший\nтекст" and got["TWO.TXT"] == "другий" and "skip.bin" not in got
    (folder / "list").write_text(f"{folder}/one.txt\n\n", encoding="utf-8")
    assert [r.text for r in files.read_listed(spark, str(folder / "list")).collect()] == ["перший\nтекст"]


def test_decoding(spark, folder):
    raw = files.read_binary(spark, str(folder))
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.encoding) for r in files.decoded(raw).collect()}
    assert got["cp.txt"] == ("десь там волоська голова\n", "cp1251") and got["u16.txt"][1] == "utf-16"
    assert got["zip.txt"] == (None, "zip") and got["r.txt"] == (None, "rtf") and "done.txt" not in got
    kept = files.without_excluded(raw, spark.createDataFrame([("one.txt",)], "name string"))
    assert kept.filter("path like '%one.txt'").count() == 0
    assert files.decode(None) == (None, "utf-8") and files.decode(b"") == ("", "utf-8")
    assert files.is_utf8_start("і".encode()) and not files.is_utf8_start("і".encode()[:1]) and not files.is_utf8_start(b"\xff\xfe")


def test_line_repair(one):
    bad = "голова нашого".encode("cp1251").decode("cp1252")
    text = f"добрий рядок\n{bad}\n{'нéîãî'[1:]}"
    got = one(files.repair_lines, t=text)
    assert got.startswith("добрий рядок\nголова нашого\n")
    assert one(files.repair_lines, t="звичайний") == "звичайний" and one(files.repair_lines, t="�") is None and one(files.repair_lines, t=None) is None


def test_columns_route(spark):
    df = spark.createDataFrame([(1, "сло-    во"), (2, "слово"), (3, None)], "k long, text string")
    a, b = files.route_columns(df)
    assert {r.k for r in a.collect()} == {2, 3} and {r.k for r in b.collect()} == {1}


def test_lexicon_files(spark, tmp_path):
    p = tmp_path / "stats.txt"
    p.write_text("# version: 1\nслово слово noun 0.5\n\t-1\t__BEG\t^\tBEG\t2\nділо діло noun 0.25\n\t1\tі\tі\tconj\t3\n", encoding="utf-8")
    words, ctx = lexicons.word_statistics(spark, str(p), "1")
    assert {r.word: r.rate for r in words.collect()} == {"слово": 0.5, "діло": 0.25}
    assert {(r.word, r.offset, r.ctx_word, r.ctx_lemma, r.cnt) for r in ctx.collect()} == {("слово", -1, "__BEG", "", 2.0), ("діло", 1, "і", "і", 3.0)}
    with pytest.raises(ValueError):
        lexicons.word_statistics(spark, str(p), "2")
    p.write_text("﻿голова,1:conc # x\n# лише коментар\nголова,1:conc\nслово,2:abst,:xp1\n", encoding="utf-8")
    assert {(r.lemma, r.semtag, r.cond) for r in lexicons.semantic_tags(spark, str(p), "noun").collect()} == {("голова", "1:conc", ""), ("слово", "2:abst", ":xp1")}
    p.write_text("сло́во noun:n\n слова́ noun:p\nділо́ noun:n\n /1/\n", encoding="utf-8")
    got = {(r.lemma, r.form, r.base, r.offset) for r in lexicons.stress_table(spark, str(p)).collect()}
    assert ("слово", "слова́", 0, 0) in got and ("діло", "діло́", 1, 1) in got
    p.write_text("UD,TAG,x\nUpos=NOUN,noun,\nNone,,\n", encoding="utf-8")
    assert [tuple(r) for r in lexicons.ud_map(spark, str(p)).collect()] == [("noun", "Upos=NOUN")]
    p.write_text("ував увати/3 verb 5\n", encoding="utf-8")
    assert lexicons.suffix_statistics(spark, str(p)).first().cnt == 5
    p.write_text("читаючи читати\n", encoding="utf-8")
    assert lexicons.derivations(spark, str(p)).first().verb_lemma == "читати"


def test_ordered_writes(spark, tmp_path):
    df = spark.createDataFrame([(k, f"r{k:02d}") for k in range(20)], "k long, body string")
    sinks.write_ordered(df, str(tmp_path / "o"), ["k"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text.split() == [f"r{k:02d}" for k in range(20)]
    sinks.write_report(df, str(tmp_path / "r"), [F.desc("k")])
    assert "r19" in next(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")) if p.stat().st_size)


def test_json_documents_are_valid(spark):
    s = spark.createDataFrame([(1, 0, 0, [("а", True, [("а", "conj")])]), (1, 0, 1, [("б", True, [("б", "x")])])], "doc_id long, para_id int, sent_id int, tokens array<struct<value:string,whitespace_before:boolean,readings:array<struct<lemma:string,tags:string>>>>")
    assert len(json.loads(sinks.documents(s, "json").first().body)["sentences"]) == 2


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("слово й слово", "2024-01-01 00:00:00", "a"), (None, "2024-01-02 00:00:00", "b")], "text string, at string, source string").withColumn("loaded_at", F.to_timestamp("at")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    x = streams.documents_stream(spark, str(tmp_path / "in"), df.schema)
    counts = streams.run_once(streams.word_counts(x), "complete", str(tmp_path / "c1"))
    assert {r.word: r.n for r in counts.collect()} == {"слово": 2, "й": 1}
    cleaned = streams.run_once(streams.clean_stream(x), "append", str(tmp_path / "c2"))
    assert cleaned.count() == 2
    got = streams.run_once(streams.arrivals(x), "update", str(tmp_path / "c3")).collect()
    assert {(r.source, r.n_docs) for r in got} == {("a", 1), ("b", 1)}


def test_runtime(spark):
    df = spark.range(10)
    assert cut(df).count() == 10 and spread(df.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
