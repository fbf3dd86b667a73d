"""Text from files: whole-text reads, folder traversal, sniffing and decoding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.classify import multi_column
from textloom.runtime import spread

# Fragments that show Ukrainian text, marks of text decoded wrongly.
UKRAINIAN = r"(?iu)[сц]ьк|ння|від|[іи]й|ої|ти| [ійвузао] | н[еі] | що "
GARBLED, LOST = "éîãî", "\u008dÃ"
#: Bytes at the start of a file by which its encoding is judged.
SNIFFED = 300
TRIED = ("cp1251", "utf-16")


def read_texts(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """``(path, text)`` of the .txt files (any letter case) in the paths."""
    r = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[tT][xX][tT]")
    return r.load(paths if isinstance(paths, list) else [paths]).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_listed(spark: SparkSession, list_file: str) -> DataFrame:
    """``(path, text)`` of the files that a list file names, one to a line. The list is of
    files given by hand; its lines come to the driver."""
    names = [r.value.strip() for r in spark.read.text(list_file).collect() if r.value.strip()]
    return spark.read.format("text").option("wholetext", True).load(names).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, recursive: bool = True, keep_cleaned: bool = False) -> DataFrame:
    """``(path, content, length)`` of .txt and .csv files; folders named good or *-good,
    which hold results, are left out."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{txt,csv,TXT,CSV}").load(path)
    if not keep_cleaned:
        r = r.filter(~F.col("path").rlike(r"/(?:[^/]*-)?good/"))
    return r.select("path", "content", "length")


def without_excluded(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """Files whose name is not listed (anti join on the last part of the path)."""
    x = excluded.select(F.col("name").alias("__n")).distinct()
    return files.withColumn("__n", F.substring_index("path", "/", -1)).join(x, "__n", "left_anti").drop("__n")


def is_utf8_start(head: bytes) -> bool:
    """Whether the first bytes form characters of up to six bytes; one that the end of the
    file cuts off does not count."""
    i = 0
    while i < len(head) and i < SNIFFED:
        b = head[i]
        n = next((k for k, (mask, lead) in enumerate(((0x80, 0), (0xE0, 0xC0), (0xF0, 0xE0), (0xF8, 0xF0), (0xFC, 0xF8), (0xFE, 0xFC)), 1) if b & mask == lead), 0)
        if not n or any(i + k >= len(head) or head[i + k] & 0xC0 != 0x80 for k in range(1, n)):
            return False
        i += n
    return True


def decode(content: bytes | None) -> tuple[str | None, str]:
    """Text of a file, and how it was got: utf-8, an encoding, repaired, or why not: zip,
    rtf, lost, replacement, short. Null and empty content is empty utf-8."""
    if not content:
        return ("" if content is not None else None), "utf-8"
    if len(content) > 100 and content[:4] == b"PK\x03\x04":
        return None, "zip"
    if len(content) > 100 and content.startswith(b"{\\rtf"):
        return None, "rtf"
    text = content.decode("utf-8", "replace")
    if len(content) <= 10 or is_utf8_start(content):
        return text, "utf-8"
    if LOST in text:
        return None, "lost"
    import re

    how = "utf-8"
    for name in TRIED:
        try:
            tried = content.decode(name)
        except UnicodeDecodeError:
            tried = content.decode(name, "replace")
        if re.search(UKRAINIAN, tried):
            text, how = tried, name
    if len(text) < 10:
        return None, "short"
    return (None, "replacement") if "�" in text else (text, how)


def decoded(files: DataFrame) -> DataFrame:
    """``(path, text, encoding)`` of binary files; rejected files have null text."""

    def run(batches):
        for b in batches:
            got = [decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["path", "text", "encoding"])

    return spread(files.select("path", "content")).mapInArrow(run, "path string, text string, encoding string")


def repair_lines(text: Column) -> Column:
    """Text with cp1251 read as cp1252: lines without a Cyrillic letter are read again.
    Other texts stay; null if marks of the error remain or bytes are lost. Native: a
    translation of the upper half of one code to the other."""
    odd = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0x100))
    right = "".join(bytes([b]).decode("cp1251", "replace") for b in range(0x80, 0x100))
    pairs = [(a, b) for a, b in zip(odd, right) if a != "�" and b != "�"]
    fix = lambda line: F.translate(line, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(r"\S") & ~x.rlike("[а-яіїєґА-ЯІЇЄҐ]"), fix(x)).otherwise(x))
    fixed = F.when(text.contains(GARBLED), F.array_join(lines, "\n")).otherwise(text)
    return F.when(~fixed.contains(GARBLED) & ~fixed.contains(LOST) & ~fixed.contains("�"), fixed)


def route_columns(texts: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts in one column, and those that seem to be in several."""
    many = F.coalesce(multi_column(F.col(text_col)), F.lit(False))
    return texts.filter(~many), texts.filter(many)
