"""Problem 8: encoding of the corpus with a public byte-level BPE tokenizer.

``encode`` runs the tokenizers library over Arrow batches. The vocabulary writes
each byte as one printable character; ``byte_alphabet`` derives that table by
rule, ``decode`` reverses it and re-joins characters whose bytes were split over
tokens, and ``token_spans`` maps byte offsets to character offsets.

Defined cases: null and empty texts have an empty list; text that looks like a
special token is plain text; other columns of the input are not touched.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import spread

#: Folder of the public tokenizer files; a parameter, never copied here.
TOKENIZER_DIR = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
#: Texts handed to the library at a time; bounds the memory of the encodings.
SLICE = 256
_loaded: dict = {}


def shipped(df: DataFrame, path: str | None) -> str:
    """The path of the tokenizer file, which is sent to all executors."""
    path = path or f"{TOKENIZER_DIR}/{BYTE_BPE}"
    df.sparkSession.sparkContext.addFile(path)
    return path


def _here(path: str) -> str:
    """The file itself, or the copy that was sent to this executor."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


def tokenizer(path: str):
    """The tokenizer of that file, loaded once per Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(_here(path))
        t.encode_special_tokens = True
        t.no_padding()
        t.no_truncation()
        _loaded[path] = t
    return _loaded[path]


def _encodings(texts: list, path: str) -> Iterator:
    t = tokenizer(path)
    fast = getattr(t, "encode_batch_fast", t.encode_batch)
    for i in range(0, len(texts), SLICE):
        yield from fast([x or "" for x in texts[i : i + SLICE]], add_special_tokens=False)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, ids array<int>)``, one row for each input row."""
    path = shipped(df, path)

    def run(batches):
        for b in batches:
            lists = [e.ids for e in _encodings(b.column(1).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["id", "ids"])

    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = df.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def sizes(df: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """Columns ``keep`` with ``n_tokens bigint``; 0 for null and empty texts."""
    path = shipped(df, path)

    def run(batches):
        for b in batches:
            n = np.fromiter((len(e.ids) for e in _encodings(b.column(b.num_columns - 1).to_pylist(), path)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], names=[*b.schema.names[:-1], "n_tokens"])

    src = spread(df.select(*keep, F.col(text_col).alias("__text")))
    return src.mapInArrow(run, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint")


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 stands for itself, the other
    bytes take the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def token_bytes(path: str | None = None) -> list[bytes]:
    """The bytes of every token, by id (tokens outside the byte alphabet: UTF-8)."""
    path = path or f"{TOKENIZER_DIR}/{BYTE_BPE}"
    if ("bytes", path) not in _loaded:
        back = {c: b for b, c in byte_alphabet().items()}
        with open(_here(path), encoding="utf-8") as f:
            spec = json.load(f)
        vocab = dict(spec["model"]["vocab"]) | {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        out = [b""] * (max(vocab.values()) + 1)
        special = {x["content"] for x in spec.get("added_tokens", [])}
        for s, i in vocab.items():
            out[i] = s.encode() if s in special else bytes(back[c] for c in s)
        _loaded["bytes", path] = out
    return _loaded["bytes", path]


def decode(ids: list[int], path: str | None = None) -> str:
    """Text of the ids; a character whose bytes are split over tokens is re-joined,
    bytes that make no character become U+FFFD."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def token_spans(text: str, ids: list[int], path: str | None = None) -> list[tuple[int, int]]:
    """Character span of each token in ``text``; a token that holds only part of a
    character's bytes spans the whole character."""
    table = token_bytes(path)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    char_at = np.concatenate([np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]]).astype(int)
    ends = np.cumsum([len(table[i]) for i in ids]).astype(int)
    starts = np.concatenate([[0], ends[:-1]]).astype(int) if len(ends) else ends
    return [(int(char_at[a]), int(char_at[b - 1]) + 1 if b > a else int(char_at[a])) for a, b in zip(starts, ends)]


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, starts array<int>, ends array<int>)``: the characters of each token, one row for each
    input row; a token of part of a character has the whole character."""
    path = shipped(df, path)

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            found = [token_spans(t, e.ids, path) for t, e in zip(texts, _encodings(texts, path))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([[x[k] for x in f] for f in found], pa.list_(pa.int32())) for k in (0, 1))], names=["id", "starts", "ends"])

    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = df.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, starts array<int>, ends array<int>").withColumnRenamed("id", id_col)


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(id, text)`` of encoded documents; null ids give null."""
    path = shipped(df, path)

    def run(batches):
        for b in batches:
            texts = [None if x is None else decode(x, path) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
